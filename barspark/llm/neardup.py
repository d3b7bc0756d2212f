"""Near-duplicate documents by min-max hashing.

One hash evaluation per shingle and permutation gives two signature values, the
minimum and the maximum, so ``bands * rows`` values cost half as many
evaluations.  Minima and maxima fall into different bands: no band holds two
values of one permutation.  Candidates are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import Workspace, raw, texts
from barspark.llm.components import connected_components
from barspark.llm.textnum import U64, mix64, shingle_set

#: 64-bit lanes of the parity sketch that rules out pairs of a shared bucket.
LANES = 32


@dataclass(frozen=True)
class MinMaxConfig:
    """``shingle`` words make a shingle; documents of at least ``percent`` similarity are linked.

    A pair of similarity s shares none of the bands with probability
    (1 - s**rows)**bands: 5e-8 at 0.8 for the default.  Buckets of several components
    that would need more than ``crowd`` comparisons of their minor documents with
    all others are searched by their rarest shingles instead of pair by pair.
    """

    shingle: int = 5
    percent: int = 80
    rows: int = 4
    bands: int = 32
    crowd: int = 1 << 26

    @property
    def permutations(self) -> int:
        return self.rows * self.bands // 2


def multipliers(n: int) -> np.ndarray:
    """Odd 64-bit multipliers; multiplying by one permutes the shingle values."""
    return mix64(np.arange(1, n + 1, dtype=U64)) | U64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a non-empty shingle set under each permutation."""
    low, high = np.full(len(factors), 2**64 - 1, U64), np.zeros(len(factors), U64)
    for at in range(0, len(shingles), 2048):  # bounds the intermediate matrix for long texts
        values = factors[:, None] * shingles[None, at : at + 2048]
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return low, high


def band_keys(shingles: np.ndarray, config: MinMaxConfig, factors: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; first the bands of minima, then those of maxima."""
    values = np.concatenate(signature(shingles, factors)).reshape(config.bands, config.rows)
    key = np.arange(1, config.bands + 1, dtype=U64)
    for row in range(config.rows):
        key = mix64(key ^ values[:, row])
    return key


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the shingles that fall on it.

    Two sketches differ in at most as many bits as the sets differ in elements,
    so a count above the tolerated difference excludes a pair for certain.
    """
    slots = (shingles * U64(0xD6E8FEB86659FD93)) >> U64(64 - (LANES * 64).bit_length() + 1)
    odd = (np.bincount(slots.astype(np.int64), minlength=LANES * 64) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _digests(config: MinMaxConfig):
    factors = multipliers(config.permutations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, first, second, keys = [], [], [], []
            for text in raw(batch):
                shingles = shingle_set(text, config.shingle)
                counts.append(len(shingles))
                if len(shingles):
                    total = mix64(shingles)
                    first.append(int(_signed(total.sum(dtype=U64)[None])[0]))
                    second.append(int(_signed(np.bitwise_xor.reduce(mix64(total))[None])[0]))
                    keys.append(_signed(band_keys(shingles, config, factors)))
                else:
                    first.append(None)
                    second.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "sum_a", "sum_b", "bands"],
            )

    return run


def _sets(config: MinMaxConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, config.shingle) for text in raw(batch)]
            sketches = np.array([parity_sketch(s) for s in sets], np.int64).reshape(-1, LANES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([_signed(s) for s in sets], pa.list_(pa.int64())), *(pa.array(sketches[:, i]) for i in range(LANES))],
                ["doc_id", "shingles", *(f"s{i}" for i in range(LANES))],
            )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, config: MinMaxConfig) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", "of_a", "of_b", shared.alias("shared"))
        .where(100 * F.col("shared").cast("long") >= config.percent * union.cast("long"))
        .select("a", "b")
    )


def _sizes_allow(a: str, b: str, config: MinMaxConfig):
    return 100 * F.least(a, b) >= config.percent * F.greatest(a, b)


def _differing(config: MinMaxConfig):
    """Whether the sketches of a row and of its ``o_`` side leave the pair possible."""
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"o_s{i}"))) for i in range(LANES)])
    # |a ^ b| * (100 + percent) <= (|a| + |b|) * (100 - percent)
    return bits * (100 + config.percent) <= (F.col("n") + F.col("o_n")) * (100 - config.percent)


def _by_rarest(crowd: DataFrame, sets: DataFrame, config: MinMaxConfig, work: Workspace) -> DataFrame:
    """Possible pairs (a, b) of different components among ``crowd(id, n, own)``.

    With shingles ordered by how many of these documents have them, two similar
    sets share one of the first n - ceil(n * percent / 100) + 1 of each.  What
    many documents have in common comes last and joins none of them.
    """
    listed = crowd.join(sets.select(F.col("doc_id").alias("id"), F.explode("shingles").alias("shingle")), "id")
    often = listed.groupBy("shingle").agg(F.count("*").alias("often"))
    order = Window.partitionBy("id").orderBy("often", "shingle")
    most = F.col("n") - F.ceil(F.col("n") * config.percent / 100) + 1
    prefix = listed.join(often, "shingle").withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("id", "n", "own", "shingle")
    prefix = work.table("prefix", prefix)
    mixed = prefix.groupBy("shingle").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.min_by("own", "id").alias("major")).where("low <> high")
    prefix = prefix.join(mixed.select("shingle", "major"), "shingle")
    other = prefix.select("shingle", F.col("id").alias("o_id"), F.col("n").alias("o_n"), F.col("own").alias("o_own"))
    pairs = prefix.where("own <> major").join(other, "shingle").where((F.col("own") != F.col("o_own")) & _sizes_allow("n", "o_n", config))
    pairs = pairs.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"), F.when(F.col("id") < F.col("o_id"), F.col("n")).otherwise(F.col("o_n")).alias("n"), F.when(F.col("id") < F.col("o_id"), F.col("o_n")).otherwise(F.col("n")).alias("o_n")).distinct()
    lanes = [f"s{i}" for i in range(LANES)]
    left = sets.select(F.col("doc_id").alias("a"), *lanes)
    right = sets.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"o_{c}") for c in lanes))
    return pairs.join(left, "a").join(right, "b").where(_differing(config)).select("a", "b")


def near_duplicates(documents: DataFrame, config: MinMaxConfig = MinMaxConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate class of every document.

    Returns one row per input row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable over links), kept (doc_id = component_id).

    Documents of equal shingle sets collapse into one representative first, so
    copies never meet in pairs.  Each bucket's documents are compared with the
    bucket's smallest one; only documents that this leaves in another component
    are compared with the rest of their bucket, behind an exact sketch bound, or
    in crowded buckets by their rarest shingles, which lose no link either.
    Empty and null texts are linked with nothing.  A null doc_id gives a null
    component that is not kept.  Repeated rows share their class; where one id has
    different texts, each counts for its own copies and the smallest for near
    ones.  An empty table gives no rows.
    """
    work = Workspace(documents.sparkSession, "neardup")
    source = texts(documents, key, text)
    digests = work.table("digests", source.mapInArrow(_digests(config), "doc_id long, n_shingles long, sum_a long, sum_b long, bands array<long>"))
    same = ["n_shingles", "sum_a", "sum_b"]
    classes = (
        digests.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*same)
        .agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    )
    classes = work.table("classes", classes)

    buckets = classes.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    pivots = buckets.groupBy("bucket").agg(F.min("id").alias("pivot"), F.min_by("n", "id").alias("pivot_n"), F.count("*").alias("size")).where("size > 1")
    shared = work.table("buckets", buckets.join(pivots.select("bucket", "pivot", "pivot_n"), "bucket"))
    stars = shared.where("id <> pivot").where(_sizes_allow("n", "pivot_n", config)).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = work.table("stars", stars)
    taking_part = shared.select(F.col("id").alias("doc_id")).distinct()
    chosen = source.join(taking_part, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    lanes = ", ".join(f"s{i} long" for i in range(LANES))
    sets = work.table("sets", chosen.mapInArrow(_sets(config), f"doc_id long, shingles array<long>, {lanes}"))

    links = work.table("links", _confirmed(stars, sets, config))
    first = work.table("first", connected_components(links, work, "first"))

    # Buckets that still hold several components: their minor documents against all others there.
    placed = (
        shared.join(first.select("id", F.col("component").alias("own")), "id", "left")
        .select("bucket", "id", "n", F.coalesce("own", "id").alias("own"), "pivot")
    )
    mixed = placed.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.min_by("own", "id").alias("major")).where("low <> high")
    sketches = sets.drop("shingles").withColumnRenamed("doc_id", "id")
    placed = work.table("mixed", placed.join(mixed.select("bucket", "major"), "bucket"))
    load = placed.groupBy("bucket").agg((F.count_if(F.col("own") != F.col("major")) * F.count("*")).alias("load")).where(F.col("load") > config.crowd).select("bucket")
    crowd = work.table("crowd", placed.join(load, "bucket", "left_semi").select("id", "n", "own").distinct())
    placed = work.table("placed", placed.join(load, "bucket", "left_anti").join(sketches, "id"))
    other = placed.select(*(F.col(c).alias(f"o_{c}") for c in placed.columns))
    rest = (
        placed.where("own <> major")
        .join(other, (F.col("bucket") == F.col("o_bucket")) & (F.col("own") != F.col("o_own")) & _sizes_allow("n", "o_n", config) & _differing(config))
        .select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))
        .distinct()
    )
    if not crowd.isEmpty():
        rest = rest.unionByName(_by_rarest(crowd, sets, config, work)).distinct()
    rest = work.table("rest", rest)
    found = _confirmed(rest, sets, config)
    owner = first.select(F.col("id").alias("v"), "component")
    bridges = (
        found.join(owner.select(F.col("v").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(owner.select(F.col("v").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    second = work.table("second", connected_components(bridges, work, "second"))
    merged = (
        classes.select("rep", *same)
        .join(first.select(F.col("id").alias("rep"), F.col("component").alias("c1")), "rep", "left")
        .select("rep", *same, F.coalesce("c1", "rep").alias("c1"))
        .join(second.select(F.col("id").alias("c1"), F.col("component").alias("c2")), "c1", "left")
        .select(*(F.col(c).alias(f"k_{c}") for c in same), F.coalesce("c2", "c1").alias("component_id"))
    )
    work.drop("sets", "mixed", "crowd", "prefix", "placed", "buckets", "stars", "rest")
    match = [F.col(c) == F.col(f"k_{c}") for c in same]
    out = digests.select("doc_id", *same).join(merged, reduce(lambda x, y: x & y, match), "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, config: MinMaxConfig = MinMaxConfig()) -> DataFrame:
    """One document of each near-duplicate class stays, with all its columns.

    Rows that repeat a kept doc_id are one document and collapse to one row.
    Rows without a doc_id belong to no class and all stay.
    """
    verdicts = near_duplicates(documents, config).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = documents.join(verdicts, documents["doc_id"] == verdicts["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(documents.where(F.col("doc_id").isNull()))
