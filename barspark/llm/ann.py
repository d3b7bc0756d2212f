"""Nearest neighbours by multiprobe p-stable hashing.

Each hash table cuts Gaussian projections of a vector into cells.  A query
visits its own bucket and those next to it in the order of their estimated
success: the squared distances, along the projections, from the query to the
cells it would have to cross into.

How many tables, projections and probes there are, and how wide the cells,
follows from the number of vectors (:func:`plan`).  Whether a vector at a given
distance falls into a visited bucket depends on that distance alone, so recall
and the share of vectors met are known before the index is built, from distances
within a bounded sample.  More vectors have nearer neighbours, which finer cells
still catch: the share met falls as the table grows.

Vectors are packed into blocks by the first few projections of their bucket; a
query is sent once to each such block, with the list of its buckets there, and
exact distances are taken to the members of these buckets only.  Queries that
meet too few vectors that way are compared with every vector of their dimension,
block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import Workspace
from barspark.llm.textnum import U64, mix64

#: Of a query's steps into next cells, the nearest this many are combined into probes.
STEPS = 12


@dataclass(frozen=True)
class ProbeConfig:
    """``recall`` is the share of the ``k`` nearest that the plan aims at.

    The plan is fitted on the ``sample`` vectors with the smallest hashed ids.
    A block holds about ``block`` vectors or ``query_block`` query vectors, and
    vectors are packed by so many projections that a pack has about ``bucket``.
    """

    recall: float = 0.975
    sample: int = 2000
    block: int = 2048
    bucket: int = 8192
    query_block: int = 256
    seed: int = 7


@dataclass(frozen=True)
class ProbePlan:
    """Tables of ``functions`` projections cut at ``width``; ``packing`` of them name a pack.

    ``share`` is the expected number of distances taken for a query, by that of all vectors.
    """

    tables: int = 1
    functions: int = 4
    probes: int = 81
    packing: int = 1
    width: float = 1.0
    share: float = 1.0


_KINDS = {n: np.array([s for s in product((0, 1), repeat=n)], np.int8) for n in (2, 4, 6, 8, 10, STEPS)}


def probe_steps(inside: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps to take from places (n, functions) inside a cell, best estimate first, and their costs.

    Each of the nearest ``STEPS`` sides of a cell may be crossed or not; crossing
    both sides of one projection is no bucket and costs infinity.
    """
    n, functions = inside.shape
    sides = np.concatenate([inside**2, (1 - inside) ** 2], 1)
    count = min(STEPS, 2 * functions)
    near = np.argsort(sides, axis=1, kind="stable")[:, :count]
    kinds = _KINDS[count]
    cost = np.take_along_axis(sides, near, 1) @ kinds.T.astype(float)
    both = np.zeros((n, len(kinds)), bool)
    for i in range(count):
        for j in range(i + 1, count):
            clash = near[:, i] % functions == near[:, j] % functions
            if clash.any():
                both[clash] |= (kinds[:, i] & kinds[:, j]).astype(bool)
    cost[both] = np.inf
    chosen = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    steps = np.zeros((n, chosen.shape[1], functions), np.int64)
    row, probe = np.arange(n)[:, None], np.arange(chosen.shape[1])[None]
    for i in range(count):
        taken = kinds[chosen, i].astype(np.int64)
        sign = np.where(near[:, i] < functions, -1, 1)[:, None]
        steps[row, probe, (near[:, i] % functions)[:, None]] += taken * sign
    return steps, np.take_along_axis(cost, chosen, 1)


class HitChance:
    """Chance that a vector some cell widths away is met, by number of probes, over random places of a query in its cell."""

    def __init__(self, functions: int, draws: int = 300, seed: int = 5):
        rng = np.random.default_rng([seed, functions])
        self.inside = rng.uniform(size=(draws, functions))
        self.moves = rng.normal(size=(draws, functions))
        steps, cost = probe_steps(self.inside, 1 << STEPS)
        self.power = 3 ** np.arange(functions)
        self.base = (np.arange(draws) * 3**functions)[:, None]
        names = np.where(np.isfinite(cost), (steps + 1) @ self.power + self.base, -1)
        self.probes = names.shape[1]
        order = np.argsort(names, axis=None)
        self.names, self.rank = names.ravel()[order], order % self.probes

    def __call__(self, reach: np.ndarray) -> np.ndarray:
        delta = np.floor(self.inside + self.moves * np.reshape(reach, (-1, 1, 1))).astype(np.int64)
        name = np.where((np.abs(delta) <= 1).all(-1), (delta + 1) @ self.power + self.base[:, 0], -2)
        slot = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        hit = self.names[slot] == name
        met = np.zeros((len(name), self.probes))
        np.add.at(met, (np.nonzero(hit)[0], self.rank[slot[hit]]), 1 / name.shape[1])
        return np.cumsum(met, 1)


def plan(vectors: np.ndarray, total: int, k: int, config: ProbeConfig) -> ProbePlan:
    """The cheapest tables, projections, probes and width that should reach ``recall`` among ``total`` vectors like these.

    The distances to a query's k nearest of all are read from the sample at the
    ranks that correspond to theirs; below the first rank they are carried on by
    the sample's intrinsic dimension (the maximum likelihood estimate).
    """
    if len(vectors) < 3:
        return ProbePlan()
    asked = vectors[:200]
    apart = np.sqrt(np.maximum(0, (asked**2).sum(1)[:, None] + (vectors**2).sum(1)[None] - 2 * asked @ vectors.T))
    np.fill_diagonal(apart, np.inf)
    apart = np.sort(apart, 1)[:, :-1]
    rank = k * (len(vectors) - 1) / max(total - 1, 1)
    few = apart[:, : min(20, apart.shape[1])]
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(few[:, -1:] / few[:, :-1])
    logs = logs[np.isfinite(logs) & (logs > 0)]
    intrinsic = float(np.clip(1.5 / logs.mean(), 1, vectors.shape[1])) if len(logs) else 1.0  # half as much again: nearer points are met more rarely than far ones tell
    ranks = rank * np.arange(1, k + 1) / k
    slots = np.clip(np.ceil(ranks).astype(int), 1, apart.shape[1]) - 1
    near = apart[:, slots] * np.minimum(ranks, 1) ** (1 / intrinsic)
    usual = float(np.sqrt(np.mean(np.square(apart))))
    if not usual:
        return ProbePlan(width=1.0)
    near = np.quantile(near, (np.arange(10) + 0.5) / 10)
    every = np.quantile(apart, (np.arange(20) + 0.5) / 20)
    best: tuple[float, ProbePlan] | None = None
    probes = np.unique(np.round(np.geomspace(1, 1 << STEPS, 25)).astype(int))
    for functions in (4, 6, 8, 10, 16):
        chances = HitChance(functions)
        for wide in (0.5, 0.7, 0.85, 1.0, 1.25, 1.5, 2.0):
            width = wide * usual
            chance = chances(np.concatenate([near, every]) / width)
            for t in probes[probes <= chance.shape[1]]:
                hit, met = chance[: len(near), t - 1], chance[len(near) :, t - 1]
                for tables in (1, 2, 3, 4, 6):  # each is a copy of all vectors
                    if np.mean(1 - (1 - hit) ** tables) < config.recall:
                        continue
                    share = tables * float(np.mean(met))
                    cost = share * total + tables * (4 * int(t) + 50)  # distances, then probes and the index, in distances
                    if best is None or cost < best[0]:
                        best = cost, ProbePlan(tables, functions, int(t), 1, width, share)
                    break
    if best is None:
        return ProbePlan(6, 4, 81, 1, 2 * usual, 6.0)
    chosen = best[1]
    same = np.mean([np.mean(np.maximum(0, 1 - np.abs(np.random.default_rng(1).normal(size=2000) * d / chosen.width))) for d in every])
    packing = math.ceil(math.log(max(total / config.bucket, 1)) / max(-math.log(same), 1e-9)) if 0 < same < 1 else 1
    return ProbePlan(chosen.tables, chosen.functions, chosen.probes, min(max(packing, 1), chosen.functions), chosen.width, chosen.share)


@dataclass(frozen=True)
class Projections:
    """The hash functions of all tables for one dimension."""

    plan: ProbePlan
    dimension: int
    seed: int
    directions: np.ndarray = field(init=False)  # dimension x (tables * functions)
    offsets: np.ndarray = field(init=False)

    def __post_init__(self):
        rng = np.random.default_rng([self.seed, self.dimension])
        n = self.plan.tables * self.plan.functions
        object.__setattr__(self, "directions", rng.normal(size=(self.dimension, n)))
        object.__setattr__(self, "offsets", rng.uniform(size=n))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """Position of each vector on each projection, in cells: (n, tables, functions)."""
        places = (vectors @ self.directions) / self.plan.width + self.offsets
        return places.reshape(len(vectors), self.plan.tables, self.plan.functions)


def cell_hash(cells: np.ndarray, table: int, dimension: int) -> np.ndarray:
    """64-bit name of each row of cells."""
    with np.errstate(over="ignore"):
        key = np.full(cells.shape[:-1], (dimension << 16) + table + 1, U64)
        for i in range(cells.shape[-1]):
            key = mix64(key ^ mix64(cells[..., i].astype(np.int64).view(U64) + U64(i + 1)))
    return key.view(np.int64)


_MEMBER = "pack long, bucket long, id long, vector array<{}>"
_PROBE = "pack long, buckets array<long>, id long, vector array<{}>"
#: Packs whose sizes may be broadcast, at 16 bytes each.
MOST_PACKS = 1 << 20


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _hashed(plan: ProbePlan, config: ProbeConfig, probing: bool):
    """A row of every vector for each table; ``probing``: for each pack to visit, with the buckets to visit in it."""
    known: dict[int, Projections] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dimension in map(int, np.unique(sizes)):
                own = batch.filter(pa.array(sizes == dimension))
                vectors = _matrix(own.column("vector"), len(own))
                if dimension not in known:
                    known[dimension] = Projections(plan, dimension, config.seed)
                places = known[dimension](vectors)
                for table in range(plan.tables):
                    home = np.floor(places[:, table])
                    if not probing:
                        cells = home.astype(np.int64)
                        names = [pa.array(cell_hash(c, table, dimension)) for c in (cells[:, : plan.packing], cells)]
                        yield pa.RecordBatch.from_arrays([*names, own.column("id"), own.column("vector")], ["pack", "bucket", "id", "vector"])
                        continue
                    for at in range(0, len(vectors), 64):
                        steps, cost = probe_steps(places[at : at + 64, table] - home[at : at + 64], plan.probes)
                        cells = home[at : at + 64, None, :].astype(np.int64) + steps
                        packs, buckets = cell_hash(cells[..., : plan.packing], table, dimension), cell_hash(cells, table, dimension)
                        rows, lists, names = [], [], []
                        for row in range(len(cells)):
                            real = np.isfinite(cost[row])
                            order = np.argsort(packs[row][real], kind="stable")
                            pack, bucket = packs[row][real][order], buckets[row][real][order]
                            edge = np.flatnonzero(np.concatenate([[True], pack[1:] != pack[:-1]]))
                            names.append(pack[edge])
                            lists += np.split(bucket, edge[1:])
                            rows.append(np.full(len(edge), at + row))
                        take = own.take(pa.array(np.concatenate(rows)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate(names)), pa.array(lists, pa.list_(pa.int64())), take.column("id"), take.column("vector")], ["pack", "buckets", "id", "vector"]
                        )

    return run


def _best(vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    apart = vectors - own
    score = np.sqrt(np.einsum("ij,ij->i", apart, apart))
    near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1]) if len(score) > k else np.arange(len(score))
    near = near[np.lexsort((ids[near], score[near]))[:k]]
    return ids[near], score[near]


def _nearest(k: int):
    """Best ``k`` of a block for each query of a query block, ties to the smaller id.

    Where the block's members have buckets, only those in a query's buckets are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, asked = batch.column("members")[i].values, batch.column("asked")[i].values
                ids, queries = base.field("id").to_numpy(zero_copy_only=False), asked.field("id").to_numpy(zero_copy_only=False)
                vectors, wanted = _matrix(base.field("vector"), len(ids)), _matrix(asked.field("vector"), len(queries))
                names = {f.name for f in base.type}
                if "bucket" in names:
                    bucket = base.field("bucket").to_numpy(zero_copy_only=False)
                    order = np.argsort(bucket, kind="stable")
                    ids, vectors = ids[order], vectors[order]
                    first = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
                    held, end = bucket[order][first], np.append(first[1:], len(ids))
                    lists = asked.field("buckets")
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for n, (query, own) in enumerate(zip(queries, wanted)):
                    if "bucket" in names:
                        slots = np.flatnonzero(np.isin(held, lists[n].values.to_numpy(zero_copy_only=False)))
                        if not len(slots):
                            continue
                        rows = np.concatenate([np.arange(first[s], end[s]) for s in slots])
                        best, score = _best(vectors[rows], ids[rows], own, k)
                    else:
                        best, score = _best(vectors, ids, own, k)
                    found.append((np.full(len(best), query), best, score))
                columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "vec_id", "score"])

    return run


def _usable(vector: str):
    """Not null, without null or non-finite components, not all zero."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return value.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(value, lambda x: x != 0)


def _compared(few: DataFrame, members: DataFrame, k: int, config: ProbeConfig) -> DataFrame:
    """The k + 1 nearest of every block of ``members`` for each row of ``few``, within the dimension.

    Blocks of vectors are dealt to slices of their dimension and each block of
    queries goes to every slice, so that a dimension is no single task's.
    """
    parts = int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = F.collect_list(F.struct("id", "vector"))
    few, members = few.withColumn("dimension", F.size("vector")), members.withColumn("dimension", F.size("vector"))
    sizes = members.groupBy("dimension").agg(F.ceil(F.count("*") / config.block).alias("blocks"))
    sizes = sizes.withColumn("slices", F.least("blocks", F.lit(parts)))  # a row for each dimension
    base = members.join(F.broadcast(sizes), "dimension").groupBy("dimension", "slices", F.pmod(F.xxhash64("id"), "blocks").alias("block")).agg(packed.alias("members"))
    base = base.withColumn("slice", F.pmod("block", "slices"))
    groups = few.groupBy("dimension").agg(F.ceil(F.count("*") / config.query_block).alias("groups"))
    asked = few.join(F.broadcast(groups), "dimension").groupBy("dimension", F.pmod(F.xxhash64("id"), "groups").alias("group")).agg(packed.alias("asked"))
    asked = asked.join(F.broadcast(sizes), "dimension").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    pairs = base.select("dimension", "slice", "members").join(asked.select("dimension", "slice", "asked"), ["dimension", "slice"])
    return pairs.select("members", "asked").mapInArrow(_nearest(k + 1), "query long, vec_id long, score double")


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, config: ProbeConfig = ProbeConfig(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found rows of ``embeddings`` for each row of ``queries``; all of them where there are fewer.

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance in double
    precision), nearest first, ties to the smaller vec_id; a query's own id is
    no candidate of its own.

    Equal vectors form one class: at most the k + 1 smallest ids of a class can
    be among anyone's k nearest besides itself, so a class of any size puts k + 1
    rows into the index, and equal query vectors are searched once.  Rows with a
    null id, and vectors that are null, zero or hold null or non-finite
    components, take no part; vectors are compared within their dimension.
    A repeated id counts once, with the smallest of its vectors.
    """
    spark = embeddings.sparkSession
    work = Workspace(spark, "ann")
    # components of four bytes stay as they are, which halves the index; distances are taken in double precision
    element = "float" if all(f.schema[vector].dataType.simpleString() == "array<float>" for f in (embeddings, queries)) else "double"
    names = {"id": F.col(key).cast("long"), "vector": F.col(vector).cast(f"array<{element}>")}
    pick = [column.alias(name) for name, column in names.items()]
    once = lambda frame: frame.select(*pick).where(F.col("id").isNotNull() & _usable("vector")).groupBy("id").agg(F.min("vector").alias("vector"))
    base, asked = once(embeddings), once(queries)
    digest = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]  # 128 bits name a vector

    within = Window.partitionBy("h1", "h2").orderBy("id")
    members = base.select("id", "vector", *digest).withColumn("at", F.row_number().over(within)).where(F.col("at") <= k + 1)
    members = work.table("members", members.select("id", "vector"))
    askers = work.table("askers", asked.select(F.col("id").alias("query_id"), *digest))
    searched = asked.select("id", "vector", *digest).groupBy("h1", "h2").agg(F.min_by("vector", "id").alias("vector"))
    searched = work.table("searched", searched.withColumn("id", F.xxhash64("h1", "h2")))

    total = members.count()
    sample = [np.array(r.vector) for r in members.orderBy(F.xxhash64("id"), "id").limit(config.sample).select("vector").collect()]
    usual = max({len(v) for v in sample}, key=lambda n: sum(len(v) == n for v in sample), default=0)
    fitted = plan(np.stack([v for v in sample if len(v) == usual]), total, k, config) if sample else ProbePlan()

    cells = work.table("cells", members.mapInArrow(_hashed(fitted, config, False), _MEMBER.format(element)))
    probes = searched.select("id", "vector").mapInArrow(_hashed(fitted, config, True), _PROBE.format(element))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = cells.groupBy("pack").agg(F.ceil(F.count("*") / config.block).alias("blocks"))
    sizes = work.table("sizes", sizes.withColumn("slices", F.least("blocks", F.lit(parts))))
    few_packs = sizes.count() <= MOST_PACKS
    sized = lambda frame, table: frame.join(F.broadcast(table) if few_packs else table, "pack")
    # dealt by pack and block, so that a large pack's blocks are gathered and compared side by side
    blocks = sized(cells, sizes).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).repartition(parts, "pack", "block")
    blocks = blocks.groupBy("pack", "slices", "block").agg(F.collect_list(F.struct("bucket", "id", "vector")).alias("members"))
    blocks = blocks.select("pack", F.pmod("block", "slices").alias("slice"), "members")
    probes = work.table("probes", sized(probes, sizes.select("pack", "slices")))
    groups = probes.groupBy("pack").agg(F.ceil(F.count("*") / config.query_block).alias("groups"))
    asking = sized(probes, groups).withColumn("group", F.pmod(F.xxhash64("id"), "groups")).repartition(parts, "pack", "group")
    asking = asking.groupBy("pack", "slices", "group").agg(F.collect_list(F.struct("buckets", "id", "vector")).alias("asked"))
    asking = asking.select("pack", "asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    found = blocks.join(asking, ["pack", "slice"]).select("members", "asked").mapInArrow(_nearest(k + 1), "query long, vec_id long, score double")

    best = Window.partitionBy("query").orderBy("score", "vec_id")
    found = work.table("found", found.distinct())
    enough = found.groupBy("query").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") > k).select(F.col("query").alias("id"))
    few = work.table("few", searched.select("id", "vector").join(enough, "id", "left_anti"))
    if not few.isEmpty():
        found = found.unionByName(_compared(few, members, k, config)).distinct()
    merged = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    merged = merged.join(searched.select(F.col("id").alias("query"), "h1", "h2"), "query").select("h1", "h2", "vec_id", "score")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = askers.join(merged, ["h1", "h2"]).where("vec_id <> query_id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
