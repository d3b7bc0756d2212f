"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hash of every ``window`` adjacent
k-grams (the last one on ties).  Any shared run of ``k + window - 1`` words
therefore shares a fingerprint.  Fingerprints of documents and benchmark items
are matched, and each match is extended word by word to its maximal run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import Workspace, raw
from barspark.llm.textnum import ALNUM, U64, ngrams, words

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<string>"


@dataclass(frozen=True)
class WinnowConfig:
    """A run of ``span`` item words (a whole item, if shorter) contaminates.

    ``k`` is the gram size.  Benchmarks of at most ``index_bytes`` of text are
    indexed once and sent to the tasks; larger ones are joined by fingerprint,
    in blocks of about that size.
    """

    span: int = 10
    k: int = 6
    index_bytes: int = 32 << 20

    @property
    def window(self) -> int:
        return self.span - self.k + 1


def winnow(values: np.ndarray, config: WinnowConfig) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of a word sequence."""
    grams = ngrams(values, config.k)
    if len(grams) < config.window:
        return np.zeros(0, np.int64), grams[:0]
    best, at = grams[: len(grams) - config.window + 1].copy(), np.arange(len(grams) - config.window + 1)
    for i in range(1, config.window):
        ahead = grams[i : i + len(best)]
        better = ahead <= best  # the last of equal ones
        best[better] = ahead[better]
        at[better] = np.flatnonzero(better) + i
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    return at[keep], best[keep]


class ItemIndex:
    """Fingerprints of benchmark items, sorted for binary search."""

    def __init__(self, items: list[tuple[str, bytes | None]], config: WinnowConfig):
        self.config, self.ids = config, [i for i, _ in items]
        parts = [words(text, ALNUM) for _, text in items]
        self.values = np.concatenate([np.zeros(0, U64), *parts])
        self.ends = np.cumsum([len(p) for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
        starts = self.ends - np.array([len(p) for p in parts], np.int64)
        self.starts = starts
        prints, where, owner = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        short: dict[int, list[tuple[int, int]]] = {}
        for n, part in enumerate(parts):
            if len(part) >= config.span:
                at, hashes = winnow(part, config)
                prints.append(hashes)
                where.append(at + starts[n])
                owner.append(np.full(len(at), n))
            elif len(part):
                short.setdefault(len(part), []).append((int(ngrams(part, len(part))[0]), n))
        prints, where, owner = (np.concatenate(x) for x in (prints, where, owner))
        order = np.argsort(prints, kind="stable")
        self.prints, self.where, self.owner = prints[order], where[order], owner[order]
        self.short = {n: (np.sort(np.array([h for h, _ in found], U64)), found) for n, found in short.items()}

    def spans(self, values: np.ndarray) -> list[tuple[int, int, int]]:
        """Maximal shared runs as (item number, first word, end word) of a document."""
        found: list[tuple[int, int, int]] = []
        if len(self.prints):
            at, hashes = winnow(values, self.config)
            low = np.searchsorted(self.prints, hashes, "left")
            high = np.searchsorted(self.prints, hashes, "right")
            done: dict[int, int] = {}
            crowded = self._crowded(hashes, low, high)
            ranges = dict(zip(low[crowded].tolist(), high[crowded].tolist()))  # of each such fingerprint once
            found += self._windows(values, np.unique(np.concatenate([self.owner[a:b] for a, b in ranges.items()]))) if ranges else []
            for j in np.flatnonzero((high > low) & ~crowded):
                p = int(at[j])
                for i in range(low[j], high[j]):
                    q, n = int(self.where[i]), int(self.owner[i])
                    if done.get(p - q, -1) > p:  # inside a run of this diagonal; items have distinct diagonals
                        continue
                    first, end = self._extend(values, p, q, n)
                    done[p - q] = end
                    if end - first >= self.config.span:
                        found.append((n, first, end))
        for size, (hashes, owners) in self.short.items():
            grams = ngrams(values, size)
            if len(grams):
                slot = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
                for p in np.flatnonzero(hashes[slot] == grams):
                    found += [(n, int(p), int(p) + size) for h, n in owners if h == int(grams[p])]
        return found

    def _crowded(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Fingerprints that would meet far more often than they occur, as those of one word again and again do."""
        _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
        times, owners = count[which], high - low
        return times * owners > 16 * (times + owners)

    def _windows(self, values: np.ndarray, items: np.ndarray) -> list[tuple[int, int, int]]:
        """Shared runs with some items, from all their windows and not from fingerprints: linear in both texts, whatever repeats."""
        own = ngrams(values, self.config.span)
        found = []
        for n in items:
            wanted = np.unique(ngrams(self.values[self.starts[n] : self.ends[n]], self.config.span))
            place = np.minimum(np.searchsorted(wanted, own), max(0, len(wanted) - 1))
            hit = np.diff(np.concatenate([[False], wanted[place] == own, [False]]).astype(np.int8)) if len(wanted) else np.zeros(1)
            found += [(int(n), int(a), int(b) + self.config.span - 1) for a, b in zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1))]
        return found

    def _extend(self, values: np.ndarray, p: int, q: int, n: int) -> tuple[int, int]:
        ahead = min(len(values) - p, int(self.ends[n]) - q)
        differs = np.flatnonzero(values[p : p + ahead] != self.values[q : q + ahead])
        end = p + (int(differs[0]) if len(differs) else ahead)
        back = min(p, q - int(self.starts[n]))
        differs = np.flatnonzero(values[p - back : p] != self.values[q - back : q])
        return p - (back - 1 - int(differs[-1]) if len(differs) else back), end


def _covered(n_words: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Edges of the union of word spans."""
    change = np.zeros(n_words + 1, np.int64)
    for first, end in spans:
        change[first] += 1
        change[end] -= 1
    return (np.cumsum(change) > 0).astype(np.int8)


def _verdicts(rows: list[tuple[int, list[str], list[tuple[int, int]]]], doc_ids: pa.Array) -> pa.RecordBatch:
    n_words, n_hit, items, spans = [], [], [], []
    for count, names, runs in rows:
        n_words.append(count)
        if not runs:
            n_hit.append(0), items.append([]), spans.append([])
            continue
        inside = _covered(count, runs)
        edge = np.diff(np.concatenate([[0], inside, [0]]))
        n_hit.append(int(inside.sum()))
        items.append(sorted(set(names)))
        spans.append([f"{a}:{b}" for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.string()))],
        ["doc_id", "n_words", "n_hit", "items", "spans"],
    )


def _with_index(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            rows = []
            for text in raw(batch):
                values = words(text, ALNUM)
                found = own.spans(values)
                rows.append((len(values), [own.ids[n] for n, _, _ in found], [(a, b) for _, a, b in found]))
            yield _verdicts(rows, batch.column("doc_id"))

    return run


def _prints(config: WinnowConfig, sizes: list[int], whole: bool):
    """Distinct fingerprints of each text; ``whole``: of items, whose short ones are a single gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = [], []
            for key, text in zip(batch.column("key"), raw(batch)):
                values = words(text, ALNUM)
                if whole:
                    sizes_here = [len(values)] if 0 < len(values) < config.span else []
                else:
                    sizes_here = sizes
                found = np.unique(np.concatenate([winnow(values, config)[1], *(ngrams(values, n) for n in sizes_here)]))
                keys += [key.as_py()] * len(found)
                hashes.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("key").type), pa.array(np.concatenate([np.zeros(0, U64), *hashes]).view(np.int64))], ["key", "print"])

    return run


def _sizes(config: WinnowConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {n for n in (len(words(text, ALNUM)) for text in raw(batch)) if 0 < n < config.span}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["size"])

    return run


_HIT = "key string, item string, spans array<string>"


def _by_block(config: WinnowConfig):
    """Hits of the documents of a block of items.

    Rows come sorted, a block's items before its documents, so that one block's
    index is held at a time, whatever the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, items, index = None, [], None
        for batch in batches:
            keys, names, spans = [], [], []
            for own, name, key, text in zip(batch.column("block").to_pylist(), batch.column("item").to_pylist(), batch.column("key").to_pylist(), raw(batch)):
                if own != block:
                    block, items, index = own, [], None
                if key is None:
                    items.append((name, text))
                    continue
                index = index or ItemIndex(items, config)
                found: dict[str, list[str]] = {}
                for n, a, b in index.spans(words(text, ALNUM)):
                    found.setdefault(index.ids[n], []).append(f"{a}:{b}")
                keys += [key] * len(found)
                names += found.keys()
                spans += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(spans, pa.list_(pa.string()))], ["key", "item", "spans"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, items, runs in zip(raw(batch), batch.column("items").to_pylist(), batch.column("runs").to_pylist()):
            rows.append((len(words(text, ALNUM)), items or [], [tuple(map(int, r.split(":"))) for r in runs or []]))
        yield _verdicts(rows, batch.column("doc_id"))


def _by_join(docs: DataFrame, items: DataFrame, size: int, config: WinnowConfig) -> DataFrame:
    """The same result for a benchmark of any size.

    Items are dealt to blocks of about ``index_bytes``.  Fingerprints of documents
    meet those of blocks in a join, which tells only which blocks a document is
    to be compared with: a common fingerprint gives a document a row for each
    block at most, not for each item, and no row carries an item's text.  Each
    block's documents are dealt to slices, to each of which its items go too.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontam")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-size // max(1, config.index_bytes)))
    items = work.table("items", items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))))
    # equal texts are one key, so that repeated rows are matched once
    keyed = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = keyed.select("key", "text").dropDuplicates(["key"])
    sizes = sorted(r[0] for r in items.mapInArrow(_sizes(config), "size long").distinct().collect())  # at most span - 1
    of_blocks = items.select(F.col("block").alias("key"), "text").mapInArrow(_prints(config, sizes, True), "key long, print long").withColumnRenamed("key", "block").distinct()
    met = texts.mapInArrow(_prints(config, sizes, False), "key string, print long").join(of_blocks, "print").select("key", "block").distinct()
    asked = texts.join(met, "key").select("block", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("slice"), F.lit(None).cast("string").alias("item"), "key", "text")
    asked = work.table("asked", asked)
    slices = asked.select("block", "slice").distinct()
    sent = items.join(slices, "block").select("block", "slice", "item", F.lit(None).cast("string").alias("key"), "text")
    rows = sent.unionByName(asked).repartition(parts, "block", "slice").sortWithinPartitions("block", "slice", F.col("key").asc_nulls_first())
    rows = rows.select(F.struct("block", "slice").alias("block"), "item", "key", "text")
    hits = rows.mapInArrow(_by_block(config), _HIT).groupBy("key").agg(F.collect_set("item").alias("items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("runs"))
    return keyed.join(work.table("hits", hits), "key", "left").select("doc_id", "text", "items", "runs").mapInArrow(_merge, SCHEMA)


def contamination(documents: DataFrame, benchmark: DataFrame, config: WinnowConfig = WinnowConfig(), key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Benchmark passages in every document.

    Returns one row per input row: doc_id, n_words, n_hit (words inside an
    occurrence), items (sorted ids of the items that occur), spans (merged hit
    runs as ``first:end`` word positions).

    Null and empty texts have no words and no hits; items without words occur
    nowhere; a null item_id is named by an empty string.  Repeated rows are
    judged alike.  An empty benchmark leaves every document clean.
    """
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 64), F.lit(0))).first()[0]
    if size > config.index_bytes:
        return _by_join(docs, items, size, config)
    found = [(r.item, r.text.encode() if r.text else None) for r in items.collect()]
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex(found, config))
    return docs.mapInArrow(_with_index(index), SCHEMA)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, config: WinnowConfig = WinnowConfig()) -> DataFrame:
    """Documents free of benchmark passages, with all their columns; rows without a doc_id stay."""
    hit = contamination(documents, benchmark, config).where("n_hit > 0 and doc_id is not null").select(F.col("doc_id").alias("hit_id")).distinct()
    return documents.join(hit, documents["doc_id"] == hit["hit_id"], "left_anti")
