"""Ranked lexical search with MaxScore in every shard of documents.

One reading of the texts writes an index: per document its number of terms and
the frequencies of the terms that any item asks for.  A shard is a slice of that
index, so shards need no shuffle and no term's postings meet in one place.
Inside a shard the lists of an item's terms are ordered by the most they can add;
those that together cannot lift a document into the item's best are non-essential
and are probed only while a document can still qualify.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import Workspace, raw
from barspark.llm.textnum import ALNUM, U64, words

#: Stands for a missing doc_id: such documents come after all others of their score.
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class SearchConfig:
    """The ``k`` best documents of each item.

    Items are searched in blocks of about ``block_terms`` (item, term) pairs, whose
    weights travel to the tasks; a shard holds up to ``shard`` documents.
    """

    k: int = 50
    block_terms: int = 2_000_000
    shard: int = 4096


def _flat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *parts]).astype(dtype, copy=False)


def _lists(parts: list[np.ndarray], dtype, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(_flat(parts, dtype), kind))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(words(text, ALNUM)).view(np.int64) for text in raw(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), _lists(found, np.int64, pa.int64())], ["item_id", "terms"])


def _postings(wanted):
    """n and the frequencies of the wanted terms (all, where ``wanted`` is none) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if wanted is None else wanted.value
        for batch in batches:
            n, terms, times = [], [], []
            for text in raw(batch):
                values = words(text, ALNUM)
                n.append(len(values))
                if own is not None:
                    values = values[own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values] if len(own) else values[:0]
                term, tf = np.unique(values, return_counts=True)
                terms.append(term.view(np.int64))
                times.append(tf)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), _lists(terms, np.int64, pa.int64()), _lists(times, np.int64, pa.int64())], ["doc_id", "n", "terms", "tfs"])

    return run


class Items:
    """A block of items: each one's terms as places in the sorted terms of the block, and the terms' weights."""

    def __init__(self, ids: list, owner: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.ids = ids
        self.terms, first, place = np.unique(term, return_index=True, return_inverse=True)
        self.weight = weight[first]
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(ids) + 1))
        self.of = [place[order[cuts[i] : cuts[i + 1]]] for i in range(len(ids))]


class Shard:
    """The posting lists of a slice of documents: for each term of a block, documents in order and what the term adds to each."""

    def __init__(self, items: Items, doc_ids: np.ndarray, m: np.ndarray, count: np.ndarray, term: np.ndarray, tf: np.ndarray):
        place = np.minimum(np.searchsorted(items.terms, term), max(0, len(items.terms) - 1))
        known = np.flatnonzero(items.terms[place] == term) if len(items.terms) else np.zeros(0, np.int64)
        doc, place, tf = np.repeat(np.arange(len(doc_ids)), count)[known], place[known], tf[known]
        adds = items.weight[place] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.argsort(place, kind="stable")
        self.doc_ids, self.doc, self.adds = doc_ids, doc[order], adds[order]
        self.start = np.searchsorted(place[order], np.arange(len(items.terms) + 1))
        self.most = np.zeros(len(items.terms), np.int64)
        some = np.flatnonzero(np.diff(self.start))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.adds, self.start[some])

    def search(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and doc_ids of the documents that reach ``least``, which is at least 1."""
        terms = terms[np.argsort(self.most[terms], kind="stable")]
        reach = np.cumsum(self.most[terms])  # what a term and all before it can add at most
        split = int(np.searchsorted(reach, least))  # those before cannot reach it together
        if split == len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.concatenate([self.doc[self.start[t] : self.start[t + 1]] for t in terms[split:]])
        adds = np.concatenate([self.adds[self.start[t] : self.start[t + 1]] for t in terms[split:]])
        total = np.bincount(doc, adds, len(self.doc_ids))  # exact: sums stay far below 2**53
        doc = np.flatnonzero(total)
        score = total[doc].astype(np.int64)
        for i in range(split - 1, -1, -1):
            alive = score + reach[i] >= least
            doc, score = doc[alive], score[alive]
            if not len(doc):
                break
            low, high = self.start[terms[i]], self.start[terms[i] + 1]
            at = low + np.searchsorted(self.doc[low:high], doc)
            hit = np.flatnonzero(at < high)
            hit = hit[self.doc[at[hit]] == doc[hit]]
            score[hit] += self.adds[at[hit]]
        good = score >= least
        return score[good], self.doc_ids[doc[good]]


def _search(block, n_docs: int, n_terms: int, config: SearchConfig, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(items.ids)
        least = np.ones(len(items.ids), np.int64)
        for batch in batches:
            for at in range(0, len(batch), config.shard):
                part = batch.slice(at, config.shard)
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
                terms, tfs = part.column("terms"), part.column("tfs")
                count = np.diff(terms.offsets.to_numpy())
                n = part.column("n").to_numpy()
                m = 50 + np.array([(50 * int(x) * n_docs) // n_terms for x in n], np.int64)
                shard = Shard(items, ids, m, count, terms.flatten().to_numpy(zero_copy_only=False).view(U64), tfs.flatten().to_numpy(zero_copy_only=False))
                for i, own in enumerate(items.of):
                    score, doc = shard.search(own, int(least[i]))
                    if len(score):
                        score, doc = np.append(best[i][0], score), np.append(best[i][1], doc)
                        top = np.lexsort((doc, -score))[: config.k]
                        best[i] = score[top], doc[top]
                        if len(top) == config.k:
                            least[i] = score[top[-1]]
        owner = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        doc, score = _flat([d for _, d in best], np.int64), _flat([s for s, _ in best], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(items.ids, id_type).take(pa.array(owner)), pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(documents: DataFrame, items: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's best documents.

    Only documents with a score above 0 are returned, equal scores by ascending
    doc_id, a missing doc_id after all others.  Null and texts without a term are
    no documents and items without a term find nothing.  Each row of documents is
    a document of its own, repeated or not; rows of one item_id (null included)
    are one item with the terms of all.  Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    work = Workspace(spark, "lexical")
    id_type = items.schema["item_id"].dataType
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_item_terms, f"item_id {id_type.simpleString()}, terms array<long>")
    asked = work.table("asked", asked.select("item_id", F.explode("terms").alias("term")).distinct())
    pairs = asked.count()
    blocks = max(1, -(-pairs // config.block_terms))
    wanted = None
    if blocks == 1:  # at most block_terms terms
        keys = [r.term for r in asked.select("term").distinct().collect()]
        wanted = spark.sparkContext.broadcast(np.sort(np.array(keys, np.int64).view(U64)))
    index = work.table("index", docs.mapInArrow(_postings(wanted), "doc_id long, n long, terms array<long>, tfs array<long>"))
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighted = work.table("weighted", asked.join(found, "term").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))))
    for block in range(blocks):
        rows = weighted.where(F.col("block") == block).select("item_id", "term", "df").collect()
        ids = list(dict.fromkeys(r.item_id for r in rows))
        place = {x: i for i, x in enumerate(ids)}
        own = Items(ids, np.array([place[r.item_id] for r in rows], np.int64), np.array([r.term for r in rows], np.int64).view(U64), np.array([weight(n_docs, r.df) for r in rows], np.int64))
        sent = spark.sparkContext.broadcast(own)
        best = index.select("doc_id", "n", "terms", "tfs").mapInArrow(_search(sent, n_docs, max(1, n_terms), config, to_arrow_type(id_type)), f"item_id {id_type.simpleString()}, doc_id long, score long")
        best.withColumn("share", F.spark_partition_id() % 64).write.mode("append").parquet(work.path("best"))
        sent.unpersist()
    best = spark.read.schema(f"item_id {id_type.simpleString()}, doc_id long, score long, share int").parquet(work.path("best"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # every task has sent k rows an item at most; shares of the tasks first, so that no task ranks all of an item's
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "share").orderBy(*order))).where(F.col("rank") <= config.k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= config.k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
