"""Removal of repeated byte strings on a Burrows-Wheeler transform.

Every 100-byte window of a text belongs to exactly one run of windows that share
the leftmost smallest k-gram hash, the run's anchor.  Equal windows have equal
anchors, so runs can be compared anchor by anchor, in a shuffle:

1. runs of equal bytes: all but the earliest are repeats, whole; those that a
   task meets among a few megabytes of its texts are settled there, so that a
   very common run is a row for each such group and not for each document;
2. anchors that have several different runs: the distinct runs' bytes are
   gathered in blocks of bounded size.  A block's Burrows-Wheeler transform is
   explored breadth first: intervals of suffixes with a common prefix are
   extended backwards by one byte, so that common prefixes appear by increasing
   length, and an interval goes on only if its right end gets its prefix length
   for the first time.  At the minimum length the search stops; neighbours that
   have none by then share at least that many bytes.  Anchors with too many
   different runs for a block are dealt by the 128-bit hashes of their windows
   instead, and all but the earliest of equal windows are repeats.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import Workspace, raw
from barspark.llm.textnum import U64, prefix_hashes, span_hashes

_NULL_ID = -(1 << 63)  # documents without an id come before all others
_SEGMENT = 1 << 22


@dataclass(frozen=True)
class RepeatConfig:
    """Strings of ``least`` bytes are compared, by anchors of ``k`` bytes.

    A block holds about ``block_bytes``; of an anchor with more than ``most_runs``
    different runs, the windows are compared one by one, by 128-bit hashes.
    """

    least: int = 100
    k: int = 32
    block_bytes: int = 1 << 18
    most_runs: int = 4096


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchored_runs(data: np.ndarray, config: RepeatConfig) -> list[np.ndarray]:
    """Anchor hash, hash of the run's bytes, first window start and number of windows of each run."""
    parts: list[list[np.ndarray]] = []
    for at in range(0, len(data) - config.least + 1, _SEGMENT):
        piece = data[at : at + _SEGMENT + config.least - 1]
        prefix = prefix_hashes(piece)
        start = np.arange(len(piece) - config.k + 1)
        grams = span_hashes(prefix, start, start + config.k)
        # the hash's upper bits, then the position: the smallest is the leftmost of the smallest
        packed = grams >> U64(24) << U64(24) | start.astype(U64)
        anchor = (_sliding_min(packed, config.least - config.k + 1) & U64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        end = np.append(first[1:], len(anchor))
        parts.append([grams[anchor[first]].view(np.int64), span_hashes(prefix, first, end - 1 + config.least).view(np.int64), first + at, end - first])
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4


_RUN = "salt long, anchor long, bytes long, doc long, tie long, first long, windows long"
_SPAN = "doc long, tie long, first long, end long"


def _batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])


def _salted(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Runs of a few megabytes of texts; all but the earliest of equal ones get a salt, for they are repeats already."""
    anchor, bytes_, doc, tie, first, windows = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((first, tie, doc, bytes_, anchor))
    again = np.zeros(len(order), bool)
    again[1:] = (anchor[order[1:]] == anchor[order[:-1]]) & (bytes_[order[1:]] == bytes_[order[:-1]])
    # a row that stands twice is one document and no repeat of itself
    lead = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
    same = (doc[order] == doc[lead]) & (tie[order] == tie[lead]) & (first[order] == first[lead])
    salt = np.zeros(len(order), np.int64)
    salt[order] = np.where(again & ~same, 1 + (doc[order] & 0xFFFF), 0)
    return _batch([salt, anchor, bytes_, doc, tie, first, windows], _RUN)


def _runs(config: RepeatConfig):
    """All runs of a task's texts, a few megabytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for doc, tie, text in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), raw(batch)):
                if text and len(text) >= config.least:
                    anchor, bytes_, first, windows = anchored_runs(np.frombuffer(text, np.uint8), config)
                    held.append([anchor, bytes_, np.full(len(anchor), doc), np.full(len(anchor), tie), first, windows])
                    size += len(text)
                    if size >= _SEGMENT:
                        yield _salted(held)
                        held, size = [], 0
        if held:
            yield _salted(held)

    return run


_FOUND = "kind int, anchor long, doc long, tie long, first long, windows long"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by anchor, bytes and document: kind 0, repeats; kind 1, the earliest of each of several runs of an anchor.

    Salted runs are repeats as they come.  Only a few rows are carried from batch
    to batch, whatever the size of a group.
    """
    last = None  # anchor and bytes of the row before
    lead = (0, 0, 0)  # where the last run stands first
    single = None  # the first run of the last anchor, while it is the anchor's only one
    for batch in batches:
        salt = batch.column("salt").to_numpy()
        known = batch.filter(pa.array(salt > 0)).drop_columns(["salt", "bytes"])
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(known.num_rows, np.int32)), *known.columns], [f.split()[0] for f in _FOUND.split(", ")])
        batch = batch.filter(pa.array(salt == 0))
        if not batch.num_rows:
            continue
        anchor, bytes_, doc, tie, first, windows = (batch.column(c).to_numpy() for c in range(1, 7))
        before_anchor = np.concatenate([[last[0] if last else ~anchor[0]], anchor[:-1]])
        before_bytes = np.concatenate([[last[1] if last else 0], bytes_[:-1]])
        new_anchor = anchor != before_anchor
        new_run = new_anchor | (bytes_ != before_bytes)
        at = np.maximum.accumulate(np.where(new_run, np.arange(len(anchor)), -1))
        lead_doc, lead_tie, lead_first = (np.where(at < 0, old, c[np.maximum(at, 0)]) for old, c in zip(lead, (doc, tie, first)))
        again = ~new_run & ((doc != lead_doc) | (tie != lead_tie) | (first != lead_first))  # a repeated row is no repeat of itself
        lead = (int(lead_doc[-1]), int(lead_tie[-1]), int(lead_first[-1]))
        group = np.cumsum(new_anchor)  # 0: the anchor that the last batch ended with
        runs = np.bincount(group, weights=new_run, minlength=int(group[-1]) + 1).astype(np.int64)
        several = runs > 1
        several[0] = runs[0] > 0  # a new run joins at least one that came before
        emit = new_run & several[group]
        out = [np.where(emit, 1, 0)[emit | again], *(c[emit | again] for c in (anchor, doc, tie, first, windows))]
        if single is not None and runs[0] > 0:
            out = [np.append(c, v) for c, v in zip(out, (1, *single))]
        if group[-1] > 0 or last is None:
            ends = np.flatnonzero(new_anchor)[-1] if new_anchor.any() else 0
            single = tuple(int(c[ends]) for c in (anchor, doc, tie, first, windows)) if runs[group[-1]] == 1 else None
        elif runs[0] > 0:
            single = None
        last = (anchor[-1], bytes_[-1])
        if len(out[0]):
            yield _batch([out[0].astype(np.int32), *out[1:]], _FOUND)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` symbols, by doubling; symbols are below 2**16 - 1.

    Suffixes that agree that far may stand in any order.
    """
    n = len(symbols)
    if n and int(symbols.max()) >= (1 << 16) - 1:
        raise ValueError(f"symbol {int(symbols.max())} does not fit 16 bits; a block holds too many texts")
    padded = np.concatenate([symbols.astype(U64) + U64(1), np.zeros(3, U64)])
    bits = U64(16)
    key = ((padded[:n] << bits | padded[1 : n + 1]) << bits | padded[2 : n + 2]) << bits | padded[3 : n + 3]
    known = 4
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - known] += rank[known:] + 1
        known *= 2


def prefix_bounds(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For sorted suffixes, where a common prefix with the one before is shorter than ``least``.

    Breadth-first backward extension of suffix intervals on the Burrows-Wheeler
    transform; the entry behind an interval's end gets its length once.
    """
    n = len(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    met = np.zeros(n, bool)
    back = place[order - 1]  # where the suffix one symbol longer stands; of the whole text: the last suffix
    front = symbols[order]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    owner = np.zeros(n, np.int64)
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        name = np.repeat(np.arange(len(low)), size)
        at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        to = back[at]
        owner[to] = name
        if len(to) > n >> 5:  # in order, by marking them: they are different places
            met[to] = True
            to = np.flatnonzero(met)
            met[to] = False
        else:
            to.sort()
        cut = np.ones(len(to) + 1, bool)
        cut[1:-1] = (to[1:] != to[:-1] + 1) | (owner[to[1:]] != owner[to[:-1]]) | (front[to[1:]] != front[to[:-1]])
        edge = np.flatnonzero(cut)
        low, high = to[edge[:-1]], to[edge[1:] - 1] + 1
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
    return known[:n]


def repeated_windows(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number, text number and offset of every ``least``-byte window that occurs more than once."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    symbols = np.zeros(int(begin[-1]), np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols[:] = data.astype(np.int64) + len(texts)
    symbols[begin[1:] - 1] = np.arange(len(texts))  # every text ends in a symbol of its own
    order = suffix_order(symbols, least + 1)
    bound = prefix_bounds(symbols, order, least)
    group = np.cumsum(bound)
    several = np.bincount(group)[group] > 1
    where = order[several]
    text = np.searchsorted(begin, where, "right") - 1
    return group[several], text, where - begin[text]


_PIECE = "anchor long, part long, more long, doc long, tie long, first long, data binary"


def _pieces(config: RepeatConfig):
    """Bytes of the listed runs of each text; of split anchors, the 128-bit hash of each window in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                out: list[tuple] = []
                for doc, tie, runs, text in zip(rows.column("doc").to_pylist(), rows.column("tie").to_pylist(), rows.column("runs").to_pylist(), raw(rows)):
                    for r in runs:
                        first, windows, anchor = r["first"], r["windows"], r["anchor"]
                        if not r["split"]:
                            out.append((anchor, 0, 0, doc, tie, first, text[first : first + windows - 1 + config.least]))
                            continue
                        for w in range(first, first + windows):
                            digest = hashlib.blake2b(text[w : w + config.least], digest_size=16).digest()
                            out.append((anchor, *struct.unpack("<2q", digest), doc, tie, w, None))
                columns = list(zip(*out)) or [[] for _ in range(7)]
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _PIECE.split(", ")])

    return run


def _blocks(config: RepeatConfig):
    """Repeated windows of pieces sorted by anchor, hash and place: of pieces with bytes, block by block; of hashed windows, all but the earliest.

    A block closes before an anchor's first piece only, so it holds fewer than
    5 * ``most_runs`` pieces; of hashed windows, just the last one is held.
    """

    def solve(keys: list[tuple[int, int, int]], data: list[bytes]) -> pa.RecordBatch:
        group, text, offset = repeated_windows(data, config.least)
        doc, tie, first = (np.array(c, np.int64)[text] for c in zip(*keys)) if keys else [np.zeros(0, np.int64)] * 3
        first = first + offset
        order = np.lexsort((first, tie, doc, group))
        again = np.zeros(len(order), bool)
        again[1:] = group[order[1:]] == group[order[:-1]]
        rows = order[again]
        rows = rows[np.lexsort((first[rows], tie[rows], doc[rows]))]
        doc, tie, first = doc[rows], tie[rows], first[rows]
        joins = (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (first[1:] <= first[:-1] + config.least)
        edge = np.flatnonzero(np.concatenate([[True], ~joins, [True]])) if len(rows) else np.zeros(1, np.int64)
        low, high = edge[:-1], edge[1:] - 1
        return _batch([doc[low], tie[low], first[low], first[high] + config.least], _SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int, int]] = []
        data: list[bytes] = []
        size, last, place = 0, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                again: list[tuple[int, int, int, int]] = []
                for anchor, part, more, doc, tie, first, piece in zip(*(rows.column(c).to_pylist() for c in range(7))):
                    key, here = (anchor, part, more, piece is None), (doc, tie, first)
                    if piece is None:
                        if key != last:
                            last, place = key, here  # the earliest
                        elif here != place:
                            again.append((*here, first + config.least))
                        continue
                    if key == last and here == place:
                        continue  # of a repeated row, which is one document
                    if key != last and (size >= config.block_bytes or len(data) >= 4 * config.most_runs):
                        yield solve(keys, data)
                        keys, data, size = [], [], 0
                    keys.append(here)
                    data.append(piece)
                    size += len(piece)
                    last, place = key, here
                if again:
                    yield _batch([np.array(c, np.int64) for c in zip(*again)], _SPAN)
        if data:
            yield solve(keys, data)

    return run


def _union(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], min(s["end"], n)) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for spans, text in zip(batch.column("spans").to_pylist(), raw(batch)):
            text = text or b""
            removed = _union(spans or [], len(text))
            edges = [0, *(x for s in removed for x in s), len(text)]
            kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            rows.append((len(text), [f"{a}:{b}" for a, b in removed], sum(b - a for a, b in removed), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows)) or [[] for _ in range(4)]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "removed", "n_removed", "kept_sha256"])


def repeated_bytes(documents: DataFrame, config: RepeatConfig = RepeatConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes of each text that lie in a ``least``-byte string that also starts earlier.

    Returns one row per input row: doc_id, n_bytes, removed (maximal runs as
    ``first:end`` bytes), n_removed, kept_sha256 (of the remaining bytes).

    Earlier means a smaller doc_id or, in the same document, a smaller offset.
    Null texts are empty; a null doc_id comes before all others.  Rows that
    repeat an id and its text are one document; different texts of one id are
    ordered by a hash.  An empty table gives no rows.
    """
    work = Workspace(documents.sparkSession, "repeats")
    source = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ids = source.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), F.xxhash64("text").alias("hash"))
    clash = ids.groupBy("doc").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b")
    tie = F.lit(0).cast("long") if clash.isEmpty() else F.xxhash64("text")
    source = source.select("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), tie.alias("tie"), "text")

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bare = source.select("doc", "tie", "text")
    # every run takes this one way, so that no repeat depends on how a second reading would cut the files;
    # of a common run, one for each few megabytes of text goes to its anchor's task, the others are spread by their salts
    runs = bare.mapInArrow(_runs(config), _RUN)
    runs = runs.repartition(parts, "anchor", "salt").sortWithinPartitions("salt", "anchor", "bytes", "doc", "tie", "first")
    found = work.table("found", runs.mapInArrow(_resolve, _FOUND))
    whole = found.where("kind = 0").select("doc", "tie", "first", (F.col("first") + F.col("windows") + (config.least - 1)).alias("end"))

    several = found.where("kind = 1").drop("kind").distinct()  # a repeated row's runs count once
    crowded = several.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > config.most_runs)
    crowded = crowded.select("anchor", F.lit(True).alias("split"))
    several = several.join(crowded, "anchor", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    listed = several.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "windows", "anchor", "split")).alias("runs"))
    pieces = listed.join(bare.dropDuplicates(["doc", "tie"]) if not clash.isEmpty() else bare, ["doc", "tie"]).select("doc", "tie", "runs", "text")
    pieces = pieces.mapInArrow(_pieces(config), _PIECE).repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part", "more", "doc", "tie", "first")
    partial = pieces.mapInArrow(_blocks(config), _SPAN)

    spans = whole.unionByName(partial)
    spans = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    schema = "doc_id long, n_bytes long, removed array<string>, n_removed long, kept_sha256 string"
    return source.join(spans, ["doc", "tie"], "left").select("doc_id", "spans", "text").mapInArrow(_report, schema)
