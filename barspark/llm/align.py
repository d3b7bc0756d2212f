"""Alignment of two tokenizers' tokens by a sweep over their end events.

Every token is an event at the byte offset where it ends.  Events travel packed
by stretches of a document's bytes, one row a tokenizer and stretch, and are
dealt by document and sorted by offset; a state machine with the open group as
its only state merges both lines, closes a group wherever tokens of both end
together and links the two tokens that end there.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import Workspace, raw
from barspark.llm.textnum import prefix_hashes, span_hashes
from barspark.llm.tokens import PieceMemory


@dataclass(frozen=True)
class AlignConfig:
    """``path_a``: a byte-level BPE of the tokenizers library; ``path_b``: a sentencepiece model that adds a space.

    Events travel in stretches of ``stretch`` bytes.  Link counts of at most
    ``most_pairs`` distinct id pairs are sent to the tasks; more are joined.
    """

    path_a: str
    path_b: str
    stretch: int = 1 << 14
    most_pairs: int = 4_000_000


#: A piece whose tokens do not spell its bytes has this id alone; both vocabularies must be smaller.
SPOILT = 0xFFFF
#: Signs of more than one byte that a tokenizer may take for white space; a text with one is encoded in one piece.
WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80")
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(0x1C, 0x21)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Signs that no token of either tokenizer holds behind a letter.
SIGNS = b".,;:!?"
_SIGN = np.zeros(256, bool)
_SIGN[list(SIGNS)] = True


class Side(PieceMemory):
    """One tokenizer: ids of pieces of text and the bytes of each token."""

    spelled: list[bytes]

    def __init__(self, entries: int = 3 << 18):
        super().__init__(np.dtype("<u2"), entries)
        self.size = np.array([len(t) for t in self.spelled], np.int64)

    def checked(self, pieces: list[bytes], lists: list[list[int]]) -> list[list[int]]:
        """The pieces' ids, or SPOILT for a piece that its tokens do not spell."""
        flat = list(chain.from_iterable(lists))
        if SPOILT not in flat:  # all at once, and one by one only if any differs
            ends = np.append(0, np.cumsum(self.size[flat]))[np.cumsum([len(ids) for ids in lists])]
            if np.array_equal(ends, np.cumsum([len(p) for p in pieces])) and b"".join(map(self.spelled.__getitem__, flat)) == b"".join(pieces):
                return lists
        return [ids if SPOILT not in ids and b"".join(map(self.spelled.__getitem__, ids)) == p else [SPOILT] for p, ids in zip(pieces, lists)]


class ByteLevel(Side):
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the byte-level alphabet: printable Latin-1 stands for itself, all other bytes for the signs from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}
        self.spelled = [bytes(byte[c] for c in t) if (t := self.tokenizer.id_to_token(i)) is not None and all(c in byte for c in t) else b"" for i in range(self.tokenizer.get_vocab_size())]
        super().__init__()

    def _encode_new(self, pieces: list[bytes]) -> list:
        coded = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return self.checked(pieces, [e.ids for e in coded])


class SentencePiece(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        #: Texts are cut into pieces only if no token holds a blank behind another sign, a line's end beside one or one of SIGNS behind a letter.
        self.cuts = not any(re.search("[^▁]▁|\n.|.\n|[A-Za-z][.,;:!?]", p, re.S) for p in names)
        self.blank = self.model.piece_to_id("▁")
        self.marks = self.model.encode("\n")[1:]
        super().__init__()

    def _encode_new(self, pieces: list[bytes]) -> list:
        # the model puts a space before what it encodes: one that leads is left to it; behind a line's end it is a token alone
        texts = ["\n" + p.decode() if p[:1] != b" " else p[1:].decode() if len(p) > 1 else "" for p in pieces]
        lead = [self.blank, *self.marks]
        found = []
        for piece, ids in zip(pieces, self.model.encode(texts, num_threads=1)):
            if piece == b" ":
                ids = [self.blank]
            elif piece[:1] != b" ":
                ids = ids[len(lead) :] if ids[: len(lead)] == lead else [SPOILT]
            found.append(ids)
        return self.checked(pieces, found)


class Both:
    """Encodes texts with both tokenizers, piece by piece.

    Neither tokenizer has a token across the beginning of a blank that follows
    another sign, nor across that of one of SIGNS behind an ASCII letter, so pieces
    are cut there and each is encoded once.
    """

    def __init__(self, config: AlignConfig, block: int = 1 << 18):
        self.a, self.b, self.block = ByteLevel(config.path_a), SentencePiece(config.path_b), block
        if max(len(self.a.spelled), len(self.b.spelled)) > SPOILT:
            raise ValueError(f"vocabularies of more than {SPOILT} tokens are not supported")

    def _block(self, texts: list[bytes], whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        cut = np.zeros(len(data), bool)
        if not whole:
            cut[1:] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & ~_BLANK[data[:-1]] | _SIGN[data[1:]] & _LETTER[data[:-1]]
        cut[bounds[:-1]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        keys, first, which = np.unique(span_hashes(prefix_hashes(data), start, end), return_index=True, return_inverse=True)
        edge = np.searchsorted(start, bounds)
        ids_a, into_a = self.a.look_up(data, start, end, keys, first, which)
        ids_b, into_b = self.b.look_up(data, start, end, keys, first, which)
        for i in range(len(texts)):
            a, b = ids_a[into_a[edge[i]] : into_a[edge[i + 1]]], ids_b[into_b[edge[i]] : into_b[edge[i + 1]]]
            yield None if (a == SPOILT).any() or (b == SPOILT).any() else (a, b)

    def _parts(self, text: bytes) -> Iterator[bytes]:
        """A long text cut before blanks that follow another sign."""
        at = 0
        while len(text) - at > self.block:
            found = re.compile(rb"[^\s\x1c-\x1f][ \n]").search(text, at + self.block)
            if not found:
                break
            yield text[at : found.start() + 1]
            at = found.start() + 1
        yield text[at:]

    def encode(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of space and text by both, or none where a text is empty or a tokenizer does not keep its bytes."""
        held: list[bytes | None] = []
        size = 0
        for text in texts:
            plain = self.b.cuts and not (text and WIDE_BLANK.search(text))
            if text and (not plain or len(text) > self.block):
                yield from self._flush(held)
                held, size = [], 0
                if not plain:
                    yield from self._block([b" " + text], whole=True)
                    continue
                parts = [next(iter(self._block([part]))) for part in self._parts(b" " + text)]
                yield None if any(p is None for p in parts) else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                continue
            held.append(b" " + text if text else None)
            size += len(text or b"")
            if size >= self.block:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        some = [t for t in held if t]
        coded = self._block(some) if some else iter(())
        for text in held:
            yield next(coded) if text else None


_both: dict[AlignConfig, Both] = {}


def both(config: AlignConfig) -> Both:
    """The worker's tokenizers; workers are reused, and so is what they remember."""
    if config not in _both:
        _both[config] = Both(config)
    return _both[config]


_EVENTS = "row long, doc_id long, stretch int, side int, ids binary"


def _events(config: AlignConfig):
    """End events of both tokenizers by document and stretch; an event's offset follows from the ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = both(config)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            held = 0
            for row, doc_id, coded in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), own.encode(raw(batch))):
                for side, ids in enumerate(coded or (np.zeros(0, "<u2"),)):
                    last = (np.cumsum((own.a, own.b)[side].size[ids]) - 1) // config.stretch if len(ids) else ids
                    cuts = np.flatnonzero(np.diff(last, prepend=-1)) if len(ids) else np.zeros(1, np.int64)
                    for i, j in zip(cuts, [*cuts[1:], len(ids)]):
                        for column, value in zip(out, (row, doc_id, int(last[i]) if len(ids) else 0, side, ids[i:j].tobytes())):
                            column.append(value)
                        held += 2 * int(j - i)
                if held > 4 << 20:
                    yield _packed(out)
                    out, held = [[], [], [], [], []], 0
            yield _packed(out)

    return run


def _packed(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["row", "doc_id", "stretch", "side", "ids"])


class Machine:
    """Merges the end events of one document, stretch by stretch.

    Between stretches it holds the tokens of the open group, two offsets, the
    counts and the running digest.
    """

    def __init__(self, own: Both):
        self.size = own.a.size, own.b.size
        n_a, n_b = len(own.a.spelled), len(own.b.spelled)
        written = [f"{i}{sign}".encode() for n, sign in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)]
        self.written, self.base = np.array(written), (0, n_a, 2 * n_a, 2 * n_a + n_b)
        self.reset()

    def reset(self) -> None:
        self.at = [0, 0]
        self.open = [(np.zeros(0, "<u2"), np.zeros(0, np.int64))] * 2
        self.n = [0, 0]
        self.groups, self.tail, self.digest = 0, b"", hashlib.sha256()

    def take(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The links of one stretch, as A id times 65536 plus B id."""
        ids, ends = [], []
        for side, new in enumerate((a, b)):
            end = self.at[side] + np.cumsum(self.size[side][new])
            self.at[side] = int(end[-1]) if len(end) else self.at[side]
            self.n[side] += len(new)
            ids.append(np.concatenate([self.open[side][0], new]))
            ends.append(np.concatenate([self.open[side][1], end]))
        place = np.searchsorted(ends[1], ends[0])
        met = np.flatnonzero(np.append(ends[1], -1)[place] == ends[0])  # A tokens that end where a B token ends
        other = place[met]
        n_a, n_b = (int(met[-1]) + 1, int(other[-1]) + 1) if len(met) else (0, 0)
        self.open = [(x[n:], e[n:]) for x, e, n in zip(ids, ends, (n_a, n_b))]
        if not len(met):
            return np.zeros(0, np.int64)
        closed_a, closed_b = ids[0][:n_a].astype(np.int64), ids[1][:n_b].astype(np.int64)
        # where each token stands: behind the A tokens up to its group's and the B tokens of the groups before
        at_a = np.arange(n_a) + np.append(0, other + 1)[np.searchsorted(met, np.arange(n_a))]
        at_b = np.arange(n_b) + (met + 1)[np.searchsorted(other, np.arange(n_b))]
        code = np.empty(n_a + n_b, np.int64)
        mark_a, mark_b = np.full(n_a, self.base[0]), np.full(n_b, self.base[2])
        mark_a[met], mark_b[other] = self.base[1], self.base[3]
        code[at_a], code[at_b] = closed_a + mark_a, closed_b + mark_b
        for some in range(0, len(code), 1 << 16):
            text = self.written[code[some : some + (1 << 16)]].tobytes().translate(None, b"\0")
            self.digest.update(self.tail + text[:-1])
            self.tail = text[-1:]
        self.groups += len(met)
        return (closed_a[met] << 16) | closed_b[other]

    def result(self) -> tuple[int, int, int, str]:
        """n_a, n_b, groups and the digest without its last sign; empty for a document without tokens."""
        return self.n[0], self.n[1], self.groups, self.digest.hexdigest() if self.groups else ""


_SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def _sweep(config: AlignConfig):
    """One row for each document, and one more for every 65,536 links of a long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(both(config))
        none = np.zeros(0, "<u2")
        key = doc_id = place = None
        waiting: list[np.ndarray] = [none, none]
        links: list[np.ndarray] = []
        held = 0

        def step() -> None:
            nonlocal held
            found = machine.take(*waiting)
            waiting[:] = none, none
            links.append(found.astype("<u4"))
            held += len(found)

        def flushed(last: bool) -> tuple:
            nonlocal held
            packed = b"".join(x.tobytes() for x in links)
            links.clear()
            held = 0
            return (key, doc_id, *(machine.result() if last else (0, 0, 0, "")), packed)

        for batch in batches:
            out = []
            for row, own_id, stretch, side, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "stretch", "side", "ids"))):
                if (row, stretch) != place and place is not None:
                    step()
                    if row != key:
                        out.append(flushed(True))
                        machine.reset()
                    elif held > 1 << 16:
                        out.append(flushed(False))
                key, doc_id, place = row, own_id, (row, stretch)
                waiting[side] = np.frombuffer(ids, "<u2")
            yield _swept(out)
        if place is not None:
            step()
            yield _swept([flushed(True)])

    return run


def _swept(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _SWEPT.split(", ")])


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch's rows, and how many each row has."""
    column = batch.column("links")
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) // 4
    low = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", "<u4", int(size.sum()), low) if size.sum() else np.zeros(0, "<u4"), size


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links by id pair, added up for every four million links of a task."""
    parts, held = [], 0

    def summed() -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate([np.zeros(0, "<u4"), *parts]), return_counts=True)
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n, pa.int64())], ["pair", "n"])

    for batch in batches:
        found, _ = _links(batch)
        parts.append(found)
        held += len(found)
        if held > 4_000_000:
            yield summed()
            held = 0
    yield summed()


def _valued(counts):
    """n_best and count_sum of each row's links from the counts of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = counts.value
        for batch in batches:
            found, size = _links(batch)
            at = np.searchsorted(pairs, found)
            into = np.append(0, np.cumsum(size))
            total, top = (np.append(0, np.cumsum(x[at])) if len(found) else np.zeros(1, np.int64) for x in (n, best))
            names = [c for c in batch.schema.names if c != "links"]
            columns = [batch.column(c) for c in names] + [pa.array(top[into[1:]] - top[into[:-1]]), pa.array(total[into[1:]] - total[into[:-1]])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_best", "count_sum"])

    return run


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct pairs with how often it holds them."""
    for batch in batches:
        found, size = _links(batch)
        rows, pairs, times = [], [], []
        for row, part in zip(batch.column("row").to_pylist(), np.split(found, np.cumsum(size)[:-1])):
            pair, n = np.unique(part, return_counts=True)
            rows.append(np.full(len(pair), row, np.int64))
            pairs.append(pair.astype(np.int64))
            times.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (rows, pairs, times)], ["row", "pair", "times"])


def sweep(documents: DataFrame, config: AlignConfig) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups_sha256 and links (32 bits each, A id times 65536 plus B id).

    A document is one row, a long one several that share ``row``, of which one
    has the counts and the digest.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    events = docs.mapInArrow(_events(config), _EVENTS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return events.repartition(parts, "row").sortWithinPartitions("row", "stretch", "side").mapInArrow(_sweep(config), _SWEPT)


def pair_counts(swept: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold each id pair."""
    found = swept.select("links").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return found.select(F.shiftright("pair", 16).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFF).cast("int").alias("b"), "n")


def align(documents: DataFrame, config: AlignConfig) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Null and empty texts, and texts whose bytes a tokenizer does not keep, have no
    tokens: zeros and an empty digest.  Each row is a document of its own, repeated
    or without an id; its links count in the corpus.  Other columns are not read.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "align")
    swept = work.table("swept", sweep(documents, config))
    counts = work.table("counts", pair_counts(swept))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    marked = counts.join(top, "b").select((F.col("a").cast("long") * 65536 + F.col("b")).alias("pair"), "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    if counts.count() <= config.most_pairs:
        table = marked.toArrow()
        pairs, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pairs)
        sent = spark.sparkContext.broadcast((pairs[order].astype("<u4"), n[order], best[order]))
        valued = swept.mapInArrow(_valued(sent), "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")
    else:
        per_row = swept.select("row", "links").mapInArrow(_link_rows, "row long, pair long, times long").join(marked, "pair")
        per_row = per_row.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        whole = swept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in plain[2:5]), F.max("groups_sha256").alias("groups_sha256"))
        valued = whole.join(per_row, "row", "left").fillna(0, ["n_best", "count_sum"])
    summed = valued.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in (*plain[2:5], "n_best", "count_sum")), F.max("groups_sha256").alias("groups_sha256"))
    return summed.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
