"""Encoding of whole texts with a public tokenizer of the ``tokenizers`` library."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np

from barspark.llm.textnum import NON_BLANK, U64, prefix_hashes, span_hashes, word_spans

#: Single signs that the word-end tokenizers keep apart from a letter before them.
SIGNS = {bytes([c]) for c in b".,;:!?"}


class PieceMemory:
    """Ids of pieces of text, found by the 64-bit hashes of their bytes in a sorted array.

    Only unknown pieces reach :meth:`_encode_new`.  ``entries`` bounds what is
    remembered; a piece beyond it is encoded again in every block that has it.
    """

    def __init__(self, dtype: np.dtype, entries: int):
        self.dtype, self.entries = dtype, entries
        self.keys, self.at = np.zeros(0, U64), np.zeros(0, np.int64)  # sorted hashes; where each one's ids begin
        self.count = np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 20, dtype), 0

    def _encode_new(self, pieces: list[bytes]) -> list:
        raise NotImplementedError

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[slot] == keys, slot, -1) if len(self.keys) else np.full(len(keys), -1)

    def _add(self, keys: np.ndarray, lists: list) -> tuple[np.ndarray, np.ndarray]:
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(count.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.concatenate(lists) if total else 0
        at = self.used + np.cumsum(count) - count
        room = self.entries - len(self.keys)
        if room > 0:
            keep = slice(0, room)
            place = np.searchsorted(self.keys, keys[keep])  # both are sorted
            self.keys, self.at, self.count = (np.insert(old, place, new[keep]) for old, new in ((self.keys, keys), (self.at, at), (self.count, count)))
            self.used += int(count[keep].sum())
        return at, count

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and before each piece (and at the end) how many ids there are.

        ``keys`` are the distinct hashes of the pieces from ``start`` to ``end``,
        ``first`` a piece of each hash and ``which`` the hash of each piece.
        """
        slot = self._find(keys)
        new = np.flatnonzero(slot < 0)
        at, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        old = slot >= 0
        at[old], count[old] = self.at[slot[old]], self.count[slot[old]]
        if len(new):
            view = data.tobytes()
            lists: list = []
            for some in range(0, len(new), 2048):  # bounds what the tokenizer holds at a time
                lists += self._encode_new([view[start[i] : end[i]] for i in first[new[some : some + 2048]]])
            at[new], count[new] = self._add(keys[new], lists)
        n = count[which]
        into = np.append(0, np.cumsum(n))
        return self.ids[np.repeat(at[which] - into[:-1], n) + np.arange(into[-1])], into


class PieceEncoder(PieceMemory):
    """Encodes texts blank by blank and remembers pieces.

    For tokenizers that never merge across white space, a text's ids are those
    of its blank-separated pieces in order, so a piece needs encoding only once.
    Pieces of letters and one sign are encoded as two.
    """

    def __init__(self, path: str, entries: int = 1 << 18, block: int = 1 << 18):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        super().__init__(np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"), entries)
        self.block = block
        #: A-Z may be lowered before the lookup only where the tokenizer does so itself.
        self.folds = self.whole("AbZ") == self.whole("abz")
        self.splits = all(self.whole(f"ab{s}") == self.whole("ab") + self.whole(s) for s in (x.decode() for x in SIGNS))
        self.signs = {s: self.whole(s.decode()) for s in SIGNS}
        self.mark = next(((t, i) for t, i in sorted(self.tokenizer.get_vocab(True).items()) if t.startswith("<|") and self.whole(f"a{t}b") == self.whole("a") + [i] + self.whole("b")), None)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_new(self, pieces: list[bytes]) -> list[list[int] | np.ndarray]:
        tails, bodies = [], []
        for piece in pieces:
            text = piece.decode("utf-8", "replace")
            # only behind an ASCII letter: a letter whose lower case ends in a mark (U+0130) joins the sign
            signed = self.splits and len(piece) > 1 and piece[-1:] in SIGNS and piece[-2:-1].isalpha()
            tails.append(self.signs[piece[-1:]] if signed else None)
            bodies.append(text[:-1] if signed else text)
        if self.mark:  # one call, with a special token between the pieces
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark[0].join(bodies)], add_special_tokens=False)[0].ids, self.dtype)
            edges = np.flatnonzero(ids == self.mark[1])
            if len(edges) == len(bodies) - 1:
                low, high = [0, *(edges + 1).tolist()], [*edges.tolist(), len(ids)]
                return [ids[a:b] if tail is None else [*ids[a:b], *tail] for a, b, tail in zip(low, high, tails)]
        coded = self.tokenizer.encode_batch_fast(bodies, add_special_tokens=False)
        return [e.ids if tail is None else [*e.ids, *tail] for e, tail in zip(coded, tails)]

    def _encode_block(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" ".join(texts), np.uint8)
        start, end = word_spans(data, NON_BLANK)
        keys, first, which = np.unique(span_hashes(prefix_hashes(data), start, end), return_index=True, return_inverse=True)
        ids, into = self.look_up(data, start, end, keys, first, which)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        edges = into[np.searchsorted(start, bounds)]
        return [ids[edges[i] : edges[i + 1]] for i in range(len(texts))]

    def _parts(self, text: bytes) -> Iterator[bytes]:
        """A long text cut behind blanks into parts of about a block, so that its length bounds no array."""
        at = 0
        while len(text) - at > self.block:
            end = max(text.rfind(blank, at, at + self.block) for blank in (b" ", b"\n")) + 1
            if end <= at:  # one piece longer than a block stays whole
                after = [x for x in (text.find(blank, at + self.block) for blank in (b" ", b"\n")) if x >= 0]
                end = min(after) + 1 if after else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """Ids (of ``dtype``) of each whole text in order; a null text has none."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            text = text or b""
            if b"<|" in text:  # a special token may be spelled out: nothing is folded or remembered
                yield from self._encode_block(held) if held else []
                yield np.array(self.whole(text.decode("utf-8", "replace")), self.dtype)
                held, size = [], 0
                continue
            if len(text) > self.block:
                yield from self._encode_block(held) if held else []
                yield np.concatenate([self._encode_block([part])[0] for part in self._parts(text.lower() if self.folds else text)])
                held, size = [], 0
                continue
            held.append(text.lower() if self.folds else text)
            size += len(text)
            if size >= self.block:
                yield from self._encode_block(held)
                held, size = [], 0
        if held:
            yield from self._encode_block(held)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder; workers are reused, and so is what it remembers."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
