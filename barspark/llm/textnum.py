"""Vectorised text primitives shared by the corpus operators.

Everything here works on one text at a time inside a Spark task, on the UTF-8
bytes of the whole text.  Words are byte runs of a fixed class; a word's value
is a 64-bit hash of its bytes, and word n-grams hash the word values, so that
no Python object per word is ever built.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_ONE = U64(1)


def _inverse(x: int) -> int:
    """Inverse of an odd number modulo 2**64 (Newton's iteration)."""
    y = x
    for _ in range(6):
        y = y * (2 - x * y) & (2**64 - 1)
    return y


_INV = U64(_inverse(int(_BASE)))
_powers = np.ones(1, U64)
_inverse_powers = np.ones(1, U64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator: a bijection on 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix64((np.arange(256, dtype=U64) + _ONE) * _BASE)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 14)
        _powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE, U64)]), dtype=U64)
        _inverse_powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _INV, U64)]), dtype=U64)
    return _powers[:n], _inverse_powers[:n]


def byte_class(predicate) -> np.ndarray:
    """256-entry boolean table of the bytes that belong to a word."""
    return np.array([bool(predicate(b)) for b in range(256)])


#: Words of the near-duplicate operators: anything but the six ASCII blanks.
NON_BLANK = byte_class(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Words of the decontamination operator: ASCII digits and small letters, and all non-ASCII bytes.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def word_spans(data: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) byte offsets of the words of ``data``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = word_bytes[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte value times power; differences give span hashes."""
    powers, _ = _power_tables(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUE[data] * powers, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes; the same bytes anywhere hash alike."""
    _, inverse = _power_tables(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def words(text: bytes | None, word_bytes: np.ndarray) -> np.ndarray:
    """Word values of a UTF-8 text after lower-casing A-Z; empty for null."""
    if not text:
        return np.zeros(0, U64)
    data = np.frombuffer(text.lower(), np.uint8)  # bytes.lower() touches A-Z only
    start, end = word_spans(data, word_bytes)
    return span_hashes(prefix_hashes(data), start, end) if len(start) else np.zeros(0, U64)


def ngrams(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words (empty if there are fewer)."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for i in range(n):
        out = out * _BASE + values[i : i + m]
    return mix64(out + U64(n))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text is one shingle, no word none."""
    values = words(text, NON_BLANK)
    if not len(values):
        return values
    return np.unique(ngrams(values, min(n, len(values))))
