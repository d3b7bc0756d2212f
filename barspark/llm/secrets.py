"""Secret scans: fixed patterns and a randomness test battery.

Beside the patterns' spans, runs of key characters are tested for randomness.
Each candidate's encoding is inferred from its characters.  Against that
encoding's alphabet three tests are taken: chi-squared uniformity of the symbol
counts, the runs test on symbols above and below the alphabet's middle, and the
lag-one serial correlation of symbol ranks.  A candidate that any of them
rejects as random is dropped.  For the others, the probability that written text
of that length would look as uniform as this is the p-value; a step-up
procedure over a document's candidates, weighted by length because longer runs
carry more evidence, holds the expected share of false discoveries.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from barspark.llm.common import texts

#: The base patterns, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

#: Alphabets of the encodings, the narrowest first; each in the order of its symbol values.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_RANKS = {name: {c: i for i, c in enumerate(letters)} for name, letters in ENCODINGS.items()}


@dataclass(frozen=True)
class BatteryConfig:
    """``accept``: level of each randomness test; ``fdr``: expected share of false discoveries.

    ``repeat`` is the chance that two characters of written text of an encoding's
    size are equal, times that size: 1 for random symbols, about 2 for text.
    ``cased`` and ``uncased`` are the rates at which joined words change between
    digits, small and capital letters, with and without capitals inside.
    """

    accept: float = 0.001
    fdr: float = 0.02
    repeat: float = 2.0
    cased: float = 0.33
    uncased: float = 0.12
    usual_length: int = 32


def _normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer_encoding(token: str) -> str | None:
    """The narrowest encoding whose alphabet holds the token and that its character kinds make plausible."""
    body = token.rstrip("=")
    kinds = sum((any(c.isdigit() for c in body), any("a" <= c <= "z" for c in body), any("A" <= c <= "Z" for c in body)))
    if kinds < 2:  # letters of one case alone, or digits alone, are words and numbers
        return None
    have = set(body)
    return next((name for name, ranks in _RANKS.items() if have <= ranks.keys()), None)


def chi_squared(ranks: list[int], size: int) -> float:
    expected = len(ranks) / size
    counts = Counter(ranks)
    return sum((n - expected) ** 2 for n in counts.values()) / expected + expected * (size - len(counts))


def chi_squared_upper(x: float, free: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    spread = 2 / (9 * free)
    return _normal_upper(((x / free) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


def runs_test(ranks: list[int], size: int) -> float:
    """Two-sided p-value of the number of runs above and below the alphabet's middle."""
    high = [2 * r >= size for r in ranks]
    up, down = sum(high), len(high) - sum(high)
    if not up or not down:
        return 0.5 ** (len(high) - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    n = up + down
    mean = 1 + 2 * up * down / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_test(ranks: list[int]) -> float:
    """Two-sided p-value of the lag-one correlation of symbol ranks."""
    n = len(ranks)
    mean = sum(ranks) / n
    power = sum((r - mean) ** 2 for r in ranks)
    if not power:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in zip(ranks, ranks[1:])) / power
    return _two_sided((r + 1 / n) * math.sqrt(n))


def text_p_value(token: str, config: BatteryConfig = BatteryConfig()) -> float:
    """How likely written text of this length would pass for random; 1 where a test rejects randomness."""
    name = infer_encoding(token)
    if name is None:
        return 1.0
    ranks = [_RANKS[name][c] for c in token.rstrip("=")]
    n, size = len(ranks), len(ENCODINGS[name])
    x = chi_squared(ranks, size)
    if min(chi_squared_upper(x, size - 1), runs_test(ranks, size), serial_test(ranks)) < config.accept:
        return 1.0
    shift = (n - 1) * (config.repeat - 1)  # what text adds to the statistic on average
    uniform = _normal_upper((size - 1 + shift - x) / math.sqrt(2 * (size - 1) + 4 * shift))
    # written names change between digits, small and capital letters rarely, random symbols most of the time
    kind = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in token.rstrip("=")]
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    rare = config.cased if 1 in kind and 2 in kind else config.uncased
    changing = sum(math.comb(n - 1, i) * rare**i * (1 - rare) ** (n - 1 - i) for i in range(changes, n)) if n <= 512 else _normal_upper((changes - rare * (n - 1)) / math.sqrt(rare * (1 - rare) * (n - 1)))
    both = max(uniform, 1e-300) * max(min(changing, 1.0), 1e-300)
    return min(1.0, both * (1 - math.log(both)))  # Fisher's combination of two


def discoveries(p_values: list[float], sizes: list[int], config: BatteryConfig = BatteryConfig()) -> list[bool]:
    """Weighted step-up procedure; weights grow with the square root of length and average one."""
    if not p_values:
        return []
    weights = [math.sqrt(s / config.usual_length) for s in sizes]
    mean = sum(weights) / len(weights)
    scaled = [p * mean / w for p, w in zip(p_values, weights)]
    order = sorted(range(len(scaled)), key=scaled.__getitem__)
    last = max((i for i, j in enumerate(order, 1) if scaled[j] <= config.fdr * i / len(order)), default=0)
    bar = scaled[order[last - 1]] if last else -1.0
    return [s <= bar for s in scaled]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns as (start, end, kind), by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def random_spans(text: str, taken: list[tuple[int, int, str]], config: BatteryConfig = BatteryConfig()) -> list[tuple[int, int, str]]:
    """Candidates outside the taken spans, which come by start, that the battery finds random."""
    starts = [s for s, _, _ in taken]
    reach = [0, *accumulate((e for _, e, _ in taken), max)]  # how far the first spans go
    tokens = [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]
    tokens = [(a, b) for a, b in tokens if reach[bisect_left(starts, b)] <= a and infer_encoding(text[a:b])]
    chosen = discoveries([text_p_value(text[a:b], config) for a, b in tokens], [b - a for a, b in tokens], config)
    return [(a, b, "random") for (a, b), good in zip(tokens, chosen) if good]


def _scan(config: BatteryConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                own = base_spans(text) if text else []
                added = random_spans(text, own, config) if text else []
                write = lambda found: [f"{kind}:{a}:{b}" for a, b, kind in found]
                base.append(write(own))
                spans.append(write(sorted(own + added, key=lambda s: (s[0], KINDS.index(s[2])))))
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(spans, kind)], ["doc_id", "base", "spans"])

    return run


def find_secrets(documents: DataFrame, config: BatteryConfig = BatteryConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of ``kind:start:end`` in code points, end exclusive) of every row.

    ``base`` holds the patterns' spans, ``spans`` these and the battery's.  Rows
    are independent: null and empty texts have no spans, repeated rows the same
    ones, an empty table gives no rows.
    """
    return texts(documents, key, text).mapInArrow(_scan(config), "doc_id long, base array<string>, spans array<string>")
