"""URL rules as a bit-parallel wildcard automaton.

All glob patterns of all rules are packed behind one another into the bits of
several 64-bit words.  Bit i stands for "the first i items of the pattern are
matched"; one step of Shift-And with a carry between words, masked by the
current byte, advances every pattern at once, and wildcards are states that keep
themselves.  Steps run over a whole batch of URLs in lockstep.

A pattern matches a canonical URL ``host`` + ``path`` from end to end.  ``*``
stands for any bytes; in the host part it stops before the first ``/``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and all its subdomains where the path starts with ``path``.

    Host and path may hold ``*``.  The longest matching rule wins, the first of
    equally long ones.  ``name`` is what a match reports.
    """

    verdict: str
    host: str
    path: str
    named: bool = True

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def patterns(self) -> list[str]:
        anywhere = [self.host] if self.host == "*" else [self.host, f"*.{self.host}"]
        return [f"{host}{self.path}*" for host in anywhere]


@dataclass(frozen=True)
class Automaton:
    """Masks per byte (256 x words), start and final states, and each final state's rule."""

    step: np.ndarray
    keep: np.ndarray
    start: np.ndarray
    final_word: np.ndarray
    final_bit: np.ndarray
    final_rule: np.ndarray

    @property
    def words(self) -> int:
        return self.step.shape[1]

    def match(self, urls: list[bytes], rank: np.ndarray) -> np.ndarray:
        """Number of the best-ranked rule of each URL, or -1."""
        order = np.argsort([len(u) for u in urls], kind="stable")[::-1]
        lengths = np.array([len(urls[i]) for i in order], np.int64)
        text = np.frombuffer(b"".join(urls[i] for i in order) + b"\0", np.uint8)
        begin = np.cumsum(lengths) - lengths
        state = np.repeat(self.start[None, :], len(urls), 0)
        for at in range(int(lengths[0]) if len(lengths) else 0):
            alive = int(np.searchsorted(-lengths, -at, "left"))  # URLs longer than at come first
            byte = text[begin[:alive] + at]
            now = state[:alive]
            moved = now << U64(1)
            moved[:, 1:] |= now[:, :-1] >> U64(63)
            state[:alive] = moved & self.step[byte] | now & self.keep[byte]
        hits = state[:, self.final_word] >> self.final_bit & U64(1) == 1
        best = np.where(hits, rank[self.final_rule][None, :], len(rank))
        chosen = best.min(1, initial=len(rank)) if best.shape[1] else np.full(len(urls), len(rank))
        by_rank = np.append(np.argsort(rank, kind="stable"), -1)
        out = np.empty(len(urls), np.int64)
        out[order] = by_rank[chosen]
        return out


def compile_rules(rules: list[Rule]) -> Automaton:
    """Pack the patterns of all rules into as many words as they need."""
    items: list[tuple[int, list[tuple[str, int]]]] = []
    for number, rule in enumerate(rules):
        for pattern in rule.patterns:
            states: list[tuple[str, int]] = []  # (kind of loop on the state before, byte)
            data, loop, in_host = pattern.encode(), "", True
            for byte in data:
                if byte == 0x2A:
                    loop = "host" if in_host else "any"
                else:
                    in_host = in_host and byte != 0x2F
                    states.append((loop, byte))
                    loop = ""
            states.append((loop, -1))
            items.append((number, states))
    bits = sum(len(states) for _, states in items)
    words = max(1, -(-bits // 64))
    step, keep, start = np.zeros((256, words), U64), np.zeros((256, words), U64), np.zeros(words, U64)
    finals: list[tuple[int, int, int]] = []
    at = 0
    for number, states in items:
        start[at // 64] |= U64(1) << U64(at % 64)
        for loop, byte in states:
            here, bit = at // 64, U64(1) << U64(at % 64)
            if loop:
                keep[:, here] |= bit
                if loop == "host":
                    keep[0x2F, here] &= ~bit
            if byte >= 0:
                after = at + 1
                step[byte, after // 64] |= U64(1) << U64(after % 64)
            else:
                finals.append((here, at % 64, number))
            at += 1
    word, place, rule = (np.array(x, np.int64) for x in zip(*finals)) if finals else (np.zeros(0, np.int64),) * 3
    return Automaton(step, keep, start, word, place.astype(U64), rule)


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _judge(rules: list[Rule], machine: Automaton, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = machine.match([(h + p).encode("utf-8", "replace") for h, p in zip(hosts, paths)], rank)
            picked = [rules[i] if i >= 0 else None for i in found]
            names = pa.array([r.name if r and r.named else None for r in picked], pa.string())
            verdicts = pa.array([r.verdict if r else "allow" for r in picked], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), names, verdicts], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: list[Rule], otherwise: list[Rule] = (), key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    ``rules`` decide first, the longest match winning.  Where none fits, the
    unnamed globs of ``otherwise`` do, in the same way, and ``allow`` where none
    of those fits either; rule is then null.  A null URL, or one without
    ``://``, has an empty host and path, which only a bare ``*`` could fit.
    Rows are independent; repeated rows and an empty table are nothing special.
    """
    every = [*rules, *(Rule(r.verdict, r.host, r.path, named=False) for r in otherwise)]
    order = sorted(range(len(every)), key=lambda i: (i >= len(rules), -len(every[i].name), i))
    rank = np.empty(len(every), np.int64)
    rank[order] = np.arange(len(every))
    source = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("_url"))
    host, path = canonical(F.col("_url"))
    parts = source.select("page_id", host.alias("host"), path.alias("path"))
    return parts.mapInArrow(_judge(every, compile_rules(every), rank), "page_id long, host string, path string, rule string, verdict string")
