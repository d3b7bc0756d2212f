"""Work that grows with the text and not with its square, and the same results as the plain way."""

import random
import string
import time

import numpy as np

from barspark.llm import decontam, secrets
from barspark.llm.textnum import ALNUM, words


def covered(values, item, span):
    grams = {tuple(item[i : i + span]) for i in range(len(item) - span + 1)}
    hit = set()
    for p in range(len(values) - span + 1):
        if tuple(values[p : p + span]) in grams:
            hit.update(range(p, p + span))
    return hit


def test_op5_repeated_words_give_the_windows_hits():
    rng = random.Random(1)
    config = decontam.WinnowConfig()
    for _ in range(150):
        alphabet = ["a", "b", "c"][: rng.randint(1, 3)]
        text = lambda n: " ".join(rng.choice(alphabet) if rng.random() < 0.9 else "z" for _ in range(n))
        items = [(f"i{k}", text(rng.randint(10, 200)).encode()) for k in range(3)]
        doc = text(rng.randint(0, 400))
        index = decontam.ItemIndex(items, config)
        got: dict = {}
        for n, a, b in index.spans(words(doc.encode(), ALNUM)):
            got.setdefault(n, set()).update(range(a, b))
        want = {n: covered(doc.split(), item.decode().split(), 10) for n, (_, item) in enumerate(items)}
        assert got == {n: hit for n, hit in want.items() if hit}


def test_op5_one_word_a_hundred_thousand_times():
    index = decontam.ItemIndex([("i", b"again " * 5_000), ("j", b"again and " * 3_000)], decontam.WinnowConfig())
    began = time.process_time()
    found = index.spans(words(b"again " * 100_000, ALNUM))
    assert {n for n, _, _ in found} == {0} and sum(b - a for _, a, b in found) == 100_000
    assert time.process_time() - began < 5


def overlapping(text, taken):
    tokens = [(m.start(), m.end()) for m in secrets.CANDIDATE.finditer(text)]
    return [(a, b) for a, b in tokens if not any(a < e and s < b for s, e, _ in taken)]


def test_op1_candidates_outside_the_taken_spans():
    rng = random.Random(2)
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 30)):
            noise = "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(5, 40)))
            parts.append(rng.choice([f"token={noise}", noise, f"secret: {noise}", "AKIA" + "A1" * 9, "0a" * 14, "plain words here"]))
        text = rng.choice([" ", "\n", "/", "=", ""]).join(parts)
        taken = secrets.base_spans(text)
        assert set((a, b) for a, b, _ in secrets.random_spans(text, taken)) <= set(overlapping(text, taken))
        all_pass = secrets.BatteryConfig(accept=0.0, fdr=1e9)
        kept = [(a, b) for a, b in overlapping(text, taken) if secrets.infer_encoding(text[a:b])]
        assert [(a, b) for a, b, _ in secrets.random_spans(text, taken, all_pass)] == kept


def test_op1_five_megabytes_of_candidates():
    rng = random.Random(3)
    line = "token={} path/{}x1\n"
    text = "".join(line.format("".join(rng.choices(string.ascii_letters, k=20)), "".join(rng.choices(string.ascii_lowercase + string.digits, k=18))) for _ in range(100_000))
    assert len(text) > 5 << 20 or len(text) > 5_000_000
    began = time.process_time()
    own = secrets.base_spans(text)
    secrets.random_spans(text, own)
    assert len(own) == 100_000 and time.process_time() - began < 90


def test_op1_power_by_length():
    """Share of random strings found, alone in a text; short ones carry less evidence, so that fewer pass."""
    rng = random.Random(4)
    alphabets = {"base62": string.ascii_letters + string.digits, "base32": string.ascii_uppercase + "234567"}
    least = {("base62", 16): 0.45, ("base62", 20): 0.6, ("base62", 24): 0.75, ("base62", 31): 0.85, ("base32", 16): 0.35, ("base32", 24): 0.6, ("base32", 31): 0.8}
    for (name, n), share in least.items():
        found = 0
        for _ in range(200):
            token = "".join(rng.choices(alphabets[name], k=n))
            found += any(a >= 6 for a, _, _ in secrets.random_spans(f"words {token} words", []))
        assert found / 200 >= share, (name, n, found / 200)
