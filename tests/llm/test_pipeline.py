"""Each stage of the pipeline against a plain version of what it says, on its predecessor's result."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from barspark.llm import mixing, queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of the documents and after each stage, by doc_id."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        path = f"file://{tmp_path_factory.mktemp(name)}/out"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
    return kept


def test_language_keeps_texts_with_letters(stages):
    before, after = ({r.doc_id: r for r in rows} for rows in stages[:2])
    gone = before.keys() - after.keys()
    assert all(any(c.isalpha() for c in before[d].text or "") for d in after)
    assert len(gone) <= 0.02 * len(before)


def test_one_document_of_each_class_stays(stages):
    before, after = stages[1], {r.doc_id for r in stages[2]}
    sets = {}
    for r in before:
        words = re.findall(r"[^\x20\x09-\x0D]+", low(r.text))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert after == {d for d in ids if root(d) == d}


def test_benchmark_passages_go(spark, stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = word.findall(low(r.text))
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        words = word.findall(low(text))
        return not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    assert {r.doc_id for r in stages[3]} == {r.doc_id for r in stages[2] if clean(r.text)}


def test_copies_are_as_many_as_the_rates_say(spark, stages):
    """Each document stands floor(rate) times and now and then once more; on average its rate."""
    docs = spark.createDataFrame(stages[3])
    rates = {r.doc_id: r.rate for r in mixing.mix(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    count = {}
    for r in stages[4]:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert all(np.floor(rates[d]) <= count.get(d, 0) <= np.ceil(rates[d]) for d in rates)
    assert abs(sum(count.values()) - sum(rates.values())) <= 4 * np.sqrt(len(rates))


def test_mixing_meets_the_targets_in_tokens(spark):
    """Domains' expected tokens among the copies that the stage keeps, on tables with labels enough to learn from."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    mixed = {r.doc_id: r for r in mixing.mix(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet")).collect()}
    kept = [r.doc_id for r in corpus_pipeline.mixed(spark, docs, MIDDLE).select("doc_id").collect()]
    tokens = sum(r.n_tokens for r in mixed.values())
    for i, share in enumerate((0.81, 0.09, 0.0)):
        assert sum(mixed[d].n_tokens * mixed[d].posterior[i] for d in kept) / tokens == pytest.approx(share, abs=0.05)


def test_records_hold_every_copy(stages):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(queries.tokenizer_path())
    rows = sorted(stages[4], key=lambda r: (r.doc_id, r.text))
    got = sorted(stages[5], key=lambda r: (r.start,))
    assert len(got) == len(rows)
    start = 0
    for r, out in zip(rows, got):
        ids = encode.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (out.doc_id, out.start, out.n_tokens, out.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_is_its_stages(spark, stages):
    digest = lambda rows: hashlib.sha256(repr(sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows)).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, SMALL).collect()) == digest(stages[5])
