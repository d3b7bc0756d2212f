"""Alignment, lexical search and quality against plain versions, and token ids against the libraries."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import align, lexical, quality
from barspark.llm.queries import TOKENIZER_A, TOKENIZER_B, tokenizer_path
from barspark.llm.tokens import PieceEncoder

SMALL = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def config():
    return align.AlignConfig(tokenizer_path(TOKENIZER_A), tokenizer_path(TOKENIZER_B))


@pytest.fixture(scope="module")
def libraries(config):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(config.path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=config.path_b)


def odd_texts(n, seed, longest=14):
    rng = random.Random(seed)
    signs = [*"abcABCxyz019.,;:!?'-\"   \n\t\r\v\x1c\x00", *"İıßéÉñÑüΣςЖ̇́あ中  ▁🙂\x85 ᠎ﬁΩK", "<|endoftext|>", "<s>", "<0x0A>", "'s", "  ", "ing", " the", "GELDİ."]
    return ["".join(rng.choices(signs, k=rng.randint(0, longest))) for _ in range(n)]


def test_word_tokens_equal_the_library():
    own = PieceEncoder(tokenizer_path())
    texts = odd_texts(20_000, 1) + ["GELDİ.", "İ!", "İ,x İ.", "A.B. c! é. ß? x."]
    wrong = [t for t, ids in zip(texts, own.encode(t.encode() for t in texts)) if ids.tolist() != own.whole(t)]
    assert not wrong


# --- alignment


def spelled(libraries, text):
    """Ids and bytes of each token by both, straight from the libraries; none where bytes are not kept."""
    a, b = libraries
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    whole = (" " + text).encode()
    return (ids_a, of_a, ids_b, of_b) if text and b"".join(of_a) == whole == b"".join(of_b) else None


def plain_alignment(libraries, rows):
    """(doc_id, n_a, n_b, groups, links, written groups) of each row, then n_best and count_sum."""
    found, count = [], Counter()
    for doc_id, text in rows:
        got = spelled(libraries, text or "")
        if not got:
            found.append((doc_id, 0, 0, [], ""))
            continue
        ids_a, of_a, ids_b, of_b = got
        end_a, end_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        written, links = [], [(a, b) for a, x in zip(ids_a, end_a) for b, y in zip(ids_b, end_b) if x == y] if len(ids_a) < 400 else [(a, ids_b[end_b.index(x)]) for a, x in zip(ids_a, end_a) if x in end_b]
        low = -1
        for cut in sorted(set(end_a) & set(end_b)):
            group = (",".join(str(i) for i, x in zip(ids, ends) if low < x <= cut) for ids, ends in ((ids_a, end_a), (ids_b, end_b)))
            written.append("|".join(group))
            low = cut
        count.update(links)
        found.append((doc_id, len(ids_a), len(ids_b), links, ";".join(written)))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [
        (doc_id, n_a, n_b, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if n_a else "")
        for doc_id, n_a, n_b, links, text in found
    ]


def test_pieces_of_both_tokenizers_equal_the_libraries(config, libraries):
    own = align.Both(config, block=64)
    texts = odd_texts(12_000, 2)
    for text, got in zip(texts, own.encode(t.encode() for t in texts)):
        want = spelled(libraries, text)
        assert (got is None) == (want is None), text
        assert got is None or (got[0].tolist(), got[1].tolist()) == (want[0], want[2]), text


@pytest.mark.parametrize("change", [{}, {"stretch": 7}, {"most_pairs": 0}, {"stretch": 5, "most_pairs": 0}])
def test_alignment_against_a_plain_version(spark, config, libraries, change):
    texts = odd_texts(150, 3, 40) + ["", "a", " ", "The cat.\n\nSat  down", "▁no", "<s> plain <|endoftext|>", "x" * 300 + " end", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id"), (7, "another text of seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as row", "1 as n_a", "2 as pair").repartition(3)
    got = align.align(docs, align.AlignConfig(**(vars(config) | change)))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_alignment(libraries, rows), key=key)


def test_alignment_of_a_long_text_and_of_nothing(spark, config, libraries):
    text = " ".join(odd_texts(3_000, 4, 10)).replace("▁", "").replace("\x85", "")
    long = text * 30
    assert len(long) > 1 << 19
    rows = [(1, text), (2, None), (3, long)]
    got = {r.doc_id: r for r in align.align(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()}
    want = spelled(libraries, long)
    assert want and (got[3].n_a, got[3].n_b) == (len(want[0]), len(want[2])) and got[3].n_links > 1 << 16 and got[2].n_a == 0
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), config).count() == 0


# --- search


def plain_search(docs, items, k=50):
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    bags = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    bags = [(d, c, c.total()) for d, c in bags if c]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    asked: dict = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(terms(text))
    out = []
    for item_id, own in asked.items():
        found = []
        for doc_id, c, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, i + 1, doc_id, -score) for i, (score, _, doc_id) in enumerate(found[:k])]
    return out


def words_of(rng, n, skew=1.3):
    return " ".join(f"w{min(300, int(rng.paretovariate(skew)))}" for _ in range(n))


@pytest.mark.parametrize("change", [{}, {"shard": 7, "k": 3}, {"block_terms": 20, "shard": 50}, {"k": 1}])
def test_search_against_a_plain_version(spark, change):
    rng = random.Random(8)
    docs = [(i, words_of(rng, rng.randint(0, 80))) for i in range(700)]
    docs += [(i, docs[i % 5][1].upper()) for i in range(700, 760)] + [(None, docs[3][1]), (5, docs[5][1]), (900, None), (901, ""), (902, "?!"), (903, "É é w1 İ")]
    items = [(f"i{i}", words_of(rng, 12)) for i in range(25)] + [("i3", "w7 é"), (None, "w2 w9"), ("none", None), ("empty", "..."), ("lost", "zzz qqq")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as terms").repartition(4), spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "3 as term"), lexical.SearchConfig(**change))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_search(docs, items, change.get("k", 50)), key=key)


def test_search_probes_little_once_the_best_are_known():
    """A common term's list is not read for documents that cannot qualify."""
    rng = np.random.default_rng(1)
    ids = np.arange(4000)
    items = lexical.Items(["x"], np.zeros(2, np.int64), np.array([10, 20], np.uint64), np.array([1, 5000], np.int64))
    shard = lexical.Shard(items, ids, np.full(4000, 100), np.full(4000, 1), np.where(rng.random(4000) < 0.01, 20, 10).astype(np.uint64), np.ones(4000, np.int64))
    score, found = shard.search(items.of[0], 1_000_000)
    assert len(found) == int((np.diff(shard.start))[1]) and score.min() > 1_000_000
    assert len(shard.search(items.of[0], 2 * 10**9)[0]) == 0  # no list is essential: none is read


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(4, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.limit(0), items).columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(lexical.search(docs, items).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


# --- quality


def test_risk_gradients_are_those_of_the_risk():
    rng = np.random.default_rng(2)
    p, u, w = rng.normal(size=(40, 5)), rng.normal(size=(60, 5)), rng.normal(size=5)
    *_, up, down = quality.risk(w, p, u, 0.7)
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        more, less = quality.risk(w + step, p, u, 0.7), quality.risk(w - step, p, u, 0.7)
        assert abs((more[0] - less[0]) / 2e-6 - up[i]) < 1e-6 and abs((more[1] - less[1]) / 2e-6 - down[i]) < 1e-6


@pytest.mark.parametrize("prior", [0.3, 0.85])
def test_classes_part_without_any_negative(prior):
    rng = np.random.default_rng(3)
    config = quality.QualityConfig(shapes=4, steps=300)
    size = 4 + len(quality.PLAIN)
    good, poor = rng.normal(0.6, 0.5, (3000, size)), rng.normal(-0.6, 0.5, (3000, size))
    n = int(3000 * prior)
    unlabelled = np.vstack([good[:n], poor[: 3000 - n]])
    model = quality.fit(rng.normal(0.6, 0.5, (2000, size)), unlabelled, prior, config)
    assert (model.score(good) >= 0.3).mean() > 0.98 and (model.score(poor) < 0.3).mean() > 0.95


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.predict(docs, quality.train(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    good, poor = found[found.quality == 1], found[found.quality == 0]
    above = np.mean([(good.score > s).mean() + 0.5 * (good.score == s).mean() for s in poor.score])
    assert above > 0.99 and (good.predicted == 1).mean() > 0.99 and (poor.predicted == 0).mean() > 0.9
    assert found.score.between(0, 1).all()


def test_quality_edges(spark):
    rows = [(i, "plain words of a quiet text " * (1 + i % 5) if i % 3 else "BUY!! NOW!! " * (1 + i % 4)) for i in range(90)]
    rows += [(None, "text"), (200, None), (201, ""), (0, rows[0][1]), (202, "é" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as quality", "true as good", "9 as score")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(0, 90, 2)] + [(None, 1), (4, None), (2, 1)], "doc_id long, quality int").selectExpr("*", "'t' as text")
    scored = quality.predict(docs, quality.train(docs, labels))
    assert scored.columns == ["doc_id", "score", "predicted"]
    found = scored.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    by_id = {r.doc_id: r.score for r in found}
    assert by_id[200] == by_id[201]
    # nothing to learn from: the prior of one label of each kind
    for own_docs, own_labels in ((docs, labels.limit(0)), (docs.limit(0), labels)):
        model = quality.train(own_docs, own_labels)
        assert {round(r.score, 6) for r in quality.predict(docs, model).collect()} == {round(model.prior, 6)}
    assert quality.predict(docs.limit(0), model).count() == 0
