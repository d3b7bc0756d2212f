"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
import pytest

from barspark.llm import ann, decontam, langid, lengths, mixing, neardup, records, secrets, substrings, tokens


def covered(texts, least):
    """Removed bytes of each text, in order, by brute force."""
    seen, out = set(), []
    for text in texts:
        cover = np.zeros(len(text), bool)
        for i in range(len(text) - least + 1):
            window = text[i : i + least]
            if window in seen:
                cover[i : i + least] = True
            seen.add(window)
        out.append(int(cover.sum()))
    return out


def quotes(n):
    """One passage in n contexts, and some whole copies of texts."""
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    passage = word(220)
    texts = [word(90) + passage + word(90) for _ in range(n)]
    return texts + texts[: n // 4]


@pytest.mark.parametrize("most_runs", [4096, 8])
def test_op7_crowded_anchor(spark, most_runs):
    texts = quotes(60)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    config = substrings.RepeatConfig(most_runs=most_runs)
    got = {r.doc_id: r.n_removed for r in substrings.repeated_bytes(frame, config).collect()}
    assert [got[i] for i in range(len(texts))] == covered([t.encode() for t in texts], 100)


def test_op7_blocks_hold_no_copies_of_a_window():
    """A crowded anchor's equal windows cross no block, however many they are."""
    import pyarrow as pa

    config = substrings.RepeatConfig(most_runs=4)
    text = quotes(1)[0]
    runs = [{"first": 0, "windows": 3, "anchor": 1, "split": True}]
    column = pa.array([runs] * 100, pa.list_(pa.struct([("first", pa.int64()), ("windows", pa.int64()), ("anchor", pa.int64()), ("split", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([0] * 100), column, pa.array([text] * 100)], ["doc", "tie", "runs", "text"])
    pieces = pa.Table.from_batches(list(substrings._pieces(config)(iter([batch]))))
    assert pieces.column("data").null_count == 300
    pieces = pieces.sort_by([(c, "ascending") for c in ("anchor", "part", "more", "doc", "tie", "first")])
    spans = [s for b in substrings._blocks(config)(iter(pieces.to_batches())) for s in b.to_pylist()]
    assert len(spans) == 297 and all(s["doc"] > 0 and s["end"] == s["first"] + 100 for s in spans)


def test_op7_symbols_beyond_the_packing_width_are_an_error():
    with pytest.raises(ValueError):
        substrings.suffix_order(np.array([0, (1 << 16) - 1, 3]), 101)


def test_op7_does_not_depend_on_how_a_second_reading_cuts_the_files(spark, tmp_path, monkeypatch):
    texts = [quotes(1)[0]] * 8
    for i, text in enumerate(texts):
        spark.createDataFrame([(i, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    write = substrings.Workspace.table

    def table(self, name, frame):
        out = write(self, name, frame)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # as if executors had come or gone
        return out

    monkeypatch.setattr(substrings.Workspace, "table", table)
    try:
        got = {r.doc_id: r.n_removed for r in substrings.repeated_bytes(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got[i] for i in range(8)] == [0] + [len(texts[0])] * 7


def test_pipeline_mixing_keeps_the_fitted_tokens_by_domain(spark):
    rng = random.Random(3)
    words = {d: [f"{d}{i}" for i in range(60)] for d in ("good", "poor", "toxic")}
    kind = ["poor" if i % 3 == 0 else "toxic" if i % 20 == 1 else "good" for i in range(3000)]
    docs = [(i, " ".join(rng.choices(words[d], k=40))) for i, d in enumerate(kind)]
    labels = [(i, int(d == "good"), int(d == "toxic")) for i, d in enumerate(kind) if i < 1200]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    mixed = mixing.mix(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = [r.doc_id for r in mixing.apply_rates(docs, mixed).select("doc_id").collect()]
    for domain, share in (("good", 0.81), ("poor", 0.09), ("toxic", 0.0)):
        assert sum(kind[i] == domain for i in kept) / len(kind) == pytest.approx(share, abs=0.02)


def by_query(frame):
    out = {}
    for r in frame.orderBy("rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_op4_every_query_gets_its_neighbours(spark):
    """Few candidates, outlying norms and a far small cluster."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 8))
    vectors[::100] *= 50.0 ** rng.uniform(0, 1, size=(30, 1))
    vectors[5] = vectors[6] = vectors[200] = 900.0
    vectors[6] += 0.5
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000 + i, [1.0, 2.0, float(i)]) for i in range(4)] + [(9000, [1.0, 2.0, 1e6])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 100 = 0 and vec_id <> 5000")
    got = by_query(ann.nearest(frame, asked, k=10))
    assert got[9000] == [5003, 5002, 5001, 5000]
    assert got[200][:2] == [5, 6]
    met = 0
    for q in range(0, 3000, 100):
        apart = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        best = [int(i) for i in np.lexsort((np.arange(3000), apart)) if i != q][:10]
        assert len(got[q]) == 10
        met += len(set(best) & set(got[q]))
    assert met >= 0.9 * 300


def test_op7_a_repeated_row_is_one_document(spark):
    texts = quotes(3)[:3]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts) for _ in range(3)], "doc_id long, text string")
    for parts in (1, 5):
        rows = substrings.repeated_bytes(frame.repartition(parts)).collect()
        assert len(rows) == 9
        assert [{r.n_removed for r in rows if r.doc_id == i} for i in range(3)] == [{n} for n in covered([t.encode() for t in texts], 100)]


def test_op7_common_runs_are_settled_where_they_are_read():
    """Of a very common run, a task sends one row to its anchor; the others go anywhere."""
    import pyarrow as pa

    text = quotes(1)[0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([0] * 500), pa.array([text] * 500)], ["doc", "tie", "text"])
    runs = pa.Table.from_batches(list(substrings._runs(substrings.RepeatConfig())(iter([batch]))))
    salted = [r["salt"] > 0 for r in runs.to_pylist()]
    assert sum(not s for s in salted) * 500 == len(salted)
    assert all(r["doc"] == 0 for r in runs.to_pylist() if r["salt"] == 0)


def test_op7_long_texts_and_resolving_across_batches(spark):
    """A text of more than one segment, and groups that go on over many small batches."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij ") for _ in range((4 << 20) + 5000))
    passage = long[(4 << 20) - 300 : (4 << 20) + 300]  # crosses the segment's edge
    texts = [long, passage + "x" * 30, "y" * 20 + passage]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, "7")
    try:
        got = {r.doc_id: r.n_removed for r in substrings.repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset(conf)
    assert [got[i] for i in range(3)] == covered([t.encode() for t in texts], 100)


def near_classes(sets, percent):
    """Smallest id reachable over links, by brute force."""
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("crowd", [0, 1 << 20])
def test_op3_buckets_of_several_components(spark, crowd):
    """Unlike documents around one common passage, with near copies in between, in pairs and by rarest shingles."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = words(150)
    texts = {}
    for i in range(60):
        own = words(50)
        texts[2 * i] = common + own
        texts[2 * i + 1] = common + own[:46] + words(4) if i % 2 else common + words(50)
    sets = {d: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} for d, t in texts.items()}
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, neardup.MinMaxConfig(crowd=crowd)).collect()}
    assert got == near_classes(sets, 80)


def test_op3_an_id_with_different_texts_gives_the_same_every_time(spark):
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "a b c d e f g h"), (3, "p q r s t u v w"), (4, "x y z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3):
        got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(frame.repartition(parts)).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_op5_blocks_of_a_large_benchmark(spark):
    """The join gives what the index gives, with a passage that all documents share and blocks of few items."""
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    common = words(14)
    items = [(f"i{i}", " ".join(words(20) + (common if i % 3 == 0 else words(5)))) for i in range(40)] + [("s", "lone short"), ("n", None)]
    docs = [(i, " ".join(words(30) + common + items[i % 40][1].split()[:12])) for i in range(50)] + [(99, None), (100, "a lone short one")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    by_index, by_join = ({(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.spans)) for r in decontam.contamination(docs, items, decontam.WinnowConfig(index_bytes=n)).collect()} for n in (1 << 20, 1500))
    assert by_index == by_join and sum(r[2] > 0 for r in by_join) == 51


SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(folder, name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def plain_posteriors(folder, config):
    """Posteriors and words of every document by a naive Bayes classifier of its own."""
    import math
    import re
    from collections import Counter

    names = sorted(config.targets)
    split = lambda text: re.split(r"[\s.,;:!?|\"'()\[\]*#&%$]+", (text or "").lower(), flags=re.ASCII)

    def traits(text):
        text, size = text or "", len(text or "")
        tests = {
            " capitals": len(re.findall("[A-Z]", text)) * 3 > size, " marks": len(re.findall(r"[#*&%$]{2,}", text)) * 50 > size,
            " shouts": (size - len(text.replace("!!", ""))) * 15 > size, " bars": text.count("|") * 40 > size, " short": size < 60,
        }
        return {n for n, t in tests.items() if t}

    docs = {r["doc_id"]: r["text"] for r in table(folder, "documents")}
    label = {}
    for r in table(folder, "labels"):
        d = "toxic" if r["toxic"] == 1 else "good" if r["quality"] == 1 else "poor" if r["quality"] == 0 else None
        if d and r["doc_id"] in docs:
            label[r["doc_id"]] = min(d, label.get(r["doc_id"], d))
    evidence = {d: (set(split(t)) | traits(t)) - {""} for d, t in docs.items()}
    size = Counter(label.values())
    seen = {d: Counter(w for i, own in label.items() if own == d for w in evidence[i]) for d in names}
    weights, absent = {}, [0.0] * len(names)
    for word in set().union(*seen.values()):
        n = [seen[d][word] for d in names]
        logs = [math.log((c + 0.5) / (size[d] + 1)) for c, d in zip(n, names)]
        top = sorted(logs)
        if sum(n) >= config.support and (top[-1] - top[-2]) * math.sqrt(sum(n)) >= config.telling - 1e-12:
            none = [math.log1p(-(c + 0.5) / (size[d] + 1)) for c, d in zip(n, names)]
            weights[word] = [a - b for a, b in zip(logs, none)]
            absent = [a + b for a, b in zip(absent, none)]
    prior = [math.log((size[d] + 1) / (sum(size.values()) + len(names))) + a for d, a in zip(names, absent)]
    out = {}
    for doc, text in docs.items():
        score = [p + sum(weights[w][i] for w in evidence[doc] if w in weights) for i, p in enumerate(prior)]
        odds = [math.exp(s - max(score)) for s in score]
        words = split(text)
        out[doc] = ([x / sum(odds) for x in odds], len(words) - (words[0] == "") - (len(words) > 1 and words[-1] == ""))
    return names, out


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_op8_against_plain_naive_bayes_and_least_squares(spark, folder):
    from barspark.llm import queries

    config = mixing.MixConfig()
    names, plain = plain_posteriors(folder, config)
    rows = {r.doc_id: r for r in queries.op8_soft_mixing(spark, folder).collect()}
    assert rows.keys() == plain.keys()
    for doc, (posterior, words) in plain.items():
        assert [rows[doc][f"p_{n}"] for n in names] == pytest.approx(posterior, abs=1e-9) and rows[doc].n_tokens == words
    tokens = np.array([plain[d][1] for d in plain], float)
    p = np.array([plain[d][0] for d in plain])
    size = tokens @ p / tokens.sum()
    target = np.array([config.targets[n] for n in names]) * config.budget
    error = lambda rate: float(np.sum(((tokens * rate) @ p / tokens.sum() - target)[size > 0] ** 2 / size[size > 0]))
    # projected gradient descent without any haste
    rate = np.ones(len(tokens))
    step = 1 / np.max(((p * tokens[:, None]).T @ p / tokens.sum() / np.sqrt(np.outer(size, size))).sum(1))
    for _ in range(20000):
        rate = np.maximum(0, rate - step * (p @ (((tokens * rate) @ p / tokens.sum() - target) / size)))
    own = np.array([rows[d].rate for d in plain])
    assert (own >= 0).all() and error(own) <= error(rate) + 1e-6
    if folder == MIDDLE:  # with labels enough to learn from, by exact posteriors of the plain classifier
        assert (tokens * own) @ p / tokens.sum() == pytest.approx(target, abs=1e-3)


def test_op8_more_words_than_the_constant_set(spark):
    """Words that are joined give what words of the constant set give."""
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{n}.parquet") for n in ("documents", "labels"))
    inline, joined = ({r.doc_id: (r.n_tokens, r.posterior) for r in mixing.mix(docs, labels, mixing.MixConfig(inline=n, steps=1)).collect()} for n in (20000, 0))
    assert inline == joined


def random_string(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_op1_battery_finds_random_strings_and_few_others():
    """Planted random strings are found, alone and several in a text; of names made of words hardly any."""
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = ["get", "user", "name", "value", "Index", "Table", "for", "Node", "list", "Parser", "http", "Error", "data", "Set", "2", "64", "v1", "config", "Builder"]
    found = planted = false = 0
    for _ in range(200):
        secrets_here = [random_string(rng, letters, rng.choice([32, 40, 48, 64])) for _ in range(rng.choice([1, 5]))]
        names = ["".join(rng.choice(parts) for _ in range(rng.randint(5, 8))) for _ in range(4)]
        text = " and ".join(secrets_here + [n for n in names if len(n) >= 16])
        spans = [text[a:b] for a, b, _ in secrets.random_spans(text, [])]
        planted += len(secrets_here)
        found += sum(s in spans for s in secrets_here)
        false += sum(s not in secrets_here for s in spans)
    assert found >= 0.9 * planted
    assert false <= 0.05 * (found + false)


def test_op1_tests_reject_what_is_not_random():
    size = 64
    flat = list(range(size)) * 4
    assert secrets.runs_test(flat, size) < 1e-6 and secrets.serial_test(flat) < 1e-6  # rising ranks
    assert secrets.chi_squared_upper(secrets.chi_squared([0] * 100, size), size - 1) < 1e-6
    rng = random.Random(2)
    ranks = [rng.randrange(size) for _ in range(400)]
    assert min(secrets.runs_test(ranks, size), secrets.serial_test(ranks), secrets.chi_squared_upper(secrets.chi_squared(ranks, size), size - 1)) > 1e-3


def test_op1_very_long_text():
    text = "word " * 60000 + "token: abcdef123456 " + "x1Y" * 200000
    assert secrets.base_spans(text) == [(300000, 300019, "assign")]


def test_op10_machine_separates_with_the_largest_margin():
    """Against a plain solver of the same problem, and on languages alone in their family."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.normal(size=80) > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    z = np.hstack([x, np.ones((80, 1))])
    loss = lambda w: 0.5 * 1e-4 * w @ w + float(share @ np.maximum(0, 1 - y * (z @ w)) ** 2)
    w = np.zeros(7)
    for _ in range(60000):
        slack = np.maximum(0, 1 - y * (z @ w))
        w -= 0.2 * (1e-4 * w - 2 * z.T @ (share * y * slack))
    assert loss(langid.fit_svm(x, y, 3000, 1e-4)) <= loss(w) + 1e-4


@pytest.mark.parametrize("langs", [["en"], ["en", "de"], ["en", "fr"]])
def test_op10_few_languages(spark, langs):
    """One language, two of one family, two families."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where(" or ".join(f"lang = '{x}'" for x in langs))
    from pyspark.sql import functions as F

    model = langid.train(docs, F.lit(True))
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    letters = [r for r in rows if r.lang_pred != langid.UNKNOWN]
    assert model.langs == sorted(langs) and sum(r.lang_pred == r.lang for r in letters) >= 0.95 * len(letters)


def test_language_stage_rejects_junk_and_keeps_documents(spark):
    """Texts with letters that are like no learned language go; labelled ones stay."""
    rng = random.Random(8)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    junk = [
        "".join(rng.choice("xqzjkvw bcdfg") for _ in range(900)), " ".join(random_string(rng, "0123456789abcdef", 40) for _ in range(30)), "%% 12 $$ 99 ## a 17 && 5 " * 40, "ZZXXQ " * 200,
    ]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    kept = {r.doc_id for r in langid.drop_unidentified(docs.unionByName(more, allowMissingColumns=True)).select("doc_id").collect()}
    assert not kept & {10**6 + i for i in range(len(junk))}
    assert len(kept) >= 0.98 * docs.count()


def test_long_texts_are_encoded_in_parts(spark, tmp_path):
    """Texts above a block of the encoder, with and without blanks."""
    from tokenizers import Tokenizer

    from barspark.llm.queries import tokenizer_path

    rng = random.Random(3)
    words = ["alpha", "Beta", "naïve", "x1y2", "end.", "(so)", "…"]
    texts = [" ".join(rng.choice(words) for _ in range(90000)), "ab" * 200000, "\n".join(rng.choice(words) * 3 for _ in range(40000)) + " "]
    assert min(len(t.encode()) for t in texts) > 1 << 18
    plain = Tokenizer.from_file(tokenizer_path())
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    got = list(tokens.PieceEncoder(tokenizer_path()).encode([t.encode() for t in texts]))
    assert [g.tolist() for g in got] == expected
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = f"file://{tmp_path}/long"
    index = records.write_records(frame, path, records.RecordConfig(tokenizer_path(), 2, file_bytes=1 << 16))
    back = records.with_starts(records.read_records(spark, path), index).orderBy("doc_id").collect()
    assert [r.ids for r in back] == [e + [2] for e in expected]
    assert [r.start for r in back] == np.cumsum([0, *(len(e) + 1 for e in expected[:-1])]).tolist()
    assert sorted(r.n_tokens for r in lengths.token_counts(frame, tokenizer_path()).collect()) == sorted(map(len, expected))


def test_op4_ties_at_the_last_rank(spark):
    """Equal distances go to the smaller ids, copies of one vector included."""
    rows = [(0, [0.0, 1.0])] + [(i, [1.0, 1.0]) for i in range(1, 9)] + [(i, [-1.0, 1.0]) for i in range(9, 30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert by_query(ann.nearest(frame, frame.where("vec_id = 0")))[0] == list(range(1, 11))


def test_op4_share_of_vectors_met_falls_with_their_number():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(2000, 64))
    shares = [ann.plan(vectors, n, 10, ann.ProbeConfig()).share for n in (2000, 10**6, 10**9)]
    assert shares[0] > shares[1] > shares[2]


def test_a_session_on_a_cluster_needs_a_shared_folder():
    from barspark.llm.common import shared_dir

    class Conf:
        def __init__(self, values):
            self.get = lambda key, default=None: values.get(key, default)

    class Session:
        pass

    session = Session()
    session.conf = Conf({"spark.master": "yarn"})
    with pytest.raises(ValueError):
        shared_dir(session)
    session.conf = Conf({"spark.master": "local-cluster[2,1,1024]"})
    with pytest.raises(ValueError):
        shared_dir(session)
    session.conf = Conf({"spark.master": "local[*]"})
    assert shared_dir(session).startswith("file://")
