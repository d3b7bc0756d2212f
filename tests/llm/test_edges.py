"""Nulls, empty and long texts, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barspark.llm import ann, decontam, langid, lengths, mixing, neardup, records, secrets, substrings, urlfilter
from barspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string, hash string, copies_ int, mixed_id string, rate double, key string, id string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    more = ("b", "h", 9, "m", 0.5, "k", "i")
    data = [
        (None, None, None, None, None, *more), (1, None, None, None, None, *more), (2, "", "en", "s", 0, *more), (3, "12 34", None, "s", 5, *more),
        (4, LONG, "en", "s", len(LONG), *more), (5, LONG, "en", "s", len(LONG), *more), (6, "one two", "en", "s", 7, *more), (6, "one two", "en", "s", 7, *more),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(frame, key="doc_id"):
    out = {}
    for r in frame.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_secrets(docs, empty):
    got = by_id(secrets.find_secrets(docs))
    assert sum(map(len, got.values())) == 8 and all(not r.base for v in got.values() for r in v)
    assert secrets.find_secrets(empty).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(None, None, "a"), (1, "no scheme", "b"), (2, "http://EXAMPLE.org/es/x?q#f", "c"), (2, "http://EXAMPLE.org/es/x?q#f", "c")], "page_id long, url string, host string")
    rules = [urlfilter.Rule("block", "example.org", "/es/")]
    got = by_id(urlfilter.judge_urls(pages, rules), "page_id")
    assert (got[None][0].host, got[None][0].path, got[None][0].rule) == ("", "", None)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got[2]] == [("example.org", "/es/x", "example.org/es/", "block")] * 2
    assert urlfilter.judge_urls(pages.where("false"), rules).count() == 0


def test_near_duplicates(docs, empty):
    got = by_id(neardup.near_duplicates(docs))
    assert got[5][0].component_id == 4 and not got[5][0].kept and got[4][0].kept
    assert got[None][0].component_id is None and not got[None][0].kept
    assert [got[i][0].n_shingles for i in (1, 2, 3)] == [0, 0, 1] and [r.kept for r in got[6]] == [True, True]
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    data = [(100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 2.0]), (8, [1.5, 2.0]), (9, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x"))
    got = ann.nearest(rows, rows.where("vec_id % 100 = 0"), k=10).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 1, 0.0), (2, 2, 0.0), (3, 8, 0.5)]
    assert ann.nearest(rows.where("false"), rows.where("false")).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([("i1", "one two"), ("i2", None), (None, ""), ("i3", "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id string, text string")
    for config in (decontam.WinnowConfig(), decontam.WinnowConfig(index_bytes=0)):  # by index and by join
        got = by_id(decontam.contamination(docs, items, config))
        assert [(r.n_hit, r["items"]) for r in got[6]] == [(2, ["i1"])] * 2
        assert got[4][0]["items"] == ["i3"] and got[4][0].n_hit == 30000
        assert got[1][0].n_words == got[2][0].n_words == 0 and got[None][0].n_hit == 0
        assert decontam.contamination(empty, items, config).count() == 0
        assert decontam.contamination(docs, items.where("false"), config).where("n_hit > 0").count() == 0
    assert sorted(r.doc_id or 0 for r in decontam.drop_contaminated(docs, items).collect()) == [0, 1, 2, 3]


def test_records_and_lengths(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/a"
    index = records.write_records(docs, path, records.RecordConfig(tokenizer_path()))
    got = by_id(records.with_starts(records.read_records(spark, path), index))
    assert got[None][0].start == 0 and got[1][0].ids == [2] and len(got[6]) == 2 and got[4][0].ids == got[5][0].ids
    path = f"file://{tmp_path}/b"
    index = records.write_records(empty, path, records.RecordConfig(tokenizer_path()))
    assert index.count() == 0
    counts = lengths.token_counts(docs, tokenizer_path(), 1)
    table = lengths.length_histogram(counts).orderBy("n_tokens").collect()
    assert table[0].n_tokens == 1 and table[0].n_docs == 3 and table[-1].quantile == 1.0
    assert lengths.length_histogram(counts.where("false")).count() == 0


def test_repeated_bytes(docs, empty):
    got = by_id(substrings.repeated_bytes(docs))
    assert got[5][0].n_removed == len(LONG) and 0 < got[4][0].n_removed < len(LONG)
    assert got[None][0].n_bytes == 0 and len(got[6]) == 2 and got[6][0].n_removed == 0
    assert substrings.repeated_bytes(empty).count() == 0


def test_mixing(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, None), (6, None, 1), (6, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(mixing.mix(docs, labels))
    assert len(got) == 7 and all(len(v) == 1 and v[0].rate >= 0 for v in got.values()) and got[1][0].n_tokens == 0
    assert mixing.mix(docs, labels.where("false")).count() == 7
    assert mixing.mix(empty, labels).count() == 0
    kept = mixing.apply_rates(docs, mixing.mix(docs, labels))
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


def test_language(docs, empty):
    model = langid.train(docs, F.lit(True))
    got = by_id(langid.predict(docs, model))
    assert got[1][0].lang_pred == got[2][0].lang_pred == got[3][0].lang_pred == "und" and got[4][0].lang_pred == "en"
    assert langid.predict(empty, model).count() == 0
    nothing = langid.train(empty, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.drop_unidentified(docs).columns == docs.columns


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, docs, empty, stage):
    small = "/root/testdata/sf0.001"
    out = stage(spark, docs, small)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns
    assert out.count() <= 8
    assert stage(spark, empty, small).count() == 0
