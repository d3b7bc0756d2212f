"""The corpus operators applied to their whole tables.

Each ``opN_*`` query derives the columns of its contract from its operator's
result.  SQL stands beside it where SQL can express it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import align, ann, decontam, langid, lengths, lexical, mixing, neardup, quality, records, secrets, substrings, urlfilter
from barspark.llm.common import Workspace

#: File of the public tokenizer that the token queries use.
TOKENIZER = "word_bpe_49k.json"
END_ID = 2


#: Files of the two tokenizers that are aligned.
TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"), F.concat_ws(",", "spans").alias("spans"))


#: The rules that the query is given; the longest match wins.
RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]
#: Globs for URLs that no rule fits: markers of pages without text of their own.
GLOBS = [
    urlfilter.Rule("block", "*", "/*.exe"),
    urlfilter.Rule("block", "*", "/*.zip"),
    urlfilter.Rule("block", "*", "/login"),
    urlfilter.Rule("block", "*", "/cart"),
    urlfilter.Rule("block", "*", "/*/wp-admin/"),
    urlfilter.Rule("block", "ads.*", "/"),
]


def op2_shift_and_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_read(spark, sf_dir, "pages"), RULES, GLOBS)


def op3_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), neardup.MinMaxConfig(shingle=4, percent=80))


def op4_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _read(spark, sf_dir, "embeddings")
    found = ann.nearest(embeddings, embeddings.where(F.col("vec_id") % 100 == 0), k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_winnow_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "records").root
    index = records.write_records(_read(spark, sf_dir, "documents"), path, records.RecordConfig(tokenizer_path(), END_ID))
    found = records.with_starts(records.read_checksums(spark, path), index)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_bytes(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    shares = [F.element_at("posterior", i + 1).alias(f"p_{name}") for i, name in enumerate(sorted(mixing.MixConfig().targets))]
    return found.select("doc_id", "n_tokens", "domain", *shares, "rate")


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lengths.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path(), extra=1)
    return lengths.length_histogram(counts)


def op10_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    model = langid.train(documents, ~langid.held_out(F.col("doc_id")))
    return langid.predict(documents, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    model = quality.train(documents, _read(spark, sf_dir, "labels"))
    return quality.predict(documents, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_event_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_read(spark, sf_dir, "documents"), align.AlignConfig(tokenizer_path(TOKENIZER_A), tokenizer_path(TOKENIZER_B)))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secret_battery": op1_secret_battery,
    "op2_shift_and_urls": op2_shift_and_urls,
    "op3_minmax_neardup": op3_minmax_neardup,
    "op4_multiprobe_ann": op4_multiprobe_ann,
    "op5_winnow_decontam": op5_winnow_decontam,
    "op6_token_records": op6_token_records,
    "op7_bwt_repeats": op7_bwt_repeats,
    "op8_soft_mixing": op8_soft_mixing,
    "op9_length_histogram": op9_length_histogram,
    "op10_hierarchical_langid": op10_hierarchical_langid,
    "op11_nonnegative_pu": op11_nonnegative_pu,
    "op12_event_sweep": op12_event_sweep,
    "op13_maxscore": op13_maxscore,
}

#: Host and path as the canonical URL has them.
_PARTS = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
)"""

ORACLES: dict[str, str] = {
    "op2_shift_and_urls": _PARTS + r""", ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
         END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN path LIKE '/%.exe%' OR path LIKE '/%.zip%' OR path LIKE '/login%' OR path LIKE '/cart%' OR path LIKE '/%/wp-admin/%' THEN 'block'
            WHEN (host LIKE 'ads.%' OR host LIKE '%.ads.%') AND path LIKE '/%' THEN 'block'
            ELSE 'allow'
       END AS verdict
FROM ruled
""",
    "op13_maxscore": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), sizes AS (
  SELECT row, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), postings AS (
  SELECT row, term, count(*) AS tf
  FROM (SELECT row, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked)
  GROUP BY row, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term
), scored AS (
  SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (row), totals
  GROUP BY item_id, row
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN sizes USING (row) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
""",
}
