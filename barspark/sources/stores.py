"""Stores and sinks around the engine: providers, a read-through cache, append-only tables, logs and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.operators.bars import resample
from barspark.sources import tables
from barspark.sources.tables import BAR_COLUMNS

Provider = Callable[[str, str, str, int], DataFrame]


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def csv_provider(spark: SparkSession, path: str) -> Provider:
    """Bars of a CSV file on [start, end); finer intervals than the file's own are an error, coarser ones are resampled."""

    def bars(symbol: str, start: str, end: str, minutes: int) -> DataFrame:
        rows = tables.read_bars_csv(spark, path, symbol)
        native = tables.native_minutes(rows).first()["minutes"]
        if native is not None and minutes < native:
            raise ValueError(f"{path} has bars of {native:g} minutes, {minutes} were asked for")
        chosen = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz")).where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
        return chosen.select("symbol", "ts", *BAR_COLUMNS) if native is None or minutes == native else resample(chosen, minutes).select("symbol", "ts", *BAR_COLUMNS)

    return bars


def parquet_provider(spark: SparkSession, path: str) -> Provider:
    """Bars of a table written by :func:`barspark.sources.tables.write_bars`; symbol and time reach the scan."""

    def bars(symbol: str, start: str, end: str, minutes: int) -> DataFrame:
        rows = spark.read.schema(tables.BAR_SCHEMA).parquet(path).where(F.col("symbol") == symbol)
        chosen = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz")).where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
        return resample(chosen, minutes).select("symbol", "ts", *BAR_COLUMNS)

    return bars


PROVIDERS: dict[str, Callable[[SparkSession, str], Provider]] = {"csv": csv_provider, "parquet": parquet_provider}


def provider(spark: SparkSession, name: str, path: str, cache: str | None = None) -> Provider:
    """A provider by name, behind a cache if one is given."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; there are {sorted(PROVIDERS)}")
    found = PROVIDERS[name](spark, path)
    return cached(spark, found, cache) if cache else found


def cached(spark: SparkSession, source: Provider, root: str) -> Provider:
    """Read through a table: a request within an earlier one's range, for the same symbol and interval, is not made again."""

    def bars(symbol: str, start: str, end: str, minutes: int) -> DataFrame:
        log, store = f"{root}/requests", f"{root}/bars"
        times = [F.lit(x).cast("timestamp_ntz") for x in (start, end)]
        if _exists(spark, log):
            seen = spark.read.parquet(log).where((F.col("symbol") == symbol) & (F.col("minutes") == minutes) & (F.col("from_") <= times[0]) & (F.col("to_") >= times[1]))
            hit = seen.select("key").first()
            if hit:
                rows = spark.read.parquet(f"{store}/key={hit['key']}")
                return rows.where((F.col("ts") >= times[0]) & (F.col("ts") < times[1]))
        row = spark.range(1).select(F.lit(symbol).alias("symbol"), F.lit(minutes).alias("minutes"), times[0].alias("from_"), times[1].alias("to_"))
        row = row.withColumn("key", F.sha2(F.concat_ws("|", "symbol", "minutes", "from_", "to_"), 256))
        key = row.first()["key"]
        source(symbol, start, end, minutes).write.mode("overwrite").parquet(f"{store}/key={key}")
        row.write.mode("append").parquet(log)  # last, so that what is listed is there
        return spark.read.parquet(f"{store}/key={key}")

    return bars


def append_new(bars: DataFrame, path: str) -> DataFrame:
    """Append bars that the store does not have; the first write of a (symbol, ts) stays.

    Returns symbol, ts and status of each distinct row: added, same or conflict
    (other values than the store's or than the first of the batch).
    """
    spark = bars.sparkSession
    values = F.struct(*BAR_COLUMNS)
    rows = bars.select("symbol", "ts", values.alias("v")).distinct()
    if _exists(spark, path):
        held = spark.read.parquet(path).select("symbol", "ts", values.alias("held"))
        rows = rows.join(held, ["symbol", "ts"], "left")
    else:
        rows = rows.withColumn("held", F.lit(None).cast(rows.schema["v"].dataType))
    first = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("v"))
    status = F.when(F.col("held").isNotNull(), F.when(F.col("held") == F.col("v"), "same").otherwise("conflict")).when(first == 1, "added").otherwise("conflict")
    from barspark.sources.shared import written

    judged = written(rows.withColumn("status", status), "append")  # before the store changes under it
    judged.where("status = 'added'").select("symbol", "ts", "v.*").write.mode("append").parquet(path)
    return judged.select("symbol", "ts", "status")


def write_csv(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as CSV with a header under its name: trades, equity, breakdowns, evaluations."""
    for name, frame in frames.items():
        flat = frame.select(*(F.to_json(c).alias(c) if kind.startswith(("map", "struct", "array")) else F.col(c) for c, kind in frame.dtypes))
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def trade_export(labelled: DataFrame) -> DataFrame:
    """Closed orders with the exit price that their result implies, price plus or minus result times risk, by closing position."""
    side = F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    out = F.round(F.col("price") + side * F.col("realized") * F.abs(F.col("price") - F.col("stop")), 4)
    rows = labelled.where("realized is not null").select("id", "symbol", F.when(F.col("is_long"), "long").otherwise("short").alias("direction"), "price", "stop", "target", "result", "realized", out.alias("exit_price"), "fill", "final")
    return rows.orderBy("symbol", "final", "id")


def append_log(rows: DataFrame, record_type: str, path: str) -> None:
    """Append rows as lines of JSON with their record type."""
    rows.select(F.lit(record_type).alias("record_type"), "*").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, record_type: str, schema: str) -> DataFrame:
    """Rows of one record type of a log."""
    return spark.read.schema(f"record_type string, {schema}").json(path).where(F.col("record_type") == record_type).drop("record_type")


#: The calls, error tags and reasons to pass that an annotation may hold.
DECISIONS = ["LONG", "SHORT", "NO_TRADE", "ACCEPT", "REJECT"]
ERROR_TAGS = ["wrong_manipulation", "wrong_sweep", "wrong_mss", "wrong_fvg", "wrong_dealing_range_context", "bad_location", "insufficient_confirmation", "other"]
PASS_REASONS = ["premium_discount", "too_far_from_ce", "rr_misleading", "insufficient_confirmation", "fvg_location", "other"]

ANNOTATION = "candidate_id string, candidate_time string, annotator string, decisions array<string>, error_tags array<string>, note string, confidence double, would_execute boolean, location_quality int, reason_for_pass array<string>, created_at timestamp"


def annotation_fault() -> Column:
    """The first rule that an annotation breaks; null if none.  Missing tags, reasons and notes count as empty ones."""
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    strange = lambda c, known: F.exists(listed(c), lambda x: ~F.coalesce(x.isin(known), F.lit(False)))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    other = lambda c: F.coalesce(F.array_contains(listed(c), "other"), F.lit(False)) & blank("note")
    return (
        F.when((F.size(listed("decisions")) == 0) | strange("decisions", DECISIONS), "decisions")
        .when(strange("error_tags", ERROR_TAGS), "error_tags")
        .when(strange("reason_for_pass", PASS_REASONS), "reason_for_pass")
        .when(other("error_tags") | other("reason_for_pass"), "note")
        .when(~F.col("confidence").between(0.0, 1.0) | F.isnan("confidence"), "confidence")
        .when(~F.col("location_quality").between(1, 5), "location_quality")
        .when(blank("annotator"), "annotator")
    )


def append_annotations(rows: DataFrame, path: str) -> None:
    """Append annotations to a log, all or, if one breaks a rule, none."""
    faults = rows.groupBy(annotation_fault().alias("fault")).count().where("fault is not null").collect()  # a row for each rule at most
    if faults:
        raise ValueError(f"annotations break rules: {sorted((r['fault'], r['count']) for r in faults)}")
    append_log(rows, "human_fidelity", path)


def latest_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The newest annotation of each candidate; no rows where there is no log."""
    rows = read_log(spark, path, "human_fidelity", ANNOTATION) if _exists(spark, path) else spark.createDataFrame([], ANNOTATION)
    names = [c for c in rows.columns if c != "candidate_id"]
    newest = F.max_by(F.struct(*names), F.struct(F.col("created_at"), F.to_json(F.struct(*names))))
    return rows.groupBy("candidate_id").agg(newest.alias("a_")).select("candidate_id", "a_.*")


def import_annotations(rows: DataFrame, path: str, keys: tuple[str, ...] = ("round", "scene_id")) -> int:
    """Add annotations that the table does not have yet, by key; the number added."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(list(keys))
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    from barspark.sources.shared import written

    new = written(new, "annotations")
    new.write.mode("append").parquet(path)
    return new.count()


def save_bundle(coefficients: DataFrame, path: str, **facts: str) -> None:
    """A frozen model: its coefficients and what it was fitted on."""
    coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")
    spark = coefficients.sparkSession
    spark.createDataFrame(sorted(facts.items()), "name string, value string").write.mode("overwrite").parquet(f"{path}/facts")


def load_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    return spark.read.parquet(f"{path}/coefficients"), {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/facts").collect()}
