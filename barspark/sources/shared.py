"""Tables written to the folder that the driver and all executors share, which cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session has none, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(spark, "_barspark_bars_dir", None) or tempfile.mkdtemp(prefix="barspark-bars-")
        spark._barspark_bars_dir = path
    return path.rstrip("/") if ":" in path else f"file://{path.rstrip('/')}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once and read back."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
