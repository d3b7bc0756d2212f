"""Working tables and column handling shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    This is ``spark.checkpoint.dir`` of the session.  Only where that is unset
    and driver and executors are one process, as in a local test session, a
    temporary folder takes its place; on a cluster its tables would be scattered,
    so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(spark, "_barspark_shared_dir", None) or f"file://{tempfile.mkdtemp(prefix='barspark-')}"
        spark._barspark_shared_dir = path
    return path.rstrip("/") if "://" in path or path.startswith("file:") else f"file://{path.rstrip('/')}"


class Workspace:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the key and the text, under fixed names, so that no other column can clash."""
    return frame.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def raw(batch: pa.RecordBatch, name: str = "text", rows: int = 256) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them; few are held at a time."""
    column = batch.column(name)
    column = column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()
