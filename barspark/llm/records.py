"""Length-delimited binary records of token ids, with an offset index.

A record file (``*.rec``) is a run of frames, little-endian:

    uint64 length | uint32 masked crc32 of those 8 bytes | body | uint32 masked crc32 of the body

and a body is ``flags uint8 | doc_id int64 | ids``: bit 0 of the flags marks a
null doc_id, bit 1 ids of four bytes instead of two.  The index is a Parquet
table (file, record, doc_id, offset, length, n_tokens), so that readers can
fetch records in any order without scanning the files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.common import raw, texts
from barspark.llm.tokens import encoder

INDEX = "file string, record long, doc_id long, offset long, length long, n_tokens long"
_HEAD, _BODY, _CRC = struct.Struct("<Q"), struct.Struct("<Bq"), struct.Struct("<I")


@dataclass(frozen=True)
class RecordConfig:
    """``end_id`` closes every document; files hold about ``file_bytes``."""

    tokenizer: str
    end_id: int = 2
    file_bytes: int = 8 << 20


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted, so that checksums of checksums stay independent."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = ids.dtype.itemsize == 4
    body = _BODY.pack((doc_id is None) | wide << 1, doc_id or 0) + ids.tobytes()
    head = _HEAD.pack(len(body))
    return b"".join([head, _CRC.pack(masked(head)), body, _CRC.pack(masked(body))])


def frames(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Document id and token ids of each frame; a damaged frame raises ValueError."""
    at = 0
    while at < len(data):
        head = data[at : at + 8]
        if len(head) < 8 or _CRC.unpack_from(data, at + 8)[0] != masked(head):
            raise ValueError(f"damaged length at byte {at}")
        (size,) = _HEAD.unpack(head)
        body = data[at + 12 : at + 12 + size]
        if len(body) < size or _CRC.unpack_from(data, at + 12 + size)[0] != masked(body):
            raise ValueError(f"damaged record at byte {at}")
        flags, doc_id = _BODY.unpack_from(body)
        yield None if flags & 1 else doc_id, np.frombuffer(body, "<u4" if flags & 2 else "<u2", offset=_BODY.size)
        at += size + 16


def _store(path: str):
    """File system and path of a URI; local, object and Hadoop stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(root: str, config: RecordConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        encode = encoder(config.tokenizer)
        end = np.array([config.end_id], encode.dtype)
        held: list[bytes] = []
        rows: list[tuple] = []
        serial = size = 0

        def flush() -> pa.RecordBatch:
            # whole files under a name of this attempt, then renamed: a lost or repeated task leaves no torn file
            name = f"part-{part:06d}-{serial:06d}.rec"
            temporary = f"{base}/_attempt-{attempt}-{serial}"
            with store.open_output_stream(temporary) as out:
                for piece in held:
                    out.write(piece)
            store.move(temporary, f"{base}/{name}")
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)],
                ["file", "record", "doc_id", "offset", "length", "n_tokens"],
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.encode(raw(batch))):
                ids = np.concatenate([ids, end])
                data = frame(doc_id, ids)
                rows.append((doc_id, size, len(data), len(ids)))
                held.append(data)
                size += len(data)
                if size >= config.file_bytes:
                    yield flush()
                    held, rows, size, serial = [], [], 0, serial + 1
        if held:
            yield flush()

    return run


def write_records(documents: DataFrame, path: str, config: RecordConfig, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every text's ids as record files in ascending doc_id order; return the index table.

    Files sort by name as documents sort by id (nulls first, equal ids by text).
    A null text is a record of the end id alone; repeated rows are written each;
    an empty table gives no file and an empty index.
    """
    spark = documents.sparkSession
    store, base = _store(path)
    store.create_dir(f"{base}/records", recursive=True)
    source = texts(documents, key, text)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_writer(f"{path}/records", config), INDEX).write.mode("overwrite").parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _reader(columns: Callable[[np.ndarray], tuple], kinds: list[tuple[str, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows, start = [], 0
                for at, (doc_id, ids) in enumerate(frames(content.as_py())):
                    rows.append((name, at, doc_id, start, len(ids), *columns(ids)))
                    start += len(ids)
                fields = [("file", pa.string()), ("record", pa.int64()), ("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), *kinds]
                values = list(zip(*rows)) or [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, fields)], [n for n, _ in fields])

    return run


_ROW = "file string, record long, doc_id long, start_in_file long, n_tokens long"


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(f"{path}/records")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record, doc_id, start_in_file, n_tokens and ids of every record; checksums are verified."""
    return _files(spark, path).mapInArrow(_reader(lambda ids: (ids.astype(np.int32),), [("ids", pa.list_(pa.int32()))]), f"{_ROW}, ids array<int>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As read_records, with ``ids_crc32`` over the ids as uint32 in place of the ids."""
    crc = lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),)
    return _files(spark, path).mapInArrow(_reader(crc, [("ids_crc32", pa.int64())]), f"{_ROW}, ids_crc32 long")


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before a record.

    Files are named by the range of ids that they were written from, so a running
    total over ranges, a row for each shuffle partition of the writer, and one
    over the files inside each range are enough.
    """
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens")).withColumn("range", F.element_at(F.split("file", "-"), 2))
    ranges = files.groupBy("range").agg(F.sum("tokens").alias("in_range"))
    ranges = ranges.select("range", (F.sum("in_range").over(Window.orderBy("range")) - F.col("in_range")).alias("earlier"))
    inside = F.sum("tokens").over(Window.partitionBy("range").orderBy("file")) - F.col("tokens")
    before = files.withColumn("inside", inside).join(ranges, "range").select("file", (F.col("earlier") + F.col("inside")).alias("before"))
    return records.join(before, "file").withColumn("start", F.col("before") + F.col("start_in_file")).drop("before")
