"""Helpers that the training-data operators share: the shared folder, staged tables, row batches."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python batch works on at a time.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. An error where it is unset: no folder of one machine can take its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder, in folders by a column if asked for, and read it back.

    Cuts the lineage; a lost executor costs only the reading of its splits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathomline/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more; an empty table may have none."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {re.match(r".*?/fathomline/[^/]+", f)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_crc32(doc_id: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def text_bytes(text):
    """UTF-8 length of a text column; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and start offsets (one more than rows) of a string column; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice record batches so that each holds about limit bytes of the text column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8_view(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def partitions_for(spark: SparkSession, n_bytes: int, target: int = 32 << 20) -> int:
    """Partitions of about target bytes, the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / target))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher on uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
