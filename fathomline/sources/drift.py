"""One scan of many small files whose columns differ: the answers of a service, a CSV file for each thing asked for."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.sources.sheets import typed_cells

#: Rows that are handed on at once.
ROWS_AT_ONCE = 4096


def _table(data: bytes) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(row, cells by header) of a CSV file; ValueError where it is none: an answer in JSON, markup or other bytes, no header, or a row with more cells than headers."""
    text = data.decode("utf-8-sig")
    if "\0" in text:
        raise ValueError("bytes that are no text")
    if text.lstrip()[:1] in ("{", "[", "<"):
        raise ValueError(f"another kind of answer: {text.strip()[:80]}")
    rows = csv.reader(io.StringIO(text, newline=""), strict=True)
    header = [x.strip() for x in next(rows, [])]
    if not any(header):
        raise ValueError("no header")
    for n, row in enumerate(rows, 1):
        if len(row) > len(header) and any(row[len(header) :]):
            raise ValueError(f"row {n} has more cells than headers")
        cells: dict[str, str] = {}
        for k, x in zip(header, row):
            if k and x != "":
                cells.setdefault(k, x)
        if row:
            yield n, list(cells.items())


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(_path, _row, _cells, error) of all files at a path: a map of each row's cells by header, or one row with an error for a file that can't be read, which gives no others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                data = data.as_py()
                try:
                    for _ in _table(data):  # a file counts only if it is sound to its end
                        pass
                except (ValueError, csv.Error) as e:  # bytes that aren't UTF-8 too
                    yield _batch([(name, None, None, f"{type(e).__name__}: {e}")])
                    continue
                rows = []
                for n, cells in _table(data):
                    rows.append((name, n, cells, None))
                    if len(rows) == ROWS_AT_ONCE:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "_path string, _row long, _cells map<string,string>, error string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_path", "_row", "_cells", "error"])


def headers(found: DataFrame) -> DataFrame:
    """(header, files): the columns that occur in the files with rows, and in how many."""
    return found.where("error is null").select("_path", F.explode(F.map_keys("_cells")).alias("header")).distinct().groupBy("header").agg(F.count("*").alias("files"))


def read_drifting(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """The union of all CSV files at a path, whatever columns each has, and the files that can't be read.

    Returns (rows, broken). rows: _path, _row, the columns of the schema, matched with
    headers in any case (null where a file lacks one or a cell isn't of its type), and
    _rest, a map of the cells of all other columns. broken: (_path, error). Empty cells
    are null; files of no bytes are passed over; a file with a header only has no rows.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = scan(spark, path)
    return found.where("error is null").select("_path", "_row", *typed_cells(schema)), found.where("error is not null").select("_path", "error")
