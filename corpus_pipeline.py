"""A corpus pipeline of five operators, each stage written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import chosen_path, cotraining, line_windows, merge_dropout, positions
from fathomline.llm._shared import stage
from fathomline.llm.queries import SEED, table, tokenizer_path


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number for every row, written so that it stays, and the name of that column: decisions hold for rows, whatever ids they share or lack."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier, learned from these documents and labels, takes for good.

    A null text is judged as an empty one; rows are judged one by one; an empty table stays empty.
    """
    scored = cotraining.score(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where("p_good >= 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of line windows; those that lose all they had go. n_chars follows the text.

    A null or empty text stays as it is; rows that repeat id and text get the same result.
    """
    found = line_windows.dedup_lines(docs)
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.where(~changed | (F.trim("text") != "")).withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near-duplicate rows.

    Rows without words are in no group and stay, as do rows that share an id but aren't alike; a null id comes after all others.
    """
    rows, key = keyed(docs)
    found = chosen_path.near_duplicates(rows, id_col=key)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"), key)
    kept = found.join(rows.select(key, order.alias("order")), key).groupBy("component_id").agg(F.min_by(key, "order").alias(key)).select(key)
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an occurrence of a benchmark window; a null text has none."""
    rows, key = keyed(docs)
    found = positions.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    return rows.join(found.where("contaminated").select(key), key, "left_anti").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the documents under seeded merge-dropout; a null text has none."""
    return merge_dropout.encode_texts(docs, tokenizer_path("piece_bpe_32k.model"), seed=SEED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the classifier nor the encoding: tests/llm/test_pipeline.py holds each stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
