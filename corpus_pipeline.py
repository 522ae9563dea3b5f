"""A corpus pipeline of the text operators: each stage works on all that the one before kept.

All stages stand null ids, null, empty and very long texts, ties, repeated rows, empty tables and other columns, which go; all but the
last give the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.common import discard, materialize
from factlake.llm.lines import drop_lines
from factlake.llm.packing import pack_documents
from factlake.llm.pii import mask_documents
from factlake.llm.quality import keep_good
from factlake.llm.simhash import keep_first

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts: the rows that score 0.5 or more, null texts as empty ones, repeated rows
    alike. With too few labels to learn from, or an empty table, all rows stay."""
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out; a document goes if it had text and all of it was repeated. Null and empty texts stay as they are, and
    rows that repeat id and text keep the same lines."""
    out = drop_lines(docs, short=True)
    return _measured(out.where((F.col("__dropped") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != "")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, the one with the smallest id; null ids come last, and of rows that are equal in all
    columns one stays. Null and empty texts are one group."""
    return keep_first(docs.select(*COLUMNS))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; all rows stay, null texts null."""
    return _measured(mask_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, a row for each piece; null and empty texts have the end id only."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify), ("lines", dedup_lines), ("simhash", near_dedup), ("pii", mask), ("packing", pack),
]

#: No SQL expresses a trained classifier or a field; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written and read again, and deleted when the next one's are written."""
    docs, docs_before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            if docs_before is not None:
                discard(docs_before)
            docs_before = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
