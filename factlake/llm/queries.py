"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import balls, licenses, mixing, search
from .common import query_docs
from .language import identify
from .lines import line_dedup
from .media import media_columns
from .packing import pack_documents
from .pieces import encode_documents
from .pii import find_private
from .quality import score_quality
from .repetition import quality_rules
from .simhash import near_duplicates


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(query_docs(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(query_docs(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(query_docs(spark, sf_dir))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(query_docs(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(query_docs(spark, sf_dir))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(query_docs(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(query_docs(spark, sf_dir))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_passages(query_docs(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(query_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(query_docs(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(query_docs(spark, sf_dir))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: size 0. Null source: the last source. Equal rows: equal copies. Empty table: no rows."""
    return mixing.mixing_plan(query_docs(spark, sf_dir))


def op12_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, of another length or not finite are left out. Equal rows stay. Empty table: no rows."""
    return balls.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts find nothing and aren't found. Each row is a document or item of its own. Empty table: no rows."""
    return search.search(query_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_language, op3_sentencepiece, op4_repetition, op5_packing, op6_lines, op7_licenses, op7_passages, op8_quality, op9_media, op10_simhash, op11_mixing, op12_balls, op13_search)}


def oracle_sql() -> dict[str, str]:
    return {"op7_licenses": licenses.oracle(), "op11_mixing": mixing.oracle(), "op12_balls": balls.oracle(), "op13_search": search.oracle()}
