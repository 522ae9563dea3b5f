"""Queries over sources that Spark has written from the driver's tables: a tree of files, a store, a table of versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import store, tree, versions
from ..sources.tables import artifacts, shared_path, table
from .queries import query


def _tree(spark, d) -> str:
    """A file for each document, in folders by source and language; every seventh is no UTF-8, and a language's folder is called target."""
    root = shared_path(spark, "tree")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")

    def write(rows):
        fs, base = tree._open(root)
        for r in rows:
            folder = f"{base}/{r.source}/{'target' if r.lang == 'de' else r.lang}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{r.doc_id}.{'md' if r.doc_id % 3 == 0 else 'rs'}") as f:
                f.write((r.text or "").encode() + (b"\xff" if r.doc_id % 7 == 0 else b""))

    docs.foreachPartition(write)
    return root


_FILES = "(SELECT source || '/' || CASE WHEN lang = 'de' THEN 'target' ELSE lang END || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.rs' END AS path, CAST(strlen(coalesce(text, '')) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS length, CASE WHEN doc_id % 7 <> 0 THEN substr(sha256(coalesce(text, '')), 1, 16) END AS digest, doc_id % 7 = 0 AS failed, lang FROM documents)"


@query(f"SELECT path, length, digest, failed FROM {_FILES} WHERE lang <> 'de' AND path LIKE '%.rs' AND length < 20000")
def tree_scan(spark, d):
    found = tree.tree(spark, _tree(spark, d), "*.rs", ("target",), 20_000)
    return found.select("path", "length", F.substring(F.sha2("content", 256), 1, 16).alias("digest"), F.col("error").isNotNull().alias("failed"))


@query(f"SELECT path, length FROM {_FILES} WHERE path LIKE 'src1/%' AND lang <> 'de'")
def tree_below(spark, d):
    return tree.tree(spark, _tree(spark, d), pruned=("target",)).where(F.col("path").startswith("src1/")).select("path", "length")


@query("SELECT o_orderpriority AS job, count(*) AS n, CAST(sum(length(o_orderkey::VARCHAR || ':' || o_orderstatus)) AS BIGINT) AS size, min(o_orderkey::VARCHAR) AS first_key FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY o_orderpriority")
def store_by_job(spark, d):
    s = store.SparkStore(spark, shared_path(spark, "store"))
    key = F.col("o_orderkey").cast("string")
    s.put(table(spark, d, "orders").select(F.col("o_orderpriority").alias("job"), key.alias("key"), F.concat_ws(":", key, "o_orderstatus").alias("body")))
    return s.read().where(F.col("job").isin("1-URGENT", "5-LOW")).groupBy("job").agg(F.count("*").alias("n"), F.sum(F.octet_length("body").cast("long")).alias("size"), F.min("key").alias("first_key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders WHERE o_custkey % 4 <> 0")
def versions_latest(spark, d):
    """Orders and their lines as tables of versions: an update, a compaction, and a delete that takes the lines with it."""
    root = shared_path(spark, "versions")
    orders, lines = versions.Versions(spark, f"{root}/orders", ["o_orderkey"]), versions.Versions(spark, f"{root}/lines", ["id"])
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    orders.put(own)
    lines.put(table(spark, d, "lineitem").select("l_orderkey").withColumn("id", F.monotonically_increasing_id()))
    orders.put(own.where("o_orderkey % 5 = 0").withColumn("status", F.lit("X")))
    orders.compact()
    versions.delete_cascade(own.where("o_custkey % 4 = 0").select("o_orderkey"), orders, (lines, "l_orderkey"))
    counts = lines.read().groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return orders.read().join(counts, "o_orderkey", "left").select("o_orderkey", "status", F.coalesce("n", F.lit(0)).alias("n_lines"))


_KEPT = "(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '{broken' WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(json_object('purpose', o_orderpriority) AS VARCHAR) END AS metadata, nullif(o_orderstatus, 'F') AS type, 'order_' || o_orderkey AS name FROM orders)"


@query(f"SELECT o_orderkey FROM {_KEPT} WHERE coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.purpose') END = '2-HIGH', false) OR coalesce(type = 'P', false) OR contains(name, '_77')")
def artifacts_or(spark, d):
    key, told = F.col("o_orderkey"), F.to_json(F.struct(F.col("o_orderpriority").alias("purpose")))
    kept = table(spark, d, "orders").select("o_orderkey", F.when(key % 11 == 0, "{broken").when(key % 7 == 0, None).otherwise(told).alias("metadata"), F.nullif("o_orderstatus", F.lit("F")).alias("type"), F.concat(F.lit("order_"), key.cast("string")).alias("name"))
    return artifacts(kept, "2-HIGH", "P", "_77").select("o_orderkey")
