"""Graphs as edge rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import remove_path, shared_path, written


def counts(edges: DataFrame) -> DataFrame:
    """One row: distinct nodes and edges of (src, dst, kind)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    n = nodes.agg(F.count_distinct("node").alias("n_nodes"))
    m = edges.distinct().agg(F.count("*").alias("n_edges"))
    return n.withColumn("one", F.lit(1)).join(m.withColumn("one", F.lit(1)), "one").drop("one")


def reach(edges: DataFrame, start: DataFrame, order: str | None = None) -> DataFrame:
    """(root, node, depth, path) of all nodes that each start node reaches over (src, dst), with the length of a shortest path and that
    path's nodes. Of several shortest paths it is the first that a search breadth first would find, edges of a node in the order of
    column `order` (by default of dst).

    Each round joins only the nodes that the round before found, and leaves out those already known. Rounds go on until one finds
    none. Each writes a folder of its own, so a round reads the last folder whole and of the others two columns, and what is returned
    is written once and the rounds' folders deleted."""
    edges = edges.groupBy("src", "dst").agg(F.min(F.col(order or "dst").cast("string" if order is None else edges.schema[order].dataType)).alias("ord"))
    front = start.select(F.col("node").alias("root"), F.col("node"), F.lit(0).alias("depth"), F.array("node").alias("path"), F.array().cast(edges.select(F.array("ord").alias("x")).schema["x"].dataType).alias("place")).distinct()
    spark, path, schema, rounds = edges.sparkSession, shared_path(edges.sparkSession, "reach"), front.schema, []
    while True:
        rounds.append(f"{path}/{len(rounds)}")
        front.write.parquet(rounds[-1])
        front = spark.read.schema(schema).parquet(rounds[-1])
        if front.isEmpty():
            out = written(spark.read.schema(schema).parquet(*rounds).drop("place"), "reached")
            remove_path(spark, path)
            return out
        known = spark.read.schema(schema).parquet(*rounds).select("root", "node")
        found = front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("place", F.array("ord")).alias("place"))
        found = found.groupBy("root", "node").agg(F.min(F.struct("place", "path")).alias("x")).select("root", "node", F.lit(len(rounds)).alias("depth"), "x.path", "x.place")
        front = found.join(known, ["root", "node"], "left_anti")


def neighbourhoods(edges: DataFrame, sinks: DataFrame, hops: int, node: str = "node") -> tuple[DataFrame, DataFrame]:
    """Around each sink the nodes up to `hops` edges away, edges taken both ways, as (sink, node, depth), and the edges that lie between two
    of them, as (sink, ...edge). All sinks grow at once, each row labelled with its own; a round joins only the nodes that the
    round before found. edges: src, dst and more."""
    ends = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    known = front = written(sinks.select(F.col(node).alias("sink"), F.col(node).alias("node"), F.lit(0).alias("depth")).distinct(), "near")
    for depth in range(1, hops + 1):
        found = front.join(ends, front.node == ends.src).select("sink", F.col("dst").alias("node")).distinct()
        front = written(found.join(known, ["sink", "node"], "left_anti").withColumn("depth", F.lit(depth)), "near")
        known = known.unionByName(front)
    own = known.select("sink", "node")
    inner = own.withColumnRenamed("node", "src").join(edges, "src").join(own.withColumnRenamed("node", "dst"), ["sink", "dst"])
    return known, inner.select("sink", *edges.columns)


def collisions(df: DataFrame, key: str, items: str) -> DataFrame:
    """Keys that hold the same set of items: signature (items sorted and joined), the first key and how many keys."""
    signed = df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(items).cast("string"))), "|").alias("signature"))
    return signed.groupBy("signature").agg(F.min(key).alias("first_key"), F.count("*").alias("n_keys")).where("n_keys > 1")
