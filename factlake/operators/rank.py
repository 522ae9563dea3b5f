"""Deduplication, ranking, top-k and sets, with the order of equal rows always stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_path


def keep_best(df: DataFrame, key: list[str], better: Column, order: str) -> DataFrame:
    """Of each key the row of the highest `better`, the earliest of equals, with first_order: where its key first stood."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max(F.struct(better.alias("__b"), (-F.col(order)).alias("__o"), *rest)).alias("__best"), F.min(order).alias("first_order"))
    return best.select(*key, *[F.col(f"__best.{c}").alias(c) for c in rest], "first_order")


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key and c != order]
    first = df.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("__first"))
    return first.select(*key, *[F.col(f"__first.{c}").alias(c) for c in [order, *rest]])


def ranked(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds the row's place from 1 in its group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_n(df: DataFrame, by: list[str], order: list[Column | str], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark limits each task's groups before the shuffle."""
    return ranked(df, by, order, name).where(F.col(name) <= n)


def page(df: DataFrame, order: list[Column | str], start: int, size: int, most: int = 100) -> DataFrame:
    """A slice of the ordered rows; `most` bounds the page."""
    return df.orderBy(*order).offset(start).limit(min(size, most))


def chunked_topk(df: DataFrame, by: list[str], first: list[Column | str], again: list[Column | str], pool: int, chunk: int, k: int) -> DataFrame:
    """Two-stage choice of k rows a group: the best `pool` by `first` are cut in chunks, each chunk sends its best by `again`
    (half more than its share, two at least), and those are ranked by `again`; the pool's others fill up to k. Adds chosen_rank."""
    rows = top_n(df, by, first, pool, "__rank").withColumn("__chunk", F.floor((F.col("__rank") - 1) / F.lit(chunk)))
    size, whole = Window.partitionBy(*by, "__chunk"), Window.partitionBy(*by)
    rows = rows.withColumn("__size", F.count("*").over(size)).withColumn("__all", F.count("*").over(whole))
    quota = F.greatest(F.lit(2), F.ceil(F.lit(float(k)) / F.col("__all") * F.col("__size") * F.lit(1.5)))
    rows = ranked(rows, [*by, "__chunk"], again, "__place").withColumn("__sent", F.col("__place") <= quota)
    out = ranked(rows, by, [F.col("__sent").cast("int").desc(), *again], "chosen_rank").where(F.col("chosen_rank") <= k)
    return out.drop("__rank", "__chunk", "__size", "__all", "__place", "__sent")


def union_in_order(*frames: DataFrame, branch: str = "branch") -> DataFrame:
    """All rows, with the number of the frame that each came from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn(branch, F.lit(i)) for i, f in enumerate(frames)))


def set_overlap(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: how many distinct keys both have, and how many only one."""
    both = left.select(*on).distinct().withColumn("__l", F.lit(1)).join(right.select(*on).distinct().withColumn("__r", F.lit(1)), on, "full")
    return both.agg(F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("n_both"), F.count_if(F.col("__r").isNull()).alias("n_left_only"), F.count_if(F.col("__l").isNull()).alias("n_right_only"))


def numbered(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds each row's place from 1 in the order of the whole table, without a task that sees the whole table.

    Rows are dealt by ranges of the order and written in it; what each range holds is counted, and a row's place is the rows of the ranges
    before its own and its place there. Rows that are equal in the order are split over ranges too, so a value that a third of all rows
    have makes no large range; which of them comes first is open. Only the counts, one for each range, are added up on the driver."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "numbered")
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    by = [F.col(x) if isinstance(x, str) else x for x in order]
    placed = tied.repartitionByRange(*by, "__tie").sortWithinPartitions(*by, "__tie").drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    part, before, at = F.shiftright("__at", 33), [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        before.append((r["part"], at))
        at += r["count"]
    parts = spark.createDataFrame(before, "__part long, __before long")  # one row for each range
    rows = placed.withColumn("__part", part).join(F.broadcast(parts), "__part")
    return rows.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*df.columns, name)


def next_page(df: DataFrame, order: list[str], after: list | None, size: int, most: int = 100) -> DataFrame:
    """The rows that follow the one whose order columns are `after` (None: the first page). Unlike an offset, a later page costs no more
    than the first: the condition reaches the scan, and each task sends at most a page. The order must tell all rows apart; nulls in it
    come last."""
    if after is not None:
        past = F.lit(False)
        for name, value in reversed(list(zip(order, after))):
            c = F.col(name)
            past = (c.isNull() & past) if value is None else (c > F.lit(value)) | c.isNull() | ((c == F.lit(value)) & past)
        df = df.where(past)
    return df.orderBy(*[F.col(x).asc_nulls_last() for x in order]).limit(min(size, most))
