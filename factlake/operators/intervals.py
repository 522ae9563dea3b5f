"""Joins of points with the spans around them, by equal keys: each span is cut into cells of powers of two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def celled(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Each span as the fewest cells (level, cell) of 2**level places that cover exactly start to end, both included: two a level at most,
    however long it is. A span whose end is before its start, or with a null end, has none. Places are whole numbers within 2**61."""
    s, e = f"CAST(`{start}` AS BIGINT)", f"CAST(`{end}` AS BIGINT) + 1"
    top = f"least(61, length(bin(greatest(1, {e} - ({s})))) - 1)"  # no cell is longer than its span
    levels = spans.withColumn("__level", F.explode(F.expr(f"sequence(0, {top})")))
    low, high = f"(-shiftright(-({s}), __level))", f"shiftright({e}, __level)"
    left, right = (F.expr(f"if({low} < {high} AND {x} & 1 = 1, {x} - {back}, NULL)") for x, back in ((low, 0), (high, 1)))
    return levels.withColumn("__cell", F.explode(F.array(left, right))).where("__cell IS NOT NULL")


def _at_levels(points: DataFrame, at: str, spans: DataFrame, start: str, end: str) -> DataFrame:
    longest = spans.agg(F.max(F.col(end).cast("long") - F.col(start).cast("long") + 1)).first()[0] or 0
    levels = list(range(min(62, longest.bit_length()))) if longest > 0 else []
    return points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("__cell", F.expr(f"shiftright(CAST(`{at}` AS BIGINT), __level)"))


def enclosing(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each point with every span of its key around it, one row a pair: a point lies in one cell of a span at most."""
    cells = celled(spans, start, end)
    return _at_levels(points, at, spans, start, end).join(cells, [*on, "__level", "__cell"]).drop("__level", "__cell")


def count_around(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, name: str = "n") -> DataFrame:
    """Each point with the number of spans of its key around it. No pair of a point and a span is made: equal spans are summed to one row
    with their number, these to a number for each cell, and places are looked up once, whatever the number of points on them."""
    same = spans.groupBy(*on, start, end).agg(F.count("*").alias("__n"))
    cells = celled(same, start, end).groupBy(*on, "__level", "__cell").agg(F.sum("__n").alias("__n"))
    places = points.select(*on, at).distinct()
    found = _at_levels(places, at, spans, start, end).join(cells, [*on, "__level", "__cell"]).groupBy(*on, at).agg(F.sum("__n").alias("__n"))
    return points.join(found, [*on, at], "left").select(*points.columns, F.coalesce("__n", F.lit(0)).alias(name))


def smallest_span(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, order: list[str]) -> DataFrame:
    """Each point with the shortest span of its key around it, of equal ones the first in `order`; null columns where there is none.

    All points in a cell lie in all spans of that cell, so only the best span of a cell is kept, before anything is joined: a span over all
    rows, or a thousand nested ones, cost each point no more than one row a level. Of spans with equal ends the best is kept before they are cut
    into cells. Points are looked up once a place and key."""
    extra = [x for x in spans.columns if x not in on]
    size = (F.col(end).cast("long") - F.col(start).cast("long")).alias("__size")
    best = F.min(F.struct(*order, *[x for x in extra if x not in order])).alias("__first")
    same = spans.groupBy(*on, start, end).agg(best)
    firsts = same.select(*on, *[F.col(x) if x in (start, end) else F.col(f"__first.{x}").alias(x) for x in extra])
    cells = celled(firsts, start, end)
    best = cells.groupBy(*on, "__level", "__cell").agg(F.min(F.struct(size, *order, *[x for x in extra if x not in order])).alias("__best"))
    places = points.select(*on, at).distinct()
    hit = _at_levels(places, at, spans, start, end).join(best, [*on, "__level", "__cell"]).groupBy(*on, at).agg(F.min("__best").alias("__best"))
    return points.join(hit, [*on, at], "left").select(*points.columns, *[F.col(f"__best.{x}").alias(x) for x in extra])
