"""Mixing sources to target weights: words of each source, repetition rates, and whole copies plus one drawn by a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import numbered
from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights that the sources take in turn, in the order of their names.
WEIGHTS = (3, 1, 2)
#: The mix's words for each word there is, and the most that a source may repeat.
SHARE, MOST = 1.5, 2.0
#: Sources up to which their table is sent to all tasks; beyond it the join is dealt by source, each source cut by a hash.
SENT_ROWS, SALTS = 10_000, 64


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 up to 1 that the row's id and text decide."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target, rate) of each source of (source, size). Sources in the order of their names' code points, null
    last, take the weights in turn and divide share x all words by them; a target stops at most x its source's words, and what is over is
    divided again by weight among the others until none is above.

    The level at which the others stand is found by sums over the sources: each round the sources below it are held at their most.
    Only two sums a round reach the driver. A source without words has target and rate 0."""
    own = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mixing-sources")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = numbered(own, [F.col("source").asc_nulls_last()], "place").withColumn("weight", pick.cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    whole = own.agg(F.sum("source_size").alias("n")).first().n or 0
    level = 0.0
    while True:
        held = F.col("cap") <= F.lit(level) * F.col("weight")
        r = ranked.agg(F.sum(F.when(held, F.col("cap"))).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("open")).first()
        if not r.open:
            break
        now = (share * whole - (r.held or 0.0)) / r.open
        if now <= level:
            break
        level = now
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    out = ranked.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    return out.select("source", "source_size", "weight", "target", "rate")


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, size (words), source_size, target, taken (words of all its copies), rate, copies. A document
    is taken floor(rate) times, and once more if a number that its id and text decide is below the rest, so reruns agree.

    Null text counts as empty: size 0, taken 0. A null source is a source of its own, the last one. Null ids are decided by the text alone.
    Rows that repeat id and text get the same number of copies. An empty table gives no rows; a very long text is counted in its row;
    other columns aren't read. Texts are read once; what is dealt out afterwards has no text."""
    doc_id, text = F.col(id_col), F.col(text_col)
    sized = materialize(docs.select(doc_id.cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), chance(doc_id, text, seed).alias("u")), "mixing-sizes")
    rates = materialize(targets(sized, weights, share, most), "mixing-rates")
    out = _with_rates(sized, rates)
    whole = F.floor("rate")
    copies = (whole + (F.col("u") < F.col("rate") - whole).cast("long")).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    rates = rates.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    if rates.count() <= SENT_ROWS:
        return rows.join(F.broadcast(rates), same).drop("__source")
    rates = rates.withColumn("__cut", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "u"), F.lit(SALTS)).cast("int"))
    return rows.join(rates, same & (F.col("__salt") == F.col("__cut"))).drop("__source", "__salt", "__cut")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy") -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as mixing_plan says, with the number of the copy from 1 in
    copy_col (a column of that name is replaced). Each row decides for itself, so texts aren't shuffled while the sources are few."""
    rates = materialize(targets(docs.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), weights, share, most), "mixing-rates")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), chance(F.col(id_col), F.col(text_col), seed).alias("u"))
    rated = _with_rates(packed, rates)
    whole = F.floor("rate")
    copies = (whole + (F.col("u") < F.col("rate") - whole).cast("long")).cast("int")
    out = rated.select("__row", copies.alias("__n")).where("__n > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy"))
    return out.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c != copy_col], F.col("__copy").alias(copy_col))


def oracle(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> str:
    """DuckDB SQL of mixing_plan over documents."""
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << 52)!r}::DOUBLE AS u FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
  w AS (SELECT *, CAST({list(weights)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS DOUBLE) AS weight, {float(most)!r}::DOUBLE * source_size AS cap, {float(share)!r}::DOUBLE * (SELECT sum(source_size) FROM s) AS budget FROM s),
  l AS (SELECT a.source, any_value(a.cap) AS cap, any_value(a.weight) AS weight, (any_value(a.budget) - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0)) / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level FROM w a, w b GROUP BY a.source),
  f AS (SELECT coalesce(arg_min(level, cap / weight) FILTER (level * weight <= cap), max(cap / weight)) AS level FROM l),
  t AS (SELECT source, source_size, least(cap, f.level * weight) AS target, CASE WHEN source_size > 0 THEN least(cap, f.level * weight) / source_size ELSE 0 END AS rate FROM w, f),
  c AS (SELECT d.*, t.source_size, t.target, t.rate, CAST(floor(t.rate) AS BIGINT) + CASE WHEN d.u < t.rate - floor(t.rate) THEN 1 ELSE 0 END AS copies FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, rate, CAST(copies AS BIGINT) AS copies FROM c"""
