"""Joins with the semantics of a lookup: the first match in order, a fallback, or a guard's absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import remove, written
from .theta import trie


def earliest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order; summed to one row before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    first = df.groupBy(*by).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__first"))
    return first.select(*by, *[F.col(f"__first.{c}").alias(c) for c in rest])


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str], how: str = "inner") -> DataFrame:
    """Each left row with the first right row of its key: never more rows than left."""
    return left.join(earliest(right, on, order), on, how)


def first_of(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key, for orders that an aggregate can't compare."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def prefix_fallback(left: DataFrame, right: DataFrame, key: str, name: str, order: str, on: list[str] | None = None) -> DataFrame:
    """left with the right row whose name equals the key, else the first whose name is a prefix of the key or the other way
    round. right is a small dictionary of names; `on` keeps the search within equal columns."""
    on = on or []
    found = earliest(right.withColumnRenamed(name, "__name"), [*on, "__name"], [order])
    both = left.join(found, [*(left[c] == found[c] for c in on), left[key] == found["__name"]], "left").select(*[left[c] for c in left.columns], F.col("__name").alias("exact_name"))
    missed = both.where(F.col("exact_name").isNull() & F.col(key).isNotNull()).select(*on, key).distinct()
    # both sides as tries: a name that is a node of the key's, or a key that is a node of the name's
    shorter = trie(missed, key, "__node").join(found.withColumnRenamed("__name", "__node"), [*on, "__node"]).withColumnRenamed("__node", "__name")
    longer = trie(found, "__name", "__node").withColumnRenamed("__node", key).join(missed, [*on, key])
    near = shorter.select(*on, key, order, "__name").unionByName(longer.select(*on, key, order, "__name"))
    near = earliest(near, [*on, key], [order]).select(*on, key, F.col("__name").alias("prefix_name"))
    return both.join(near, [*on, key], "left").withColumn("matched_name", F.coalesce("exact_name", "prefix_name")).drop("exact_name", "prefix_name")


def without(left: DataFrame, covered: DataFrame, on: list[str]) -> DataFrame:
    """Left rows whose key isn't covered."""
    return left.join(covered.select(*on).distinct(), on, "left_anti")


def band_first(left: DataFrame, right: DataFrame, on: list[str], at: str, other: str, low: float, high: float, order: list[str], bucket: float) -> DataFrame:
    """Each left row with the first right row of its key whose place `other` is within [at + low, at + high], else null.
    Places are cut in buckets, so that the band is found by equal keys."""
    lo, hi = F.floor((F.col(at) + F.lit(low)) / F.lit(bucket)), F.floor((F.col(at) + F.lit(high)) / F.lit(bucket))
    dealt = left.withColumn("__bucket", F.explode(F.sequence(lo, hi)))
    found = right.withColumn("__bucket", F.floor(F.col(other) / F.lit(bucket)))
    hit = dealt.join(found, [*on, "__bucket"]).where((F.col(other) >= F.col(at) + F.lit(low)) & (F.col(other) <= F.col(at) + F.lit(high)))
    extra = [c for c in right.columns if c not in on]
    best = hit.groupBy(*left.columns).agg(F.min(F.struct(*order, *[c for c in extra if c not in order])).alias("__first"))
    best = best.select(*[F.col(c).alias(f"__{c}") for c in left.columns], "__first")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in left.columns]  # nulls in other columns lose no match
    return left.join(best, same, "left").select(*left.columns, *[F.col(f"__first.{c}").alias(c) for c in extra])


def upsert(known: DataFrame, news: DataFrame, key: list[str]) -> DataFrame:
    """known with values of news put over them, and the rows that only news has. News holds a key once."""
    values = [c for c in known.columns if c not in key]
    return known.alias("k").join(news.alias("n"), key, "full").select(*key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"k.{c}")).alias(c) for c in values])


def nest(parent: DataFrame, child: DataFrame, key: list[str], *aggregates: Column) -> DataFrame:
    """parent with aggregates over its children; without children they are null."""
    return parent.join(child.groupBy(*key).agg(*aggregates), key, "left")


def both_ends(edges: DataFrame, nodes: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    return edges.join(nodes.select(F.col(node).alias(src)), src, "left_semi").join(nodes.select(F.col(node).alias(dst)), dst, "left_semi")


def pairs_within(df: DataFrame, by: list[str], item: str, order: str) -> DataFrame:
    """Pairs of items i < j in the order of each key's rows, made inside the row of the key: for groups that are small by
    nature, such as the accounts of one function."""
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, item))).alias("__all"))
    pairs = F.flatten(F.transform("__all", lambda a, i: F.transform(F.slice("__all", i + 2, F.size("__all")), lambda b: F.struct(a[item].alias("a"), b[item].alias("b")))))
    return grouped.select(*by, F.explode(pairs).alias("p")).select(*by, "p.a", "p.b")


#: Items up to which a key's pairs of items are made; keys of more meet the others item by item.
FEW_ITEMS = 32


def overlap_counts(rows: DataFrame, key: str, item: str, n: int, few: int = FEW_ITEMS) -> DataFrame:
    """(key, n_others): with how many other keys each key shares an item, for those that share any; nulls meet nothing. All work runs in n
    partitions, dealt by items and by keys.

    Keys that share one item are counted, and not paired: over its items, a key sums the other keys of each. Only who shares s items or more
    than one is counted s times in that sum, and has to be found. Two keys of at most `few` items meet at each pair of items that both
    hold, s (s - 1) / 2 times; a key of more items meets every key of each item, s times, as its pairs of items would grow with the square."""
    k, i = F.col("__k"), F.col("__i")
    held = rows.select(F.col(key).alias("__k"), F.col(item).alias("__i")).where(k.isNotNull() & i.isNotNull())
    by_item, by_key = held.repartition(n, "__i").distinct(), held.repartition(n, "__k").distinct()
    sized = by_key.withColumn("__size", F.count("*").over(Window.partitionBy("__k")))
    small = sized.where(F.col("__size").between(2, few)).groupBy("__k").agg(F.sort_array(F.collect_list("__i")).alias("__all"))
    twos = F.flatten(F.transform("__all", lambda a, j: F.transform(F.slice("__all", j + 2, F.size("__all")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    twos = small.select("__k", F.explode(twos).alias("p")).select("__k", F.col("p.a").alias("__a"), F.col("p.b").alias("__b")).repartition(n, "__a", "__b")
    large = sized.where(F.col("__size") > few).select("__k", "__i").repartition(n, "__i")
    # neither side of these joins may be broadcast: the planner doesn't know how many pairs an order makes
    at_twos = twos.hint("merge").join(twos.withColumnRenamed("__k", "__other"), ["__a", "__b"]).where("__k <> __other")
    at_items = large.hint("merge").join(by_item.withColumnRenamed("__k", "__other"), "__i").where("__k <> __other")

    dealt = lambda k, other, how: F.struct(k.alias("__k"), other.alias("__other"), F.lit(0).cast("long").alias("__met"), F.lit(how).alias("__how"))
    other = F.col("__other")
    none = F.lit(None).cast(rows.schema[key].dataType).alias("__other")
    sums = by_item.select("__k", none, (F.count("*").over(Window.partitionBy("__i")) - 1).alias("__met"), F.lit("sum").alias("__how"))
    all_ = sums.unionByName(at_twos.select(F.inline(F.array(dealt(k, other, "twos"))))).unionByName(at_items.select(F.inline(F.array(dealt(k, other, "items"), dealt(other, k, "turned")))))
    times = {x: F.count_if(F.col("__how") == x).alias(f"__{x}") for x in ("twos", "items", "turned")}
    each = all_.repartition(n, "__k").groupBy("__k", "__other").agg(F.sum("__met").alias("__met"), *times.values())
    # two large keys meet from both sides
    shared = F.greatest("__items", "__turned", F.when(F.col("__twos") > 0, F.round((1 + F.sqrt(1 + 8 * F.col("__twos"))) / 2).cast("long")).otherwise(0))
    once = F.when(F.col("__other").isNull(), F.col("__met")).otherwise(1 - shared)
    return each.groupBy("__k").agg(F.sum(once).alias("n_others")).where("n_others > 0").withColumnRenamed("__k", key)


#: Pairs of one group that are assigned in one row; larger groups go in rounds until they are as small.
ROW_PAIRS = 4096


def greedy_match(expected: DataFrame, scores: DataFrame, by: list[str], least: float, row_pairs: int = ROW_PAIRS) -> DataFrame:
    """One-to-one assignment in the order of `expected`: each takes its best partner not yet taken, if the score is above
    `least`; of equal scores the earliest partner. expected: by, e_ord; scores: by, e_ord, a_ord, score. Returns by, e_ord, a_ord, score.

    A small group is a fold in its row. In a larger one each round settles all pairs in which the partner is the best that the expectation
    has left, and the expectation the first that has this partner left: no earlier one can take it any more, so the pair is what the
    sequence would give. What either end still had goes, and groups that are small by then are folded. A round is two
    aggregates and joins dealt by both ends, so a group of any size is spread; rounds follow the longest chain of expectations that wait
    for one another."""
    settled = []
    rest = written(scores.where(F.col("score") > least).groupBy(*by, "e_ord", "a_ord").agg(F.max("score").alias("score")).join(expected.select(*by, "e_ord").distinct(), [*by, "e_ord"], "left_semi"), "match-pairs")
    while True:
        sizes = rest.groupBy(*by).agg(F.count("*").alias("__n"))
        small = rest.join(sizes.where(F.col("__n") <= row_pairs).select(*by), by, "left_semi")
        settled.append(written(_folded(small, by), "match-settled"))
        large = rest.join(sizes.where(F.col("__n") > row_pairs).select(*by), by, "left_semi")
        if large.isEmpty():
            remove(rest)
            break
        top = large.groupBy(*by, "e_ord").agg(F.min(F.struct((-F.col("score")).alias("less"), "a_ord")).alias("x")).select(*by, "e_ord", "x.a_ord", (-F.col("x.less")).alias("score"))
        first = large.groupBy(*by, "a_ord").agg(F.min("e_ord").alias("e_ord"))
        pairs = written(top.join(first, [*by, "e_ord", "a_ord"]).select(*by, "e_ord", "a_ord", "score"), "match-settled")
        settled.append(pairs)
        left = written(large.join(pairs.select(*by, "e_ord"), [*by, "e_ord"], "left_anti").join(pairs.select(*by, "a_ord"), [*by, "a_ord"], "left_anti").select(*rest.columns), "match-pairs")
        remove(rest)
        rest = left
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _folded(scores: DataFrame, by: list[str]) -> DataFrame:
    options = scores.groupBy(*by, "e_ord").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "a_ord"))).alias("options"))
    all_ = options.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("e_ord", "options"))).alias("all"))
    e_type, a_type = scores.schema["e_ord"].dataType.simpleString(), scores.schema["a_ord"].dataType.simpleString()
    start = F.array().cast(f"array<struct<e_ord:{e_type},a_ord:{a_type},score:double>>")

    def step(done: Column, e: Column) -> Column:
        free = F.filter(e["options"], lambda o: ~F.exists(done, lambda d: d["a_ord"] == o["a_ord"]))
        best = F.try_element_at(free, F.lit(1))
        return F.when(best.isNull(), done).otherwise(F.concat(done, F.array(F.struct(e["e_ord"].alias("e_ord"), best["a_ord"].alias("a_ord"), (-best["less"]).alias("score")))))

    return all_.select(*by, F.explode(F.aggregate("all", start, step)).alias("m")).select(*by, "m.e_ord", "m.a_ord", "m.score")
