"""Repositories to look at: which are worth it, how they are scored and in what order they come."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
# Words that a topic or a description must hold, topics that count, and the steps of points.
SUBJECTS = ("solana", "anchor")
TOPICS = ("solana", "anchor", "defi", "dex", "lending", "staking", "nft", "dao")
STARS = ((1000, 40, "1K+ stars"), (500, 30, "500+ stars"), (100, 20, "100+ stars"), (50, 10, "50+ stars"))
FORKS = ((100, 10, "100+ forks"), (50, 5, None))
DAYS = ((30, 15, "updated <30 days"), (90, 10, "updated <90 days"), (365, 5, None))
VALUE = {"high": 25, "medium": 15}


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def auditable(repos: DataFrame, least_stars: int = 10, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Repositories of enough stars whose topics or description name a subject."""
    told = F.exists("topics", lambda t: _any(t, subjects)) | _any(F.lower("description"), subjects)
    return repos.where((c("stars") >= least_stars) & F.coalesce(told, F.lit(False)))


def _tier(value: Column, steps, below: bool = False) -> tuple[Column, Column]:
    """Points and reason of the first step that the value reaches, or with below, stays under."""
    points, reason = None, None
    for limit, n, text in steps:
        test = value < limit if below else value >= limit
        points = F.when(test, n) if points is None else points.when(test, n)
        reason = F.when(test, F.lit(text)) if reason is None else reason.when(test, F.lit(text))
    return points.otherwise(0), reason


def scored(repos: DataFrame, known: DataFrame, as_of: date) -> DataFrame:
    """Adds score and reason: points for stars, for being the first known project (owner, repo, category, value, ord) whose owner or
    name it has, for an update not long before as_of, for forks, and three for each topic that counts."""
    owners = known.groupBy("owner").agg(F.min(F.struct("ord", "category", "value")).alias("by_owner"))
    names = known.groupBy(c("repo").alias("name")).agg(F.min(F.struct("ord", "category", "value")).alias("by_name"))
    rows = repos.join(owners, "owner", "left").join(names, "name", "left").withColumn("k", F.least("by_owner", "by_name"))
    stars, star_text = _tier(c("stars"), STARS)
    forks, fork_text = _tier(c("forks"), FORKS)
    days, day_text = _tier(F.datediff(F.lit(as_of), c("updated").cast("date")), DAYS, below=True)
    value = F.when(c("k").isNull(), 0).when(c("k.value") == "high", VALUE["high"]).when(c("k.value") == "medium", VALUE["medium"]).otherwise(5)
    named = F.when(c("k").isNotNull(), F.format_string("known %s protocol (%s TVL)", "k.category", "k.value"))
    topics = F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda t: _any(F.lower(t), TOPICS))
    told = F.when(F.size(topics) > 0, F.concat(F.lit("topics: "), F.array_join(topics, ", ")))
    return rows.select(*repos.columns, (stars + value + days + forks + 3 * F.size(topics)).cast("long").alias("score"), F.concat_ws("; ", star_text, named, day_text, fork_text, told).alias("reason"))


def best(rows: DataFrame, order: str, most: int = 5) -> DataFrame:
    """The first `most` by score; equal scores by `order`."""
    return rows.orderBy(c("score").desc(), order).limit(most)


def searched(rows: DataFrame, words: str | None = None, category: str | None = None, columns: Sequence[str] = ("name", "description", "category")) -> DataFrame:
    """Rows of a category (all if none is named) that show the words in one of the columns, whatever the case."""
    out = rows.where(c("category") == category) if category else rows
    return out.where(reduce(lambda a, b: a | b, (F.lower(x).contains(words.lower()) for x in columns))) if words else out
