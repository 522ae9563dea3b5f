"""Rollups of runs, jobs and patches, and tables of plans that findings are joined to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def counts_map(rows: DataFrame, by: list[str], value: str, name: str = "counts", unknown: str = "UNKNOWN") -> DataFrame:
    """One row for each key with a map of how often each value stands there; nulls count as `unknown`. Counted before the maps are made."""
    counted = rows.groupBy(*by, F.coalesce(c(value), F.lit(unknown)).alias("__value")).agg(F.count("*").alias("__n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__value", "__n")))).alias(name))


def get(counts: Column | str, key: str, default: int = 0) -> Column:
    return F.coalesce(F.try_element_at(counts, F.lit(key)), F.lit(default))


def run_totals(runs: DataFrame) -> DataFrame:
    """One row over runs (n_findings, n_enriched, n_patches, n_proofs, request_url): how many, sums, and requests opened. A run counts once."""
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(f"total_{x[2:]}") for x in ("n_findings", "n_enriched", "n_patches", "n_proofs")]
    return runs.agg(F.count("*").alias("total_runs"), *sums, F.count_if(c("request_url").isNotNull()).alias("total_requests"))


def patch_metrics(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """One row: findings, patches by status, and findings that no patch was tried for."""
    s = c("status")
    tried = patches.agg(F.count("*").alias("attempted"), *[F.count_if(s == x).alias(x) for x in ("validated", "needs_human", "failed")])
    total = findings.agg(F.count("*").alias("total"))
    return tried.crossJoin(total).select("total", "attempted", "validated", "needs_human", "failed", (c("total") - c("attempted")).alias("skipped"))  # one row each


def mean_latency(calls: DataFrame, column: str, *by: str) -> DataFrame:
    """Rounded mean, 0 without any."""
    mean = F.coalesce(F.round(F.avg(column)), F.lit(0)).cast("long").alias("mean_latency")
    return (calls.groupBy(*by) if by else calls).agg(mean)


def ready(jobs: DataFrame) -> DataFrame:
    """Adds ready and, where a job isn't, why."""
    ok = F.coalesce(c("status") == "SUCCEEDED", F.lit(False))
    return jobs.withColumn("ready", ok).withColumn("error", F.when(~ok, F.format_string("job is %s, it must be SUCCEEDED", F.coalesce("status", F.lit("unknown")))))


def of_difficulty(repos: DataFrame, difficulty: str) -> DataFrame:
    return repos.where(c("difficulty") == difficulty)


def total_expected(repos: DataFrame, column: str = "expected") -> DataFrame:
    """One row: how many findings the repositories expect in all."""
    return repos.agg(F.coalesce(F.sum(F.size(F.coalesce(c(column), F.array()))), F.lit(0)).cast("long").alias("total_expected"))


#: How a class of finding is shown to be real (steps) and what changes (delta), and what it means (impact) and how easy it is, in our words.
PLANS = [
    (1, "send the call without the signature", "state changes unsigned", "anyone acts for the authority", "easy"), (2, "pass an account of another program", "foreign bytes are trusted", "forged state is accepted", "easy"),
    (3, "derive the address with other seeds or bump", "another address is accepted", "accounts of users collide", "moderate"), (4, "pass a program of one's own", "foreign code runs with the caller's accounts", "funds move at will", "easy"),
    (5, "pass an account of another type", "bytes are read as another type", "fields are forged", "moderate"), (6, "run the first call again", "a live account is set anew", "the owner is replaced", "easy"), (7, "fund a closed account in the same transaction", "old data lives on", "a claim is made twice", "moderate"),
    (8, "shrink and grow the account", "old bytes come back", "stale data is read", "hard"), (9, "pass the largest amount", "a sum wraps round", "balances are wrong", "moderate"), (10, "call out of order", "a state is left that wasn't entered", "steps are skipped", "moderate"),
    (11, "append accounts of one's own", "unseen accounts are used", "checks are passed by", "moderate"), (12, "wait for a price to grow old", "an old price is used", "trades at a wrong price", "hard"), (13, "pass a token account of another mint", "worthless tokens count", "funds are drained", "easy"),
    (14, "change an account in the called program", "old values are used", "a balance counts twice", "hard"), (15, "pass one account twice", "it is changed twice", "funds appear", "easy"),
]


def with_plans(findings: DataFrame) -> DataFrame:
    """Adds steps, delta, impact and exploitability of the finding's class; unknown classes have a general line."""
    table = findings.sparkSession.createDataFrame(PLANS, "class_id int, steps string, delta string, impact string, exploitability string")
    rows = findings.join(F.broadcast(table), "class_id", "left")  # one row a class
    return rows.withColumns({"steps": F.coalesce("steps", F.lit("read the function and try its limits")), "delta": F.coalesce("delta", F.lit("unknown")), "impact": F.coalesce("impact", F.lit("unknown")), "exploitability": F.coalesce("exploitability", F.lit("unknown"))})
