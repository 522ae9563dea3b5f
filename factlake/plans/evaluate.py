"""Findings against expectations: match scores, one-to-one assignment, metrics and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import decide, joins

c = F.col
LEAST = 0.6


def match_score() -> Column:
    """Of an expected (e_) and an actual finding: class and function must agree; names, file and severity count where the
    expectation has them."""
    low = F.lower("instruction")
    kind = F.when(c("vuln_class") == c("e_class"), 0.4).when(F.array_contains(F.coalesce("e_alt", F.array().cast("array<string>")), c("vuln_class")), 0.3)
    called = F.concat(F.array(low), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))  # its own name and those it is dispatched under
    same = F.exists("e_instructions", lambda e: F.exists(called, lambda a: a.contains(F.lower(e)) | F.lower(e).contains(a)))
    wanted = F.transform(F.coalesce("e_accounts", F.array().cast("array<string>")), lambda a: F.lower(a))
    n = F.size(wanted)
    shared = F.size(F.filter(wanted, lambda w: F.exists("accounts", lambda a: F.lower(a).contains(w) | w.contains(F.lower(a)))))
    names, names_most = F.when(n > 0, F.lit(0.15) * shared / n).otherwise(0.0), F.when(n > 0, 0.15).otherwise(0.0)
    file, file_most = F.when(c("path").endswith(c("e_file")) | c("e_file").endswith(c("path")), 0.1).otherwise(0.0), F.when(c("e_file").isNotNull(), 0.1).otherwise(0.0)
    grave, grave_most = F.when(decide.severity_rank(c("severity")) <= decide.severity_rank(c("e_severity")), 0.05).otherwise(0.0), F.when(c("e_severity").isNotNull(), 0.05).otherwise(0.0)
    total = kind + F.lit(0.3) + names + F.when(c("e_file").isNotNull(), file).otherwise(0.0) + F.when(c("e_severity").isNotNull(), grave).otherwise(0.0)
    return F.when(kind.isNull() | ~same, 0.0).otherwise(total / (F.lit(0.4) + F.lit(0.3) + names_most + file_most + grave_most))


def match(expected: DataFrame, actual: DataFrame, least: float = LEAST) -> DataFrame:
    """(repo_id, e_ord, a_ord, score) of the assignment. The pairs scored are those of a repository and class, the few that can match."""
    classes = expected.withColumn("vuln_class", F.explode(F.array_distinct(F.concat(F.array("e_class"), F.coalesce("e_alt", F.array().cast("array<string>"))))))
    scores = classes.join(actual, ["repo_id", "vuln_class"]).withColumn("score", match_score())
    return joins.greedy_match(expected.select("repo_id", "e_ord"), scores.select("repo_id", "e_ord", "a_ord", "score"), ["repo_id"], least)


def traps_hit(traps: DataFrame, actual: DataFrame) -> DataFrame:
    """(repo_id, trap) with the first grave finding of its class and function."""
    hit = traps.join(actual, "repo_id").where((c("vuln_class") == c("false_class")) & (c("trap_instruction").isNull() | c("instruction").contains(c("trap_instruction"))) & c("severity").isin("CRITICAL", "HIGH"))
    return joins.earliest(hit.select("repo_id", "trap", "a_ord"), ["repo_id", "trap"], ["a_ord"])


def repo_metrics(expected: DataFrame, actual: DataFrame, matched: DataFrame) -> DataFrame:
    """Per repository: expected, found, missed, false positives (unmatched ones of MEDIUM or worse), precision, recall, f1."""
    e = expected.groupBy("repo_id").agg(F.count("*").alias("n_expected"))
    m = matched.groupBy("repo_id").agg(F.count("*").alias("n_found"))
    left = actual.join(matched.select("repo_id", "a_ord"), ["repo_id", "a_ord"], "left_anti").where(decide.severity_rank(c("severity")) <= 2)
    f = left.groupBy("repo_id").agg(F.count("*").alias("n_false"))
    rows = e.join(m, "repo_id", "full").join(f, "repo_id", "full").na.fill(0, ["n_expected", "n_found", "n_false"])
    return rated(rows.withColumn("n_missed", c("n_expected") - c("n_found")))


def rated(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("precision", decide.guarded_ratio(c("n_found"), c("n_found") + c("n_false"))).withColumn("recall", decide.guarded_ratio(c("n_found"), c("n_expected")))
    return rows.withColumn("f1", decide.f1(c("precision"), c("recall")))


def class_metrics(expected: DataFrame, actual: DataFrame, matched: DataFrame) -> DataFrame:
    """Per class: expectations count under theirs, matches under the actual class, so missed may be negative; every unmatched
    finding is a false one here, of any severity."""
    kinds = actual.select("repo_id", "a_ord", "vuln_class")
    hit = matched.join(kinds, ["repo_id", "a_ord"])
    loose = kinds.join(matched.select("repo_id", "a_ord"), ["repo_id", "a_ord"], "left_anti")

    def one(df: DataFrame, column: str, e: int, f: int, w: int) -> DataFrame:
        return df.select(c(column).alias("vuln_class"), F.lit(e).alias("e"), F.lit(f).alias("f"), F.lit(w).alias("w"))

    rows = one(expected, "e_class", 1, 0, 0).unionByName(one(hit, "vuln_class", 0, 1, 0)).unionByName(one(loose, "vuln_class", 0, 0, 1))
    rows = rows.groupBy("vuln_class").agg(F.sum("e").alias("n_expected"), F.sum("f").alias("n_found"), F.sum("w").alias("n_false"))
    return rated(rows.withColumn("n_missed", c("n_expected") - c("n_found")))


def suite(repos: DataFrame) -> DataFrame:
    """One row over all repositories without an error (column error null, if there is one)."""
    rows = repos.where("error is null") if "error" in repos.columns else repos
    return rated(rows.agg(F.count("*").alias("n_repos"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n_expected", "n_found", "n_false", "n_missed")]))


def compare(before: DataFrame, now: DataFrame, whole: float = 0.05, one: float = 0.10) -> DataFrame:
    """Regressions: repositories whose f1 fell by more than `one`, and the suite's measures that fell by more than `whole`."""
    pair = before.select("repo_id", c("f1").alias("was")).join(now.select("repo_id", "f1"), "repo_id")
    repos = pair.where(c("was") - c("f1") > one).select(c("repo_id").alias("what"), "was", c("f1").alias("is"))
    totals = [suite(x).select(F.stack(F.lit(3), F.lit("precision"), "precision", F.lit("recall"), "recall", F.lit("f1"), "f1").alias("what", "value")) for x in (before, now)]
    both = totals[0].withColumnRenamed("value", "was").join(totals[1].withColumnRenamed("value", "is"), "what")
    return repos.unionByName(both.where(c("was") - c("is") > whole))
