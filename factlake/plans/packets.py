"""Packets of findings: what somebody needs to write a fix, as one row for each finding, cut to a bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from ..sources.tables import spread
from . import candidates

c = F.col

# How many lines around a finding are shown, how long an excerpt may be, and the forms of the lines.
AROUND, MOST = 100, 10_000
NO_SOURCE, NO_CONSTRAINT, NO_TARGET = "[source unavailable]", "unconstrained", "?"
CALLS_HEAD, ADDRESSES_HEAD = "CPI calls:", "PDA derivations:"


def _in_order(rows: DataFrame, line: Column, head: str, name: str) -> DataFrame:
    """(repo_id, instruction, name): the lines of each function in the order of ord, under a head. A line's text is all that is shuffled."""
    own = rows.select("repo_id", "instruction", F.struct("ord", line.alias("text")).alias("x")).where("instruction is not null")
    listed = own.groupBy("repo_id", "instruction").agg(F.array_sort(F.collect_list("x")).alias("all"))
    return listed.select("repo_id", "instruction", F.array_join(F.concat(F.array(F.lit(head)), F.transform("all", lambda x: x["text"])), "\n").alias(name))


def numbered(content: Column, line: Column, end_line: Column, around: int = AROUND, most: int = MOST) -> Column:
    """The lines of content from `around` above line to `around` below end_line, each with its number, cut to `most` characters; empty
    where the content is shorter, null where it is null."""
    rows = F.split(content, "\n", -1)
    first = F.greatest(F.lit(0), line - around)
    shown = F.slice(rows, first + 1, F.greatest(F.lit(0), end_line + around - first))
    return F.substring(F.array_join(F.transform(shown, lambda x, i: F.concat((first + i + 1).cast("string"), F.lit("|"), x)), "\n"), 1, most)


def constraint_map(fields: Column) -> Column:
    """A line for each field of a struct of accounts: name, type and constraints. Empty for null."""

    def one(x: Column) -> Column:
        return F.when(F.coalesce(x["expression"], F.lit("")) == "", x["kind"]).otherwise(F.concat(x["kind"], F.lit("="), x["expression"]))

    def row(f: Column) -> Column:
        own = F.array_join(F.transform(f["constraints"], one), ", ")
        return F.concat(F.lit("  "), f["name"], F.lit(": "), f["type"], F.lit(" ["), F.when(own == "", NO_CONSTRAINT).otherwise(own), F.lit("]"))

    return F.coalesce(F.array_join(F.transform(fields, row), "\n"), F.lit(""))


def packets(findings: DataFrame, p: candidates.Parsed, files: DataFrame, around: int = AROUND, most: int = MOST) -> DataFrame:
    """findings (repo_id, vuln_class, instruction, path, line, end_line, and fix, an array of steps, if there is one) with excerpt,
    constraint_map, fix_pattern and related.

    The excerpt is of the file's text; where that can't be read (no row, or null) it is the function's, and without one says so. The map is
    of the struct of accounts that the first function of that name takes. related lists the calls and derived addresses of the function
    in order. Nulls in instruction leave map and related empty; repeated findings stay repeated; no findings give no rows. Nothing is
    broadcast. Findings, without texts, are the side of the last join that is held in memory, some 2,048 and the rows of one file in a task; texts
    are shuffled once at most, pass by unsorted, and never leave that join."""
    ins = joins.earliest(p.instructions.select("repo_id", c("name").alias("instruction"), "ord", "context", c("excerpt").alias("own_text")), ["repo_id", "instruction"], ["ord"]).drop("ord")
    maps = candidates.struct_of(p, ins).select("repo_id", "instruction", "own_text", constraint_map(c("fields")).alias("constraint_map"))
    called = F.concat(F.lit("  "), "call_type", F.lit(" → "), F.when(F.coalesce("target", F.lit("")) == "", NO_TARGET).otherwise(c("target")), F.lit(" (validated: "), c("validated").cast("string"), F.lit(")"))
    derived = F.concat(F.lit("  seeds=["), F.array_join("seeds", ", "), F.lit("] bump="), "bump")
    about = maps.hint("merge").join(_in_order(p.calls, called, CALLS_HEAD, "calls"), ["repo_id", "instruction"], "full").hint("merge").join(_in_order(p.pdas, derived, ADDRESSES_HEAD, "addresses"), ["repo_id", "instruction"], "full")
    about = about.withColumn("related", F.concat_ws("\n", "calls", "addresses")).drop("calls", "addresses")
    steps = F.array_join("fix", "\n") if "fix" in findings.columns else F.lit("")
    rows = spread(findings.hint("merge").join(about, ["repo_id", "instruction"], "left"), "repo_id", "path").hint("shuffle_hash")
    rows = rows.join(files.select("repo_id", "path", "content"), ["repo_id", "path"], "left").withColumn("excerpt", numbered(c("content"), c("line"), c("end_line"), around, most))
    own = F.when(F.coalesce("own_text", F.lit("")) == "", NO_SOURCE).otherwise(F.substring("own_text", 1, most))
    return rows.select(
        *[x for x in findings.columns if x != "fix"], F.coalesce("excerpt", own).alias("excerpt"), F.coalesce("constraint_map", F.lit("")).alias("constraint_map"),
        F.when(F.coalesce(steps, F.lit("")) == "", c("vuln_class")).otherwise(steps).alias("fix_pattern"), F.coalesce("related", F.lit("")).alias("related"),
    )
