"""Findings as documents, plans and neighbours: what is written for people."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import decide, joins

c = F.col

#: What to do about a class of finding, in our words; a framework's own advice goes before the general one.
FIXES = [
    (1, "anchor", "Take the authority as a Signer."), (1, None, "Require the authority's signature."), (2, "anchor", "Use a typed account."), (2, None, "Compare the account's owner with the program."), (3, None, "Derive the address with its canonical bump and seeds that tell users apart."),
    (4, None, "Compare the called program's id before the call."), (5, None, "Check a type tag before reading bytes."), (6, None, "Refuse accounts that are live already."), (7, None, "Zero the data of an account that is closed."), (8, None, "Zero memory that is grown."), (9, None, "Use checked arithmetic."),
    (10, None, "Test the state before leaving it."), (11, None, "Count and test the remaining accounts."), (12, None, "Test age, confidence and owner of the price."), (13, None, "Compare mint and authority."), (14, None, "Load the account again after the call."), (15, None, "Require that the two keys differ."),
]


def with_fixes(findings: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds fix, where the finding has none of its own: the framework's advice, else the general one."""
    table = findings.sparkSession.createDataFrame(FIXES, "class_id int, framework string, fix string")
    special, general = table.where("framework is not null"), table.where("framework is null").select("class_id", c("fix").alias("general"))
    rows = findings.join(kinds.select("repo_id", "framework"), "repo_id", "left").join(F.broadcast(special), ["class_id", "framework"], "left").join(F.broadcast(general), "class_id", "left")
    return rows.withColumn("fix", F.coalesce("fix", "general")).drop("general", "framework")


def blast_radius(findings: DataFrame, instructions: DataFrame) -> DataFrame:
    """Adds mutable (accounts that the function changes) and shared_with (other functions that use one of them)."""
    used = instructions.select("repo_id", c("name").alias("instruction"), F.explode("accounts").alias("a")).select("repo_id", "instruction", c("a.name").alias("account"), c("a.is_mut").alias("is_mut")).distinct()
    own = used.where("is_mut").groupBy("repo_id", "instruction").agg(F.array_sort(F.collect_set("account")).alias("mutable"))
    pairs = used.where("is_mut").join(used.select("repo_id", "account", c("instruction").alias("other")), ["repo_id", "account"]).where("other <> instruction")
    shared = pairs.groupBy("repo_id", "instruction").agg(F.array_sort(F.collect_set("other")).alias("shared_with"))
    return findings.join(own, ["repo_id", "instruction"], "left").join(shared, ["repo_id", "instruction"], "left")


def as_json(ranked: DataFrame) -> DataFrame:
    """(repo_id, document): the findings of each repository in order of rank."""
    rows = ranked.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("rank", "class_id", "class_name", "severity", "confidence", "title", "path", "line", "instruction"))).alias("findings"))
    return rows.select("repo_id", F.to_json(F.struct("repo_id", "findings")).alias("document"))


def as_markdown(ranked: DataFrame, summary: DataFrame, most: int = 20) -> DataFrame:
    """(repo_id, document): verdict, counts, and the first `most` findings by severity, then rank."""
    order = Window.partitionBy("repo_id").orderBy(decide.severity_rank(c("severity")), "rank")
    rows = ranked.withColumn("n", F.row_number().over(order)).where(c("n") <= most)
    line = F.format_string("%d. **%s** %s (`%s:%d`, %.0f%%)", "n", "severity", "title", "path", "line", c("confidence") * 100)
    listed = rows.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), "\n").alias("list"))
    head = F.format_string("# %s\n\nVerdict: %s. %d findings: %d critical, %d high, %d medium, %d low, %d info.\n\n", "repo_id", "verdict", "total", "critical", "high", "medium", "low", "info")
    return summary.join(listed, "repo_id").select("repo_id", F.concat(head, "list", F.lit("\n")).alias("document"))


def _listed(rows: DataFrame, line: Column, name: str) -> DataFrame:
    """(repo_id, name): the lines of each repository in the order of rank."""
    own = rows.select("repo_id", F.struct("rank", line.alias("t")).alias("x")).groupBy("repo_id").agg(F.array_sort(F.collect_list("x")).alias("all"))
    return own.select("repo_id", F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias(name))


def _place() -> Column:
    return F.concat(F.lit("`"), "path", F.lit(":"), c("line").cast("string"), F.lit("`"), F.when(F.coalesce("instruction", F.lit("")) != "", F.concat(F.lit(" @ `"), "instruction", F.lit("`"))).otherwise(""))


def _numbered(ranked: DataFrame) -> DataFrame:
    """The critical findings of each repository, then the high ones, each in order of rank, with place n from 1 as rank."""
    grave = ranked.where(c("severity").isin("CRITICAL", "HIGH"))
    return grave.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(decide.severity_rank(c("severity")), "rank")))


def change_texts(ranked: DataFrame, changed: DataFrame) -> DataFrame:
    """(repo_id, title, body) of the change that mends the critical and high findings: their number, the findings in order of rank, and the
    files of changed (repo_id, path) by path. A repository without such findings has a text that says so; without findings it has none."""
    grave = ranked.where(c("severity").isin("CRITICAL", "HIGH"))
    line = F.concat(F.row_number().over(Window.partitionBy("repo_id").orderBy("rank")).cast("string"), F.lit(". **["), "severity", F.lit("]** "), "title", F.lit(" in "), _place())
    files = changed.select("repo_id", "path").distinct().groupBy("repo_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    s = c("severity")
    rows = ranked.groupBy("repo_id").agg(F.count_if(s == "CRITICAL").alias("critical"), F.count_if(s == "HIGH").alias("high")).join(_listed(grave, line, "list"), "repo_id", "left").join(files, "repo_id", "left")
    n = c("critical") + c("high")
    paths = F.coalesce("paths", F.array().cast("array<string>"))
    body = F.concat(
        F.format_string("## Security fixes\n\n- critical: %d\n- high: %d\n- files changed: %d\n\n### Findings\n\n", "critical", "high", F.size(paths)), F.coalesce("list", F.lit("none")),
        F.lit("\n\n### Files\n\n"), F.when(F.size(paths) == 0, "none").otherwise(F.array_join(F.transform(paths, lambda p: F.concat(F.lit("- `"), p, F.lit("`"))), "\n")),
        F.lit("\n\n### To verify\n\nRead each change, run the repository's tests, and test that the finding is gone.\n"),
    )
    return rows.select("repo_id", F.concat(F.lit("fix: "), n.cast("string"), F.when(n == 1, " security issue").otherwise(" security issues")).alias("title"), body.alias("body"))


def advisories(ranked: DataFrame, summary: DataFrame, counts: DataFrame, graphs: DataFrame) -> DataFrame:
    """(repo_id, document): an advisory with the verdict, counts by severity and recommendation, a section for each critical, then each
    high finding, a table of the others in order of rank, sizes of graphs (repo_id, graph, n_nodes, n_edges), and counts (repo_id,
    framework, functions, structs, calls, addresses) of what was read. A finding's fix stands in its section if there is a column of that
    name. A repository without findings has no advisory. Each part is summed by repository, and the parts meet by its id."""
    sure = F.format_string("%.0f%%", c("confidence") * 100)
    fix = F.when(F.coalesce("fix", F.lit("")) != "", F.concat(F.lit("\n\nFix: "), "fix")).otherwise("") if "fix" in ranked.columns else F.lit("")
    section = F.concat(F.lit("### "), c("rank").cast("string"), F.lit(". "), "title", F.lit("\n\n| field | value |\n|---|---|\n| severity | "), "severity", F.lit(" |\n| class | "), c("class_id").cast("string"), F.lit(", "), "class_name", F.lit(" |\n| place | "), _place(), F.lit(" |\n| confidence | "), sure, F.lit(" |"), fix, F.lit("\n"))
    other = F.concat(F.lit("| "), c("class_id").cast("string"), F.lit(" | "), "severity", F.lit(" | "), "title", F.lit(" | "), _place(), F.lit(" | "), sure, F.lit(" |"))
    sized = graphs.select("repo_id", c("graph").alias("rank"), "n_nodes", "n_edges")
    rows = summary.join(_listed(_numbered(ranked), section, "sections"), "repo_id", "left").join(_listed(ranked.where(~c("severity").isin("CRITICAL", "HIGH")), other, "others"), "repo_id", "left")
    rows = rows.join(_listed(sized, F.format_string("- %s: %d nodes, %d edges", "rank", "n_nodes", "n_edges"), "sizes"), "repo_id", "left").join(counts, "repo_id", "left")
    number = [F.coalesce(x, F.lit(0)).cast("long") for x in ("functions", "structs", "calls", "addresses")]
    document = F.concat(
        F.format_string("# Advisory: %s\n\nVerdict: %s\n\n## Summary\n\n%d finding(s).\n\n| severity | count |\n|---|---|\n| critical | %d |\n| high | %d |\n| medium | %d |\n| low | %d |\n| info | %d |\n\n", "repo_id", F.when((c("critical") == 0) & (c("high") == 0), "SHIP READY").otherwise("DO NOT SHIP"), "total", "critical", "high", "medium", "low", "info"),
        F.lit("Recommendation: "), "recommendation", F.lit("\n\n## Findings\n\n"), F.coalesce("sections", F.lit("None is critical or high.\n")),
        F.when(c("others").isNull(), "").otherwise(F.concat(F.lit("\n## Other findings\n\n| class | severity | title | place | confidence |\n|---|---|---|---|---|\n"), "others", F.lit("\n"))),
        F.when(c("sizes").isNull(), "").otherwise(F.concat(F.lit("\n## Graphs\n\n"), "sizes", F.lit("\n"))),
        F.format_string("\n## What was read\n\nFramework %s; %d functions, %d structs, %d calls, %d derived addresses.\n", F.coalesce("framework", F.lit("unknown")), *number),
    )
    return rows.select("repo_id", document.alias("document"))


def with_excerpts(findings: DataFrame, files: DataFrame, around: int = 100, most: int = 12_000) -> DataFrame:
    """Adds excerpt: numbered lines of the file from `around` - 1 before the finding's line to `around` after it."""
    parts = F.split("content", "\n", -1)
    first = F.greatest(F.lit(0), c("line") - around)
    shown = F.transform(F.slice(parts, first + 1, F.lit(2 * around)), lambda x, i: F.concat((first + i + 1).cast("string"), F.lit(": "), x))
    rows = findings.join(files.select("repo_id", "path", "content"), ["repo_id", "path"], "left")
    return rows.withColumn("excerpt", F.substring(F.array_join(shown, "\n"), 1, most)).drop("content")


def with_first(findings: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """Adds the value of the first row of other (repo_id, ord, title, class_name, value) whose title equals the finding's, or
    whose class name its title contains. An OR of an equal key and a search within the repository's few rows."""
    keys = findings.select("repo_id", "title").distinct()
    named = other.select("repo_id", "ord", c("title").alias("o_title"), "class_name", value)
    hit = keys.join(named, "repo_id").where((c("title") == c("o_title")) | c("title").contains(c("class_name")))
    return findings.join(joins.earliest(hit.select("repo_id", "title", "ord", value), ["repo_id", "title"], ["ord"]).drop("ord"), ["repo_id", "title"], "left")


@dataclass(frozen=True)
class Edit:
    """A line edit: of the lines from `before` above a finding to `after` below it, the first that fits and isn't guarded already gets lines
    above and below it, or is changed."""

    before: int
    after: int
    fits: Callable[[str], bool]
    guarded: Callable[[list[str], int], bool] = lambda rows, k: False
    change: Callable[[str], str] = lambda line: line
    above: Callable[[list[str], int], list[str]] = lambda rows, k: []
    below: Callable[[list[str], int], list[str]] = lambda rows, k: []

    def apply(self, rows: list[str], at: int) -> tuple[int, list[str], str, list[str]] | None:
        """Which line is edited, what comes above it, what it becomes and what comes below it; None if nothing changes."""
        for k in range(max(0, at - self.before), min(len(rows), at + self.after + 1)):
            if self.fits(rows[k]) and not self.guarded(rows, k):
                indent = re.match(r"\s*", rows[k])[0]
                above, below = ([indent + x for x in make(rows, k)] for make in (self.above, self.below))
                new = self.change(rows[k])
                return (k, above, new, below) if above or below or new != rows[k] else None
        return None


def _near(rows: list[str], first: int, last: int, *words: str) -> bool:
    """Whether the rows [first, last) show all words."""
    text = "\n".join(rows[max(0, first) : last])
    return all(w in text for w in words)


def _says(*words: str) -> Callable[[str], bool]:
    return lambda line: any(w in line for w in words)


def _signed(line: str) -> str:
    return line.replace("#[account(", "#[account(signer, ", 1) if "#[account(" in line else re.sub(r"(Account|Unchecked|System)\w*<'info>", "Signer<'info>", line)


def _checked(line: str) -> str:
    for sign, name in (("+", "add"), ("-", "sub"), ("*", "mul"), ("/", "div")):
        line = re.sub(rf"(\w[\w.]*)\s*\{sign}\s*(\w[\w.]*)(?!\s*\))", rf"\1.checked_{name}(\2).ok_or(Overflow)?", line)
    return line


def _read_next(rows: list[str], k: int) -> list[str]:
    m = re.search(r"ctx\.accounts\.(\w+)", "\n".join(rows[k + 1 : k + 10]))
    return [f"ctx.accounts.{m[1]}.reload()?;"] if m else []


#: Edits by class of finding; the others get a note.
EDITS = {
    1: Edit(0, 0, _says("AccountInfo<'info>", "UncheckedAccount<'info>", "#[account("), lambda r, k: "signer" in r[k], _signed), 2: Edit(0, 0, lambda x: "#[account(" in x and "has_one" not in x and "owner" not in x, change=lambda x: x.replace("#[account(", "#[account(has_one = authority, ", 1)),
    3: Edit(5, 4, lambda x: "seeds" in x and "=" in x and "]" in x, lambda r, k: _near(r, k, k + 5, "bump"), lambda x: x.replace("]", "], bump", 1)), 4: Edit(2, 4, _says("invoke", "CpiContext"), lambda r, k: _near(r, k - 5, k, "require!", "InvalidProgram"), above=lambda r, k: ["require!(target_program.key() == EXPECTED_PROGRAM, InvalidProgram);"]),
    5: Edit(0, 0, lambda x: "AccountInfo<'info>" in x and "Account<" not in x, change=lambda x: x.replace("AccountInfo<'info>", "Account<'info, Checked>", 1)), 6: Edit(5, 4, lambda x: "#[account(" in x and "init" in x, lambda r, k: _near(r, k, k + 5, "constraint", "initialized"), below=lambda r, k: ["    constraint = !account.is_initialized @ AlreadyInitialized,"]),
    7: Edit(3, 9, lambda x: "close" in x or ("lamports()" in x and "= 0" in x), lambda r, k: _near(r, k + 1, k + 5, "fill(0)") or _near(r, k + 1, k + 5, "discriminator"), below=lambda r, k: ["account.try_borrow_mut_data()?.fill(0);"]), 9: Edit(0, 0, lambda x: not x.lstrip().startswith("//"), change=_checked),
    14: Edit(2, 4, _says("invoke", "transfer", "CpiContext"), lambda r, k: not _read_next(r, k) or _near(r, k + 1, k + 3, ".reload()"), below=_read_next),
}


def patched(content: str, findings: list[tuple[int, int, str]]) -> str:
    """Applies the edits of findings (class, line from 1, note) in their order. Edits of a file stack: a finding's place moves with the
    lines that earlier ones have added above it. A class without an edit, or one that finds nothing to do, gets a note above the line."""
    rows = content.split("\n")
    place = list(range(len(rows)))  # where each line of the content stands now
    for kind, line, note in findings:
        if not 0 < line <= len(place):
            continue
        at = place[line - 1]
        k, above, new, below = (kind in EDITS and EDITS[kind].apply(rows, at)) or (at, [f"// TODO: {note}"], rows[at], [])
        rows[k : k + 1] = [*above, new, *below]
        place = [p + len(above) * (p >= k) + len(below) * (p > k) for p in place]
    return "\n".join(rows)


def patches(ranked: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, diff) of the files with findings; edits of a file stack in order of rank, files are handled one by one."""
    own = ranked.groupBy("repo_id", "path").agg(F.array_sort(F.collect_list(F.struct("rank", "class_id", "line", "title"))).alias("all")).join(files.select("repo_id", "path", "content"), ["repo_id", "path"])

    def run(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                new = patched(f.content or "", [(x["class_id"], x["line"], x["title"]) for x in f.all])
                rows.append((f.repo_id, f.path, "\n".join(difflib.unified_diff((f.content or "").split("\n"), new.split("\n"), f"a/{f.path}", f"b/{f.path}", lineterm=""))))
            yield pd.DataFrame(rows, columns=["repo_id", "path", "diff"])

    return own.mapInPandas(run, "repo_id string, path string, diff string")
