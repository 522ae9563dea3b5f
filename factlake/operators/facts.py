"""Facts about contract sources, from lines of text: a table for each kind of fact, keyed by repo_id and path.

`files` has repo_id, path and content. Where a block has to be followed by its braces a file is read by a Python table function,
file by file; everything else is columns and windows. `ord` gives the order of rows: files by path, then place in the file."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread
from .text import lines, nearest_preceding

_PUBLIC = re.compile(r"pub\s+fn\s+(\w+)\s*[<(]")
_CONTEXT = re.compile(r"pub\s+fn\s+(\w+)\s*\(\s*ctx\s*:\s*Context")
_NATIVE = re.compile(r"fn\s+((?:process|handle)_\w+)")
_STRUCT, _FIELD = re.compile(r"pub\s+struct\s+(\w+)"), re.compile(r"pub\s+(\w+)\s*:\s*(.+)")
_ERROR = re.compile(r'#\[msg\("[^"]*"\)\]\s*(\w+)|(\w+)(?:\s*=\s*(\d+))?')
#: Words that make a number a value. Fixed values.
VALUE_WORDS = ("amount", "balance", "lamports", "price", "fee", "u64", "u128")


def _step(line: str) -> int:
    return line.count("{") - line.count("}")


def block_end(rows: list[str], first: int) -> int:
    """Index of the line on which the braces opened from `first` are closed, a later line; `first` if they never are."""
    depth = 0
    for k in range(first, len(rows)):
        depth += _step(rows[k])
        if k > first and depth <= 0:
            return k
    return first


def module_lines(rows: list[str]) -> set[int]:
    """Lines inside the program module: from the attribute on until its braces are closed; a line without braces right after
    the attribute ends it too if nothing is open."""
    inside, depth, out = False, 0, set()
    for k, line in enumerate(rows):
        if "#[program]" in line:
            inside, depth = True, 0
            continue
        if inside:
            depth += _step(line)
            inside = depth > 0
            if inside:
                out.add(k)
    return out


def functions_of(content: str, framework: str) -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, body) of a file's entry functions; lines from 1."""
    rows = content.split("\n")
    if framework == "native":
        hits = [(k, m[1]) for k, x in enumerate(rows) if (m := _NATIVE.search(x))]
    else:
        own = module_lines(rows)
        hits = [(k, m[1]) for k, x in enumerate(rows) if k in own and (m := _PUBLIC.search(x))]
        hits = hits or [(k, m[1]) for k, x in enumerate(rows) if (m := _CONTEXT.search(x))]
    out = []
    for k, name in hits:
        end = block_end(rows, k)
        out.append((name, k + 1, end + 1, "\n".join(rows[k : end + 1])))
    return out


def structs_of(content: str) -> list[tuple[str, int, list[tuple[str, str, int]], bool, bool]]:
    """(name, line, fields, mentions init, mentions close) of structs within four lines below an accounts attribute."""
    rows, out = content.split("\n"), []
    for k, line in enumerate(rows):
        if not any(a in line for a in ("#[derive(Accounts)]", "#[account]", "#[account(")):
            continue
        found = next(((j, m[1]) for j in range(k + 1, min(k + 5, len(rows))) if (m := _STRUCT.search(rows[j]))), None)
        if found:
            j, name = found
            body = rows[j : block_end(rows, j) + 1] if _closes(rows, j) else rows[j:]
            fields = [(m[1], m[2].rstrip(", \t\r"), j + i + 1) for i, x in enumerate(body) if (m := _FIELD.search(x))]
            out.append((name, j + 1, fields, any("init" in x for x in body), any("close" in x for x in body)))
    return out


def _closes(rows: list[str], first: int) -> bool:
    return block_end(rows, first) > first


def frameworks(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(repo_id, framework): anchor if a manifest names it, else native if a source has an entry point, else unknown. Without a table of
    manifests sources that use the framework stand for them."""
    c = F.col("content")
    found = files.groupBy("repo_id").agg(F.bool_or(c.contains("anchor_lang") | c.contains("#[program]")).alias("a"), F.bool_or(c.contains("entrypoint!") | c.contains("process_instruction")).alias("n"))
    if manifests is not None:
        named = manifests.groupBy("repo_id").agg(F.bool_or(c.contains("anchor-lang")).alias("named"))
        found = found.join(named, "repo_id", "left").withColumn("a", F.col("named"))
    return found.select("repo_id", F.when(F.col("a"), "anchor").when(F.col("n"), "native").otherwise("unknown").alias("framework"))


def error_codes(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, name, code) of error enums: codes count from 6000 in each file, and an explicit number sets them anew. A line
    that holds only a message gives a code named `msg`, as the lines are read one by one."""

    def run(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                inside, code = False, 6000
                for k, line in enumerate((f.content or "").split("\n")):
                    if "#[error_code]" in line or "ProgramError" in line:
                        inside = True
                    elif inside and "}" in line:
                        inside = False
                    elif inside and (m := _ERROR.search(line)) and (name := m[1] or m[2]) not in ("pub", "enum"):
                        code = int(m[3]) if m[3] else code
                        rows.append((f.repo_id, f.path, k + 1, name, code))
                        code += 1
            yield pd.DataFrame(rows, columns=["repo_id", "path", "line", "name", "code"])

    return files.select("repo_id", "path", "content").mapInPandas(run, "repo_id string, path string, line int, name string, code long")


def _tags(*tests: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(test, F.lit(tag)) for test, tag in tests)), lambda x: x.isNotNull())


def _has(*words: str) -> Column:
    out = F.col("body").contains(words[0])
    for w in words[1:]:
        out = out | F.col("body").contains(w)
    return out


def instructions(files: DataFrame, kinds: DataFrame) -> DataFrame:
    """Entry functions: name, line, end_line, body, accounts, signer_checks, owner_checks, cpi_mentions, arithmetic, ord."""

    def run(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            rows = [(f.repo_id, f.path, f.framework, *x) for f in batch.itertuples(index=False) for x in functions_of(f.content or "", f.framework)]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "framework", "name", "line", "end_line", "body"])

    # texts are sorted for the join and files read after it: in tasks of so many files, whatever the number of shuffle partitions
    found = spread(files, "repo_id").join(kinds, "repo_id").select("repo_id", "path", "framework", "content")
    found = found.mapInPandas(run, "repo_id string, path string, framework string, name string, line int, end_line int, body string")
    body = F.col("body")
    anchor = F.transform(
        F.array_distinct(F.regexp_extract_all(body, F.lit(r"ctx\.accounts\.(\w+)"), F.lit(1))),
        lambda n: F.struct(
            n.alias("name"), (body.contains("Signer") | body.contains(F.concat(n, F.lit(".is_signer"))) | F.regexp_like(body, F.concat(F.lit(r"(?s)#\[account\([^)]*signer[^)]*\)\]\s*.*"), n))).alias("is_signer"),
            (body.contains(F.concat(F.lit("mut "), n)) | F.regexp_like(body, F.concat(F.lit(r"(?s)#\[account\([^)]*mut[^)]*\)\]\s*.*"), n))).alias("is_mut"),
        ),
    )
    native = F.transform(
        F.regexp_extract_all(body, F.lit(r"let\s+(\w+)\s*=\s*next_account_info"), F.lit(1)),
        lambda n: F.struct(n.alias("name"), body.contains(F.concat(n, F.lit(".is_signer"))).alias("is_signer"), body.contains(F.concat(n, F.lit(".is_writable"))).alias("is_mut")),
    )
    value = "|".join(VALUE_WORDS)
    ops = F.filter(
        F.transform(F.split(body, "\n", -1), lambda x, i: F.struct((F.col("line") + i).alias("line"), F.regexp_extract(x, r"([+\-*/])", 1).alias("op"), F.regexp_like(x, F.lit("checked_|try_|saturating_")).alias("checked"), x.alias("text"))),
        lambda o: F.regexp_like(o["text"], F.lit(r"[+\-*/]\s*[^=]")) & ~F.ltrim(o["text"]).startswith("//") & F.regexp_like(o["text"], F.lit(value)),
    )
    mentions = F.concat(*(F.regexp_extract_all(body, F.lit(p), F.lit(0)) for p in (r"invoke(?:_signed)?\s*\(", "CpiContext", r"token::\w+", r"system_program::\w+", "anchor_lang::solana_program::program::invoke")))
    return found.select(
        "repo_id", "path", "framework", "name", "line", "end_line", "body", F.when(F.col("framework") == "native", native).otherwise(anchor).alias("accounts"),
        _tags((_has("is_signer"), "is_signer"), (_has("#[account(signer", "Signer<"), "anchor_signer"), (_has("has_one"), "has_one"), (F.regexp_like(body, F.lit(r"constraint\s*=.*key\(\)")), "key_constraint")).alias("signer_checks"),
        _tags((_has(".owner") & _has("==", "require!"), "owner_check"), (_has("Account<", "Program<"), "anchor_account_type"), (_has("token::authority"), "token_authority")).alias("owner_checks"),
        mentions.alias("cpi_mentions"), F.transform(ops, lambda o: F.struct(o["line"].cast("int").alias("line"), o["op"].alias("op"), o["checked"].alias("checked"))).alias("arithmetic"),
        F.concat_ws(":", "path", F.lpad(F.col("line").cast("string"), 9, "0")).alias("ord"),
    )


def account_structs(files: DataFrame) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            rows = [(f.repo_id, f.path, name, line, [{"name": a, "type": b, "line": c} for a, b, c in fields], i, c_) for f in batch.itertuples(index=False) for name, line, fields, i, c_ in structs_of(f.content or "")]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "name", "line", "fields", "has_init", "has_close"])

    found = files.select("repo_id", "path", "content").mapInPandas(run, "repo_id string, path string, name string, line int, fields array<struct<name:string,type:string,line:int>>, has_init boolean, has_close boolean")
    return found.withColumn("ord", F.concat_ws(":", "path", F.lpad(F.col("line").cast("string"), 9, "0")))


def _numbered(files: DataFrame) -> DataFrame:
    """Lines with the name of the function they stand in or below."""
    rows = lines(spread(files.select("repo_id", "path", "content"), "repo_id"), "content", "repo_id", "path")  # the windows below need no other shuffle
    name = F.regexp_extract("line", r"(?:pub\s+)?fn\s+(\w+)", 1)
    return rows.withColumn("instruction", F.coalesce(nearest_preceding(F.when(name != "", name), ["repo_id", "path"], ["line_no"]), F.lit("unknown")))


def _around(before: int, after: int) -> Column:
    window = Window.partitionBy("repo_id", "path").orderBy("line_no").rowsBetween(before, after)
    return F.array_join(F.collect_list("line").over(window), "\n")


def cpi_calls(files: DataFrame) -> DataFrame:
    """Calls of other programs: line, instruction, target, validated, reloaded, ord."""
    rows = _numbered(files).withColumn("near", _around(-10, 9)).withColumn("later", _around(1, 19))
    rows = rows.where(F.col("line").rlike(r"invoke(?:_signed)?\s*\(") | F.col("line").contains("CpiContext::new"))
    near, named = F.col("near"), F.regexp_extract("near", r"program\s*[=:]\s*(\w+)", 1)
    target = F.when(near.contains("token_program") | near.contains("spl_token"), "spl_token").when(near.contains("system_program"), "system_program").when(near.contains("associated_token"), "associated_token").when(named != "", named).otherwise("unknown")
    valid = near.contains("program_id") | near.contains("Program<") | near.contains("token_program") | near.contains("system_program")
    return rows.select("repo_id", "path", F.col("line_no").cast("int").alias("line"), "instruction", target.alias("target"), valid.alias("validated"), F.regexp_extract_all("later", F.lit(r"(\w+)\.reload\(\)"), F.lit(1)).alias("reloaded"), F.concat_ws(":", "path", F.lpad(F.col("line_no").cast("string"), 9, "0")).alias("ord"))


def pda_derivations(files: DataFrame) -> DataFrame:
    """Derived addresses: line, seeds, bump (canonical, unchecked or missing), instruction, form, ord. A line may hold both forms."""
    rows = _numbered(files).withColumn("near", _around(-3, 4)).withColumn("close", _around(-2, 2))

    def seeds(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")

    listed = r"seeds\s*=\s*\[([^\]]*)\]"
    declared = rows.where(F.col("line").rlike(listed)).select("*", seeds(F.regexp_extract("line", listed, 1)).alias("seeds"), F.when(~F.col("near").contains("bump"), "missing").when(F.col("near").contains("bump ="), "unchecked").otherwise("canonical").alias("bump"), F.lit(0).alias("form"))
    called = rows.where(F.col("line").contains("find_program_address") | F.col("line").contains("create_program_address"))
    called = called.select("*", seeds(F.regexp_extract("close", r"\[([^\]]*)\]", 1)).alias("seeds"), F.when(F.col("line").contains("find_program_address"), "canonical").otherwise("unchecked").alias("bump"), F.lit(1).alias("form"))
    both = declared.unionByName(called)
    return both.select("repo_id", "path", F.col("line_no").cast("int").alias("line"), "seeds", "bump", "instruction", "form", F.concat_ws(":", "path", F.lpad(F.col("line_no").cast("string"), 9, "0"), F.col("form").cast("string")).alias("ord"))
