"""Graphs of first-generation facts: edges (repo_id, src, dst, kind), with node kinds where a graph needs them.

A node's name starts with what it is (ix:, acc:, struct:, ...). Names carry no file, so accounts of one name are one node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import decide, joins
from .rules import Facts

c = F.col


def _id(kind: str, name: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), c(name) if isinstance(name, str) else name)


def _edges(df: DataFrame, src: Column, dst: Column, kind: str | Column) -> DataFrame:
    return df.select("repo_id", src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def authority_flow(f: Facts) -> DataFrame:
    accounts = f.instructions.select("repo_id", "name", F.explode("accounts").alias("a"))
    fields = f.structs.select("repo_id", "name", F.explode("fields").alias("f")).where(decide.any_of(c("f.name"), "authority", "owner", "admin"))
    tied = f.instructions.where(F.array_contains("signer_checks", "has_one"))
    return _union(
        _edges(accounts.where("a.is_signer"), _id("acc", "a.name"), _id("ix", "name"), "signs"), _edges(accounts.where("a.is_mut"), _id("ix", "name"), _id("acc", "a.name"), "mutates"),
        _edges(tied, _id("ix", "name"), _id("ix", "name"), "has_one_check"), _edges(fields, _id("field", F.concat_ws(".", "name", "f.name")), _id("struct", "name"), "controls"),
    )


def token_flow(f: Facts) -> DataFrame:
    ix, body = f.instructions, c("body")
    moved = ix.where(body.contains("lamports") & decide.any_of(body, "+=", "-="))

    def ends(sign: str) -> Column:
        return F.explode(F.regexp_extract_all(body, F.lit(rf"(\w+)\.(?:try_borrow_mut_)?lamports\(\)\s*.*{sign}="), F.lit(1)))

    tokens = ix.where(decide.any_of(body, "token::transfer", "Transfer {", "transfer_checked"))
    source, target = (F.regexp_extract(body, rf"{end}\s*[:=]\s*(?:ctx\.accounts\.)?(\w+)", 1) for end in ("from", "to"))
    spl = _id("spl:transfer", "name")
    return _union(
        _edges(moved.select("*", ends("-").alias("a")), _id("acc", "a"), _id("ix", "name"), "sends_sol"), _edges(moved.select("*", ends(r"\+").alias("a")), _id("ix", "name"), _id("acc", "a"), "receives_sol"),
        _edges(ix.where(decide.any_of(body, "system_program::transfer", "Transfer {")), _id("ix", "name"), _id("sys:transfer", "name"), "cpi_transfer"), _edges(tokens, _id("ix", "name"), spl, "spl_transfer"),
        _edges(tokens.withColumn("a", source).where("a <> ''"), _id("acc", "a"), spl, "from"), _edges(tokens.withColumn("a", target).where("a <> ''"), spl, _id("acc", "a"), "to"),
        _edges(ix.where(decide.any_of(body, "token::mint_to", "MintTo")), _id("ix", "name"), _id("spl:mint", "name"), "mints"), _edges(ix.where(decide.any_of(body, "token::burn", "Burn {")), _id("ix", "name"), _id("spl:burn", "name"), "burns"),
    )


def state_enums(files: DataFrame) -> DataFrame:
    """(repo_id, enum, variant) of enums whose name speaks of a state."""
    found = files.select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)pub\s+enum\s+\w*(?:State|Status|Phase|Stage)\w*\s*\{[^}]*\}"), F.lit(0))).alias("t"))
    body = F.regexp_replace(F.regexp_extract("t", r"(?s)\{([^}]*)\}", 1), r"//[^\n]*|#\[[^\]]*\]|\([^)]*\)", "")
    return found.select("repo_id", F.regexp_extract("t", r"enum\s+(\w+)", 1).alias("enum"), F.explode(F.regexp_extract_all(body, F.lit(r"(\w+)\s*(?:=\s*\d+\s*)?(?:,|\s*$)"), F.lit(1))).alias("variant")).distinct()


def state_machine(f: Facts) -> DataFrame:
    """Transitions, match arms and guards of state variants; in repositories without such an enum flags like `is_active` stand for them."""
    variants = state_enums(f.files)
    body = c("body")

    def mentions(pattern: str, group: int, kind: str) -> DataFrame:
        return f.instructions.select("repo_id", "name", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(group)))).alias("variant"), F.lit(kind).alias("kind"))

    arms = f.instructions.select("repo_id", "name", F.explode(F.regexp_extract_all(body, F.lit(r"(?s)match\s+\w+\.\w+\s*\{([^}]*)\}"), F.lit(1))).alias("t"))
    arms = arms.select("repo_id", "name", F.explode(F.regexp_extract_all("t", F.lit(r"(\w+)\s*=>"), F.lit(1))).alias("variant"), F.lit("requires").alias("kind"))
    named = _union(mentions(r"\w+\s*=\s*(?:\w+::)?(\w+)", 1, "transitions"), arms, mentions(r"(?:require|assert)!\s*\(\s*\w+\.\w+\s*==\s*(?:\w+::)?(\w+)", 1, "guards"))
    hit = named.join(variants, ["repo_id", "variant"])
    state = F.concat(F.lit("state:"), c("enum"), F.lit("::"), c("variant"))
    forth, back = hit.where("kind = 'transitions'"), hit.where("kind <> 'transitions'")
    flags = f.structs.select("repo_id", "name", F.explode("fields").alias("f")).where(decide.any_of(c("f.name"), "initialized", "is_", "active", "closed", "claimed", "locked"))
    flags = joins.without(flags, variants, ["repo_id"])
    return _union(_edges(forth, _id("ix", "name"), state, c("kind")), _edges(back, state, _id("ix", "name"), c("kind")), _edges(flags, _id("struct", "name"), _id("flag", F.concat_ws(".", "name", "f.name")), "flag"))


def pda_graph(f: Facts) -> DataFrame:
    """Functions, derived addresses and seeds; structs that a file's seeds lead to; addresses of several functions that share all seeds."""
    own = f.pdas.withColumn("pda", F.concat(F.lit("pda:"), c("instruction"), F.lit(":"), c("line").cast("string")))
    seeds = own.select("*", F.explode("seeds").alias("s"))
    near = f.files.select("repo_id", "path", "content").join(f.structs.select("repo_id", c("name").alias("struct")), "repo_id").where(F.regexp_like("content", F.concat(F.lit(r"(?s)seeds\s*=.*?"), c("struct"))))
    resolved = own.join(near, ["repo_id", "path"])
    signed = own.where(F.size("seeds") > 0).withColumn("signature", F.array_join(F.array_sort("seeds"), "|"))
    shared = signed.groupBy("repo_id", "signature").agg(F.collect_set("instruction").alias("all"), F.count("*").alias("n")).where("n > 1").select("repo_id", "signature", F.explode("all").alias("instruction"))
    return _union(
        _edges(own, _id("ix", "instruction"), c("pda"), "derives"), _edges(seeds, _id("seed", F.regexp_replace("s", "[^a-zA-Z0-9_]", "_")), c("pda"), "seeds_into"),
        _edges(resolved, c("pda"), _id("struct", "struct"), "resolves_to"), _edges(shared, _id("collision", "signature"), _id("ix", "instruction"), "shared_seeds"),
    )


GRAPHS = {"authority_flow": authority_flow, "token_flow": token_flow, "state_machine": state_machine, "pda": pda_graph}


def all_graphs(f: Facts) -> DataFrame:
    return _union(*(g(f).select("*", F.lit(name).alias("graph")) for name, g in GRAPHS.items()))


def sizes(edges: DataFrame) -> DataFrame:
    """Nodes and edges of each graph of each repository."""
    nodes = edges.select("repo_id", "graph", F.explode(F.array("src", "dst")).alias("node")).groupBy("repo_id", "graph").agg(F.count_distinct("node").alias("n_nodes"))
    return nodes.join(edges.groupBy("repo_id", "graph").agg(F.count("*").alias("n_edges")), ["repo_id", "graph"])


def difference(before: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """Rows added, removed or modified between two tables of equal columns, by key and a hash of the rest."""
    rest = [x for x in before.columns if x not in key]
    a, b = (x.select(*key, F.xxhash64(*rest).alias("h")) for x in (before, now))
    both = a.withColumnRenamed("h", "was").join(b, key, "full")
    change = F.when(c("was").isNull(), "added").when(c("h").isNull(), "removed").when(c("was") != c("h"), "modified")
    return both.select(*key, change.alias("change")).where("change is not null")
