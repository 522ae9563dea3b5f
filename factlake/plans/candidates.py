"""Rules of the second and third generation: candidates from parsed sources.

A candidate has repo_id, vuln_class, severity, confidence, instruction, path, line, end_line, accounts (names), reason, link (the value-moving
operation behind it, or null), excerpt, rule, ord, and after `generate` fingerprint, rank and id."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import decide, joins, rank, syntax
from ..sources.tables import spread, written

c = F.col
#: Kinds of operations that nobody may start unsigned. Fixed values.
DANGEROUS = ("token_transfer", "sol_transfer", "token_burn", "account_close", "set_authority")
OWNED = ("Account", "Program", "InterfaceAccount", "Interface")

# What the third generation looks for in a body, in a line or in the name of a called function.
STALENESS = (
    r"(?i)slot[-_]?diff", r"(?i)last[-_]?update", r"(?i)stale", r"(?i)valid[-_]?slot", r"age\s*[<>]", r"(?i)current[-_]?slot\s*-", r"(?i)clock\.slot\s*-", r"(?i)oracle_staleness", r"(?i)max[-_]?age", r"(?i)freshness", r"(?i)expires?[-_]?at",
    r"(?i)timestamp[-_]?diff", r"(?i)unix[-_]?timestamp", r"(?i)slots?[-_]?since",
)
CONFIDENCE = (r"(?i)confidence", r"(?i)deviation", r"(?i)twap", r"(?i)ema[-_]?price", r"(?i)price[-_]?range", r"(?i)oracle[-_]?guard")
SANITY = (r"price\s*[><=!]=?\s*0", r"(?i)min[-_]?price", r"(?i)max[-_]?price", r"(?i)price[-_]?bound", r"(?i)assert.*price", r"(?i)require.*price")
VALIDATION_CALL = (r"(?i)valid", r"(?i)check.*oracle", r"(?i)oracle.*check", r"(?i)verify.*price", r"(?i)staleness")
BODY_VALIDATION_CALL = (r"(?i)valid", r"(?i)staleness", r"(?i)check.*price")
ORACLE_ACCOUNT = (r"(?i)oracle", r"(?i)price", r"(?i)pyth", r"(?i)switchboard", r"(?i)feed")
ORACLE_READ = (
    r"(?i)get_price\s*\(", r"(?i)oracle.*price", r"(?i)price.*oracle", r"(?i)pyth.*get", r"(?i)switchboard.*get", r"(?i)load_price_account", r"(?i)get_pyth_price", r"(?i)price_account", r"(?i)oracle_ai", r"\.price\s*\(", r"(?i)get_price_data",
)
DESERIALIZE = (
    r"try_from_slice", r"unpack\s*\(", r"unpack_unchecked", r"deserialize\s*\(", r"from_account_info", r"try_deserialize", r"try_from_account_info", r"Account::unpack", r"AccountState::unpack", r"Reserve::unpack", r"Obligation::unpack",
    r"LendingMarket::unpack", r"Mint::unpack", r"TokenAccount::unpack",
)
OWNER_CHECK = (
    r"\.owner\s*==\s*program_id", r"\.owner\s*==\s*&?program_id", r"\.owner\s*!=\s*program_id", r"assert_eq!\s*\([^)]*\.owner", r"check_program_account", r"check_account_owner", r"assert_owned_by", r"(?i)owner_check", r"(?i)validate_owner",
    r"(?i)verify_account_owner", r"spl_token::check_program_account",
)
PROGRAM_CALL = (r"invoke\s*\(", r"invoke_signed\s*\(", r"CpiContext::new", r"anchor_lang::solana_program::program::invoke")
STATE_READ = (r"(?i)\.amount", r"(?i)\.lamports\(\)", r"(?i)\.data\.borrow", r"(?i)\.balance", r"(?i)\.supply", r"(?i)\.total", r"(?i)unpack\s*\(")
RELOAD = (r"\.reload\s*\(\)", r"\.try_borrow_data\s*\(\)", r"AccountInfo::try_from", r"Account::try_from", r"Account::unpack", r"exit\s*\(\s*&")


def any_pattern(patterns: tuple[str, ...]) -> str:
    """One pattern that is found where any of these is."""
    return "|".join(f"(?:{p})" for p in patterns)


@dataclass
class Parsed:
    files: DataFrame
    instructions: DataFrame
    structs: DataFrame
    sinks: DataFrame
    calls: DataFrame
    pdas: DataFrame


def gather(files: DataFrame, parsed: DataFrame | None = None) -> Parsed:
    """Fact tables of files. Every rule reads them, some more than once, so files are parsed once and written; `parsed` (syntax.parse), where
    it is given, should be written too."""
    parsed = written(syntax.parse(files), "parsed") if parsed is None else parsed
    kind = c("framework")
    kinds = parsed.groupBy("repo_id").agg(F.bool_or(kind == "anchor").alias("a"), F.bool_or(kind == "native").alias("n")).select("repo_id", F.when(c("a"), "anchor").when(c("n"), "native").otherwise("unknown").alias("framework"))
    instructions = syntax.exploded(parsed, "instructions").join(kinds, "repo_id")
    fields = syntax.account_fields(parsed)
    nested = fields.groupBy("repo_id", "path", "struct", "struct_ord", "accounts").agg(F.array_sort(F.collect_list(F.struct("n", "name", "type", "kind", "inner", "constraints", "is_signer", "is_mut", "path", "line", "end_line"))).alias("fields"))
    structs = syntax.exploded(parsed, "structs").select("repo_id", "path", c("name").alias("struct"), c("ord").alias("struct_ord"), "line", "end_line").join(nested, ["repo_id", "path", "struct", "struct_ord"])
    sinks, calls = syntax.sinks(parsed), syntax.calls(parsed)
    # the address of a field belongs to the first function that uses its struct, else keeps the struct's name
    users = joins.earliest(instructions.where("context is not null").select("repo_id", c("context").alias("instruction"), "ord", c("name").alias("user")), ["repo_id", "instruction"], ["ord"]).select("repo_id", "instruction", "user")
    pdas = syntax.derivations(parsed).join(users, ["repo_id", "instruction"], "left")
    pdas = pdas.withColumn("instruction", F.when(c("source") == "constraint", F.coalesce("user", "instruction")).otherwise(c("instruction"))).drop("user").withColumn("excerpt", F.array_join("seeds", ", "))
    return Parsed(parsed, instructions, structs, sinks, calls, pdas)


def struct_of(p: Parsed, left: DataFrame) -> DataFrame:
    """left (with context) and the fields of the struct of that name, else of the first whose name is a prefix of it or the other way
    round; null without one."""
    names = p.structs.where("accounts").select("repo_id", "struct", c("struct_ord").alias("s_ord"), "fields")
    # tables of facts seem small to the planner, as it doesn't know how long texts and lists are: none of these joins may broadcast one
    exact = joins.first_match(left.hint("merge"), names.withColumn("context", c("struct")), ["repo_id", "context"], ["s_ord"], "left")
    open_ = exact.where(c("struct").isNull() & c("context").isNotNull()).select("repo_id", "context").distinct()
    near = open_.hint("merge").join(names, "repo_id").where(c("context").startswith(c("struct")) | c("struct").startswith(c("context")))
    near = joins.first_of(near, ["repo_id", "context"], ["s_ord"]).select("repo_id", "context", c("struct").alias("p_struct"), c("fields").alias("p_fields"))
    out = exact.join(near.hint("merge"), ["repo_id", "context"], "left")
    return out.select(*left.columns, F.coalesce("struct", "p_struct").alias("struct"), F.coalesce("fields", "p_fields").alias("fields"))


def authority(f: Column) -> Column:
    return decide.any_of(f["name"], "authority", "owner", "admin", "payer", "signer") | (f["kind"] == "Signer")


def has(f: Column, *kinds: str) -> Column:
    return F.exists(f["constraints"], lambda x: x["kind"].isin(*kinds))


def owned(f: Column) -> Column:
    return f["kind"].isin(*OWNED) | has(f, "owner")


def guarded(fields: Column, name: Column, body: Column) -> Column:
    """Whether something ties the account to an authority: has_one, a constraint that names it, or a requirement on its key."""
    tied = F.exists(fields, lambda f: F.exists(f["constraints"], lambda x: ((x["kind"] == "has_one") & (x["expression"] == name)) | ((x["kind"] == "constraint") & x["expression"].contains(name))))
    return tied | (body.contains("require!(") & (body.contains(F.concat(name, F.lit(".key()"))) | body.contains(F.concat(name, F.lit(".is_signer")))))


def names(fields: Column) -> Column:
    return F.transform(fields, lambda f: f["name"])


def candidate(df: DataFrame, rule: int, vuln: str, severity: str | Column, confidence: float | Column, reason: str, accounts: Column | None = None, linked: bool = False, place: str | None = None, at: str = "", cut: int = 500) -> DataFrame:
    """`at` is the column whose path, line and end_line are the candidate's place: by default the row itself, else a field of it."""
    order = F.concat_ws("#", "ord", *([F.lpad(c(place).cast("string"), 6, "0")] if place else []))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    link = F.format_string("%s at line %d", "sink", "line") if linked else F.lit(None).cast("string")
    where = [c(f"{at}.{x}" if at else x).alias(x) for x in ("path", "line", "end_line")]
    return df.select(
        "repo_id", F.lit(vuln).alias("vuln_class"), lit(severity).alias("severity"), lit(confidence).alias("confidence"), "instruction", *where,
        (accounts if accounts is not None else F.array().cast("array<string>")).alias("accounts"), F.format_string(reason, "instruction").alias("reason"), link.alias("link"), F.substring("excerpt", 1, cut).alias("excerpt"), F.lit(rule).alias("rule"), order.alias("ord"),
    )


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def second_generation(p: Parsed) -> DataFrame:
    """Candidates of rules 1 to 14."""
    bodies = p.instructions.select("repo_id", c("name").alias("instruction"), "context", c("excerpt").alias("body"), c("ord").alias("i_ord"))
    at = struct_of(p, joins.first_match(p.sinks, bodies, ["repo_id", "instruction"], ["i_ord"])).where(c("fields").isNotNull())
    rulers = F.filter("fields", authority)
    at = at.withColumn("rulers", rulers).withColumn("unsigned", ~F.exists(rulers, lambda f: f["is_signer"]))
    token = at.where(c("sink").isin("token_transfer", "token_mint_to", "token_burn"))
    some, none = F.size("rulers") > 0, F.size("rulers") == 0
    held = token.select("*", F.posexplode("fields").alias("k", "f")).where(((c("f.inner") == "TokenAccount") | c("f.type").contains("TokenAccount")) & ~has(c("f"), "token_authority") & F.array_contains("accounts", c("f.name")))
    feeds = at.where("sink = 'oracle_read'").select("*", F.posexplode("fields").alias("k", "f")).where(decide.any_of(c("f.name"), "oracle", "price", "feed", "aggregator"))
    own = struct_of(p, p.instructions.select("repo_id", "path", c("name").alias("instruction"), "context", "line", "end_line", c("excerpt"), "ord"))
    kinds = p.sinks.groupBy("repo_id", "instruction").agg(F.collect_set("sink").alias("kinds"))
    open_ = own.where(c("fields").isNotNull()).join(kinds, ["repo_id", "instruction"], "left")
    loose = open_.select("*", F.posexplode("fields").alias("k", "f")).where(authority(c("f")) & ~c("f.is_signer") & c("f.is_mut")).where(~guarded(c("fields"), c("f.name"), c("excerpt")))
    # of a struct only the first function that uses it is reported
    first = joins.first_of(own.where("struct is not null and context = struct"), ["repo_id", "struct"], ["ord"])
    parts = first.select("*", F.posexplode("fields").alias("k", "f"))
    bare = parts.where(c("f.kind").isin("UncheckedAccount", "AccountInfo") & c("f.is_mut") & ~has(c("f"), "constraint", "address", "owner"))
    rows = p.instructions.select("repo_id", "path", c("name").alias("instruction"), c("line").alias("first"), "ord", F.posexplode(F.split("excerpt", "\n", -1)).alias("k", "excerpt"))
    rows = rows.withColumn("line", c("first") + c("k")).withColumn("end_line", c("line"))
    sums = rows.where(~F.ltrim("excerpt").startswith("//") & c("excerpt").rlike(r"[+\-*]\s*[^=>]|\bas\s+u(64|128)\b") & c("excerpt").rlike("(?i)amount|balance|lamports|price|fee|rate|supply|reserve") & ~c("excerpt").rlike("checked_|saturating_|try_"))
    field = F.array("f.name")
    return union(
        candidate(token.where(c("unsigned") & some), 1, "missing_signer", "CRITICAL", 0.88, "%s: tokens move and no authority signs", names(c("rulers")), True),
        candidate(token.where(none & ~decide.any_of(c("excerpt"), "CpiContext::new_with_signer", "invoke_signed")), 2, "missing_signer", "HIGH", 0.72, "%s: tokens move without an authority or a signing address", None, True),
        candidate(held, 3, "token_authority_mismatch", "HIGH", 0.78, "%s: token account without authority constraint", field, True, "k", "f"),
        candidate(at.where((c("sink") == "sol_transfer") & c("unsigned") & some), 4, "missing_signer", "CRITICAL", 0.85, "%s: lamports move and no authority signs", names(c("rulers")), True),
        candidate(at.where((c("sink") == "account_close") & c("unsigned") & ~F.exists("fields", lambda f: has(f, "close")) & c("excerpt").contains("lamports") & c("excerpt").contains("= 0")), 5, "close_revive", "CRITICAL", 0.82, "%s: account is drained by hand", c("accounts"), True),
        candidate(at.where((c("sink") == "set_authority") & c("unsigned")), 6, "missing_signer", "CRITICAL", 0.90, "%s: authority changes hands unsigned", names(c("rulers")), True),
        candidate(feeds.where(~owned(c("f"))), 7, "oracle_validation", "CRITICAL", 0.80, "%s: owner of the price account isn't validated", field, True, "k", "f"),
        candidate(feeds.where(~decide.any_of(c("body"), "timestamp", "stale", "max_age", "confidence")), 8, "oracle_validation", "HIGH", 0.65, "%s: price may be stale", field, True, "k", "f"),
        candidate(open_.where(F.arrays_overlap("kinds", F.array(*map(F.lit, DANGEROUS))) & ~F.exists("fields", lambda f: f["is_signer"])), 9, "missing_signer", "CRITICAL", 0.90, "%s: value moves and no account signs", names(c("fields")), cut=200),
        candidate(loose, 10, "missing_signer", "HIGH", 0.78, "%s: mutable authority that nothing ties", field, False, "k", "f", 200),
        candidate(bare, 11, "missing_owner", "HIGH", 0.72, "%s: mutable account without any check", field, False, "k", "f", 200),
        candidate(parts.where(has(c("f"), "init_if_needed")), 12, "reinit", "HIGH", 0.70, "%s: account may be initialised again", field, False, "k", "f", 200),
        candidate(p.calls.where(~c("validated") & c("call_type").contains("invoke")), 13, "arbitrary_cpi", "CRITICAL", 0.85, "%s: called program isn't validated"),
        candidate(p.pdas.where("bump = 'unchecked'"), 14, "pda_derivation", "HIGH", 0.75, "%s: bump isn't checked"),
        candidate(p.pdas.where("bump = 'missing' and source = 'constraint'"), 15, "pda_derivation", "MEDIUM", 0.60, "%s: address without a stored bump"),
        candidate(sums.withColumn("excerpt", F.trim("excerpt")), 16, "integer_overflow", "HIGH", 0.55, "%s: unchecked arithmetic on a value", None, False, "k"),
    )


def shows(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.regexp_like(text, F.lit(any_pattern(patterns)))


def stale_prices(p: Parsed, most: int = 5) -> DataFrame:
    """Prices read without a test of their age, at most one a function and `most` a repository, the rule's own limit. First the
    operations that read a price, then, in repositories without any or of another framework, whole bodies."""
    body = c("body")
    bodies = p.instructions.select("repo_id", c("name").alias("instruction"), "calls", c("excerpt").alias("body"), c("ord").alias("i_ord"))
    fresh, sure, sane = shows(body, STALENESS), shows(body, CONFIDENCE), shows(body, SANITY)
    # of the four guards the two that a candidate can still have
    grave = ~sure & ~sane
    read = joins.first_match(p.sinks.where("sink = 'oracle_read'"), bodies, ["repo_id", "instruction"], ["i_ord"]).where(~fresh & ~F.exists("calls", lambda f: shows(f, VALIDATION_CALL)))
    one = joins.first_of(read, ["repo_id", "instruction"], ["ord"])
    feeds, others = F.filter("accounts", lambda a: shows(a, ORACLE_ACCOUNT)), F.filter("accounts", lambda a: ~shows(a, ORACLE_ACCOUNT))
    priced = candidate(one, 20, "oracle_validation", F.when(grave, "CRITICAL").otherwise("HIGH"), F.when(grave, 0.82).otherwise(0.65), "%s: price is read without a test of its age", F.concat(feeds, F.slice(others, 1, 2)), True)
    rest = p.instructions.select("repo_id", "path", c("name").alias("instruction"), "line", "end_line", "framework", "calls", c("excerpt").alias("body"), F.substring("excerpt", 1, 200).alias("excerpt"), "ord")
    rest = rest.where(shows(body, ORACLE_READ) & ~fresh & ~F.exists("calls", lambda f: shows(f, BODY_VALIDATION_CALL)))
    rest = joins.first_of(joins.without(rest, one, ["repo_id", "instruction"]), ["repo_id", "instruction"], ["ord"])
    sunk = p.sinks.where("sink = 'oracle_read'").select("repo_id").distinct()
    rest = union(rest.where("framework <> 'anchor'"), joins.without(rest.where("framework = 'anchor'"), sunk, ["repo_id"]))
    found = union(priced, candidate(rest, 21, "oracle_validation", "HIGH", 0.65, "%s: price is read without a test of its age"))
    return rank.top_n(found, ["repo_id"], ["rule", "ord"], most, "__n").drop("__n")


def _lines(instructions: DataFrame) -> DataFrame:
    """Lines of functions (k from 0), with the number that each has in its file."""
    rows = instructions.select("repo_id", "path", c("name").alias("instruction"), "ord", c("line").alias("first"), F.posexplode(F.split("excerpt", "\n", -1)).alias("k", "text"))
    return rows.withColumn("line", c("first") + c("k"))


def unowned_bytes(p: Parsed, most_structs: int = 5) -> DataFrame:
    """In native repositories of few account structs: bytes read from an account whose owner the function never looks at, one row for
    each account of a function."""
    many = p.structs.groupBy("repo_id").count().where(c("count") > most_structs).select("repo_id")
    plain = joins.without(p.instructions.where("framework <> 'anchor'"), many, ["repo_id"]).where(~shows(c("excerpt"), OWNER_CHECK))
    rows = _lines(plain).where(~F.ltrim("text").startswith("//") & shows(c("text"), DESERIALIZE))
    account = F.regexp_extract("text", r"let\s+(?:mut\s+)?(\w+)\s*=.*(?:unpack|deserialize|try_from)", 1)
    rows = rows.withColumn("account", F.when(account != "", account).otherwise("unknown_account")).withColumn("end_line", c("line") + 1).withColumn("excerpt", F.trim("text"))
    return candidate(joins.first_of(rows, ["repo_id", "instruction", "account"], ["ord", "k"]), 22, "missing_owner", "HIGH", 0.72, "%s: bytes are read from an account of unknown owner", F.array("account"), False, "k")


def stale_reads(p: Parsed) -> DataFrame:
    """A call of another program, and in the next 29 lines a read of state that nothing has loaded again: the first of each function,
    with the first call of the repository that stands within two lines of it, in whatever file."""
    order = Window.partitionBy("repo_id", "path", "instruction", "ord").orderBy("k")
    after = F.array_join(F.collect_list("text").over(order.rowsBetween(1, 29)), "\n")
    n_after = F.count("text").over(order.rowsBetween(1, 29))
    rows = _lines(p.instructions).withColumn("after", after).withColumn("end_line", (c("line") + F.least(n_after, F.lit(10))).cast("int"))
    rows = rows.where(~F.ltrim("text").startswith("//") & shows(c("text"), PROGRAM_CALL) & shows(c("after"), STATE_READ) & ~shows(c("after"), RELOAD))
    first = joins.first_of(rows, ["repo_id", "instruction"], ["ord", "k"]).select("repo_id", "path", "instruction", "ord", "k", "line", "end_line", F.trim("text").alias("excerpt"))
    calls = p.calls.select("repo_id", c("line").alias("call_line"), c("ord").alias("call_ord"), F.when(c("target") != "", c("target")).otherwise("unknown_program").alias("target"))
    near = joins.band_first(first, calls, ["repo_id"], "line", "call_line", -2, 2, ["call_ord", "call_line", "target"], 4)
    accounts = F.filter(F.array("target"), lambda x: x.isNotNull())
    return candidate(near, 23, "stale_post_cpi", "HIGH", 0.68, "%s: state is read after a call without reload", accounts, False, "k")


def third_generation(p: Parsed) -> DataFrame:
    """Price, owner and stale-read candidates over the excerpts of bodies."""
    return union(stale_prices(p), unowned_bytes(p), stale_reads(p))


def keyed(candidates: DataFrame, prefix: str = "") -> DataFrame:
    text = decide.fingerprint("vuln_class", "instruction", "path", c("line").cast("string"), names=c("accounts"))
    return candidates.withColumn("fingerprint", F.concat(F.lit(prefix), text))


def generate(p: Parsed) -> DataFrame:
    """Candidates of the second generation: one a fingerprint, ranked by weight times confidence, id from 0 in that order."""
    found = keyed(second_generation(p))
    place = F.concat_ws("/", F.lpad(c("rule").cast("string"), 3, "0"), "ord")
    rest = [x for x in found.columns if x not in ("repo_id", "fingerprint")]
    best = found.withColumn("place", place).groupBy("repo_id", "fingerprint").agg(F.min_by(F.struct(*rest), F.struct((-c("confidence")).alias("x"), "place")).alias("b"), F.min("place").alias("first"))
    best = best.select("repo_id", "fingerprint", *[c(f"b.{x}").alias(x) for x in rest], "first")
    score = decide.severity_weight(c("severity")) * c("confidence")
    out = rank.ranked(best.withColumn("score", score), ["repo_id"], [c("score").desc(), "first"])
    return out.withColumn("id", c("rank") - 1).withColumn("origin", F.lit("second"))


def with_third(candidates: DataFrame, p: Parsed) -> DataFrame:
    """Adds the third generation's, with ids from 10000; the two aren't deduplicated against each other."""
    more = rank.ranked(keyed(third_generation(p), "v3:"), ["repo_id"], ["rule", "ord"])
    more = more.withColumn("id", c("rank") + 9999).withColumn("origin", F.lit("third")).withColumn("score", decide.severity_weight(c("severity")) * c("confidence")).withColumn("first", c("ord"))
    return candidates.unionByName(more)


def graded(candidates: DataFrame, confirmations: DataFrame, proofs: DataFrame, p: Parsed, sure_from: int = 80, open_from: int = 50) -> DataFrame:
    """Candidates with status, adjusted and capped severity, blended confidence, and grade with its evidence.

    A proof gives A. A confirmation of at least `sure_from` gives B if there is evidence in the source, else C; without it evidence
    gives C, and so does an uncertain verdict of at least `open_from`; the rest are D. Evidence is accounts, a value-moving operation, a
    known account struct of the function, a place of 20 lines or fewer, or a rule of the third generation.

    confirmations: repo_id, id, verdict, sure, easy; proofs: repo_id, id, proven; both may lack a candidate. Third-generation ones
    are LIKELY unless a proof says more."""
    uses = joins.earliest(p.instructions.where("context is not null").select("repo_id", c("name").alias("instruction"), "context", "ord"), ["repo_id", "instruction"], ["ord"])
    firsts = joins.earliest(p.instructions.select("repo_id", c("name").alias("instruction"), "ord"), ["repo_id", "instruction"], ["ord"])
    known = struct_of(p, uses.join(firsts, ["repo_id", "instruction", "ord"])).where("struct is not null").select("repo_id", "instruction", c("struct").alias("known_struct"))
    rows = candidates.join(confirmations, ["repo_id", "id"], "left").join(proofs, ["repo_id", "id"], "left").join(known, ["repo_id", "instruction"], "left")
    verdict, proven = c("verdict"), F.coalesce("proven", F.lit(False))
    status = decide.status(proven, verdict, c("severity"), c("confidence"))
    rows = rows.withColumn("status", F.when((c("origin") == "third") & ~proven, "LIKELY").otherwise(status))
    rows = rows.withColumn("severity", decide.adjusted_severity(c("severity"), verdict, c("sure"), F.coalesce("easy", F.lit(False)))).withColumn("confidence", decide.blended_confidence(c("confidence"), verdict, c("sure"), proven))
    narrow = c("end_line") - c("line") <= 20
    signs = [
        F.when(F.size("accounts") > 0, F.concat(F.lit("accounts "), F.array_join("accounts", ", "))), c("link"), F.concat(F.lit("account struct "), c("known_struct")),
        F.when(narrow, F.format_string("lines %d-%d", "line", "end_line")), F.when(c("origin") == "third", F.lit("third-generation rule")),
    ]
    evidence = F.filter(F.array(*signs), lambda x: x.isNotNull())
    some, sure = F.size("evidence") > 0, (verdict == "confirmed") & (c("sure") >= sure_from)
    grade = F.when(proven, "A").when(sure & some, "B").when(sure | some | ((verdict == "uncertain") & (c("sure") >= open_from)), "C").otherwise("D")
    rows = rows.withColumn("evidence", evidence).withColumn("grade", grade).withColumn("uncapped", c("severity"))
    return rows.withColumn("severity", decide.capped_severity(c("severity"), c("grade"))).withColumn("evidence", F.array_join("evidence", "; ")).drop("known_struct")


def grade_distribution(rows: DataFrame) -> DataFrame:
    """Findings of each grade and those whose severity their grade lowered, of each repository."""
    g = c("grade")
    return rows.groupBy("repo_id").agg(*[F.count_if(g == x).alias(x.lower()) for x in "ABCD"], F.count_if(c("severity") != c("uncapped")).alias("downgraded"))


def status_counts(rows: DataFrame) -> DataFrame:
    s = c("status")
    return rows.groupBy("repo_id").agg(F.count("*").alias("total"), *[F.count_if(s == x).alias(x.lower()) for x in ("PROVEN", "LIKELY", "NEEDS_HUMAN", "REJECTED")])


def not_rejected(rows: DataFrame) -> DataFrame:
    return rows.where(c("status") != "REJECTED")


def at_least(rows: DataFrame, severity: str) -> DataFrame:
    """Rows as grave as `severity` or graver."""
    return rows.where(decide.severity_rank(c("severity")) <= decide.severity_rank(F.lit(severity)))


def proof_jobs(candidates: DataFrame, confirmations: DataFrame, sure: float = 0.85) -> DataFrame:
    """Candidates that a proof is worth: confirmed ones, and where nobody has looked the sure and critical ones."""
    rows = candidates.join(confirmations.select("repo_id", "id", "verdict"), ["repo_id", "id"], "left")
    return rows.where((c("verdict") == "confirmed") | (c("verdict").isNull() & (c("confidence") >= sure) & (c("severity") == "CRITICAL")))


def fallback_topk(candidates: DataFrame, most: int) -> DataFrame:
    """The first `most` of each repository by severity (100, 50, 10) plus 40 times the confidence; equal ones by id."""
    s = c("severity")
    score = F.when(s == "CRITICAL", 100).when(s == "HIGH", 50).otherwise(10) + c("confidence") * 40.0
    return rank.top_n(candidates.drop("rank"), ["repo_id"], [score.desc(), "id"], most)


def dispatch_names(p: Parsed) -> DataFrame:
    """(repo_id, instruction, names): under which variants of a dispatch table a function is called, in order; a dispatcher that isn't
    called from one itself has all of its variants. Bodies are read whole, however far down a table goes."""
    # a body may be long, so an arm begins only where a name does, and what is repeated is given up whole (possessive): time follows the text
    arm = r"(?<!\w)(?<!\w::)(\w++(?:::\w++)*+)\s*+=>\s*+(?:\{\s*+)?+(?:self\.|Self::)?(\w++)\s*+\("
    zipped = F.arrays_zip(F.regexp_extract_all("body", F.lit(arm), F.lit(1)).alias("variant"), F.regexp_extract_all("body", F.lit(arm), F.lit(2)).alias("callee"))
    # few functions hold a table, and a join before may have put them all into one partition, as they are small
    tables = spread(p.instructions.where(c("body").contains("=>")).select("repo_id", "name", "ord", "body"), "repo_id")
    rows = tables.select("repo_id", c("name").alias("dispatcher"), "ord", F.posexplode(zipped).alias("k", "x"))
    rows = rows.select("repo_id", "dispatcher", "ord", "k", F.lower(F.element_at(F.split("x.variant", "::"), -1)).alias("variant"), "x.callee").where(~c("callee").isin("err", "msg", "return"))
    known = p.instructions.select("repo_id", c("name").alias("callee")).distinct()
    first = rows.join(known, ["repo_id", "callee"]).groupBy("repo_id", "callee", "variant").agg(F.min(F.struct("ord", "k")).alias("at"))
    called = first.groupBy("repo_id", c("callee").alias("instruction")).agg(F.array_sort(F.collect_list(F.struct("at", "variant"))).alias("all"))
    own = rows.groupBy("repo_id", c("dispatcher").alias("instruction")).agg(F.array_sort(F.collect_list(F.struct(F.struct("ord", "k").alias("at"), "variant"))).alias("all"))
    both = called.unionByName(joins.without(own, called, ["repo_id", "instruction"]))
    return both.select("repo_id", "instruction", F.transform("all", lambda x: x["variant"]).alias("names"))
