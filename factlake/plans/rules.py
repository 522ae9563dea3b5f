"""Rules of the first generation: each takes the fact tables and gives findings as a DataFrame.

A finding has repo_id, class_id, class_name, severity, confidence, title, path, line, end_line, instruction, and rule and ord,
which give its place. A rule is registered with its number; `detect` unions those asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import decide, facts, joins, rank

c = F.col


@dataclass
class Facts:
    files: DataFrame
    kinds: DataFrame
    instructions: DataFrame
    structs: DataFrame
    cpis: DataFrame
    pdas: DataFrame


def gather(files: DataFrame, manifests: DataFrame | None = None) -> Facts:
    kinds = facts.frameworks(files, manifests)
    return Facts(files, kinds, facts.instructions(files, kinds), facts.account_structs(files), facts.cpi_calls(files), facts.pda_derivations(files))


# Fixed values from here on: the names of the classes, the words that each rule looks for, and its severities and confidences.
RULES: dict[int, tuple[str, Callable[[Facts], DataFrame]]] = {}


def rule(number: int, name: str):
    def add(f):
        RULES[number] = name, f
        return f

    return add


def body(*words: str) -> Column:
    return decide.any_of(c("body"), *words)


def named(*words: str) -> Column:
    return decide.any_of(c("name"), *words)


def finding(df: DataFrame, severity: str | Column, confidence: float, title: Column, part: int = 0, *, instruction: str = "name", place: Column | None = None) -> DataFrame:
    end = c("end_line") if "end_line" in df.columns else F.lit(None).cast("int")
    level = F.lit(severity) if isinstance(severity, str) else severity
    order = F.concat_ws("#", "ord", *([F.lpad(place.cast("string"), 6, "0")] if place is not None else []), F.lit(str(part)))
    return df.select("repo_id", level.alias("severity"), F.lit(confidence).alias("confidence"), title.alias("title"), "path", c("line").cast("int").alias("line"), end.alias("end_line"), c(instruction).alias("instruction"), order.alias("ord"))


def both(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def each_account(df: DataFrame, test=None) -> DataFrame:
    accounts = F.filter("accounts", test) if test else c("accounts")
    return df.select("*", F.posexplode(accounts).alias("n", "account"))


@rule(1, "Missing Signer Check")
def missing_signer(f: Facts) -> DataFrame:
    open_ = f.instructions.where(F.exists("accounts", lambda a: a["is_mut"]) & ~F.exists("accounts", lambda a: a["is_signer"]) & (F.size("signer_checks") == 0) & ~body("is_signer", "Signer<", "#[account(signer"))

    def ruler(a):
        return decide.any_of(a["name"], "authority", "owner", "admin", "payer")

    one = each_account(open_, ruler)
    rest = open_.where(~F.exists("accounts", ruler))
    return both(finding(one, "CRITICAL", 0.92, F.format_string("%s: signature of '%s' is never required", "name", "account.name"), place=c("n")), finding(rest, "HIGH", 0.75, F.format_string("%s: changes accounts without any signer", "name")))


@rule(2, "Missing Owner Check")
def missing_owner(f: Facts) -> DataFrame:
    native = each_account(f.instructions.where((c("framework") == "native") & ~F.array_contains("owner_checks", "owner_check")), lambda a: a["is_mut"])
    anchor = f.instructions.where((c("framework") == "anchor") & body("UncheckedAccount", "AccountInfo") & ~body("/// CHECK:") & ~F.array_contains("owner_checks", "anchor_account_type"))
    return both(finding(native, "CRITICAL", 0.88, F.format_string("%s: owner of '%s' isn't verified", "name", "account.name"), place=c("n")), finding(anchor, "HIGH", 0.82, F.format_string("%s: unchecked account without owner validation", "name")))


@rule(3, "PDA Derivation Mistake")
def pda_mistakes(f: Facts) -> DataFrame:
    user = F.exists("seeds", lambda s: decide.any_of(s, "key()", "pubkey", "authority", "user", "owner", ".as_ref()"))

    def part(test: Column, severity: str, confidence: float, text: str, k: int) -> DataFrame:
        return finding(f.pdas.where(test), severity, confidence, F.format_string(f"%s: {text}", "instruction"), k, instruction="instruction")

    return both(
        part(c("bump") == "unchecked", "HIGH", 0.85, "bump of a derived address isn't checked", 0),
        part(~user & (F.size("seeds") <= 1), "HIGH", 0.80, "seeds of a derived address don't tell users apart", 1),
        part(c("bump") == "missing", "MEDIUM", 0.70, "derived address without a bump", 2),
    )


@rule(4, "Arbitrary CPI Target")
def arbitrary_target(f: Facts) -> DataFrame:
    return finding(f.cpis.where(~c("validated")), "CRITICAL", 0.90, F.format_string("%s: called program isn't validated", "instruction"), instruction="instruction")


@rule(5, "Type Confusion / Account Substitution")
def type_confusion(f: Facts) -> DataFrame:
    structs = f.structs.join(f.kinds, "repo_id")
    native = structs.where(c("framework") == "native").withColumn("instruction", F.lit(None).cast("string"))
    readers = f.files.where(c("content").contains("try_from_slice")).select("repo_id", c("path").alias("file"), "content")
    read = structs.join(readers, "repo_id").where(c("content").contains(c("name"))).select("repo_id", c("file").alias("path"), "name", F.lit(0).alias("line"), F.lit(None).cast("string").alias("instruction"), F.concat_ws("@", "ord", "file").alias("ord"))
    return both(finding(native, "HIGH", 0.80, F.format_string("Struct '%s' has no discriminator", "name"), instruction="instruction"), finding(read, "MEDIUM", 0.72, F.format_string("'%s' is read from bytes without a type check", "name"), 1, instruction="instruction"))


@rule(6, "Reinitialization / Double-Init")
def double_init(f: Facts) -> DataFrame:
    seen = body("is_initialized", "initialized == true", "initialized == false", "!= 0") | F.regexp_like("body", F.lit(r"require!\s*\(\s*!\s*\w+\.initialized"))
    return finding(f.instructions.where(named("init", "create", "setup") & ~body("#[account(init", "init,") & ~seen), "HIGH", 0.85, F.format_string("%s: can be run again on a live account", "name"))


@rule(7, "Close-then-Revive / Closure without Zeroing")
def close_revive(f: Facts) -> DataFrame:
    closing = named("close", "delete", "withdraw_all", "remove") | (body("lamports()") & body("= 0", "-="))
    zeroed = body("fill(0)", "0u8; ", ".data.borrow_mut()") | (body("#[account(") & body("close"))
    return finding(f.instructions.where(closing & ~zeroed), "HIGH", 0.82, F.format_string("%s: closes an account and leaves its data", "name"))


@rule(8, "Unchecked Realloc / Stale Memory")
def unchecked_realloc(f: Facts) -> DataFrame:
    return finding(f.instructions.where(body("realloc") & ~body("zero_init", "realloc::zero = true")), "MEDIUM", 0.78, F.format_string("%s: grown memory isn't zeroed", "name"))


@rule(9, "Integer Overflow/Underflow")
def overflow(f: Facts) -> DataFrame:
    ops = f.instructions.select("repo_id", "path", "name", "end_line", "ord", F.posexplode("arithmetic").alias("n", "op")).where("not op.checked")
    ops = ops.select("repo_id", "path", "name", "end_line", c("op.line").alias("line"), c("op.op").alias("sign"), F.concat_ws("+", "ord", F.lpad(c("n").cast("string"), 6, "0")).alias("ord"))
    return finding(joins.earliest(ops, ["repo_id", "path", "line"], ["ord"]), "HIGH", 0.80, F.format_string("%s: unchecked '%s' on a value", "name", "sign"))


@rule(10, "State Machine Violation")
def state_machine(f: Facts) -> DataFrame:
    checked = F.regexp_like("body", F.lit("(?s)(?:require|assert|match|if).*(?:state|status|phase|stage)"))
    return finding(f.instructions.where(named("claim", "redeem", "withdraw", "finalize", "update", "transition", "complete", "cancel") & ~checked), "HIGH", 0.75, F.format_string("%s: doesn't look at the state it leaves", "name"))


@rule(11, "Remaining Accounts Privilege Injection")
def remaining_accounts(f: Facts) -> DataFrame:
    uses = f.instructions.where(body("remaining_accounts"))
    known = body("remaining_accounts.iter()") & body("key()", "owner", "is_signer")
    return both(
        finding(uses.where(~known), "HIGH", 0.85, F.format_string("%s: remaining accounts are taken unseen", "name")),
        finding(uses.where(~F.regexp_like("body", F.lit(r"remaining_accounts\.len\(\)\s*[<>=!]"))), "MEDIUM", 0.65, F.format_string("%s: remaining accounts aren't counted", "name"), 1),
    )


@rule(12, "Oracle Validation Failure")
def oracle(f: Facts) -> DataFrame:
    uses = f.instructions.where(body("price", "oracle", "pyth", "switchboard", "chainlink"))
    fresh = body("timestamp", "last_updated", "stale", "age") | (body("slot") & body("current"))
    owned = body("oracle") & ((F.size("owner_checks") > 0) | body("owner"))
    return both(
        finding(uses.where(~fresh), "HIGH", 0.82, F.format_string("%s: price may be stale", "name")),
        finding(uses.where(~body("conf", "deviation", "twap")), "MEDIUM", 0.70, F.format_string("%s: price is used without its confidence", "name"), 1),
        finding(uses.where(~owned), "CRITICAL", 0.88, F.format_string("%s: owner of the price account isn't verified", "name"), 2),
    )


@rule(13, "Token Account Authority/Mint Mismatch")
def token_mismatch(f: Facts) -> DataFrame:
    uses = f.instructions.where(body("TokenAccount", "token_account", "token::", "spl_token"))
    mint = body("mint =", "token::mint") | F.regexp_like("body", F.lit(r"constraint.*mint.*key\(\)"))
    authority = body("token::authority", "authority =") | F.regexp_like("body", F.lit(r"constraint.*authority.*key\(\)"))
    return both(finding(uses.where(~mint & body("mint")), "HIGH", 0.83, F.format_string("%s: mint isn't compared", "name")), finding(uses.where(~authority & body("vault", "treasury", "pool")), "HIGH", 0.80, F.format_string("%s: authority of a token account isn't compared", "name"), 1))


@rule(14, "Post-CPI Stale Read")
def stale_read(f: Facts) -> DataFrame:
    own = f.instructions.select("repo_id", c("name").alias("instruction"), "body", "end_line", c("ord").alias("i_ord"))
    calls = joins.first_match(f.cpis, own, ["repo_id", "instruction"], ["i_ord"])
    rows = F.split("body", "\n", -1)
    calls_at = F.filter(F.transform(rows, lambda x, i: F.when(x.contains("invoke") | x.contains("CpiContext"), i)), lambda i: i.isNotNull())
    first = F.try_element_at(calls_at, F.lit(1))
    after = F.array_join(F.slice(rows, first + 2, F.size(rows)), "\n")
    reads = F.regexp_extract_all(c("after"), F.lit(r"(\w+)\.(amount|lamports|data|key)"), F.lit(1))
    found = calls.where(first.isNotNull()).withColumn("after", after).withColumn("read", F.try_element_at(F.filter(reads, lambda n: ~F.array_contains("reloaded", n) & ~c("after").contains(F.concat(n, F.lit(".reload()"))) & ~n.isin("ctx", "self")), F.lit(1)))
    return finding(found.where(c("read").isNotNull()), "HIGH", 0.78, F.format_string("%s: '%s' is read after a call without reload", "instruction", "read"), instruction="instruction")


@rule(15, "Duplicate Account Injection / Account Aliasing")
def duplicates(f: Facts) -> DataFrame:
    unequal = body("key() !=") | (body("!= ") & body(".key()")) | F.regexp_like("body", F.lit(r"constraint\s*=.*key\(\)\s*!=\s*.*key\(\)"))
    some = f.instructions.withColumn("muts", F.transform(F.filter("accounts", lambda a: a["is_mut"]), lambda a: a["name"])).where((F.size("muts") >= 2) & ~unequal)
    pairs = F.flatten(F.transform("muts", lambda a, i: F.transform(F.slice("muts", i + 2, F.size("muts")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    found = some.select("*", F.posexplode(pairs).alias("n", "p"))
    a, b = c("p.a"), c("p.b")
    roles = [a.contains(x) & b.contains(y) for x, y in (("from", "to"), ("source", "dest"), ("sender", "receiver"), ("user", "vault"))]
    near = reduce(lambda x, y: x | y, roles) | ((a == "account_a") & (b == "account_b")) | (F.size("muts") == 2)
    return finding(found.where(near), "HIGH", 0.75, F.format_string("%s: '%s' and '%s' may be one account", "name", "p.a", "p.b"), place=c("n"))


def detect(f: Facts, numbers: list[int] | None = None) -> DataFrame:
    """Findings of the rules, in the order of their numbers."""
    out = [RULES[n][1](f).select("*", F.lit(n).alias("class_id"), F.lit(RULES[n][0]).alias("class_name"), F.lit(n).alias("rule")) for n in numbers or sorted(RULES)]
    return both(*out)


# ---- constraints and permutations ------------------------------------------------------------------------


CONSTRAINTS: dict[str, tuple[int, Callable[[Facts], DataFrame]]] = {}


def constraint(kind: str, class_id: int):
    """Registers a constraint: it gives (repo_id, kind, subject, severity, message, ord) of what doesn't hold."""

    def add(f):
        CONSTRAINTS[kind] = class_id, f
        return f

    return add


def violations(f: Facts, kinds: list[str] | None = None) -> DataFrame:
    """Violations of the constraints named, in the order in which they were registered; by default of all."""
    return both(*(CONSTRAINTS[k][1](f) for k in kinds or CONSTRAINTS))


@constraint("authority_chain", 1)
def authority_chain(f: Facts) -> DataFrame:
    one = each_account(f.instructions, lambda a: a["is_mut"] & ~a["name"].contains("system_program") & ~a["name"].contains("token_program"))
    one = one.where(~F.exists("accounts", lambda a: a["is_signer"]))
    name = c("account.name")
    linked = body("has_one") | F.regexp_like("body", F.concat(F.lit("constraint.*"), name, F.lit(".*(authority|owner)")))
    chain = one.where(~linked).select("repo_id", F.lit("authority_chain").alias("kind"), F.concat_ws("::", "name", name).alias("subject"), F.lit("HIGH").alias("severity"), F.format_string("'%s' of %s is changed without a verified authority", name, "name").alias("message"), F.concat_ws("#", F.lit("0"), "ord", F.lpad(c("n").cast("string"), 6, "0")).alias("ord"))
    return chain


@constraint("pda_consistency", 3)
def pda_consistency(f: Facts) -> DataFrame:
    seeds = F.array_join(F.array_sort(F.transform("seeds", lambda s: F.regexp_replace(s, r"\s", ""))), "|")
    grouped = f.pdas.withColumn("set", seeds).groupBy("repo_id", "set").agg(F.array_sort(F.collect_set("bump")).alias("modes"), F.min("ord").alias("first")).where(F.size("modes") > 1)
    return grouped.select("repo_id", F.lit("pda_consistency").alias("kind"), c("set").alias("subject"), F.lit("HIGH").alias("severity"), F.format_string("Address of seeds [%s] is derived with bumps %s", "set", F.array_join("modes", ", ")).alias("message"), F.concat_ws("#", F.lit("1"), "first").alias("ord"))


@constraint("balance_conservation", 9)
def balance_conservation(f: Facts) -> DataFrame:
    moved = f.instructions.where(body("try_borrow_mut_lamports") | (body("lamports") & body("+=")))
    ups, downs = F.regexp_count("body", F.lit(r"lamports\(\).*\+=")), F.regexp_count("body", F.lit(r"lamports\(\).*-="))
    return moved.where(ups != downs).select("repo_id", F.lit("balance_conservation").alias("kind"), c("name").alias("subject"), F.lit("MEDIUM").alias("severity"), F.format_string("%s adds lamports %d times and takes them %d times", "name", ups, downs).alias("message"), F.concat_ws("#", F.lit("2"), "ord").alias("ord"))


def permutations(f: Facts) -> DataFrame:
    """(repo_id, instruction, kind, severity, accounts, ord) of account lists that an attacker would try."""
    rows = f.instructions.select("repo_id", c("name").alias("instruction"), "accounts", "ord")

    def named_account(*words):
        return lambda a: decide.any_of(a["name"], *words)

    signer = rows.select("*", F.explode(F.filter("accounts", lambda a: a["is_signer"] | named_account("authority", "owner", "admin")(a))).alias("a")).select("repo_id", "instruction", F.lit("signer_substitution").alias("kind"), F.lit("critical").alias("severity"), F.array("a.name").alias("names"), "ord")
    muts = F.transform(F.filter("accounts", lambda a: a["is_mut"]), lambda a: a["name"])
    pairs = F.flatten(F.transform("muts", lambda a, i: F.transform(F.slice("muts", i + 2, F.size("muts")), lambda b: F.array(a, b))))
    alias = rows.withColumn("muts", muts).select("repo_id", "instruction", F.lit("aliasing").alias("kind"), F.lit("high").alias("severity"), F.explode(pairs).alias("names"), "ord")
    program = rows.select("*", F.explode(F.filter("accounts", named_account("program"))).alias("a")).select("repo_id", "instruction", F.lit("program_substitution").alias("kind"), F.lit("critical").alias("severity"), F.array("a.name").alias("names"), "ord")
    data = rows.select("*", F.explode(F.filter("accounts", lambda a: ~named_account("program", "system", "rent", "clock")(a))).alias("a")).select("repo_id", "instruction", F.lit("uninitialised").alias("kind"), F.lit("medium").alias("severity"), F.array("a.name").alias("names"), "ord")
    return both(signer, alias, program, data)


def with_constraints(findings: DataFrame, f: Facts) -> DataFrame:
    """findings, then violations that none of them covers (same function and class), then notes for critical permutations of
    functions without a critical finding."""
    kind = c("kind")
    class_id = reduce(lambda x, k: x.when(kind == k, CONSTRAINTS[k][0]), CONSTRAINTS, F.when(F.lit(False), 0)).otherwise(0)
    found = violations(f).withColumn("class_id", class_id).withColumn("instruction", F.element_at(F.split("subject", "::"), 1))
    # of balance rows a later one is covered by an earlier one of the same function
    fresh = joins.without(found, findings, ["repo_id", "instruction", "class_id"])
    again = joins.first_of(fresh.where(kind == "balance_conservation"), ["repo_id", "subject"], ["ord"])
    fresh = both(fresh.where(kind != "balance_conservation"), again)
    extra = fresh.select("repo_id", "severity", F.lit(0.65).alias("confidence"), c("message").alias("title"), F.lit("constraint-analysis").alias("path"), F.lit(0).alias("line"), F.lit(None).cast("int").alias("end_line"), c("subject").alias("instruction"), "ord", "class_id", F.concat(F.lit("Constraint: "), kind).alias("class_name"), F.lit(20).alias("rule"))
    so_far = both(findings, extra)
    grave = so_far.where("severity = 'CRITICAL'")
    notes = joins.without(permutations(f).where("severity = 'critical'"), grave, ["repo_id", "instruction"])
    notes = notes.select("repo_id", F.lit("INFO").alias("severity"), F.lit(0.50).alias("confidence"), F.format_string("%s: %s of %s", "instruction", "kind", F.array_join("names", ", ")).alias("title"), F.lit("adversarial-synthesis").alias("path"), F.lit(0).alias("line"), F.lit(None).cast("int").alias("end_line"), "instruction", F.concat_ws("#", "ord", "kind", F.array_join("names", ",")).alias("ord"), F.lit(0).alias("class_id"), F.lit("Adversarial Account Synthesis").alias("class_name"), F.lit(21).alias("rule"))
    return both(so_far, notes)


def assemble(findings: DataFrame) -> DataFrame:
    """One finding of each class, place and function (the surest; of equals the first), with rank by weight times confidence in
    each repository; equal scores keep the order in which their key first stood."""
    place = F.concat_ws("/", F.lpad(c("rule").cast("string"), 3, "0"), "ord")
    key = ["repo_id", "class_id", "path", "line", "instruction"]
    rest = [x for x in findings.columns if x not in key]
    keyed = findings.withColumn("__place", place)
    best = keyed.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct((-c("confidence")).alias("x"), "__place")).alias("best"), F.min("__place").alias("first"))
    best = best.select(*key, *[c(f"best.{x}").alias(x) for x in rest], "first")
    score = decide.severity_weight(c("severity")) * c("confidence")
    return rank.ranked(best.withColumn("score", score), ["repo_id"], [c("score").desc(), "first"])


def summary(ranked: DataFrame) -> DataFrame:
    """Counts by severity, the verdict and the recommendation of each repository."""
    s = c("severity")
    found = ranked.groupBy("repo_id").agg(F.count("*").alias("total"), *[F.count_if(s == name).alias(name.lower()) for name, _ in decide.SEVERITIES])
    counts = c("critical"), c("high"), c("medium")
    return found.withColumn("verdict", decide.verdict(*counts)).withColumn("recommendation", decide.recommendation(*counts))


def audit(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Ranked findings of all repositories."""
    f = gather(files, manifests)
    return assemble(with_constraints(detect(f), f))
