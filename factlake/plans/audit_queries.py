"""Queries of the audit rules, each over fact tables made from all rows of `part`, with the SQL that it must equal.

Facts of a part are picked by its key from short lists of names, bodies and account lists, by prime moduli, so that all of them meet.
The lists are the same literals on both sides; what the rules make of them is written twice, in DataFrames and in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from . import graphs, rules
from .queries import query

_PER_REPO = 20
_NAMES = ["init_vault", "create_pool", "setup", "close_account", "delete_user", "withdraw_all", "claim", "transfer", "update", "deposit", "finalize", "run", "remove"]
_BODIES = [
    "let a = 1;", "#[account(init, payer = user)]\nvault.initialized = true;", "require!(!vault.initialized, Bad);\nvault.x = 1;", "if vault.state == 0 { }\nvault.is_signer();", "let v: UncheckedAccount = x;",
    "/// CHECK: fine\nlet v: AccountInfo = x;", "acc.lamports() -= 5;\nto.lamports() += 5;\nto.lamports() += 1;", "let lamports = a.lamports();\nx = 0;\n**a.try_borrow_mut_lamports()? = 0;", "data.fill(0);\na.lamports() -= 1;",
    "acc.realloc(10, false)?;", "acc.realloc(10, false)?; // realloc::zero = true", "for a in ctx.remaining_accounts.iter() { a.key(); }", "let r = ctx.remaining_accounts;\nctx.remaining_accounts.len() > 3;", "let p = oracle.price;",
    "let p = pyth.price; let age = clock.slot - current; let conf = p.conf; owner", "let p = switchboard.value; twap; last_updated", "token::transfer(from: ctx.accounts.vault, to: pool)?; // mint vault",
    "token_account.mint = x; vault; authority = y; token::mint_to(z)", "invoke(&ix, &accs)?;\nlet x = vault.amount;\nlet y = ctx.data;", "invoke(&ix, &accs)?;\nvault.reload()?;\nlet x = vault.amount;\nlet y = pool.lamports;",
    "CpiContext::new(a, b);\nself.key;\nlet z = ctx.amount;\nvault.state = State::Open;", "require!(a.key() != b.key(), Same);\nSigner<\nrequire!(vault.state == State::Closed, Bad);", "has_one = authority\nmatch vault.state { Open => 1, Closed => 2 }\nconstraint = vault.authority; token::burn(x)",
]
_ACCOUNTS = [
    [], ["vault:m"], ["vault:m", "authority:m"], ["vault:m", "user:s"], ["from:m", "to:m", "system_program:"], ["to:m", "from:m", "user_key:", "token_program:m"], ["account_a:m", "account_b:m", "vault:m", "user:m"],
]
_SIGNERS = [[], ["is_signer"], ["has_one"]]
_OWNERS = [[], ["owner_check"], ["anchor_account_type"], ["token_authority"], ["owner_check", "anchor_account_type"]]
_SUMS = [[], ["0+n"], ["0+y", "1-n"], ["1*n", "1-n"], [], ["2/n"], [], ["3+y"], ["0-n", "4*n"], [], ["1+n"]]
_RELOADED = [[], ["vault"], ["pool"]]
_SEEDS = [["b\"x\""], ["b\"x\"", "user.key()"], ["user.key()", "b\"x\""], [], ["b\"pool\"", "mint"], ["authority"], ["b\"pool\" ", "mint"]]
_STRUCTS = ["Vault", "Pool", "User", "Config", "Position"]
_FIELDS = [[], ["authority"], ["amount", "is_active"], ["owner", "claimed"], ["bump"], ["admin_key", "locked"], ["initialized"]]
_FILES = [
    "let v = Vault::try_from_slice(x);", "let p = try_from_slice(y); Pool User", "seeds = [b\"x\"]\nVault", "pub enum VaultState { Open, Closed = 2, Done }", "nothing", "seeds=[a] Pool\nseeds = [b] Config", "pub enum Phase {\n // first\n Open,\n Run(u8),\n Closed\n}",
]
_FRAMEWORKS = ["anchor", "native", "unknown"]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _listed(values: list) -> str:
    """SQL of a list of texts, of lists of texts, or of lists of structs."""
    return "[" + ", ".join("NULL" if v is None else _text(v) if isinstance(v, str) else _struct(v) if isinstance(v, dict) else _listed(v) for v in values) + "]"


def _struct(x: dict) -> str:
    return "{" + ", ".join(f"'{k}': {'NULL' if v is None else _text(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else v if not isinstance(v, list) else _listed(v)}" for k, v in x.items()) + "}"


def _pick(values: list, kind: str, place: str) -> tuple[Callable[[], Column], str]:
    """The value at a place of part's key, for Spark (made when a session is there) and for SQL."""

    def column() -> Column:
        return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.expr(place.replace("//", " DIV ")).cast("int") % len(values))

    return column, f"(CAST({_listed(values)} AS {_DUCK[kind]}[]))[1 + ({place}) % {len(values)}]"


_ACCOUNT = "array<struct<name:string,is_signer:boolean,is_mut:boolean>>"
_SUM = "array<struct<off:int,op:string,checked:boolean>>"
_FIELD = "array<struct<name:string,type:string,line:int>>"
_DUCK = {
    "string": "VARCHAR", "array<string>": "VARCHAR[]", _ACCOUNT: "STRUCT(name VARCHAR, is_signer BOOLEAN, is_mut BOOLEAN)[]", _SUM: "STRUCT(off INTEGER, op VARCHAR, checked BOOLEAN)[]",
    _FIELD: "STRUCT(name VARCHAR, type VARCHAR, line INTEGER)[]",
}
_ACCOUNT_ROWS = [[{"name": x.split(":")[0], "is_signer": x.endswith("s"), "is_mut": x.endswith("m")} for x in own] for own in _ACCOUNTS]
_SUM_ROWS = [[{"off": int(x[0]), "op": x[1], "checked": x[2] == "y"} for x in own] for own in _SUMS]
_FIELD_ROWS = [[{"name": x, "type": "u8", "line": k} for k, x in enumerate(own)] for own in _FIELDS]

_COLUMNS = {
    "ix": {
        "framework": _pick(_FRAMEWORKS, "string", f"p_partkey // {_PER_REPO}"), "name": _pick(_NAMES, "string", "p_partkey"), "body": _pick(_BODIES, "string", "p_partkey"), "accounts": _pick(_ACCOUNT_ROWS, _ACCOUNT, "p_partkey"),
        "signer_checks": _pick(_SIGNERS, "array<string>", "p_partkey"), "owner_checks": _pick(_OWNERS, "array<string>", "p_partkey"), "sums": _pick(_SUM_ROWS, _SUM, "p_partkey"),
    },
    "cpis": {"instruction": _pick(_NAMES, "string", "p_partkey // 3"), "reloaded": _pick(_RELOADED, "array<string>", "p_partkey")},
    "pdas": {"seeds": _pick(_SEEDS, "array<string>", "p_partkey"), "bump": _pick(["canonical", "unchecked", "missing"], "string", "p_partkey"), "instruction": _pick(_NAMES, "string", "p_partkey // 5")},
    "structs": {"name": _pick(_STRUCTS, "string", "p_partkey"), "fields": _pick(_FIELD_ROWS, _FIELD, "p_partkey")},
    "files": {"content": _pick(_FILES, "string", "p_partkey")},
    "kinds": {"framework": _pick(_FRAMEWORKS, "string", f"p_partkey // {_PER_REPO}")},
}
_REPO = f"'r' || CAST(p_partkey // {_PER_REPO} AS VARCHAR) AS repo_id"
_PLACE = "'f' || CAST(p_partkey % 2 AS VARCHAR) || '.rs' AS path, CAST(10 * (p_partkey // 7) + 1 AS INTEGER) AS line, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ord"


def _sql_table(name: str, more: str = "") -> str:
    own = ", ".join(f"{sql} AS {c}" for c, (_, sql) in _COLUMNS[name].items())
    return f"{name} AS (SELECT p_partkey AS k, {_REPO}, {_PLACE}, {own}{more} FROM part)"


_WITH = "WITH " + ", ".join([
    _sql_table("ix", ", CAST(10 * (p_partkey // 7) + 6 AS INTEGER) AS end_line"), _sql_table("cpis", ", p_partkey % 5 = 0 AS validated"), _sql_table("pdas"), _sql_table("structs"), _sql_table("files"),
    f"kinds AS (SELECT DISTINCT {_REPO}, {_COLUMNS['kinds']['framework'][1]} AS framework FROM part)",
])


def _facts(spark, d) -> rules.Facts:
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    repo = F.concat(F.lit("r"), F.floor(k / _PER_REPO).cast("string")).alias("repo_id")
    place = [repo, F.concat(F.lit("f"), (k % 2).cast("string"), F.lit(".rs")).alias("path"), (10 * F.floor(k / 7) + 1).cast("int").alias("line"), F.lpad(k.cast("string"), 9, "0").alias("ord")]

    def made(name: str, *more: Column) -> DataFrame:
        return part.select(k.alias("k"), *place, *(c().alias(n) for n, (c, _) in _COLUMNS[name].items()), *more)

    ix = made("ix", (10 * F.floor(k / 7) + 6).cast("int").alias("end_line"))
    ix = ix.withColumn("arithmetic", F.transform("sums", lambda s: F.struct((F.col("line") + s["off"]).alias("line"), s["op"].alias("op"), s["checked"].alias("checked")))).drop("sums", "k")
    kinds = part.select(repo, _COLUMNS["kinds"]["framework"][0]().alias("framework")).distinct()
    return rules.Facts(made("files").select("repo_id", "path", "content", "ord"), kinds, ix, made("structs").drop("k"), made("cpis", (k % 5 == 0).alias("validated")).drop("k"), made("pdas").drop("k"))


_SHOWN = ("repo_id", "severity", "confidence", "title", "path", "line", "end_line", "instruction")
_RULE_SQL: dict[int, str] = {}


def _has(*words: str, column: str = "body") -> str:
    return "(" + " OR ".join(f"contains({column}, {_text(w)})" for w in words) + ")"


def _row(severity: str, confidence: float, title: str, source: str, where: str, *, path="path", line="line", end="end_line", instruction="name") -> str:
    return f"SELECT repo_id, '{severity}' AS severity, {confidence}::DOUBLE AS confidence, {title} AS title, {path} AS path, CAST({line} AS INTEGER) AS line, CAST({end} AS INTEGER) AS end_line, CAST({instruction} AS VARCHAR) AS instruction FROM {source} WHERE {where}"


def _rule(number: int, name: str, *parts: str):
    body = " UNION ALL ".join(parts)
    _RULE_SQL[number] = body

    def run(spark, d):
        return rules.RULES[number][1](_facts(spark, d)).select(*_SHOWN)

    run.__name__ = f"rule_{number:02d}_{name}"
    query(f"{_WITH} {body}")(run)


_MUTS = "list_filter(accounts, lambda a: a.is_mut)"
_RULER = "(contains(a.name, 'authority') OR contains(a.name, 'owner') OR contains(a.name, 'admin') OR contains(a.name, 'payer'))"
_EACH = "(SELECT ix.*, unnest(accounts) AS a FROM ix)"
_UNSIGNED = f"len(list_filter(accounts, lambda a: a.is_mut)) > 0 AND len(list_filter(accounts, lambda a: a.is_signer)) = 0 AND len(signer_checks) = 0 AND NOT {_has('is_signer', 'Signer<', '#[account(signer')}"

_rule(
    1, "missing_signer", _row("CRITICAL", 0.92, "name || ': signature of ''' || a.name || ''' is never required'", _EACH, f"{_UNSIGNED} AND {_RULER}"),
    _row("HIGH", 0.75, "name || ': changes accounts without any signer'", "ix", f"{_UNSIGNED} AND len(list_filter(accounts, lambda a: {_RULER})) = 0"),
)
_rule(
    2, "missing_owner", _row("CRITICAL", 0.88, "name || ': owner of ''' || a.name || ''' isn''t verified'", _EACH, "framework = 'native' AND NOT list_contains(owner_checks, 'owner_check') AND a.is_mut"),
    _row("HIGH", 0.82, "name || ': unchecked account without owner validation'", "ix", f"framework = 'anchor' AND {_has('UncheckedAccount', 'AccountInfo')} AND NOT {_has('/// CHECK:')} AND NOT list_contains(owner_checks, 'anchor_account_type')"),
)
_PDA = {"end": "NULL", "instruction": "instruction"}
_USER = "len(list_filter(seeds, lambda s: contains(s, 'key()') OR contains(s, 'pubkey') OR contains(s, 'authority') OR contains(s, 'user') OR contains(s, 'owner') OR contains(s, '.as_ref()'))) > 0"
_rule(
    3, "pda_mistakes", _row("HIGH", 0.85, "instruction || ': bump of a derived address isn''t checked'", "pdas", "bump = 'unchecked'", **_PDA),
    _row("HIGH", 0.80, "instruction || ': seeds of a derived address don''t tell users apart'", "pdas", f"NOT {_USER} AND len(seeds) <= 1", **_PDA), _row("MEDIUM", 0.70, "instruction || ': derived address without a bump'", "pdas", "bump = 'missing'", **_PDA),
)
_rule(4, "arbitrary_target", _row("CRITICAL", 0.90, "instruction || ': called program isn''t validated'", "cpis", "NOT validated", **_PDA))
_rule(
    5, "type_confusion", _row("HIGH", 0.80, "'Struct ''' || name || ''' has no discriminator'", "(SELECT structs.* FROM structs JOIN kinds USING (repo_id) WHERE kinds.framework = 'native')", "true", end="NULL", instruction="NULL"),
    _row("MEDIUM", 0.72, "'''' || name || ''' is read from bytes without a type check'", "(SELECT s.repo_id, s.name, f.path FROM structs s JOIN kinds USING (repo_id) JOIN files f ON f.repo_id = s.repo_id AND contains(f.content, 'try_from_slice') AND contains(f.content, s.name))", "true", line="0", end="NULL", instruction="NULL"),
)
_rule(6, "double_init", _row("HIGH", 0.85, "name || ': can be run again on a live account'", "ix", f"{_has('init', 'create', 'setup', column='name')} AND NOT {_has('#[account(init', 'init,')} AND NOT {_has('is_initialized', 'initialized == true', 'initialized == false', '!= 0')} AND NOT regexp_matches(body, 'require!\\s*\\(\\s*!\\s*\\w+\\.initialized')"))
_rule(7, "close_revive", _row("HIGH", 0.82, "name || ': closes an account and leaves its data'", "ix", f"({_has('close', 'delete', 'withdraw_all', 'remove', column='name')} OR ({_has('lamports()')} AND {_has('= 0', '-=')})) AND NOT ({_has('fill(0)', '0u8; ', '.data.borrow_mut()')} OR ({_has('#[account(')} AND {_has('close')}))"))
_rule(8, "unchecked_realloc", _row("MEDIUM", 0.78, "name || ': grown memory isn''t zeroed'", "ix", f"{_has('realloc')} AND NOT {_has('zero_init', 'realloc::zero = true')}"))
_OPS = "(SELECT *, row_number() OVER (PARTITION BY repo_id, path, spot ORDER BY ord, n) AS first FROM (SELECT repo_id, path, name, end_line, ord, n, line + s.off AS spot, s.op AS op FROM (SELECT ix.*, unnest(sums) AS s, unnest(range(len(sums))) AS n FROM ix) WHERE NOT s.checked))"
_rule(9, "overflow", _row("HIGH", 0.80, "name || ': unchecked ''' || op || ''' on a value'", _OPS, "first = 1", line="spot"))
_rule(10, "state_machine", _row("HIGH", 0.75, "name || ': doesn''t look at the state it leaves'", "ix", f"{_has('claim', 'redeem', 'withdraw', 'finalize', 'update', 'transition', 'complete', 'cancel', column='name')} AND NOT regexp_matches(body, '(?s)(?:require|assert|match|if).*(?:state|status|phase|stage)')"))
_rule(
    11, "remaining_accounts", _row("HIGH", 0.85, "name || ': remaining accounts are taken unseen'", "ix", f"{_has('remaining_accounts')} AND NOT ({_has('remaining_accounts.iter()')} AND {_has('key()', 'owner', 'is_signer')})"),
    _row("MEDIUM", 0.65, "name || ': remaining accounts aren''t counted'", "ix", f"{_has('remaining_accounts')} AND NOT regexp_matches(body, 'remaining_accounts\\.len\\(\\)\\s*[<>=!]')"),
)
_PRICE = _has("price", "oracle", "pyth", "switchboard", "chainlink")
_rule(
    12, "oracle", _row("HIGH", 0.82, "name || ': price may be stale'", "ix", f"{_PRICE} AND NOT ({_has('timestamp', 'last_updated', 'stale', 'age')} OR ({_has('slot')} AND {_has('current')}))"),
    _row("MEDIUM", 0.70, "name || ': price is used without its confidence'", "ix", f"{_PRICE} AND NOT {_has('conf', 'deviation', 'twap')}"),
    _row("CRITICAL", 0.88, "name || ': owner of the price account isn''t verified'", "ix", f"{_PRICE} AND NOT ({_has('oracle')} AND (len(owner_checks) > 0 OR {_has('owner')}))"),
)
_TOKEN = _has("TokenAccount", "token_account", "token::", "spl_token")
_rule(
    13, "token_mismatch", _row("HIGH", 0.83, "name || ': mint isn''t compared'", "ix", f"{_TOKEN} AND {_has('mint')} AND NOT ({_has('mint =', 'token::mint')} OR regexp_matches(body, 'constraint.*mint.*key\\(\\)'))"),
    _row("HIGH", 0.80, "name || ': authority of a token account isn''t compared'", "ix", f"{_TOKEN} AND {_has('vault', 'treasury', 'pool')} AND NOT ({_has('token::authority', 'authority =')} OR regexp_matches(body, 'constraint.*authority.*key\\(\\)'))"),
)
_AFTER = """(SELECT *, list_filter(regexp_extract_all(after, '(\\w+)\\.(amount|lamports|data|key)', 1), lambda n: NOT list_contains(reloaded, n) AND NOT contains(after, n || '.reload()') AND n NOT IN ('ctx', 'self'))[1] AS read FROM
  (SELECT *, array_to_string(rows[spot + 1:], chr(10)) AS after FROM (SELECT *, list_position(list_transform(rows, lambda x: contains(x, 'invoke') OR contains(x, 'CpiContext')), true) AS spot FROM
  (SELECT c.repo_id, c.path, c.line, c.instruction, c.reloaded, i.end_line, string_split(i.body, chr(10)) AS rows FROM cpis c JOIN (SELECT repo_id, name, arg_min(body, ord) AS body, arg_min(end_line, ord) AS end_line FROM ix GROUP BY repo_id, name) i ON i.repo_id = c.repo_id AND i.name = c.instruction)) WHERE spot > 0))"""
_rule(14, "stale_read", _row("HIGH", 0.78, "instruction || ': ''' || read || ''' is read after a call without reload'", _AFTER, "read IS NOT NULL", instruction="instruction"))
_PAIRS = f"(SELECT *, len(muts) AS n, unnest(flatten(list_transform(range(1, len(muts)), lambda i: list_transform(range(i + 1, len(muts) + 1), lambda j: {{'a': muts[i], 'b': muts[j]}})))) AS p FROM (SELECT *, list_transform({_MUTS}, lambda a: a.name) AS muts FROM ix))"
_NEAR = " OR ".join(f"(contains(p.a, '{x}') AND contains(p.b, '{y}'))" for x, y in (("from", "to"), ("source", "dest"), ("sender", "receiver"), ("user", "vault")))
_rule(15, "duplicates", _row("HIGH", 0.75, "name || ': ''' || p.a || ''' and ''' || p.b || ''' may be one account'", _PAIRS, f"NOT ({_has('key() !=')} OR ({_has('!= ')} AND {_has('.key()')}) OR regexp_matches(body, 'constraint\\s*=.*key\\(\\)\\s*!=\\s*.*key\\(\\)')) AND ({_NEAR} OR (p.a = 'account_a' AND p.b = 'account_b') OR n = 2)"))

# ---- constraints, permutations and what becomes of them ----------------------------------------------------

_CHAIN = f"""SELECT repo_id, 'authority_chain' AS kind, name || '::' || a.name AS subject, 'HIGH' AS severity, '''' || a.name || ''' of ' || name || ' is changed without a verified authority' AS message FROM {_EACH}
  WHERE a.is_mut AND NOT contains(a.name, 'system_program') AND NOT contains(a.name, 'token_program') AND len(list_filter(accounts, lambda x: x.is_signer)) = 0 AND NOT ({_has('has_one')} OR regexp_matches(body, 'constraint.*' || a.name || '.*(authority|owner)'))"""
_MODES = """SELECT repo_id, 'pda_consistency' AS kind, seed_set AS subject, 'HIGH' AS severity, 'Address of seeds [' || seed_set || '] is derived with bumps ' || string_agg(DISTINCT bump, ', ' ORDER BY bump) AS message FROM
  (SELECT *, array_to_string(list_sort(list_transform(seeds, lambda s: regexp_replace(s, '\\s', '', 'g'))), '|') AS seed_set FROM pdas) GROUP BY repo_id, seed_set HAVING count(DISTINCT bump) > 1"""
_UPS, _DOWNS = (f"len(regexp_extract_all(body, 'lamports\\(\\).*{sign}='))" for sign in ("\\+", "-"))
_BALANCE = f"""SELECT repo_id, 'balance_conservation' AS kind, name AS subject, 'MEDIUM' AS severity, name || ' adds lamports ' || {_UPS} || ' times and takes them ' || {_DOWNS} || ' times' AS message FROM ix WHERE ({_has('try_borrow_mut_lamports')} OR ({_has('lamports')} AND {_has('+=')})) AND {_UPS} <> {_DOWNS}"""
_VIOLATIONS = f"{_CHAIN} UNION ALL {_MODES} UNION ALL {_BALANCE}"


def _violations(kind: str):
    def run(spark, d):
        return rules.violations(_facts(spark, d)).where(F.col("kind") == kind).select("repo_id", "kind", "subject", "severity", "message")

    return run


for _n, _kind, _own in ((16, "authority_chain", _CHAIN), (17, "pda_consistency", _MODES), (18, "balance_conservation", _BALANCE)):
    _f = _violations(_kind)
    _f.__name__ = f"rule_{_n}_{_kind}"
    query(f"{_WITH} {_own}")(_f)

_PERMUTATIONS = f"""SELECT repo_id, name AS instruction, 'signer_substitution' AS kind, 'critical' AS severity, a.name AS names FROM {_EACH} WHERE a.is_signer OR contains(a.name, 'authority') OR contains(a.name, 'owner') OR contains(a.name, 'admin')
  UNION ALL SELECT repo_id, name, 'aliasing', 'high', p.a || ',' || p.b FROM {_PAIRS} UNION ALL SELECT repo_id, name, 'program_substitution', 'critical', a.name FROM {_EACH} WHERE contains(a.name, 'program')
  UNION ALL SELECT repo_id, name, 'uninitialised', 'medium', a.name FROM {_EACH} WHERE NOT (contains(a.name, 'program') OR contains(a.name, 'system') OR contains(a.name, 'rent') OR contains(a.name, 'clock'))"""


@query(f"{_WITH} {_PERMUTATIONS}")
def rule_19_permutations(spark, d):
    return rules.permutations(_facts(spark, d)).select("repo_id", "instruction", "kind", "severity", F.array_join("names", ",").alias("names"))


_FINDINGS = " UNION ALL ".join(f"SELECT *, {n} AS class_id FROM ({sql})" for n, sql in sorted(_RULE_SQL.items()))
_EXTRA = f"""SELECT v.repo_id, v.severity, 0.65::DOUBLE AS confidence, v.message AS title, v.subject AS instruction, v.class_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, kind, CASE WHEN kind = 'balance_conservation' THEN subject ELSE message END ORDER BY message) AS again FROM
  (SELECT *, CASE kind WHEN 'authority_chain' THEN 1 WHEN 'pda_consistency' THEN 3 ELSE 9 END AS class_id FROM v)) v WHERE (kind <> 'balance_conservation' OR again = 1) AND NOT EXISTS (SELECT 1 FROM found f WHERE f.repo_id = v.repo_id AND f.instruction = string_split(v.subject, '::')[1] AND f.class_id = v.class_id)"""


@query(f"""{_WITH}, found AS ({_FINDINGS}), v AS ({_VIOLATIONS}), extra AS ({_EXTRA}), grave AS (SELECT repo_id, instruction FROM found WHERE severity = 'CRITICAL'), n AS ({_PERMUTATIONS})
SELECT repo_id, class_id, severity, count(*) AS n FROM (SELECT repo_id, class_id, severity FROM found UNION ALL SELECT repo_id, class_id, severity FROM (SELECT DISTINCT repo_id, class_id, severity, instruction FROM extra WHERE class_id = 9) UNION ALL SELECT e.repo_id, e.class_id, e.severity FROM
  (SELECT v.repo_id, v.severity, CASE kind WHEN 'authority_chain' THEN 1 ELSE 3 END AS class_id, v.subject FROM v WHERE kind <> 'balance_conservation') e WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.repo_id = e.repo_id AND f.instruction = string_split(e.subject, '::')[1] AND f.class_id = e.class_id)
  UNION ALL SELECT n.repo_id, 0, 'INFO' FROM n WHERE n.severity = 'critical' AND NOT EXISTS (SELECT 1 FROM grave g WHERE g.repo_id = n.repo_id AND g.instruction = n.instruction)) GROUP BY repo_id, class_id, severity""")
def rule_20_with_constraints(spark, d):
    f = _facts(spark, d)
    found = rules.with_constraints(rules.detect(f), f)
    return found.groupBy("repo_id", F.col("class_id").cast("int").alias("class_id"), "severity").agg(F.count("*").alias("n"))


@query(f"""{_WITH}, found AS ({_FINDINGS}), best AS (SELECT repo_id, class_id, path, line, instruction, max(confidence) AS confidence FROM found GROUP BY ALL)
SELECT repo_id, CAST(class_id AS INTEGER) AS class_id, path, CAST(line AS INTEGER) AS line, instruction, confidence FROM best""")
def audit_assembled(spark, d):
    ranked = rules.assemble(rules.detect(_facts(spark, d)))
    return ranked.select("repo_id", F.col("class_id").cast("int").alias("class_id"), "path", F.col("line").cast("int").alias("line"), "instruction", "confidence")


# ---- graphs ------------------------------------------------------------------------------------------------


def _graph(name: str, function, *parts: str):
    def run(spark, d):
        return function(_facts(spark, d)).select("repo_id", "src", "dst", "kind")

    run.__name__ = f"graph_{name}"
    query(f"{_WITH} {' UNION ALL '.join(parts)}")(run)


_STRUCT_FIELDS = "(SELECT repo_id, name, unnest(fields) AS f FROM structs)"


def _edge(src: str, dst: str, kind: str, source: str, where: str = "true") -> str:
    return f"SELECT repo_id, {src} AS src, {dst} AS dst, {kind if kind.startswith('k.') else repr(kind)} AS kind FROM {source} WHERE {where}"


_IX = "'ix:' || name"
_graph(
    "authority_flow", graphs.authority_flow, _edge("'acc:' || a.name", _IX, "signs", _EACH, "a.is_signer"), _edge(_IX, "'acc:' || a.name", "mutates", _EACH, "a.is_mut"), _edge(_IX, _IX, "has_one_check", "ix", "list_contains(signer_checks, 'has_one')"),
    _edge("'field:' || name || '.' || f.name", "'struct:' || name", "controls", _STRUCT_FIELDS, "contains(f.name, 'authority') OR contains(f.name, 'owner') OR contains(f.name, 'admin')"),
)
_MOVED = f"(SELECT *, unnest(regexp_extract_all(body, '(\\w+)\\.(?:try_borrow_mut_)?lamports\\(\\)\\s*.*{{}}=', 1)) AS a FROM ix WHERE {_has('lamports')} AND {_has('+=', '-=')})"
_SENT = f"(SELECT *, regexp_extract(body, 'from\\s*[:=]\\s*(?:ctx\\.accounts\\.)?(\\w+)', 1) AS f, regexp_extract(body, 'to\\s*[:=]\\s*(?:ctx\\.accounts\\.)?(\\w+)', 1) AS t FROM ix WHERE {_has('token::transfer', 'Transfer {', 'transfer_checked')})"
_SPL = "'spl:transfer:' || name"
_graph(
    "token_flow", graphs.token_flow, _edge("'acc:' || a", _IX, "sends_sol", _MOVED.format("-")), _edge(_IX, "'acc:' || a", "receives_sol", _MOVED.format("\\+")), _edge(_IX, "'sys:transfer:' || name", "cpi_transfer", "ix", _has("system_program::transfer", "Transfer {")),
    _edge(_IX, _SPL, "spl_transfer", _SENT), _edge("'acc:' || f", _SPL, "from", _SENT, "f <> ''"), _edge(_SPL, "'acc:' || t", "to", _SENT, "t <> ''"), _edge(_IX, "'spl:mint:' || name", "mints", "ix", _has("token::mint_to", "MintTo")), _edge(_IX, "'spl:burn:' || name", "burns", "ix", _has("token::burn", "Burn {")),
)
_VARIANTS = """(SELECT DISTINCT repo_id, enum, unnest(regexp_extract_all(body, '(\\w+)\\s*(?:=\\s*\\d+\\s*)?(?:,|\\s*$)', 1)) AS variant FROM (SELECT repo_id, regexp_extract(t, 'enum\\s+(\\w+)', 1) AS enum, regexp_replace(regexp_extract(t, '(?s)\\{([^}]*)\\}', 1), '//[^\\n]*|#\\[[^\\]]*\\]|\\([^)]*\\)', '', 'g') AS body FROM
  (SELECT repo_id, unnest(regexp_extract_all(content, '(?s)pub\\s+enum\\s+\\w*(?:State|Status|Phase|Stage)\\w*\\s*\\{[^}]*\\}')) AS t FROM files)))"""
_STATE = "'state:' || enum || '::' || variant"


def _mentioned(pattern: str) -> str:
    return f"(SELECT m.*, v.enum FROM (SELECT repo_id, name, unnest(list_distinct(regexp_extract_all(body, '{pattern}', 1))) AS variant FROM ix) m JOIN {_VARIANTS} v USING (repo_id, variant))"


_ARMS = f"(SELECT m.*, v.enum FROM (SELECT repo_id, name, unnest(regexp_extract_all(t, '(\\w+)\\s*=>', 1)) AS variant FROM (SELECT repo_id, name, unnest(regexp_extract_all(body, '(?s)match\\s+\\w+\\.\\w+\\s*\\{{([^}}]*)\\}}', 1)) AS t FROM ix)) m JOIN {_VARIANTS} v USING (repo_id, variant))"
_graph(
    "state_machine", graphs.state_machine, _edge(_IX, _STATE, "transitions", _mentioned("\\w+\\s*=\\s*(?:\\w+::)?(\\w+)")), _edge(_STATE, _IX, "requires", _ARMS), _edge(_STATE, _IX, "guards", _mentioned("(?:require|assert)!\\s*\\(\\s*\\w+\\.\\w+\\s*==\\s*(?:\\w+::)?(\\w+)")),
    _edge("'struct:' || name", "'flag:' || name || '.' || f.name", "flag", _STRUCT_FIELDS, "(contains(f.name, 'initialized') OR contains(f.name, 'is_') OR contains(f.name, 'active') OR contains(f.name, 'closed') OR contains(f.name, 'claimed') OR contains(f.name, 'locked')) AND repo_id NOT IN (SELECT repo_id FROM " + _VARIANTS + ")"),
)
_NODE = "'pda:' || instruction || ':' || line"
_graph(
    "pda", graphs.pda_graph, _edge("'ix:' || instruction", _NODE, "derives", "pdas"), _edge("'seed:' || regexp_replace(s, '[^a-zA-Z0-9_]', '_', 'g')", _NODE, "seeds_into", "(SELECT *, unnest(seeds) AS s FROM pdas)"),
    _edge(_NODE, "'struct:' || name", "resolves_to", "(SELECT p.*, s.name FROM pdas p JOIN files f USING (repo_id, path) JOIN structs s ON s.repo_id = f.repo_id AND regexp_matches(f.content, '(?s)seeds\\s*=.*?' || s.name))"),
    _edge("'collision:' || signature", "'ix:' || instruction", "shared_seeds", "(SELECT repo_id, signature, unnest(list(DISTINCT instruction)) AS instruction FROM (SELECT *, array_to_string(list_sort(seeds), '|') AS signature FROM pdas WHERE len(seeds) > 0) GROUP BY repo_id, signature HAVING count(*) > 1)"),
)
