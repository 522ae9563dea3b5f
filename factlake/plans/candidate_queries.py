"""Queries of the second and third generation of rules, over parsed facts made from all rows of `part` as in audit_queries, with the
SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from . import audit_queries as audit
from . import candidates
from .audit_queries import _DUCK, _PER_REPO, _PLACE, _REPO, _has, _pick
from .queries import query

_CONTEXTS = ["Take", "TakeAccounts", "Rea", None, "Read", "Make", "Close", "Missing", "Give", "SwapCtx", "Init"]
_CALLED = [[], ["validate_price"], ["check_x", "check_price"]]
_EXCERPTS = [
    "fn a() {\n let amount = amount + 1;\n}", "x", "require!(authority.key() == a, B);\nlet fee = fee * rate;", "// let price = price + 1;\nlet y = amount as u64;", "balance.checked_add(1) + amount", "timestamp; max_age; price_account", "confidence interval",
    "let p = get_price(x);", "let p = oracle.price; clock.slot - last", "let d = Vault::try_from_slice(&a.data)?;\nlet mut acc = Mint::unpack(&b)?;\n// let e = Mint::unpack(&c)?;", "let d = Vault::try_from_slice(&a)?; a.owner == program_id", "invoke(&ix, accs)?;\nlet x = vault.amount;",
    "invoke(&ix, accs)?;\nvault.reload()?;\nlet x = vault.amount;", "// invoke(\nCpiContext::new(a);\n\nlet s = a.total;", "pyth and get; deviation", "load_price_account(a); twap", "unpack (b)\nlet q = deserialize(x);",
]
_STRUCT_NAMES = ["Take", "Read", "Make", "Close", "Give", "Swap", "InitAll"]


def _field(n: int, name: str, kind: str, inner: str | None = None, constraints: str = "", signer: bool = False, mut: bool = False) -> dict:
    own = [{"kind": x.split("=")[0], "expression": x.split("=", 1)[1] if "=" in x else None} for x in constraints.split("|") if x]
    return {"n": n, "name": name, "type": f"{kind}<'info, {inner}>" if inner else f"{kind}<'info>", "kind": kind, "inner": inner, "constraints": own, "is_signer": signer, "is_mut": mut}


_FIELD_LISTS = [
    [_field(0, "authority", "AccountInfo", None, "mut", False, True), _field(1, "vault", "Account", "TokenAccount", "mut", False, True)], [_field(0, "authority", "Signer", None, "", True), _field(1, "vault", "Account", "TokenAccount", "token_authority=authority", False, True)],
    [_field(0, "price_feed", "AccountInfo"), _field(1, "pool", "UncheckedAccount", None, "mut", False, True)], [_field(0, "oracle", "Account", "Feed"), _field(1, "user", "SystemAccount", None, "init_if_needed|payer=user", False, True)],
    [_field(0, "owner", "UncheckedAccount", None, "mut|constraint=owner.key() == vault.owner", False, True), _field(1, "vault", "Account", "Vault", "mut|has_one=owner|close=owner", False, True)],
    [_field(0, "payer", "AccountInfo", None, "signer|mut", True, True), _field(1, "aggregator", "AccountInfo", None, "owner=feed_program")],
    [_field(0, "admin", "AccountInfo", None, "mut", False, True), _field(1, "data", "UncheckedAccount", None, "address=X", False, True), _field(2, "token", "Account", "TokenAccount")],
]
_SINKS = ["token_transfer", "token_mint_to", "token_burn", "sol_transfer", "account_close", "set_authority", "oracle_read", "state_write", "oracle_read", "account_close", "realloc"]
_SINK_ACCOUNTS = [["vault", "authority"], ["token", "oracle_acct", "pool", "x"], []]
_SINK_TEXTS = ["token::transfer(CpiContext::new_with_signer(a), b)", "x.lamports = 0; lamports() = 0", "get_price(&feed)?", "transfer(a)", "**a.lamports.borrow_mut() = 0"]
_CALL_TYPES = ["invoke", "invoke_signed", "CpiContext::new", "token::*", "invoke"]
_TARGETS = ["&ix", "", "program"]

_FIELD = "array<struct<n:int,name:string,type:string,kind:string,inner:string,constraints:array<struct<kind:string,expression:string>>,is_signer:boolean,is_mut:boolean>>"
_DUCK[_FIELD] = 'STRUCT(n INTEGER, name VARCHAR, type VARCHAR, kind VARCHAR, "inner" VARCHAR, constraints STRUCT(kind VARCHAR, expression VARCHAR)[], is_signer BOOLEAN, is_mut BOOLEAN)[]'
_COLUMNS = {
    "ins": {"name": _pick(audit._NAMES, "string", "p_partkey"), "context": _pick(_CONTEXTS, "string", "p_partkey"), "calls": _pick(_CALLED, "array<string>", "p_partkey"), "excerpt": _pick(_EXCERPTS, "string", "p_partkey"), "framework": _pick(audit._FRAMEWORKS, "string", f"p_partkey // {_PER_REPO}")},
    "st": {"struct": _pick(_STRUCT_NAMES, "string", "p_partkey // 2"), "fields": _pick(_FIELD_LISTS, _FIELD, "p_partkey")},
    "sk": {"sink": _pick(_SINKS, "string", "p_partkey"), "instruction": _pick(audit._NAMES, "string", "p_partkey // 2"), "accounts": _pick(_SINK_ACCOUNTS, "array<string>", "p_partkey"), "excerpt": _pick(_SINK_TEXTS, "string", "p_partkey")},
    "ca": {"call_type": _pick(_CALL_TYPES, "string", "p_partkey"), "target": _pick(_TARGETS, "string", "p_partkey"), "instruction": _pick(audit._NAMES, "string", "p_partkey // 3")},
    "pd": {"seeds": _pick(audit._SEEDS, "array<string>", "p_partkey"), "bump": _pick(["canonical", "unchecked", "missing"], "string", "p_partkey"), "source": _pick(["inline", "constraint"], "string", "p_partkey"), "instruction": _pick(audit._NAMES, "string", "p_partkey // 5")},
}
_END = "CAST(10 * (p_partkey // 7) + 4 + 3 * (p_partkey % 11) AS INTEGER) AS end_line"


def _sql_table(name: str, more: str) -> str:
    own = ", ".join(f"{sql} AS {c}" for c, (_, sql) in _COLUMNS[name].items())
    rows = f"SELECT {_REPO}, {_PLACE}, {_END}, {own}{more} FROM part"
    if name == "st":  # fields stand in the lines of their struct, each some lines long
        rows = f"SELECT * EXCLUDE (fields), list_transform(fields, lambda f: struct_insert(f, path := path, line := CAST(line + 1 + f.n AS INTEGER), end_line := CAST(line + 1 + 2 * f.n AS INTEGER))) AS fields FROM ({rows})"
    return f"{name} AS ({rows})"


# a sink or a function with the struct of its context: by name, else the first whose name is a prefix of it or the other way round
_OF = "coalesce((SELECT arg_min({x}, s.ord) FROM st s WHERE s.accounts AND s.repo_id = {t}.repo_id AND s.struct = {t}.context), (SELECT arg_min({x}, s.ord) FROM st s WHERE s.accounts AND s.repo_id = {t}.repo_id AND (starts_with({t}.context, s.struct) OR starts_with(s.struct, {t}.context))))"
_RULER = "(contains(f.name, 'authority') OR contains(f.name, 'owner') OR contains(f.name, 'admin') OR contains(f.name, 'payer') OR contains(f.name, 'signer') OR f.kind = 'Signer')"
_WITH = "WITH " + ", ".join([
    _sql_table("ins", ""), _sql_table("st", ", p_partkey % 13 <> 0 AS accounts"), _sql_table("sk", ""), _sql_table("ca", ", p_partkey % 4 = 0 AS validated, '' AS excerpt"), _sql_table("pd", ", '' AS excerpt"),
    "one AS (SELECT repo_id, name AS instruction, arg_min(struct_pack(c := context), ord).c AS context, arg_min(excerpt, ord) AS body, arg_min(calls, ord) AS calls FROM ins GROUP BY repo_id, name)",
    f"raw AS (SELECT j.*, {_OF.format(x='s.fields', t='j')} AS fields FROM (SELECT sk.*, one.context, one.body FROM sk JOIN one USING (repo_id, instruction)) j)",
    f"at_ AS (SELECT *, list_filter(fields, lambda f: {_RULER}) AS rulers FROM raw WHERE fields IS NOT NULL)",
    "tok AS (SELECT * FROM at_ WHERE sink IN ('token_transfer', 'token_mint_to', 'token_burn'))",
    f"own AS (SELECT i.*, name AS instruction, {_OF.format(x='s.fields', t='i')} AS fields, {_OF.format(x='s.struct', t='i')} AS struct FROM ins i)",
    "parts AS (SELECT *, unnest(fields) AS f, unnest(range(len(fields))) AS n FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, struct ORDER BY ord) AS first FROM own WHERE struct IS NOT NULL AND context = struct) WHERE first = 1)",
])


def _parsed(spark, d) -> candidates.Parsed:
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    place = [
        F.concat(F.lit("r"), F.floor(k / _PER_REPO).cast("string")).alias("repo_id"), F.concat(F.lit("f"), (k % 2).cast("string"), F.lit(".rs")).alias("path"), (10 * F.floor(k / 7) + 1).cast("int").alias("line"),
        F.lpad(k.cast("string"), 9, "0").alias("ord"), (10 * F.floor(k / 7) + 4 + 3 * (k % 11)).cast("int").alias("end_line"),
    ]

    def made(name: str, *more) -> DataFrame:
        return part.select(*place, *(c().alias(n) for n, (c, _) in _COLUMNS[name].items()), *more)

    none = F.lit("").alias("excerpt")
    ins = made("ins").withColumn("body", F.col("excerpt")).withColumn("params", F.lit(""))
    st = made("st", (k % 13 != 0).alias("accounts")).withColumnRenamed("ord", "struct_ord")
    st = st.withColumn("fields", F.transform("fields", lambda f: f.withField("path", F.col("path")).withField("line", F.col("line") + 1 + f["n"]).withField("end_line", F.col("line") + 1 + 2 * f["n"])))
    return candidates.Parsed(part.limit(0), ins, st, made("sk"), made("ca", (k % 4 == 0).alias("validated"), none), made("pd", none))


_SHOWN = ("repo_id", "vuln_class", "severity", "confidence", "instruction", "path", "line", "end_line", "rule", "ord")


def _shown(found: DataFrame) -> DataFrame:
    return found.select(*_SHOWN, F.array_join("accounts", ",").alias("accounts"))


def _row(rule: int, vuln: str, severity: str, confidence: str | float, source: str, where: str, accounts: str = "''", place: str | None = None, line: str = "line", end: str = "end_line", at: str = "") -> str:
    order = f"ord || '#' || lpad(CAST({place} AS VARCHAR), 6, '0')" if place else "ord"
    severity = severity if severity.startswith("CASE") else f"'{severity}'"
    return f"SELECT repo_id, '{vuln}' AS vuln_class, {severity} AS severity, CAST({confidence} AS DOUBLE) AS confidence, instruction, {at}path AS path, CAST({at}{line} AS INTEGER) AS line, CAST({at}{end} AS INTEGER) AS end_line, {rule} AS rule, {order} AS ord, {accounts} AS accounts FROM {source} WHERE {where}"


_KIND = "len(list_filter(f.constraints, lambda x: x.kind IN ({}))) > 0"
_UNSIGNED = "len(list_filter(rulers, lambda f: f.is_signer)) = 0"
_NAMED = "array_to_string(list_transform({}, lambda f: f.name), ',')"
_FIELDS_AT = "(SELECT *, unnest(fields) AS f, unnest(range(len(fields))) AS n FROM {})"
_FEEDS = "sink = 'oracle_read' AND (contains(f.name, 'oracle') OR contains(f.name, 'price') OR contains(f.name, 'feed') OR contains(f.name, 'aggregator'))"
_GUARDED = """(len(list_filter(fields, lambda g: len(list_filter(g.constraints, lambda x: (x.kind = 'has_one' AND x.expression = f.name) OR (x.kind = 'constraint' AND contains(x.expression, f.name)))) > 0)) > 0
  OR (contains(excerpt, 'require!(') AND (contains(excerpt, f.name || '.key()') OR contains(excerpt, f.name || '.is_signer'))))"""
_LINES = "(SELECT repo_id, path, instruction, ord, line + k AS line, line + k AS end_line, k, text FROM (SELECT *, name AS instruction, unnest(string_split(excerpt, chr(10))) AS text, unnest(range(len(string_split(excerpt, chr(10))))) AS k FROM ins))"
_CANDIDATES = {
    "c01_unsigned_tokens": [_row(1, "missing_signer", "CRITICAL", 0.88, "tok", f"{_UNSIGNED} AND len(rulers) > 0", _NAMED.format("rulers"))],
    "c02_no_authority": [_row(2, "missing_signer", "HIGH", 0.72, "tok", f"len(rulers) = 0 AND NOT {_has('CpiContext::new_with_signer', 'invoke_signed', column='excerpt')}")],
    "c03_token_account": [_row(3, "token_authority_mismatch", "HIGH", 0.78, _FIELDS_AT.format("tok"), f"(f.\"inner\" = 'TokenAccount' OR contains(f.type, 'TokenAccount')) AND NOT {_KIND.format(repr('token_authority'))} AND list_contains(accounts, f.name)", "f.name", "n", at="f.")],
    "c04_unsigned_lamports": [_row(4, "missing_signer", "CRITICAL", 0.85, "at_", f"sink = 'sol_transfer' AND {_UNSIGNED} AND len(rulers) > 0", _NAMED.format("rulers"))],
    "c05_drained": [_row(5, "close_revive", "CRITICAL", 0.82, "at_", f"sink = 'account_close' AND {_UNSIGNED} AND len(list_filter(fields, lambda f: {_KIND.format(repr('close'))})) = 0 AND contains(excerpt, 'lamports') AND contains(excerpt, '= 0')", "array_to_string(accounts, ',')")],
    "c06_authority_change": [_row(6, "missing_signer", "CRITICAL", 0.90, "at_", f"sink = 'set_authority' AND {_UNSIGNED}", _NAMED.format("rulers"))],
    "c07_price_account": [
        _row(7, "oracle_validation", "CRITICAL", 0.80, _FIELDS_AT.format("at_"), f"{_FEEDS} AND NOT (f.kind IN ('Account', 'Program', 'InterfaceAccount', 'Interface') OR {_KIND.format(repr('owner'))})", "f.name", "n", at="f."),
        _row(8, "oracle_validation", "HIGH", 0.65, _FIELDS_AT.format("at_"), f"{_FEEDS} AND NOT {_has('timestamp', 'stale', 'max_age', 'confidence')}", "f.name", "n", at="f."),
    ],
    "c08_nobody_signs": [_row(9, "missing_signer", "CRITICAL", 0.90, "own", "fields IS NOT NULL AND len(list_filter(fields, lambda f: f.is_signer)) = 0 AND EXISTS (SELECT 1 FROM sk WHERE sk.repo_id = own.repo_id AND sk.instruction = own.instruction AND sk.sink IN ('token_transfer', 'sol_transfer', 'token_burn', 'account_close', 'set_authority'))", _NAMED.format("fields"))],
    "c09_loose_authority": [_row(10, "missing_signer", "HIGH", 0.78, _FIELDS_AT.format("own"), f"{_RULER} AND NOT f.is_signer AND f.is_mut AND NOT {_GUARDED}", "f.name", "n", at="f.")],
    "c10_bare_account": [_row(11, "missing_owner", "HIGH", 0.72, "parts", f"f.kind IN ('UncheckedAccount', 'AccountInfo') AND f.is_mut AND NOT {_KIND.format(repr('constraint') + ', ' + repr('address') + ', ' + repr('owner'))}", "f.name", "n", at="f.")],
    "c11_reinit": [_row(12, "reinit", "HIGH", 0.70, "parts", _KIND.format(repr("init_if_needed")), "f.name", "n", at="f.")],
    "c12_called_program": [_row(13, "arbitrary_cpi", "CRITICAL", 0.85, "ca", "NOT validated AND contains(call_type, 'invoke')")],
    "c13_address": [_row(14, "pda_derivation", "HIGH", 0.75, "pd", "bump = 'unchecked'"), _row(15, "pda_derivation", "MEDIUM", 0.60, "pd", "bump = 'missing' AND source = 'constraint'")],
    "c14_arithmetic": [_row(16, "integer_overflow", "HIGH", 0.55, _LINES, "NOT starts_with(ltrim(text), '//') AND regexp_matches(text, '[+\\-*]\\s*[^=>]|\\bas\\s+u(64|128)\\b') AND regexp_matches(text, '(?i)amount|balance|lamports|price|fee|rate|supply|reserve') AND NOT regexp_matches(text, 'checked_|saturating_|try_')", "''", "k")],
}


def _second(rules: list[int]):
    def run(spark, d):
        return _shown(candidates.second_generation(_parsed(spark, d)).where(F.col("rule").isin(rules)))

    return run


for _name, _parts in _CANDIDATES.items():
    _f = _second([int(p.split(" AS rule")[0].rpartition(", ")[2]) for p in _parts])
    _f.__name__ = f"rule_{_name}"
    query(f"{_WITH} {' UNION ALL '.join(_parts)}")(_f)

# ---- third generation --------------------------------------------------------------------------------------


def _any(column: str, patterns: tuple[str, ...]) -> str:
    return f"regexp_matches({column}, {audit._text(candidates.any_pattern(patterns))})"


def _called(patterns: tuple[str, ...]) -> str:
    return f"len(list_filter(calls, lambda x: {_any('x', patterns)})) > 0"


_FEED = _any("x", candidates.ORACLE_ACCOUNT)
_GRAVE = f"NOT {_any('body', candidates.CONFIDENCE)} AND NOT {_any('body', candidates.SANITY)}"
_READ = f"(SELECT * FROM (SELECT sk.*, one.body, one.calls, row_number() OVER (PARTITION BY repo_id, instruction ORDER BY sk.ord) AS first FROM sk JOIN one USING (repo_id, instruction) WHERE sink = 'oracle_read' AND NOT {_any('body', candidates.STALENESS)} AND NOT {_called(candidates.VALIDATION_CALL)}) WHERE first = 1)"
_PRICED = _row(20, "oracle_validation", f"CASE WHEN {_GRAVE} THEN 'CRITICAL' ELSE 'HIGH' END", f"CASE WHEN {_GRAVE} THEN 0.82 ELSE 0.65 END", _READ, "true", f"array_to_string(list_concat(list_filter(accounts, lambda x: {_FEED}), list_filter(accounts, lambda x: NOT {_FEED})[1:2]), ',')")
_REST = f"(SELECT * FROM (SELECT *, name AS instruction, row_number() OVER (PARTITION BY repo_id, name ORDER BY ord) AS first FROM ins WHERE {_any('excerpt', candidates.ORACLE_READ)} AND NOT {_any('excerpt', candidates.STALENESS)} AND NOT {_called(candidates.BODY_VALIDATION_CALL)} AND NOT EXISTS (SELECT 1 FROM {_READ} r WHERE r.repo_id = ins.repo_id AND r.instruction = ins.name)) WHERE first = 1)"
_PRICES = f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY rule, ord) AS n FROM ({_PRICED} UNION ALL " + _row(21, "oracle_validation", "HIGH", 0.65, _REST, "framework <> 'anchor' OR repo_id NOT IN (SELECT repo_id FROM sk WHERE sink = 'oracle_read')") + ")) WHERE n <= 5"
_TEXTS = _LINES.replace("k, text FROM", "k, text, account FROM").replace("AS k FROM ins", "AS k, '' AS account FROM ins WHERE {}")
_BYTES = f"""(SELECT *, row_number() OVER (PARTITION BY repo_id, instruction, who ORDER BY ord, k) AS first FROM (SELECT *, coalesce(nullif(regexp_extract(text, 'let\\s+(?:mut\\s+)?(\\w+)\\s*=.*(?:unpack|deserialize|try_from)', 1), ''), 'unknown_account') AS who
  FROM {_TEXTS.replace('{}', "framework <> 'anchor' AND NOT " + _any('excerpt', candidates.OWNER_CHECK) + ' AND (SELECT count(*) FROM st WHERE st.repo_id = ins.repo_id) <= 20')} WHERE NOT starts_with(ltrim(text), '//') AND {_any('text', candidates.DESERIALIZE)}))"""
_OWNERS = _row(22, "missing_owner", "HIGH", 0.72, _BYTES, "first = 1", "who", "k", end="line + 1")
_AFTER = f"""(SELECT *, row_number() OVER (PARTITION BY repo_id, instruction ORDER BY ord, k) AS first FROM (SELECT *, string_agg(text, chr(10)) OVER w AS after, count(*) OVER w AS n_after FROM {_LINES} WINDOW w AS (PARTITION BY repo_id, path, instruction, ord ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 29 FOLLOWING))
  WHERE NOT starts_with(ltrim(text), '//') AND {_any('text', candidates.PROGRAM_CALL)} AND {_any('after', candidates.STATE_READ)} AND NOT {_any('after', candidates.RELOAD)})"""
_NEAREST = f"(SELECT a.*, (SELECT arg_min(CASE WHEN c.target <> '' THEN c.target ELSE 'unknown_program' END, c.ord) FROM ca c WHERE c.repo_id = a.repo_id AND c.line BETWEEN a.line - 2 AND a.line + 2) AS target FROM {_AFTER} a WHERE first = 1)"
_STALE = _row(23, "stale_post_cpi", "HIGH", 0.68, _NEAREST, "true", "coalesce(target, '')", "k", end="line + least(n_after, 10)")
_MOST_STRUCTS = 20


@query(f"{_WITH} {_PRICES}")
def rule_c15_stale_price(spark, d):
    return _shown(candidates.stale_prices(_parsed(spark, d)))


@query(f"{_WITH} {_OWNERS}")
def rule_c16_unowned_bytes(spark, d):
    return _shown(candidates.unowned_bytes(_parsed(spark, d), _MOST_STRUCTS))


@query(f"{_WITH} {_STALE}")
def rule_c17_stale_read(spark, d):
    return _shown(candidates.stale_reads(_parsed(spark, d)))


_ALL = " UNION ALL ".join(x for own in _CANDIDATES.values() for x in own)
_WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 100.0::DOUBLE WHEN 'HIGH' THEN 75.0 WHEN 'MEDIUM' THEN 50.0 WHEN 'LOW' THEN 25.0 ELSE 10.0 END"
_PRINT = "vuln_class || ':' || instruction || ':' || path || ':' || line || ':' || array_to_string(list_sort(CASE WHEN accounts = '' THEN [] ELSE string_split(accounts, ',') END), ',')"
_GENERATED = f"""(SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_WEIGHT} * confidence DESC, first) - 1 AS id, 'second' AS origin FROM (SELECT *, min(place) OVER (PARTITION BY repo_id, fingerprint) AS first, row_number() OVER (PARTITION BY repo_id, fingerprint ORDER BY confidence DESC, place) AS n FROM
  (SELECT *, {_PRINT} AS fingerprint, lpad(CAST(rule AS VARCHAR), 3, '0') || '/' || ord AS place FROM ({_ALL}))) WHERE n = 1)"""
_THIRD = f"(SELECT *, 'v3:' || {_PRINT} AS fingerprint, row_number() OVER (PARTITION BY repo_id ORDER BY rule, ord) + 9999 AS id, 'third' AS origin FROM ({_PRICES} UNION ALL {_OWNERS.replace('<= 20', '<= 5')} UNION ALL {_STALE}))"
_BOTH = f"(SELECT repo_id, id, origin, fingerprint, severity, confidence, rule, instruction, line, end_line, accounts FROM {_GENERATED} UNION ALL SELECT repo_id, id, origin, fingerprint, severity, confidence, rule, instruction, line, end_line, accounts FROM {_THIRD})"


@query(f"{_WITH} SELECT repo_id, id, origin, fingerprint, severity, confidence FROM {_GENERATED}")
def rule_c18_generated(spark, d):
    return candidates.generate(_parsed(spark, d)).select("repo_id", "id", "origin", "fingerprint", "severity", "confidence")


@query(f"{_WITH} SELECT repo_id, id, origin, fingerprint, severity, confidence FROM {_BOTH}")
def rule_c19_with_third(spark, d):
    p = _parsed(spark, d)
    return candidates.with_third(candidates.generate(p), p).select("repo_id", "id", "origin", "fingerprint", "severity", "confidence")


_LINKED = "rule IN (1, 2, 3, 4, 5, 6, 7, 8, 20)"
_KNOWN = f"(SELECT repo_id, instruction, {_OF.format(x='s.struct', t='one')} AS known FROM one)"
_ASKED = f"(SELECT {_REPO}, p_partkey % {_PER_REPO} AS id, ['confirmed', 'rejected', 'uncertain', 'confirmed'][1 + p_partkey % 4] AS verdict, CAST(p_partkey % 101 AS DOUBLE) AS sure, p_partkey % 2 = 0 AS easy FROM part WHERE p_partkey % 7 <> 0)"
_PROVEN = f"(SELECT {_REPO}, p_partkey % {_PER_REPO} AS id, p_partkey % 9 = 0 AS proven FROM part WHERE p_partkey % 3 = 0)"
_GRADED = f"""SELECT repo_id, id, status, grade, confidence, CASE WHEN grade = 'C' AND severity = 'CRITICAL' THEN 'HIGH' WHEN grade = 'D' AND severity IN ('CRITICAL', 'HIGH') THEN 'MEDIUM' ELSE severity END AS severity FROM
  (SELECT *, CASE WHEN proven THEN 'A' WHEN verdict = 'confirmed' AND sure >= 80 AND shown THEN 'B' WHEN (verdict = 'confirmed' AND sure >= 80) OR shown OR (verdict = 'uncertain' AND sure >= 50) THEN 'C' ELSE 'D' END AS grade FROM
  (SELECT b.repo_id, b.id, verdict, sure, coalesce(proven, false) AS proven, (accounts <> '' OR {_LINKED} OR known IS NOT NULL OR end_line - line <= 20 OR origin = 'third') AS shown,
    CASE WHEN origin = 'third' AND NOT coalesce(proven, false) THEN 'LIKELY' WHEN coalesce(proven, false) THEN 'PROVEN' WHEN verdict = 'confirmed' THEN 'LIKELY' WHEN verdict = 'rejected' THEN 'REJECTED' WHEN verdict = 'uncertain' THEN 'NEEDS_HUMAN' WHEN confidence >= 0.8 AND severity = 'CRITICAL' THEN 'LIKELY' WHEN confidence >= 0.7 THEN 'NEEDS_HUMAN' ELSE 'REJECTED' END AS status,
    CASE WHEN verdict = 'confirmed' AND sure > 80 AND coalesce(easy, false) AND severity <> 'CRITICAL' THEN 'CRITICAL' WHEN verdict = 'confirmed' AND sure < 40 AND severity = 'CRITICAL' THEN 'HIGH' ELSE severity END AS severity,
    CASE WHEN coalesce(proven, false) THEN greatest(0.95::DOUBLE, m) ELSE m END AS confidence FROM
    (SELECT *, CASE verdict WHEN 'confirmed' THEN least(1.0::DOUBLE, 0.4::DOUBLE * confidence + 0.6::DOUBLE * (sure / 100.0::DOUBLE)) WHEN 'rejected' THEN 0.2::DOUBLE * confidence WHEN 'uncertain' THEN 0.6::DOUBLE * confidence ELSE confidence END AS m FROM {_BOTH} LEFT JOIN {_ASKED} USING (repo_id, id) LEFT JOIN {_PROVEN} USING (repo_id, id) LEFT JOIN {_KNOWN} USING (repo_id, instruction)) b))"""


def _graded(spark, d) -> DataFrame:
    p, k = _parsed(spark, d), F.col("p_partkey")
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("r"), F.floor(k / _PER_REPO).cast("string")).alias("repo_id"), (k % _PER_REPO).alias("id"))
    verdict = F.get(F.array(*map(F.lit, ("confirmed", "rejected", "uncertain", "confirmed"))), (k % 4).cast("int"))
    asked = part.where("p_partkey % 7 <> 0").select("repo_id", "id", verdict.alias("verdict"), (k % 101).cast("double").alias("sure"), (k % 2 == 0).alias("easy"))
    proofs = part.where("p_partkey % 3 = 0").select("repo_id", "id", (k % 9 == 0).alias("proven"))
    return candidates.graded(candidates.with_third(candidates.generate(p), p), asked, proofs, p)


@query(f"{_WITH} {_GRADED}")
def rule_p12_graded(spark, d):
    return _graded(spark, d).select("repo_id", "id", "status", "grade", "confidence", "severity")


@query(f"{_WITH}, g AS ({_GRADED}) SELECT g.repo_id, count(*) FILTER (WHERE grade = 'A') AS a, count(*) FILTER (WHERE grade = 'B') AS b, count(*) FILTER (WHERE grade = 'C') AS c, count(*) FILTER (WHERE grade = 'D') AS d, count(*) FILTER (WHERE g.severity <> x.before) AS downgraded FROM g JOIN (SELECT b.repo_id, b.id, CASE WHEN verdict = 'confirmed' AND sure > 80 AND coalesce(easy, false) AND severity <> 'CRITICAL' THEN 'CRITICAL' WHEN verdict = 'confirmed' AND sure < 40 AND severity = 'CRITICAL' THEN 'HIGH' ELSE severity END AS before FROM {_BOTH} b LEFT JOIN {_ASKED} USING (repo_id, id)) x USING (repo_id, id) GROUP BY g.repo_id")
def grade_distribution(spark, d):
    return candidates.grade_distribution(_graded(spark, d))


@query(f"{_WITH}, g AS ({_GRADED}) SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE status = 'PROVEN') AS proven, count(*) FILTER (WHERE status = 'LIKELY') AS likely, count(*) FILTER (WHERE status = 'NEEDS_HUMAN') AS needs_human, count(*) FILTER (WHERE status = 'REJECTED') AS rejected FROM g GROUP BY repo_id")
def status_counts(spark, d):
    return candidates.status_counts(_graded(spark, d))


@query(f"{_WITH}, g AS ({_GRADED}) SELECT repo_id, id, severity, status FROM g WHERE status <> 'REJECTED' AND severity IN ('CRITICAL', 'HIGH')")
def kept_findings(spark, d):
    rows = _graded(spark, d)
    return candidates.at_least(candidates.not_rejected(rows), "HIGH").select("repo_id", "id", "severity", "status")


@query(f"{_WITH} SELECT repo_id, id FROM {_BOTH} LEFT JOIN {_ASKED} USING (repo_id, id) WHERE verdict = 'confirmed' OR (verdict IS NULL AND confidence >= 0.85 AND severity = 'CRITICAL')")
def proof_jobs(spark, d):
    p, k = _parsed(spark, d), F.col("p_partkey")
    verdict = F.get(F.array(*map(F.lit, ("confirmed", "rejected", "uncertain", "confirmed"))), (k % 4).cast("int"))
    asked = table(spark, d, "part").where("p_partkey % 7 <> 0").select(F.concat(F.lit("r"), F.floor(k / _PER_REPO).cast("string")).alias("repo_id"), (k % _PER_REPO).alias("id"), verdict.alias("verdict"))
    return candidates.proof_jobs(candidates.with_third(candidates.generate(p), p), asked).select("repo_id", "id")


@query(f"{_WITH} SELECT repo_id, id, rank FROM (SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 50 ELSE 10 END + confidence * 40.0::DOUBLE DESC, id) AS rank FROM {_GENERATED}) WHERE rank <= 10")
def fallback_topk(spark, d):
    return candidates.fallback_topk(candidates.generate(_parsed(spark, d)), 10).select("repo_id", "id", "rank")
