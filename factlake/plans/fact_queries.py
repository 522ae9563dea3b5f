"""Queries of source facts: a small source file is written for every row of `part` from a few templates, the readers of sources turn it
into facts, and SQL finds the same in the text by lines and patterns, or states what a template holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, syntax
from ..sources.tables import program_id, program_name, spread, table, written
from . import candidates
from .audit_queries import _listed
from .queries import query

_KEY = "{k}"
#: Sources of the first generation; {k} is the part's key.
_TEMPLATES = [
    """use anchor_lang::prelude::*;
declare_id!("Prog{k}");
#[program]
pub mod vaults {
    pub fn withdraw_{k}(ctx: Context<Take>, amount: u64) -> Result<()> {
        let mut vault = &mut ctx.accounts.vault;
        require!(ctx.accounts.authority.is_signer, Bad);
        vault.balance = vault.balance - amount;
        // vault.price - fee
        let x = amount.checked_add(1) + amount;
        invoke(&ix, &accounts)?;
        vault.reload()?;
        Ok(())
    }
    pub fn look<'a>(ctx: Context<See>) -> Result<()> {
        if ctx.accounts.user.owner == ctx.accounts.user.key() { token::transfer(a)?; }
        Ok(())
    }
}
#[account]
pub struct Vault {
    pub authority: Pubkey,
    pub total: u64,
}
#[error_code]
pub enum Bad {
    First,
    Second = 6100,
    Third,
}""",
    """entrypoint!(process_instruction);
fn process_close_{k}(accounts: &[AccountInfo]) {
    let from = next_account_info(it)?;
    let to_wallet = next_account_info(it)?;
    if from.is_writable && to_wallet.is_signer { x = fee * 2; }
    let seeds = &[b"x", user.as_ref()];
    let a = Pubkey::create_program_address(seeds, id);
    let (b, c) = Pubkey::find_program_address(&[b"pool", mint.as_ref()], id);
}
fn handle_{k}(a: A) { }""",
    """pub fn free_{k}(ctx: Context<Take>) {
    CpiContext::new(program = target_{k}, x);
}
#[derive(Accounts)]
pub struct Take<'info> {
    #[account(init, seeds = [b"v", user.key()], bump)]
    pub vault: Account<'info, Vault>,
    #[account(mut, close = user)]
    pub user: Signer<'info>,
}
fn other() {
    let s = 1;
    system_program::transfer(c, lamports)?;
    invoke_signed(&ix, &a, &s)?;
}""",
    "nothing to find in part {k}",
]
_N = len(_TEMPLATES)


def _files(spark, d, templates=None) -> DataFrame:
    texts = _TEMPLATES if templates is None else templates
    k = F.col("p_partkey")
    keys = spread(table(spark, d, "part").select("p_partkey"), "p_partkey")  # part is a few MB, its sources are a thousand times as much
    content = F.replace(F.get(F.array(*map(F.lit, texts)), (k % len(texts)).cast("int")), F.lit(_KEY), k.cast("string"))
    return keys.select(F.concat(F.lit("r"), k.cast("string")).alias("repo_id"), F.lit("lib.rs").alias("path"), content.alias("content"))


def _with(templates: list[str]) -> str:
    return f"""WITH files AS (SELECT 'r' || p_partkey AS repo_id, p_partkey AS k, p_partkey % {len(templates)} AS t, replace(({_listed(templates)})[1 + p_partkey % {len(templates)}], '{_KEY}', p_partkey::VARCHAR) AS content FROM part),
    rows AS (SELECT repo_id, t, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM files),
    steps AS (SELECT *, sum(len(regexp_extract_all(line, '\\{{')) - len(regexp_extract_all(line, '\\}}'))) OVER (PARTITION BY repo_id ORDER BY n) AS depth FROM rows)"""


_WITH = _with(_TEMPLATES)
# the line on which the braces opened from a line are closed, a later one; the line itself if they never are
_ENDED = "(SELECT h.*, coalesce((SELECT min(b.n) FROM steps b WHERE b.repo_id = h.repo_id AND b.n > h.n AND b.depth - h.before <= 0), h.n) AS end_n FROM (SELECT *, coalesce(lag(depth) OVER (PARTITION BY repo_id ORDER BY n), 0) AS before FROM steps) h)"
_STARTS = f"""(SELECT repo_id, n, end_n, name, framework FROM (SELECT e.*, CASE WHEN m.n IS NOT NULL THEN 'anchor' WHEN entry THEN 'native' ELSE 'unknown' END AS framework, CASE WHEN m.n IS NULL AND entry THEN nullif(regexp_extract(line, 'fn\\s+((?:process|handle)_\\w+)', 1), '')
  WHEN m.n IS NOT NULL THEN CASE WHEN e.n > m.n AND e.n < m.closed THEN nullif(regexp_extract(line, 'pub\\s+fn\\s+(\\w+)\\s*[<(]', 1), '') END ELSE nullif(regexp_extract(line, 'pub\\s+fn\\s+(\\w+)\\s*\\(\\s*ctx\\s*:\\s*Context', 1), '') END AS name
  FROM {_ENDED} e JOIN (SELECT repo_id, contains(content, 'entrypoint!') OR contains(content, 'process_instruction') AS entry FROM files) f USING (repo_id)
  LEFT JOIN (SELECT a.repo_id, a.n, min(b.n) AS closed FROM steps a JOIN steps b ON b.repo_id = a.repo_id AND b.n > a.n + 1 AND b.depth <= a.depth WHERE contains(a.line, '#[program]') GROUP BY a.repo_id, a.n) m USING (repo_id)) WHERE name IS NOT NULL)"""
_BODIES = f"(SELECT s.*, array_to_string(list(r.line ORDER BY r.n), chr(10)) AS body FROM {_STARTS} s JOIN rows r ON r.repo_id = s.repo_id AND r.n BETWEEN s.n AND s.end_n GROUP BY ALL)"


def _gathered(spark, d) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, d)
    return files, facts.instructions(files, facts.frameworks(files))


@query(f"{_WITH} SELECT repo_id, framework, name, n::INTEGER AS line, end_n::INTEGER AS end_line, body FROM {_BODIES}")
def facts_x01_x04_functions(spark, d):
    return _gathered(spark, d)[1].select("repo_id", "framework", "name", "line", "end_line", "body")


_ANCHOR = """list_transform(list_distinct_first, lambda a: a || ':' || (contains(body, 'Signer') OR contains(body, a || '.is_signer') OR regexp_matches(body, '(?s)#\\[account\\([^)]*signer[^)]*\\)\\]\\s*.*' || a))::VARCHAR || ':' || (contains(body, 'mut ' || a) OR regexp_matches(body, '(?s)#\\[account\\([^)]*mut[^)]*\\)\\]\\s*.*' || a))::VARCHAR)"""
_ALL = "regexp_extract_all(body, 'ctx\\.accounts\\.(\\w+)', 1)"


@query(f"""{_WITH} SELECT repo_id, name, array_to_string(CASE WHEN framework = 'native' THEN list_transform(regexp_extract_all(body, 'let\\s+(\\w+)\\s*=\\s*next_account_info', 1), lambda a: a || ':' || contains(body, a || '.is_signer')::VARCHAR || ':' || contains(body, a || '.is_writable')::VARCHAR) ELSE {_ANCHOR} END, ',') AS accounts
  FROM (SELECT *, list_filter({_ALL}, lambda x, i: list_position({_ALL}, x) = i) AS list_distinct_first FROM {_BODIES})""")
def facts_x05_x06_accounts(spark, d):
    shown = F.transform("accounts", lambda a: F.concat_ws(":", a["name"], a["is_signer"].cast("string"), a["is_mut"].cast("string")))
    return _gathered(spark, d)[1].select("repo_id", "name", F.array_join(shown, ",").alias("accounts"))


def _tags(*tests: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{tag}' END" for test, tag in tests) + "], lambda x: x IS NOT NULL), ',')"


_SIGNED = _tags(("contains(body, 'is_signer')", "is_signer"), ("contains(body, '#[account(signer') OR contains(body, 'Signer<')", "anchor_signer"), ("contains(body, 'has_one')", "has_one"), ("regexp_matches(body, 'constraint\\s*=.*key\\(\\)')", "key_constraint"))
_OWNED = _tags(("contains(body, '.owner') AND (contains(body, '==') OR contains(body, 'require!'))", "owner_check"), ("contains(body, 'Account<') OR contains(body, 'Program<')", "anchor_account_type"), ("contains(body, 'token::authority')", "token_authority"))


@query(f"{_WITH} SELECT repo_id, name, {_SIGNED} AS signer_checks, {_OWNED} AS owner_checks FROM {_BODIES}")
def facts_x07_check_tags(spark, d):
    return _gathered(spark, d)[1].select("repo_id", "name", F.array_join("signer_checks", ",").alias("signer_checks"), F.array_join("owner_checks", ",").alias("owner_checks"))


_MENTIONS = " || ".join(f"regexp_extract_all(body, '{p}')" for p in ("invoke(?:_signed)?\\s*\\(", "CpiContext", "token::\\w+", "system_program::\\w+", "anchor_lang::solana_program::program::invoke"))


@query(f"{_WITH} SELECT repo_id, name, array_to_string({_MENTIONS}, ',') AS mentions FROM {_BODIES}")
def facts_x08_call_mentions(spark, d):
    return _gathered(spark, d)[1].select("repo_id", "name", F.array_join("cpi_mentions", ",").alias("mentions"))


@query(f"""{_WITH} SELECT s.repo_id, s.name, r.n::INTEGER AS line, regexp_extract(r.line, '([+\\-*/])', 1) AS op, regexp_matches(r.line, 'checked_|try_|saturating_') AS checked FROM {_STARTS} s JOIN rows r ON r.repo_id = s.repo_id AND r.n BETWEEN s.n AND s.end_n
  WHERE regexp_matches(r.line, '[+\\-*/]\\s*[^=]') AND NOT starts_with(ltrim(r.line), '//') AND regexp_matches(r.line, '{"|".join(facts.VALUE_WORDS)}')""")
def facts_x09_arithmetic(spark, d):
    rows = _gathered(spark, d)[1].select("repo_id", "name", F.explode("arithmetic").alias("x"))
    return rows.select("repo_id", "name", "x.line", "x.op", "x.checked")


@query(f"""{_WITH}, heads AS (SELECT a.repo_id, a.n AS attribute, min(b.n) AS n FROM rows a JOIN rows b ON b.repo_id = a.repo_id AND b.n BETWEEN a.n + 1 AND a.n + 4 AND regexp_matches(b.line, 'pub\\s+struct\\s+(\\w+)') WHERE contains(a.line, '#[derive(Accounts)]') OR contains(a.line, '#[account]') OR contains(a.line, '#[account(') GROUP BY a.repo_id, a.n)
  SELECT h.repo_id, regexp_extract(any_value(CASE WHEN r.n = h.n THEN r.line END), 'pub\\s+struct\\s+(\\w+)', 1) AS name, h.n::INTEGER AS line, coalesce(string_agg(CASE WHEN regexp_matches(r.line, 'pub\\s+(\\w+)\\s*:\\s*(.+)') THEN regexp_extract(r.line, 'pub\\s+(\\w+)\\s*:', 1) || '=' || rtrim(regexp_extract(r.line, 'pub\\s+\\w+\\s*:\\s*(.+)', 1), ', ') END, ';' ORDER BY r.n), '') AS fields, bool_or(contains(r.line, 'init')) AS has_init, bool_or(contains(r.line, 'close')) AS has_close
  FROM heads h JOIN {_ENDED} e ON e.repo_id = h.repo_id AND e.n = h.n JOIN rows r ON r.repo_id = h.repo_id AND r.n BETWEEN h.n AND e.end_n GROUP BY h.repo_id, h.attribute, h.n""")
def facts_x10_account_structs(spark, d):
    fields = F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["name"], f["type"])), ";")
    return facts.account_structs(_files(spark, d)).select("repo_id", "name", "line", fields.alias("fields"), "has_init", "has_close")


_NAMED = "(SELECT *, coalesce(last_value(nullif(regexp_extract(line, '(?:pub\\s+)?fn\\s+(\\w+)', 1), '') IGNORE NULLS) OVER (PARTITION BY repo_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS instruction, {} FROM rows)"


def _near(before: int, after: int, name: str) -> str:
    low, high = (f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING" for x in (before, after))
    return f"string_agg(line, chr(10)) OVER (PARTITION BY repo_id ORDER BY n ROWS BETWEEN {low} AND {high}) AS {name}"


@query(f"""{_WITH} SELECT repo_id, n::INTEGER AS line, instruction, CASE WHEN contains(near, 'token_program') OR contains(near, 'spl_token') THEN 'spl_token' WHEN contains(near, 'system_program') THEN 'system_program' WHEN contains(near, 'associated_token') THEN 'associated_token' WHEN regexp_extract(near, 'program\\s*[=:]\\s*(\\w+)', 1) <> '' THEN regexp_extract(near, 'program\\s*[=:]\\s*(\\w+)', 1) ELSE 'unknown' END AS target,
  (contains(near, 'program_id') OR contains(near, 'Program<') OR contains(near, 'token_program') OR contains(near, 'system_program')) AS validated, coalesce(array_to_string(regexp_extract_all(later, '(\\w+)\\.reload\\(\\)', 1), ','), '') AS reloaded FROM {_NAMED.format(_near(-10, 9, "near") + ", " + _near(1, 19, "later"))} WHERE regexp_matches(line, 'invoke(?:_signed)?\\s*\\(') OR contains(line, 'CpiContext::new')""")
def facts_x11_calls(spark, d):
    return facts.cpi_calls(_files(spark, d)).select("repo_id", "line", "instruction", "target", "validated", F.array_join("reloaded", ",").alias("reloaded"))


_SEEDS = "array_to_string(list_filter(list_transform(string_split({}, ','), lambda s: trim(s)), lambda s: s <> ''), '|')"
_LISTED = "seeds\\s*=\\s*\\[([^\\]]*)\\]"


@query(f"""{_WITH}, x AS (SELECT * FROM {_NAMED.format(_near(-3, 4, "near") + ", " + _near(-2, 2, "close"))})
  SELECT repo_id, n::INTEGER AS line, {_SEEDS.format(f"regexp_extract(line, '{_LISTED}', 1)")} AS seeds, CASE WHEN NOT contains(near, 'bump') THEN 'missing' WHEN contains(near, 'bump =') THEN 'unchecked' ELSE 'canonical' END AS bump, instruction, 0 AS form FROM x WHERE regexp_matches(line, '{_LISTED}')
  UNION ALL SELECT repo_id, n::INTEGER, {_SEEDS.format("regexp_extract(close, '\\[([^\\]]*)\\]', 1)")}, CASE WHEN contains(line, 'find_program_address') THEN 'canonical' ELSE 'unchecked' END, instruction, 1 FROM x WHERE contains(line, 'find_program_address') OR contains(line, 'create_program_address')""")
def facts_x12_derivations(spark, d):
    return facts.pda_derivations(_files(spark, d)).select("repo_id", "line", F.array_join("seeds", "|").alias("seeds"), "bump", "instruction", "form")


@query(f"{_WITH} SELECT repo_id, line::INTEGER AS line, name, code::BIGINT AS code FROM files JOIN (VALUES (0, 27, 'First', 6000), (0, 28, 'Second', 6100), (0, 29, 'Third', 6101)) e(t, line, name, code) USING (t)")
def facts_x13_error_codes(spark, d):
    return facts.error_codes(_files(spark, d)).select("repo_id", "line", "name", "code")


@query(f"{_WITH} SELECT repo_id, CASE WHEN p_partkey % 3 = 0 THEN 'anchor' WHEN contains(content, 'entrypoint!') OR contains(content, 'process_instruction') THEN 'native' ELSE 'unknown' END AS framework FROM files JOIN part ON p_partkey = k")
def facts_s04_frameworks(spark, d):
    k = F.col("p_partkey")
    manifests = table(spark, d, "part").where("p_partkey % 2 = 0 or p_partkey % 3 = 0").select(F.concat(F.lit("r"), k.cast("string")).alias("repo_id"), F.when(k % 3 == 0, "anchor-lang = 1").otherwise("other = 2").alias("content"))
    return facts.frameworks(_files(spark, d), manifests)


@query("SELECT 'r' || (p_partkey // 3) AS repo_id, coalesce(arg_min('prog_' || p_partkey, p_partkey) FILTER (WHERE p_partkey % 2 = 0), 'dir_' || (p_partkey // 3)) AS program FROM part GROUP BY p_partkey // 3")
def facts_s05_program_name(spark, d):
    k, repo = F.col("p_partkey"), F.floor(F.col("p_partkey") / 3).cast("string")
    name = F.concat(F.when(k % 2 == 0, "prog_").otherwise("test_"), k.cast("string"))
    return program_name(table(spark, d, "part").select(F.concat(F.lit("r"), repo).alias("repo_id"), F.lpad(k.cast("string"), 9, "0").alias("path"), F.concat(F.lit('[package]\nname = "'), name, F.lit('"')).alias("content"), F.concat(F.lit("/a/dir_"), repo).alias("directory")))


@query(f"{_WITH} SELECT repo_id, 'Prog' || k AS program_id FROM files WHERE t = 0")
def facts_s06_program_id(spark, d):
    return program_id(_files(spark, d))


# ---- second generation: the scanner ------------------------------------------------------------------------

_PARSED = """use anchor_lang::prelude::*;
// a comment { with a brace
pub const LIMIT_{k}: u64 = {k};
#[program]
pub mod vaults {
    pub fn withdraw(ctx: Context<Take>, amount: u64) -> Result<()> {
        let c = '{'; let s = "}}"; /* nested /* x */ { */
        let vault = &mut ctx.accounts.vault;
        vault.balance = amount;
        token::transfer(CpiContext::new(ctx.accounts.token_program.to_account_info(), t), amount)?;
        msg!("x {}", token::burn(a));
        invoke(&ix_{k}, &[ctx.accounts.vault.to_account_info()])?;
        Ok(())
    }
    pub fn read(ctx: Context<Read>) -> Result<()> {
        let p = get_price(&ctx.accounts.price_feed)?;
        let (a, b) = Pubkey::find_program_address(&[b"s", p.key().as_ref()], id);
        Ok(())
    }
    pub(crate) fn hidden(x: u8) { }
}
#[derive(Accounts)]
pub struct Take<'info> {
    #[account(mut, seeds = [b"v", user.key().as_ref()], bump, has_one = owner @ Bad)]
    pub vault: Box<Account<'info, Vault>>,
    #[account(init_if_needed, payer = owner, bump = vault.bump, seeds = [b"w"])]
    pub user: AccountInfo<'info>,
    pub signer: Signer<'info>,
}
pub enum VaultState { Open, Closed(u8), Done }
"""
_NATIVE = """entrypoint!(process_instruction);
fn process_all(i: I) { match i { I::Swap => process_swap(a), I::Trade => { process_swap(b) } I::Odd => err(x), } }
fn process_swap(a: A) { system_instruction::transfer(f, t, {k}); }
"""
_SCANNED = [_PARSED, _NATIVE, "fn open( {", ""]
_SWITH = _with(_SCANNED)


def _scan(spark, d, *parts: str) -> DataFrame:
    return syntax.parse(_files(spark, d, _SCANNED), *parts)


def _stated(columns: str, rows: str) -> str:
    """What the templates hold, a row each, for every part of that template; {k} is its key."""
    return f"{_SWITH}, e({columns}) AS (VALUES {rows})"


_FUNCTIONS = _stated("t, name, line, end_line, params, context, calls", """(0, 'withdraw', 6, 14, 'amount: u64', 'Take', 'token::transfer,CpiContext::new,ctx.accounts.token_program.to_account_info,invoke,ctx.accounts.vault.to_account_info,Ok'),
  (0, 'read', 15, 19, '', 'Read', 'get_price,Pubkey::find_program_address,p.key,Ok'), (1, 'process_all', 2, 2, 'i: I', NULL, 'process_swap,err'), (1, 'process_swap', 3, 3, 'a: A', NULL, 'system_instruction::transfer')""")


@query(f"{_FUNCTIONS} SELECT repo_id, name, line::INTEGER AS line, end_line::INTEGER AS end_line, params, context FROM files JOIN e USING (t)")
def facts_x14_x15_functions(spark, d):
    return syntax.exploded(_scan(spark, d, "instructions"), "instructions").select("repo_id", "name", "line", "end_line", "params", "context")


@query(f"{_SWITH} SELECT repo_id, CASE t WHEN 0 THEN 'anchor' WHEN 1 THEN 'native' ELSE 'unknown' END AS framework, (len(content) - len(replace(content, chr(10), '')) + 1)::INTEGER AS n_lines, substr(sha256(content), 1, 16) AS digest FROM files")
def facts_s08_s09_files(spark, d):
    return syntax.read_files(_files(spark, d, _SCANNED)).where("error is null").select("repo_id", "framework", "n_lines", "digest")


@query(f"""{_stated("t, name, kind, inn, is_signer, is_mut, line, constraints", '''(0, 'vault', 'Account', 'Vault', false, true, 25, 'mut;seeds=[b"v", user.key().as_ref()];bump;has_one=owner @ Bad'), (0, 'user', 'AccountInfo', 'o', false, true, 27, 'init_if_needed;payer=owner;bump=vault.bump;seeds=[b"w"]'), (0, 'signer', 'Signer', 'o', true, false, 28, '')''')}
  SELECT repo_id, name, kind, inn AS inner_type, is_signer, is_mut, line::INTEGER AS line, constraints FROM files JOIN e USING (t)""")
def facts_x17_x20_fields(spark, d):
    shown = F.array_join(F.transform("constraints", lambda x: F.concat_ws("=", x["kind"], x["expression"])), ";")
    return syntax.account_fields(_scan(spark, d, "structs")).select("repo_id", "name", "kind", F.col("inner").alias("inner_type"), "is_signer", "is_mut", "line", shown.alias("constraints"))


@query(f"""{_stated("t, kind, name, value, line", "(0, 'constant', 'LIMIT_{k}', '{k}', 3), (0, 'macro', 'msg', '\"x {}\", token::burn(a)', 11), (0, 'state_enum', 'VaultState', 'Open,Closed,Done', 30)")} SELECT repo_id, kind, replace(name, '{_KEY}', k::VARCHAR) AS name, replace(value, '{_KEY}', k::VARCHAR) AS value, line::INTEGER AS line FROM files JOIN e USING (t)""")
def facts_x21_items(spark, d):
    return syntax.exploded(_scan(spark, d, "items"), "items").select("repo_id", "kind", "name", "value", "line")


@query(f"""{_stated("t, sink, instruction, accounts, line", "(0, 'state_write', 'withdraw', '', 9), (0, 'token_transfer', 'withdraw', 'token_program', 10), (0, 'oracle_read', 'read', 'price_feed', 16), (1, 'sol_transfer', 'process_swap', '', 3)")} SELECT repo_id, sink, instruction, accounts, line::INTEGER AS line FROM files JOIN e USING (t)""")
def facts_x22_x23_sinks(spark, d):
    return syntax.sinks(_scan(spark, d, "nodes")).select("repo_id", "sink", "instruction", F.array_join("accounts", ",").alias("accounts"), "line")


@query(f"""{_stated("t, call_type, target, validated, instruction, line", "(0, 'CpiContext::new', 'ctx.accounts.token_program.to_account_info()', true, 'withdraw', 10), (0, 'CpiContext::new', 'ctx.accounts.token_program.to_account_info()', true, 'withdraw', 10), (0, 'invoke', 'ix_{k}', false, 'withdraw', 12)")} SELECT repo_id, call_type, replace(target, '{_KEY}', k::VARCHAR) AS target, validated, instruction, line::INTEGER AS line FROM files JOIN e USING (t)""")
def facts_x24_x27_calls(spark, d):
    return syntax.calls(_scan(spark, d, "nodes")).select("repo_id", "call_type", "target", "validated", "instruction", "line")


@query(f"""{_stated("t, seeds, bump, source, instruction, line", '''(0, 'b"v"|user.key().as_ref()', 'missing', 'constraint', 'Take', 25), (0, 'b"w"', 'canonical', 'constraint', 'Take', 27), (0, 'b"s"|p.key().as_ref()', 'canonical', 'inline', 'read', 17)''')} SELECT repo_id, seeds, bump, source, instruction, line::INTEGER AS line FROM files JOIN e USING (t)""")
def facts_x25_x26_derivations(spark, d):
    return syntax.derivations(written(_scan(spark, d, "structs", "nodes"), "parsed")).select("repo_id", F.array_join("seeds", "|").alias("seeds"), "bump", "source", "instruction", "line")


@query(f"""{_stated("t, instruction, names", "(1, 'process_swap', 'swap,trade'), (1, 'process_all', 'swap,trade')")} SELECT repo_id, instruction, names FROM files JOIN e USING (t)""")
def facts_x28_dispatch(spark, d):
    p = candidates.gather(None, written(_scan(spark, d, "instructions"), "parsed"))
    return candidates.dispatch_names(p).select("repo_id", "instruction", F.array_join("names", ",").alias("names"))
