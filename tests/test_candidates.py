import pytest
from pyspark.sql import functions as F

from factlake.operators import syntax
from factlake.plans import candidates, evaluate

SOURCE = """use anchor_lang::prelude::*;
// a comment { with a brace
#[program]
pub mod vaults {
    pub fn withdraw(ctx: Context<Take>, amount: u64) -> Result<()> {
        let c = '{'; let s = "}}"; /* nested /* x */ { */
        let vault = &mut ctx.accounts.vault;
        vault.balance = vault.balance - amount;
        token::transfer(CpiContext::new(ctx.accounts.token_program.to_account_info(), t), amount)?;
        msg!("x {}", token::burn(a));
        invoke(&ix, &[ctx.accounts.vault.to_account_info()])?;
        let after = ctx.accounts.vault.amount;
        Ok(())
    }
    pub fn read(ctx: Context<Read>) -> Result<()> {
        let p = get_price(&ctx.accounts.price_feed)?;
        Ok(())
    }
    pub fn safe(ctx: Context<Safe>) -> Result<()> {
        Ok(())
    }
}
#[derive(Accounts)]
pub struct Take<'info> {
    #[account(mut, seeds = [b"v", user.key().as_ref()], bump)]
    pub vault: Box<Account<'info, Vault>>,
    #[account(mut)]
    pub authority: AccountInfo<'info>,
}
#[derive(Accounts)]
pub struct Read<'info> { pub price_feed: AccountInfo<'info>, }
#[derive(Accounts)]
pub struct Safe<'info> { #[account(init_if_needed, payer = owner)] pub owner: Signer<'info>, }
"""


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([("r", "lib.rs", SOURCE), ("e", "lib.rs", ""), ("n", "lib.rs", None)], "repo_id string, path string, content string")
    return syntax.parse(files).persist()


def test_blanked():
    text = "a /* x /* y */ z */ b 'c' \"q\\\"r\" r#\"s\"t\"# &'a str // end\nf"
    bare = syntax.blanked(text)
    assert len(bare) == len(text) and bare.split() == ["a", "b", "&'a", "str", "f"]


def test_parse(parsed):
    r = parsed.where("repo_id = 'r'").first()
    assert [(i.name, i.context, i.params) for i in r.instructions] == [("withdraw", "Take", "amount: u64"), ("read", "Read", ""), ("safe", "Safe", "")]
    assert [s.name for s in r.structs] == ["Take", "Read", "Safe"] and r.framework == "anchor" and r.error is None
    assert not any("burn" in n.text or n.target in ("derive", "account") for n in r.nodes)
    assert parsed.where("repo_id <> 'r' and size(instructions) = 0").count() == 2


def test_constraints(spark):
    text = "mut, has_one = owner @ Bad, seeds = [b\"v\", x.as_ref()], bump, bump = v.bump, token::mint = m, close = to, odd thing"
    got = spark.range(1).select(syntax.constraints(__import__("pyspark").sql.functions.lit(text)).alias("x")).first().x
    assert [(k.kind, k.expression) for k in got] == [("mut", None), ("has_one", "owner @ Bad"), ("seeds", '[b"v", x.as_ref()]'), ("bump", None), ("bump", "v.bump"), ("token_mint", "m"), ("close", "to"), ("raw", "odd thing")]


def test_fields(parsed):
    got = {(r.struct, r.name): (r.kind, r.inner, r.is_signer, r.is_mut) for r in syntax.account_fields(parsed).collect()}
    assert got[("Take", "vault")] == ("Account", "Vault", False, True) and got[("Safe", "owner")][2:] == (True, True) and got[("Read", "price_feed")][0] == "AccountInfo"


@pytest.fixture(scope="module")
def found(parsed):
    p = candidates.gather(None, parsed)
    return p, candidates.with_third(candidates.generate(p), p).persist()


def test_rules(found):
    rows = found[1].collect()
    fired = {(r.rule, r.instruction) for r in rows}
    assert {(1, "withdraw"), (9, "withdraw"), (13, "withdraw"), (15, "withdraw"), (16, "withdraw"), (11, "withdraw"), (10, "withdraw"), (7, "read"), (12, "safe"), (20, "read"), (23, "withdraw")} <= fired
    assert not any(i == "safe" and r != 12 for r, i in fired)
    second = sorted((r for r in rows if r.origin == "second"), key=lambda r: r.id)
    assert [r.id for r in second] == list(range(len(second))) and len({r.fingerprint for r in second}) == len(second)
    assert all(a.score >= b.score for a, b in zip(second, second[1:])) and all(r.id >= 10000 for r in rows if r.origin == "third")


def test_graded(spark, found):
    confirmations = spark.createDataFrame([("r", 0, "confirmed", 90.0, True), ("r", 1, "rejected", 50.0, False)], "repo_id string, id long, verdict string, sure double, easy boolean")
    proofs = spark.createDataFrame([("r", 2, True)], "repo_id string, id long, proven boolean")
    rows = {r.id: r for r in candidates.graded(found[1], confirmations, proofs, found[0]).collect()}
    assert (rows[0].status, rows[0].grade) == ("LIKELY", "B") and rows[1].status == "REJECTED" and (rows[2].status, rows[2].grade) == ("PROVEN", "A")
    assert all(r.severity != "CRITICAL" for r in rows.values() if r.grade in "CD") and rows[2].confidence >= 0.95


def test_evaluate(spark):
    expected = spark.createDataFrame([("r", 0, "missing_signer", None, ["withdraw"], ["authority"], None, "HIGH"), ("r", 1, "reinit", ["missing_owner"], ["make"], None, None, None)], "repo_id string, e_ord int, e_class string, e_alt array<string>, e_instructions array<string>, e_accounts array<string>, e_file string, e_severity string")
    actual = spark.createDataFrame([("r", 0, "missing_signer", "Withdraw", ["authority"], "lib.rs", "CRITICAL", None), ("r", 1, "missing_signer", "withdraw", [], "lib.rs", "CRITICAL", None), ("r", 2, "oracle", "x", [], "lib.rs", "LOW", None), ("r", 3, "missing_owner", "other", [], "lib.rs", "HIGH", ["make"])], "repo_id string, a_ord int, vuln_class string, instruction string, accounts array<string>, path string, severity string, aliases array<string>")
    matched = evaluate.match(expected, actual).persist()
    assert {(r.e_ord, r.a_ord) for r in matched.collect()} == {(0, 0), (1, 3)}
    m = evaluate.repo_metrics(expected, actual, matched).first()
    assert (m.n_expected, m.n_found, m.n_false, m.n_missed, m.recall) == (2, 2, 1, 0, 1.0)
    kinds = {r.vuln_class: (r.n_expected, r.n_found, r.n_false, r.n_missed) for r in evaluate.class_metrics(expected, actual, matched).collect()}
    assert kinds == {"missing_signer": (1, 1, 1, 0), "reinit": (1, 0, 0, 1), "missing_owner": (0, 1, 0, -1), "oracle": (0, 0, 1, 0)}
    was = spark.createDataFrame([("r", 2, 2, 0, 0, 1.0)], "repo_id string, n_expected long, n_found long, n_false long, n_missed long, f1 double")
    now = spark.createDataFrame([("r", 2, 1, 0, 1, 0.66)], was.schema)
    assert {r.what for r in evaluate.compare(was, now).collect()} == {"r", "recall", "f1"}


def test_dispatch(spark):
    source = "entrypoint!(process_instruction);\nfn process_all(i: I) { match i { I::Swap => process_swap(a), I::Trade => { process_swap(b) } I::Odd => err(x), I::Far => other(y), } }\nfn process_swap(a: A) { }\n"
    p = candidates.gather(None, syntax.parse(spark.createDataFrame([("d", "lib.rs", source)], "repo_id string, path string, content string")))
    assert {(r.instruction, tuple(r.names)) for r in candidates.dispatch_names(p).collect()} == {("process_swap", ("swap", "trade")), ("process_all", ("swap", "trade", "far"))}


def test_dispatch_tables_are_read_to_their_end(spark):
    """F1 of round 4: a function's first 60 lines were all that was searched; what stood below had no name."""
    arms = [f"        I::Do{k} => do_{k}(a)," for k in range(200)]
    arms[150] = "        kind::I::Do150 =>\n            {\n  self.do_150 (a) }"
    source = "entrypoint!(process_instruction);\nfn process_all(i: I) {\n    match i {\n" + "\n".join(arms) + "\n        I::Late => process_late(a),\n    }\n}\nfn process_late(a: A) { }\n"
    p = candidates.gather(None, syntax.parse(spark.createDataFrame([("d", "lib.rs", source)], "repo_id string, path string, content string")))
    got = {r.instruction: r.names for r in candidates.dispatch_names(p).collect()}
    assert got == {"process_late": ["late"], "process_all": [*(f"do{k}" for k in range(200)), "late"]}


def test_grades_by_sureness_and_evidence(spark, found):
    """Below 80 a confirmation gives no B; without evidence it gives C from 80, and an uncertain verdict C from 50."""
    base = found[1].where("repo_id = 'r'").limit(1)
    cases = [(k, verdict, float(sure), wide) for k, (verdict, sure, wide) in enumerate([("confirmed", 60, 0), ("confirmed", 79, 0), ("confirmed", 80, 0), ("confirmed", 80, 1), ("confirmed", 79, 1), ("uncertain", 50, 1), ("uncertain", 49, 1), ("rejected", 99, 1)])]
    asked = spark.createDataFrame(cases, "id long, verdict string, sure double, wide int")
    none, lit = F.array().cast("array<string>"), F.lit
    rows = base.drop("id").crossJoin(asked.select("id", "wide")).withColumn("severity", lit("CRITICAL")).withColumn("origin", lit("second")).withColumn("link", lit(None).cast("string"))
    rows = rows.withColumn("accounts", none).withColumn("instruction", lit("nowhere")).withColumn("line", lit(1)).withColumn("end_line", F.when(F.col("wide") == 1, 50).otherwise(9)).drop("wide")
    confirmations = asked.select(lit("r").alias("repo_id"), "id", "verdict", "sure", lit(False).alias("easy"))
    got = {r.id: (r.grade, r.severity) for r in candidates.graded(rows, confirmations, spark.createDataFrame([], "repo_id string, id long, proven boolean"), found[0]).collect()}
    assert [got[k][0] for k in range(8)] == ["C", "C", "B", "C", "D", "C", "D", "D"] and got[0][1] == "HIGH" and got[2][1] == "CRITICAL" and got[4][1] == "MEDIUM"


def test_two_operations_on_one_field(spark):
    """Two price reads of one function show the same field: it is found once, where the field stands."""
    source = "#[program]\npub mod m {\n    pub fn read(ctx: Context<Read>) -> Result<()> {\n        let p = get_price(&ctx.accounts.price_feed)?;\n        let q = get_price(&ctx.accounts.price_feed)?;\n        Ok(())\n    }\n}\n#[derive(Accounts)]\npub struct Read<'info> {\n    pub price_feed:\n        AccountInfo<'info>,\n}\n"
    p = candidates.gather(None, syntax.parse(spark.createDataFrame([("r", "lib.rs", source)], "repo_id string, path string, content string")))
    rows = candidates.generate(p).where("rule = 7").collect()
    assert [(r.line, r.end_line, r.accounts) for r in rows] == [(11, 12, ["price_feed"])] and rows[0].link.startswith("oracle_read at line")


def test_aliases_match_by_containment(spark):
    expected = spark.createDataFrame([("r", 0, "reinit", ["swap_exact"])], "repo_id string, e_ord int, e_class string, e_instructions array<string>")
    expected = expected.selectExpr("*", "cast(null as array<string>) as e_alt", "cast(null as array<string>) as e_accounts", "cast(null as string) as e_file", "cast(null as string) as e_severity")
    actual = spark.createDataFrame([("r", 0, "reinit", "process_x", [], "lib.rs", "HIGH", ["Swap"]), ("r", 1, "reinit", "process_y", [], "lib.rs", "HIGH", ["trade"])], "repo_id string, a_ord int, vuln_class string, instruction string, accounts array<string>, path string, severity string, aliases array<string>")
    assert [(r.e_ord, r.a_ord, r.score) for r in evaluate.match(expected, actual).collect()] == [(0, 0, 1.0)]
