import json

import pytest
from pyspark.sql import functions as F

from factlake.plans import candidates, graphs, packets, reports, rules

SOURCE = """#[program]
pub mod m {
    pub fn go(ctx: Context<Go>) -> Result<()> {
        let mut vault = ctx.accounts.vault;
        vault.state = State::Open;
        require!(vault.state == State::Closed, Bad);
        total = total - fee;
        a.try_borrow_mut_lamports() -= 1; b.lamports() += 1;
        let (k, b) = Pubkey::find_program_address(&[b"x", user.key().as_ref()], id);
        token::transfer(from: ctx.accounts.vault, to: pool)?;
        Ok(())
    }
}
pub enum VaultState { Open, Closed }
#[account]
pub struct Vault {
    pub authority: Pubkey,
}
"""


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("r", "lib.rs", SOURCE), ("e", "lib.rs", "")], "repo_id string, path string, content string")
    return rules.gather(files)


def test_graphs(facts):
    rows = {(r.graph, r.src, r.dst, r.kind) for r in graphs.all_graphs(facts).collect()}
    assert ("authority_flow", "field:Vault.authority", "struct:Vault", "controls") in rows
    assert {("token_flow", "ix:go", "spl:transfer:go", "spl_transfer"), ("token_flow", "acc:vault", "spl:transfer:go", "from"), ("token_flow", "spl:transfer:go", "acc:pool", "to")} <= rows
    assert {("state_machine", "ix:go", "state:VaultState::Open", "transitions"), ("state_machine", "state:VaultState::Closed", "ix:go", "guards")} <= rows
    assert ("pda", "ix:go", "pda:go:9", "derives") in rows and ("pda", "seed:b_x_", "pda:go:9", "seeds_into") in rows
    assert all(r.n_nodes > 0 for r in graphs.sizes(graphs.all_graphs(facts)).collect())


def test_documents(facts):
    ranked = rules.audit(facts.files).persist()
    doc = json.loads(reports.as_json(ranked).first().document)
    assert [f["rank"] for f in doc["findings"]] == list(range(1, len(doc["findings"]) + 1))
    text = reports.as_markdown(ranked, rules.summary(ranked)).first().document
    assert text.startswith("# r\n\nVerdict: ") and "\n1. **" in text
    fixed = reports.with_fixes(ranked, facts.kinds).where("class_id = 9 and rule = 9").first()
    assert fixed.fix == "Use checked arithmetic."
    near = reports.with_excerpts(ranked.where("rule = 9"), facts.files, around=2).first().excerpt
    assert near.split("\n")[0].startswith("6: ") and "7:         total" in near
    diff = reports.patches(ranked.where("class_id = 9 and path = 'lib.rs'"), facts.files).first()["diff"]
    assert "+        total = total.checked_sub(fee).ok_or(Overflow)?;" in diff
    assert reports.blast_radius(ranked, facts.instructions).count() == ranked.count()


def test_difference(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b"), (3, "c")], [(2, "b"), (3, "d"), (4, "e")]))
    assert {(r.k, r.change) for r in graphs.difference(a, b, ["k"]).collect()} == {(1, "removed"), (3, "modified"), (4, "added")}


EDITED = [
    (1, "pub a: AccountInfo<'info>,", "pub a: Signer<'info>,"), (1, "    #[account(mut)]", "    #[account(signer, mut)]"), (2, "#[account(mut)]", "#[account(has_one = authority, mut)]"), (3, "seeds = [b\"x\"]", "seeds = [b\"x\"], bump"),
    (4, "  invoke(&ix)?;", "  require!(target_program.key() == EXPECTED_PROGRAM, InvalidProgram);\n  invoke(&ix)?;"), (5, "pub a: AccountInfo<'info>,", "pub a: Account<'info, Checked>,"), (6, " #[account(init)]", " #[account(init)]\n     constraint = !account.is_initialized @ AlreadyInitialized,"),
    (7, "close(a);", "close(a);\naccount.try_borrow_mut_data()?.fill(0);"), (9, "let x = a + b;", "let x = a.checked_add(b).ok_or(Overflow)?;"), (14, "invoke(x)?;\nctx.accounts.vault;", "invoke(x)?;\nctx.accounts.vault.reload()?;\nctx.accounts.vault;"),
    (8, "a", "// TODO: note\na"), (3, "seeds = [a]; bump", "// TODO: note\nseeds = [a]; bump"),
]


@pytest.mark.parametrize("kind, before, after", EDITED)
def test_edits(kind, before, after):
    assert reports.patched(before, [(kind, 1, "note")]) == after


def test_edits_stack():
    """Places of later findings move with the lines that earlier edits add above them, and not with those below."""
    text = "invoke(a)?;\nlet x = a + b;\nclose(c);\nlet y = c - d;"
    got = reports.patched(text, [(7, 3, ""), (4, 1, ""), (9, 4, ""), (9, 2, ""), (9, 99, "")])
    assert got == "require!(target_program.key() == EXPECTED_PROGRAM, InvalidProgram);\ninvoke(a)?;\nlet x = a.checked_add(b).ok_or(Overflow)?;\nclose(c);\naccount.try_borrow_mut_data()?.fill(0);\nlet y = c.checked_sub(d).ok_or(Overflow)?;"


PACKED = """use anchor_lang::prelude::*;
#[program]
pub mod m {
    pub fn go(ctx: Context<Go>) -> Result<()> {
        invoke(&ix, accounts)?;
        let (k, b) = Pubkey::find_program_address(&[b"x", user.key().as_ref()], id);
        Ok(())
    }
}
#[derive(Accounts)]
pub struct Go<'info> {
    #[account(mut, has_one = owner)]
    pub vault: Account<'info, Vault>,
    pub owner: AccountInfo<'info>,
}
"""


def test_packets(spark):
    """Of a parsed source: excerpt with numbers, map of constraints, related lines in order; files that are absent, null, short or long,
    functions that nobody knows, null functions, repeated findings and none."""
    files = spark.createDataFrame([("r", "lib.rs", PACKED), ("r", "null.rs", None), ("r", "long.rs", "y" * 300 + ("\n" + "y" * 300) * 400)], "repo_id string, path string, content string")
    p = candidates.gather(files.where("path = 'lib.rs'"))
    found = spark.createDataFrame(
        [(1, "r", "lib.rs", 5, 5, "go", ["a", "b"]), (2, "r", "null.rs", 5, 5, "go", None), (3, "r", "gone.rs", 5, 5, "who", []), (4, "r", "lib.rs", 500, 501, None, None), (5, "r", "long.rs", 200, 200, "go", None), (6, "q", "lib.rs", 1, 1, "go", None), (6, "q", "lib.rs", 1, 1, "go", None)],
        "k int, repo_id string, path string, line int, end_line int, instruction string, fix array<string>",
    ).withColumn("vuln_class", F.lit("kind"))
    rows = packets.packets(found, p, files).collect()
    got = {r.k: r for r in rows}
    assert len(rows) == 7 and sorted(r.k for r in rows) == [1, 2, 3, 4, 5, 6, 6]
    lines = PACKED.split("\n")
    assert got[1].excerpt == "\n".join(f"{k}|{x}" for k, x in enumerate(lines, 1)) and got[1].fix_pattern == "a\nb"
    assert got[1].constraint_map == "  vault: Account<'info, Vault> [mut, has_one=owner]\n  owner: AccountInfo<'info> [unconstrained]"
    assert got[1].related.split("\n") == ["CPI calls:", "  invoke → ix (validated: false)", "PDA derivations:", "  seeds=[b\"x\", user.key().as_ref()] bump=canonical"]
    assert "invoke(&ix, accounts)" in got[2].excerpt and "|" not in got[2].excerpt.split("\n")[0] and got[2].fix_pattern == "kind"
    assert (got[3].excerpt, got[3].constraint_map, got[3].related, got[3].fix_pattern) == ("[source unavailable]", "", "", "kind")
    assert (got[4].excerpt, got[4].constraint_map, got[4].related) == ("", "", "") and got[6].excerpt == "[source unavailable]"
    assert len(got[5].excerpt) == packets.MOST and got[5].excerpt.startswith("101|yyy")
    assert packets.packets(found.limit(0), p, files).count() == 0


def test_advisories(spark, facts):
    """Of the findings of a source: every finding stands once, grave ones in sections; the empty repository has no document."""
    ranked = rules.audit(facts.files).persist()
    counts = facts.kinds.select("repo_id", "framework", F.lit(1).alias("functions"), F.lit(None).cast("long").alias("structs"), F.lit(0).alias("calls"), F.lit(2).alias("addresses"))
    text = {r.repo_id: r.document for r in reports.advisories(ranked, rules.summary(ranked), counts, graphs.sizes(graphs.all_graphs(facts))).collect()}
    grave = ranked.where("severity in ('CRITICAL', 'HIGH')").count()
    assert set(text) == {"r"} and text["r"].count("\n### ") == grave > 0 and text["r"].count("%") == ranked.count()
    assert "Verdict: DO NOT SHIP" in text["r"] and "Recommendation: Do not ship. " in text["r"] and "- token_flow: " in text["r"] and "1 functions, 0 structs, 0 calls, 2 derived addresses" in text["r"]
    change = reports.change_texts(ranked, reports.patches(ranked, facts.files)).collect()
    assert [r.title for r in change] == [f"fix: {grave} security issue{'s' * (grave != 1)}"] and "- `lib.rs`" in change[0].body
