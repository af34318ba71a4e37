"""Transaction replay against a plain state machine on random steps, and the account life cycle case by case."""

import random

import pytest
from pyspark.sql import types as T

from marketlens.operators.accounting import HOLDS, TOKEN, WRAPPED, _states, account_generations, reconcile_lifecycle

TOK = "struct<mint:string,owner:string,program:string,amount:long>"
ACCOUNTS = f"tx long, account string, pre long, post long, fee long, token_pre {TOK}, token_post {TOK}, signer boolean, writable boolean"
EFFECTS = "tx long, seq long, kind string, source string, target string, amount long, mint string, owner string, program string, parent long, space int"


def step(kind, source=None, target=None, amount=None, mint=None, owner=None, program=TOKEN, parent=None, space=None):
    return [kind, source, target, amount, mint, owner, program, parent, space]


class Stop(Exception):
    pass


def plain(accounts, effects):
    """Replays one transaction with dictionaries; (blockers, native residuals, token residuals)."""
    said = set()
    names = {a["account"]: a for a in accounts}
    native = {}
    tokens, closed, made, vault_closed, fund, reserve = {}, set(), {}, set(), {}, {}

    def need(ok, why):
        if not ok:
            raise Stop(why)

    def move(a, b, n):
        need(a in names and b in names, "account_outside_message")
        need(native[a] >= n, "native_underflow")
        native[a] -= n
        native[b] += n

    try:
        for a in accounts:
            need(a["pre"] >= a["fee"], "fee_exceeds_balance")
            native[a["account"]] = a["pre"] - a["fee"]
            if a["token_pre"]:
                tokens[a["account"]] = dict(a["token_pre"])
        by = {i: e for i, e in enumerate(effects)}
        for kind, src, dst, n, mint, owner, program, parent, space in effects:
            for x in (src, dst):
                need(x is None or kind in ("ata_create",) or kind[:6] in ("token:", "system", "set_au") or x in names, "account_outside_message")
            if kind == "transfer":
                move(src, dst, n)
            elif kind == "create":
                if dst in closed:
                    need(native[dst] == 0 and owner == tokens[dst]["program"], "recreated_token_account_unverified")
                    closed.discard(dst)
                    tokens.pop(dst)
                    made.pop(dst, None)
                empty = native[dst] == 0 and names[dst]["pre"] == 0
                move(src, dst, n)
                fund.pop(dst, None)
                reserve.pop(dst, None)
                p = by.get(parent)
                if p and p[0] == "ata_create" and (p[2], p[1], p[4], p[6]) == (dst, src, WRAPPED, TOKEN) and owner == TOKEN and space == 165 and empty and n > 1:
                    fund[dst] = (n, parent, p[5])
                need(dst not in made and dst not in vault_closed, "native_account_reinitialization")
                made[dst] = owner
            elif kind == "init":
                need(dst not in tokens and dst not in closed, "account_reinitialization")
                tokens[dst] = {"mint": mint, "owner": owner, "program": program, "amount": 0}
                if mint == WRAPPED:
                    said.add("new_wsol_reserve_unverified")
                    if dst in fund and fund[dst][1] == parent and fund[dst][2] == owner and native[dst] == fund[dst][0]:
                        reserve[dst] = fund[dst][0]
                        said.add("ata_rent_and_historical_program_semantics_unverified")
            elif kind == "sync":
                t = tokens.get(dst)
                need(t and dst not in closed and t["mint"] == WRAPPED, "sync_native_identity_unverified")
                need(dst in reserve, "sync_native_historical_reserve_missing")
                need(native[dst] - reserve[dst] >= t["amount"], "sync_native_decrease_unsupported")
                t["amount"] = native[dst] - reserve[dst]
            elif kind == "token_transfer":
                need(src in tokens and dst in tokens and src not in closed and dst not in closed, "missing_transfer_account_state")
                a, b = tokens[src], tokens[dst]
                need(a["mint"] == b["mint"], "transfer_identity_mismatch")
                need(mint is None or mint == a["mint"], "checked_mint_mismatch")
                need(a["amount"] >= n, "token_underflow")
                a["amount"] -= n
                b["amount"] += n
                if a["mint"] == WRAPPED:
                    move(src, dst, n)
            elif kind in ("mint", "burn"):
                need(dst in tokens and dst not in closed, "mint_burn_account_missing")
                need(tokens[dst]["mint"] == mint != WRAPPED, "mint_burn_identity_mismatch")
                new = tokens[dst]["amount"] + (n if kind == "mint" else -n)
                need(new >= 0, "mint_burn_amount_bounds")
                tokens[dst]["amount"] = new
                said.add("mint_burn_authority_and_supply_unverified")
            elif kind == "close":
                need(src in tokens and src not in closed, "missing_close_state")
                need(tokens[src]["mint"] == WRAPPED or tokens[src]["amount"] == 0, "nonempty_close")
                move(src, dst, native[src])
                tokens[src]["amount"] = 0
                closed.add(src)
            elif kind == "program_close":
                need(src != dst, "pump_close_roles")
                need(names[dst]["signer"] and names[dst]["writable"] and names[src]["writable"], "pump_close_permissions")
                need(src not in vault_closed and made.get(src) == program, "pump_close_creation_unverified")
                need(names[src]["pre"] == 0 and names[src]["post"] == 0, "pump_close_endpoints")
                move(src, dst, native[src])
                vault_closed.add(src)
                said.add("pump_close_pda_and_deployed_version_unverified")
            elif kind.startswith("token:"):
                said.add("unsupported_token_effect:" + kind[6:])
    except Stop as why:
        return sorted(said | {str(why)}), [], []
    token_left = []
    for a in sorted(names):
        t, post = tokens.get(a), names[a]["token_post"]
        if t is None and post is None:
            continue
        if t is None or (post is None and a not in closed):
            said.add("missing_endpoint_account_state")
        elif post is not None and (a in closed or any(t[k] != post[k] for k in ("mint", "owner", "program"))):
            said.add("endpoint_identity_changed")
        elif post is not None and post["amount"] != t["amount"]:
            token_left.append((a, post["amount"] - t["amount"]))
    native_left = [(a, names[a]["post"] - native[a]) for a in sorted(names) if names[a]["post"] != native[a]]
    said |= {HOLDS[0]} | ({"token_balance_residual"} if token_left else set()) | ({"native_balance_residual"} if native_left else set())
    return sorted(said), native_left, token_left


def account(name, pre=100, post=100, fee=0, token=None, token_post=None, signer=False, writable=True):
    one = lambda t: None if t is None else dict(zip(("mint", "owner", "program", "amount"), t))
    return {"account": name, "pre": pre, "post": post, "fee": fee, "token_pre": one(token), "token_post": one(token_post), "signer": signer, "writable": writable}


def frames(spark, cases):
    schema = T._parse_datatype_string(ACCOUNTS)
    a = spark.createDataFrame([{"tx": i, **x} for i, (accounts, _) in enumerate(cases) for x in accounts], schema)
    e = spark.createDataFrame([(i, s, *x) for i, (_, effects) in enumerate(cases) for s, x in enumerate(effects)], EFFECTS)
    return a, e


def run(spark, cases):
    rows = {r["tx"]: r for r in reconcile_lifecycle(*frames(spark, cases)).collect()}
    return [(rows[i]["blockers"], [(x["account"], int(x["residual"])) for x in rows[i]["native_residuals"]], [(x["account"], int(x["residual"])) for x in rows[i]["token_residuals"]], rows[i]["status"]) for i in range(len(cases))]


def agree(spark, cases):
    for case, got in zip(cases, run(spark, cases)):
        want = plain(*case)
        assert got[:3] == want, (case, got, want)
        assert got[3] == ("UNKNOWN" if set(want[0]) - set(HOLDS) else "ENDPOINT_AMOUNTS_MATCH")


def test_replay_against_state_machine(spark):
    rng = random.Random(11)
    names, mints, cases = ["p", "t", "x", "y", "s"], ["M", "M", WRAPPED], []
    for _ in range(400):
        accounts = [account("p", rng.choice([3, 60, 200]), 150, 5, signer=True), account("t", 10, 10, 0, ("M", "p", TOKEN, 50), ("M", "p", TOKEN, rng.choice([50, 45]))), account("x", rng.choice([0, 0, 4]), 0),
                    account("y", 0, rng.choice([0, 20])), account("s", 10, rng.choice([10, 30]), 0, ("M", "q", TOKEN, 0), ("M", "q", TOKEN, rng.choice([0, 5])))]
        effects = []
        for _ in range(rng.randint(1, 9)):
            a, b, n, m = rng.choice(names), rng.choice([*names, "x", "y"]), rng.randint(0, 25), rng.choice(mints)
            at = len(effects)
            if rng.random() < .55:  # whole lives make long valid lines
                z = rng.choice("xy")
                effects += rng.choice([
                    [step("create", "p", z, n + 2, owner=TOKEN), step("init", target=z, mint="M", owner="p"), step("token_transfer", "t", z, 5, "M"), step("token_transfer", z, "s", 5), step("close", z, rng.choice("pys"))],
                    [step("ata_create", "p", z, mint=WRAPPED, owner="p"), step("create", "p", z, n + 2, owner=TOKEN, parent=at, space=165), step("init", target=z, mint=WRAPPED, owner="p", parent=at),
                     step("transfer", "p", z, 3), step("sync", target=z), step("close", z, rng.choice("px"))],
                    [step("create", "p", z, n, owner="V", program="V"), step("program_close", z, "p", program="V")], [step("mint", target="t", amount=7, mint="M"), step("burn", target="t", amount=7, mint="M")]])
            else:
                effects.append(rng.choice([step("transfer", a, b, n), step("token_transfer", a, b, n, rng.choice([None, "M"])), step("close", b, a), step("init", target=b, mint=m, owner="p"),
                                           step("create", "p", b, n, owner=TOKEN), step("burn", target=b, amount=n, mint=m), step("sync", target=b), step("token:freeze", target=b), step("transfer", "p", "out", 1)]))
        cases.append((accounts, effects))
    agree(spark, cases)
    assert len({tuple(plain(*c)[0]) for c in cases}) > 15


def test_cases(spark):
    a = lambda **k: [account("p", 100, 100, **k), account("x", 0, 0), account("t", token=("M", "p", TOKEN, 100), token_post=("M", "p", TOKEN, 100))]
    life = [step("create", "p", "x", 20, owner=TOKEN), step("init", target="x", mint="M", owner="p"), step("close", "x", "p")]
    got = run(spark, [(a(), life + life), (a(), life[:2] + life), (a(), life + [step("create", "p", "x", 20, owner="other")]), (a(fee=101), []), (a(), [step("burn", target="t", amount=101, mint="M")]),
                      (a(), [step("mint", target="t", amount=7, mint="M"), step("burn", target="t", amount=7, mint="M")]), (a(), [step("burn", target="t", amount=1, mint=WRAPPED)]),
                      (a(), [step("mint", target="t", amount=7, mint="M")]), (a(fee=1), []), (a(), [step("system:allocate", target="x")])])
    assert [g[3] for g in got] == ["ENDPOINT_AMOUNTS_MATCH", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "ENDPOINT_AMOUNTS_MATCH", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert "native_account_reinitialization" in got[1][0] and "recreated_token_account_unverified" in got[2][0] and got[3][0] == ["fee_exceeds_balance"]
    assert "mint_burn_amount_bounds" in got[4][0] and "mint_burn_authority_and_supply_unverified" in got[5][0] and "mint_burn_identity_mismatch" in got[6][0]
    assert got[7][2] == [("t", -7)] and got[8][1] == [("p", 1)] and "unsupported_system_effect:allocate" in got[9][0]


@pytest.mark.parametrize("depth", [1, 30])
def test_refunds_flow_on(spark, depth):
    """Each close pays into the next account, which then closes: the last gets everything."""
    names = [f"a{i:02}" for i in range(depth + 1)]
    accounts = [account("p", 0, depth * (depth + 1) // 2, writable=True)] + [account(n, i, 0, 0, ("M", "p", TOKEN, 0)) for i, n in enumerate(names)]
    effects = [step("close", x, y) for x, y in zip(names, [*names[1:], "p"])]
    a, e = frames(spark, [(accounts, effects)])
    assert reconcile_lifecycle(a, e).first()["status"] == "ENDPOINT_AMOUNTS_MATCH"
    lives = {r["account"]: r for r in account_generations(a, e).collect()}
    assert int(lives[names[-1]]["refund"]) == depth * (depth + 1) // 2 and lives[names[-1]]["shut"] == depth and lives[names[-1]]["opened"] == -1


def test_legs_are_made_once(spark):
    """Refunds and states come from one pass over the legs: before, they were made and sorted once for the closes and once for the rest, and joined."""
    token = "struct<mint:string,owner:string,program:string,amount:long>"
    a = spark.createDataFrame([("a", "p", 100, 95, 5, None, None, True, True)], f"tx string, account string, pre long, post long, fee long, token_pre {token}, token_post {token}, signer boolean, writable boolean")
    e = spark.createDataFrame([("a", 0, "transfer", "p", "p", 1, None, None, None, None, None)], "tx string, seq long, kind string, source string, target string, amount long, mint string, owner string, program string, parent long, space int")
    plan = _states(a, e, "tx")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
