import math

import pytest
from pyspark.sql import functions as F

from premia.operators import audit, policy, selection

CONTRACT = (
    "contract_id int, underlying string, mark double, expected_return double, long_cost double, short_cost double, "
    "short_margin double, short_allowed boolean, effective_cap double, delta_nav double, vix_vega_nav double, "
    "beta_spy_nav double, stress_scenario_crash double"
)
LOOSE = policy.Limits(per_contract_abs=1.0, underlying_gross=1.0, vix_vega_abs=None, beta_spy_abs=None, stress_loss_abs=None)


@pytest.fixture
def world(table):
    contracts = table(
        [(1, "AAA", 10.0, 0.02, 0.001, 0.002, 0.5, True, 0.5, 1.0, 0.0, 1.0, -0.5),
         (2, "BBB", 20.0, 0.01, 0.001, 0.002, 0.5, False, 0.5, 2.0, 0.0, 2.0, 0.1)],
        CONTRACT,
    )
    scenarios = table([(k, c, 0.0) for k in range(3) for c in (1, 2)], "scenario_id int, contract_id int, ret double")

    def flat(books):
        return books.groupBy("book_id").agg(F.lit(0.01).alias("volatility"))

    def books(rows):
        return table(rows, "book_id int, contract_id int, weight double")

    return contracts, scenarios, flat, books


def test_every_breach_is_measured(world):
    contracts, scenarios, flat, books = world
    limits = policy.Limits(
        gross_nav=0.5, net_nav_abs=0.05, short_nav_abs=0.1, per_contract_abs=1.0, delta_abs=0.2, vix_vega_abs=None,
        beta_spy_abs=0.1, stress_loss_abs=0.05, underlying_gross=0.25,
    )
    rules = policy.Policy(annual_volatility_ceiling=0.02, cvar_loss_nav=0.0005, short_margin_nav=0.1, collateral_nav=0.4)
    row = audit.portfolio_audit(
        books([(7, 1, 0.3), (7, 2, -0.25)]), contracts, scenarios, flat, limits, rules
    ).first()
    cost = 0.3 * 0.001 + 0.25 * 0.002
    want = {
        "breach_gross": 0.05, "breach_net": 0.0, "breach_short": 0.15, "breach_underlying": 0.05, "exposure_delta": 0.0,
        "exposure_beta_spy": 0.1, "breach_stress": 0.175 - 0.05, "breach_margin": 0.025, "breach_collateral": 0.025,
        "breach_assignment": 0.25, "breach_cvar": cost - 0.0005, "breach_caps": 0.0,
        "breach_annual_volatility": 0.01 * math.sqrt(12) - 0.02,
    }
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-12), name
    assert row["max_violation"] == pytest.approx(0.25) and row["feasible"] is False


def test_scenarios_without_cells_still_lose_the_cost(world, table):
    contracts, _, flat, books = world
    rows = audit.book_rows(books([(1, 1, 0.5)]), contracts)
    sparse = table([(1, 1, -0.2), (2, 2, 0.3), (3, 2, 0.1), (4, 2, 0.1)], "scenario_id int, contract_id int, ret double")
    costs = audit.book_sums(rows, LOOSE).select("book_id", "cost")
    got = audit.scenario_cvar(rows, sparse, costs, 0.5).first()["cvar"]
    assert got == pytest.approx((0.1 + 0.0005 + 0.0005) / 2)


def test_truncation_and_cash(world):
    contracts, scenarios, flat, books = world
    given = books([(1, 1, 0.15), (1, 2, 0.25), (2, 1, 0.05), (3, 1, 0.15), (3, 2, -0.25)])
    legs, verdict = audit.integer_or_cash(given, contracts, scenarios, flat, LOOSE, policy.FIRST_POLICY, nav=10_000.0)
    held = {(r["book_id"], r["contract_id"]): (r["contracts"], r["weight"]) for r in legs.collect()}
    assert held[(1, 1)] == (1.0, pytest.approx(0.1)) and held[(1, 2)] == (1.0, pytest.approx(0.2))
    assert held[(2, 1)] == (0.0, 0.0) and held[(3, 2)] == (0.0, 0.0)
    reasons = {r["book_id"]: (r["abstained"], r["reason"]) for r in verdict.collect()}
    assert reasons[1] == (False, "direct_truncation") and reasons[2][0] is False
    assert reasons[3] == (True, "infeasible_direct_book")
    with pytest.raises(ValueError):
        audit.integer_or_cash(given, contracts, scenarios, flat, LOOSE, policy.FIRST_POLICY, nav=0.0)


def test_negative_edge_legs_survive_rounding_but_not_the_second_stage(world):
    contracts, scenarios, flat, books = world
    rules = policy.Policy(annual_volatility_ceiling=0.25, deployment_target=0.4)
    given = books([(1, 1, 0.1), (1, 2, -0.05), (2, 1, 0.4), (3, 2, -0.1), (4, 1, 0.1), (5, 1, 0.05), (5, 2, 0.05)])
    stage1 = given.select("book_id").distinct().select(
        "book_id", (F.col("book_id") != 4).alias("accepted"), F.lit(1.0).alias("risk_aversion")
    )
    verdict, legs = selection.scale_to_target(stage1, given, contracts, scenarios, flat, LOOSE, rules)
    got = {r["book_id"]: r for r in verdict.collect()}
    flags = ["deployment_target_feasible", "deployment_target_applied", "deployment_target_met", "positive_edge_contracts"]
    assert [got[1][f] for f in flags] == [True, True, True, 1]
    assert [got[2][f] for f in flags] == [True, False, True, 1]
    assert [got[3][f] for f in flags] == [False, False, False, 0]
    assert [got[4][f] for f in flags] == [False, False, False, 0]
    # Both legs have edge; the full tilt leans to contract 1 and has the best utility.
    assert [got[5][f] for f in flags] == [True, True, True, 2] and got[5]["tilt"] == 2
    chosen = {r["contract_id"]: r["weight"] for r in legs.where("book_id.book_id = 5 AND book_id.tilt = 2").collect()}
    assert sum(chosen.values()) == pytest.approx(0.4)
    assert chosen[1] / chosen[2] == pytest.approx(0.019 / 0.009)
    tight = policy.Policy(annual_volatility_ceiling=0.001, deployment_target=0.4)
    none, _ = selection.scale_to_target(stage1, given, contracts, scenarios, flat, LOOSE, tight)
    row = none.where("book_id = 1").first()
    assert [row[f] for f in flags] == [False, False, False, 1] and row["tilt"] is None


def test_selection_matches_brute_force(table):
    import random

    rng = random.Random(9)
    rules = policy.Policy(annual_volatility_ceiling=0.25)
    rows = [(b % 4, b, rng.uniform(-0.01, 0.05), rng.uniform(0, 0.01), rng.uniform(0.01, 0.2), rng.random() < 0.6) for b in range(40)]
    rows += [(9, 100, 0.01, 0.0, 0.01, False), (8, 101, 0.01, 0.0, 0.5, True)]
    df = table(rows, "decision_id int, book_id int, mean double, cost double, volatility double, feasible boolean")
    got = {r["decision_id"]: r for r in selection.select_candidate(df, rules).collect()}
    ceiling = 0.25 / math.sqrt(12)
    for d in range(4):
        want = None
        for lam in rules.ladder():
            pool = [r for r in rows if r[0] == d and r[5]]
            best = max(pool, key=lambda r: (r[2] - r[3] - 0.5 * lam * r[4] ** 2, -r[1]))
            if best[4] <= ceiling:
                want = (best[1], lam)
                break
        assert want is None or (got[d]["book_id"], got[d]["risk_aversion"]) == (want[0], pytest.approx(want[1]))
    assert got[9]["status"] == "no_feasible_candidate" and got[8]["status"] == "ceiling_not_reached"


def test_caps_must_cover_exactly(table):
    contracts = table([(1, "AAA"), (2, "VX_FRONT"), (3, "BBB")], "contract_id int, underlying string")
    caps = table([(1, 0.3), (2, 0.04), (4, 0.1)], "contract_id int, cap double")
    got = {r["contract_id"]: r for r in policy.policy_limits(contracts, caps, policy.Limits()).collect()}
    assert got[1]["contract_limit"] == 0.18 and got[2]["contract_limit"] == 0.04
    assert got[2]["underlying_limit"] == 0.20 and got[1]["underlying_limit"] == 0.35
    assert got[3]["problem"] == "missing_cap" and got[4]["problem"] == "unexpected_cap"


FAULTS = {
    "cap_missing": ("effective_cap", None), "cost_missing": ("long_cost", -0.1), "permission_missing": ("short_allowed", None),
    "exposure_missing": ("delta_nav", None), "stress_missing": ("stress_scenario_crash", float("nan")),
}


@pytest.mark.parametrize("problem", FAULTS)
def test_a_missing_input_is_never_feasible(world, problem):
    contracts, scenarios, flat, books = world
    name, value = FAULTS[problem]
    kind = dict(contracts.dtypes)[name]
    faulty = contracts.withColumn(name, F.when(F.col("contract_id") == 1, F.lit(value).cast(kind)).otherwise(F.col(name)))
    limits = policy.Limits(per_contract_abs=1.0, underlying_gross=1.0, vix_vega_abs=None, beta_spy_abs=None, stress_loss_abs=None, delta_abs=9.0)
    rows = audit.portfolio_audit(books([(1, 1, 0.01), (2, 2, 0.01)]), faulty, scenarios, flat, limits, policy.FIRST_POLICY).collect()
    got = {r["book_id"]: (r["problem"], r["feasible"], r["max_violation"]) for r in rows}
    assert got == {1: (problem, False, None), 2: (None, True, 0.0)}


def test_scenarios_and_volatility_must_be_there(world, table):
    contracts, scenarios, flat, books = world
    given = books([(1, 1, 0.01), (2, 2, 0.01), (3, 2, float("nan"))])

    def audited(cells, volatility_of=flat):
        rows = audit.portfolio_audit(given, contracts, audit.scenario_prepare(cells, contracts), volatility_of, LOOSE, policy.FIRST_POLICY)
        return {r["book_id"]: (r["problem"], r["feasible"]) for r in rows.collect()}

    nan = ("weight_not_finite", False)
    shape = "scenario_id int, contract_id int, ret double"
    assert audited(scenarios) == {1: (None, True), 2: (None, True), 3: nan}
    assert audited(scenarios.where("scenario_id = 0")) == {1: ("too_few_scenarios", False), 2: ("too_few_scenarios", False), 3: nan}
    assert audited(scenarios.where("contract_id = 2")) == {1: ("scenario_missing", False), 2: (None, True), 3: nan}
    wild = scenarios.unionByName(table([(5, 1, float("inf")), (6, 2, float("nan"))], shape))
    assert audited(wild) == {1: ("scenario_not_finite", False), 2: (None, True), 3: nan}

    def partly(rows):
        return flat(rows).withColumn("volatility", F.when(F.col("book_id") == 2, F.col("volatility")))

    assert audited(scenarios, partly) == {1: ("volatility_missing", False), 2: (None, True), 3: nan}


def test_shorts_breach_long_only(world):
    contracts, _, _, books = world
    rows = audit.book_rows(books([(1, 1, 0.1), (1, 2, -0.2), (2, 1, 0.1)]), contracts)
    limits = policy.Limits(per_contract_abs=1.0, underlying_gross=1.0, vix_vega_abs=None, beta_spy_abs=None, stress_loss_abs=None, long_only=True)
    got = {r["book_id"]: r["max_violation"] for r in audit.constraint_violation(rows, limits).collect()}
    assert got == {1: pytest.approx(0.2), 2: 0.0}


def test_candidates_are_sized_to_the_budget_before_they_compete(table):
    rows = [(1, 1, 0.02, 0.1, 0.5), (1, 2, 0.06, 0.2, 2.0), (1, 3, 0.9, 0.1, 0.0), (1, 4, 0.9, None, 1.0), (1, 5, 0.06, 0.2, 4.0),
            (2, 6, 0.9, 0.1, float("inf"))]
    df = table(rows, "decision_id int, book_id int, mean double, volatility double, gross double")
    sized = selection.scaled_to_budget(df, 1.0)
    got = {r["book_id"]: (r["mean"], r["volatility"], r["gross"]) for r in sized.collect()}
    assert got[1] == (0.04, 0.2, 1.0) and got[2] == (0.03, 0.1, 1.0) and got[3] == (None, None, None) == got[6]
    picks = [tuple(r) for r in selection.select_max_sharpe(sized, 1.0).collect()]
    assert [(d, b, n) for d, b, _, n in picks] == [(1, 2, 3)]
    # Unscaled, only books at the budget to 1e-5 compete, and none is.
    assert selection.select_max_sharpe(df.where("book_id <> 4"), 1.0).count() == 0


def test_a_leg_without_a_contract_is_a_problem_of_its_book(world):
    contracts, scenarios, flat, books = world
    given = books([(1, 1, 0.01), (1, 99, 0.01), (2, 1, 0.15), (3, 99, 0.0), (4, 98, float("nan"))])
    rows = audit.book_rows(given, contracts)
    assert rows.count() == 5 and rows.where("contract_missing").count() == 3
    lost = ("contract_missing", False, None, None, None, None)
    got = {
        r["book_id"]: (r["problem"], r["feasible"], r["gross"], r["max_violation"], r["cvar"], r["volatility"])
        for r in audit.portfolio_audit(given, contracts, scenarios, flat, LOOSE, policy.FIRST_POLICY).collect()
    }
    assert got[1] == got[3] == got[4] == lost
    assert got[2][:4] == (None, True, 0.15, 0.0) and got[2][5] == 0.01

    terms = {r["book_id"]: (r["mean"], r["cost"], r["gross"]) for r in selection.book_utility_terms(rows).collect()}
    assert terms[1] == (None, None, None) and terms[2] == (0.15 * 0.02, 0.15 * 0.001, 0.15)
    edges = {r["book_id"]: (r["legs"], r["missing_contracts"], r["positive_edge_contracts"]) for r in selection.edge_counts(rows).collect()}
    assert edges == {1: (2, 1, 1), 2: (1, 0, 1), 3: (1, 1, 0), 4: (1, 1, 0)}

    legs, verdict = audit.integer_or_cash(given, contracts, scenarios, flat, LOOSE, policy.FIRST_POLICY, nav=10_000.0)
    reasons = {r["book_id"]: (r["abstained"], r["reason"]) for r in verdict.collect()}
    assert reasons == {2: (False, "direct_truncation"), **{b: (True, "contract_missing") for b in (1, 3, 4)}}
    held = {(r["book_id"], r["contract_id"]): r["contracts"] for r in legs.collect()}
    assert held == {(1, 1): 0.0, (1, 99): 0.0, (2, 1): 1.0, (3, 99): 0.0, (4, 98): 0.0}


def test_a_book_with_a_missing_contract_has_no_second_stage(world):
    contracts, scenarios, flat, books = world
    rules = policy.Policy(annual_volatility_ceiling=0.25, deployment_target=0.4)
    given = books([(1, 1, 0.1), (2, 1, 0.1), (2, 99, 0.01)])
    stage1 = given.select("book_id").distinct().select("book_id", F.lit(True).alias("accepted"), F.lit(1.0).alias("risk_aversion"))
    verdict, _ = selection.scale_to_target(stage1, given, contracts, scenarios, flat, LOOSE, rules)
    got = {r["book_id"]: (r["deployment_target_feasible"], r["deployment_target_applied"]) for r in verdict.collect()}
    assert got == {1: (True, True), 2: (False, False)}


@pytest.mark.parametrize("tile, bucket", [(64, 65_536), (4, 65_536), (3, 5), (1, 1)])
def test_packed_scenarios_match_brute_force(table, tile, bucket):
    import random

    rng = random.Random(tile)
    # Repeated cells, contracts without cells, a book of all contracts and one that shares no cell.
    cells = [(k, c, rng.choice([-0.1, 0.0, rng.uniform(-0.3, 0.3)])) for k in range(41) for c in range(12) if rng.random() < 0.3]
    cells += cells[::9] + [(None, 1, -0.4)]
    legs = [(b, c, rng.uniform(-0.2, 0.3)) for b in range(6) for c in range(15) if b == 0 or rng.random() < 0.4] + [(77, 14, 0.2)]
    cost = {b: rng.uniform(0.0, 0.01) for b, _, _ in legs}
    scenarios = table(cells, "scenario_id int, contract_id int, ret double")
    rows = table(legs, "book_id int, contract_id int, weight double")
    costs = table(list(cost.items()), "book_id int, cost double")

    want = {}
    for b, c, w in legs:
        for k, other, ret in cells:
            if c == other:
                want[b, k] = want.get((b, k), 0.0) + w * ret
    got = audit.scenario_sums(rows, scenarios, tile, bucket).collect()
    assert len(got) == len(want)
    assert {(r["book_id"], r["scenario_id"]): r["scenario_return"] for r in got} == pytest.approx(want)

    names = {k for k, _, _ in cells}
    for alpha in (0.95, 0.5, 0.999):
        plain = {}
        for b in cost:
            losses = sorted((cost[b] - want.get((b, k), 0.0) for k in names), reverse=True)
            m = len(names) * (1.0 - alpha)
            plain[b] = sum(min(1.0, max(0.0, m - i)) * loss for i, loss in enumerate(losses)) / m
        tails = audit.scenario_cvar(rows, scenarios, costs, alpha, tile, bucket).collect()
        assert {r["book_id"]: r["cvar"] for r in tails} == pytest.approx(plain)
    with pytest.raises(ValueError):
        audit.scenario_cvar(rows, scenarios, costs, 1.0)


def test_a_leg_meets_a_row_a_tile_not_a_row_a_scenario(table):
    scenarios = table([(k, c, 0.01 * c) for k in range(128) for c in range(5)], "scenario_id int, contract_id int, ret double")
    axis = audit.scenario_axis(scenarios)
    packed = audit.packed_scenarios(scenarios, axis)
    assert axis.count() == 128 and packed.count() == 5 * 2
    rows = table([(b, c, 0.1) for b in range(3) for c in range(5)], "book_id int, contract_id int, weight double")
    sums = audit.packed_sums(rows, packed).collect()
    assert len(sums) == 3 * 2 and all(v == pytest.approx(0.01) for r in sums for v in r["_sums"])


def test_tail_losses_without_scenarios_or_with_wild_numbers(table):
    shape = "scenario_id int, contract_id int, ret double"
    rows = table([(1, 1, 0.5), (2, 1, float("nan")), (3, 2, 0.1), (4, 2, None)], "book_id int, contract_id int, weight double")
    costs = table([(1, 0.01), (2, 0.01), (3, None), (4, 0.02)], "book_id int, cost double")
    empty = audit.scenario_cvar(rows, table([], shape), costs, 0.5).collect()
    assert {r["book_id"]: r["cvar"] for r in empty} == {1: None, 2: None, 3: None, 4: None}
    cells = table([(1, 1, -0.2), (2, 2, 0.1), (3, 2, None)], shape)
    got = {r["book_id"]: r["cvar"] for r in audit.scenario_cvar(rows, cells, costs, 0.5).collect()}
    # One and a half of three losses: 0.11 and half of 0.01.
    assert got == {1: pytest.approx((0.11 + 0.005) / 1.5), 2: None, 3: None, 4: pytest.approx(0.02)}


def test_a_contract_listed_twice_counts_twice_in_every_sum(world, table):
    """Its legs are two and each has its cells twice, as rows that join: no sum of a book leaves a copy out."""

    contracts, _, flat, books = world
    twice = contracts.unionByName(contracts.where("contract_id = 1"))
    cells = table([(0, 1, -0.1), (1, 1, 0.2), (0, 2, 0.1), (1, 2, -0.3)], "scenario_id int, contract_id int, ret double")
    prepared = audit.scenario_prepare(cells, twice)
    rules = policy.Policy(annual_volatility_ceiling=1.0, cvar_alpha=0.5, cvar_loss_nav=0.01)
    row = audit.portfolio_audit(books([(1, 1, 0.1), (1, 2, 0.05)]), twice, prepared, flat, LOOSE, rules).first()
    cost = 0.001 * (2 * 0.1 + 0.05)
    assert row["gross"] == pytest.approx(0.25) and row["cost"] == pytest.approx(cost)
    assert row["cvar"] == pytest.approx(cost - (4 * 0.1 * -0.1 + 0.05 * 0.1))
    assert row["feasible"] is False


def test_overlapping_part_keys_leave_no_difference_from_sql(spark, tmp_path):
    """integer_or_cash on six copies of the tables, the last part of each numbered as the first of the next: five parts are listed twice."""

    import duckdb

    from premia.plans import catalog

    given, keys = "/root/testdata/sf0.001", {
        "region": {}, "nation": {}, "customer": {"c_custkey": "customer"}, "supplier": {"s_suppkey": "supplier"}, "part": {"p_partkey": "part"},
        "orders": {"o_orderkey": "orders", "o_custkey": "customer"},
        "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
    }
    con = duckdb.connect()

    def shift(owner):
        return con.execute(f"SELECT count(*) FROM '{given}/{owner}.parquet'").fetchone()[0] - (owner == "part")

    for file, columns in keys.items():
        moved = ", ".join(f"{column} + i * {shift(owner)} AS {column}" for column, owner in columns.items())
        rows = f"SELECT t.* REPLACE ({moved}) FROM '{given}/{file}.parquet' t, range(6) r(i)" if columns else f"FROM '{given}/{file}.parquet'"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{file}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {file} AS FROM '{tmp_path}/{file}.parquet'")
    query = catalog()["integer_or_cash"]
    result = con.execute(query.sql)
    columns = [item[0] for item in result.description]
    want = sorted(result.fetchall(), key=repr)
    got = sorted((tuple(row) for row in query.run(spark, str(tmp_path)).select(*columns).collect()), key=repr)
    assert got == want and want


def test_only_accepted_books_below_the_target_have_candidates(world):
    contracts, scenarios, flat, books = world
    rules = policy.Policy(annual_volatility_ceiling=0.25, deployment_target=0.4)
    given = books([(1, 1, 0.1), (2, 1, 0.4), (3, 1, 0.1), (4, 1, 0.1), (4, 99, 0.1)])
    stage1 = given.select("book_id").distinct().select(
        "book_id", (F.col("book_id") != 3).alias("accepted"), F.lit(1.0).alias("risk_aversion")
    )
    verdict, legs = selection.scale_to_target(stage1, given, contracts, scenarios, flat, LOOSE, rules)
    assert {r["b"] for r in legs.select(F.col("book_id.book_id").alias("b")).collect()} == {1}
    applied = {r["book_id"]: r["deployment_target_applied"] for r in verdict.collect()}
    assert applied == {1: True, 2: False, 3: False, 4: False}


def many_books(table, books):
    """Forty books of two or three of twelve contracts: sound ones, some with a short that is not allowed, some with a missing contract."""

    contracts = table(
        [(c, "AAA" if c % 2 else "BBB", 10.0, 0.01 * c, 0.001, 0.002, 0.5, c % 3 != 0, 0.5, 0.1 * c, 0.0, 0.1 * c, -0.01 * c) for c in range(12)],
        CONTRACT,
    )
    scenarios = table(
        [(k, c, math.sin(k * 7 + c * 3) / 4) for k in range(25) for c in range(12) if (k + c) % 4],
        "scenario_id int, contract_id int, ret double",
    )
    given = books(
        [(b, (b * 5 + i * 7) % 12, 0.04 * (i + 1) * (-1 if (b + i) % 3 == 0 else 1)) for b in range(40) for i in range(2 + b % 2)]
        + [(b, 99, 0.01) for b in range(0, 40, 7)]
    )
    return contracts, scenarios, given


def test_rounds_change_no_audit(world, table, monkeypatch):
    """Books audited a few at a time are those audited at once, and only legs of books without a problem meet their cells."""

    _, _, flat, books = world
    contracts, scenarios, given = many_books(table, books)
    run = lambda: audit.portfolio_audit(given, contracts, scenarios, flat, LOOSE, policy.FIRST_POLICY)
    met, tails = [], audit.tail_losses
    monkeypatch.setattr(audit, "tail_losses", lambda rows, *rest: met.append(rows.collect()) or tails(rows, *rest))
    names = ["book_id", "feasible", "problem", "gross", "breach_assignment", "cvar", "volatility", "max_violation"]
    whole = sorted(tuple(row) for row in run().select(*names).collect())
    assert len(whole) == 40 and len(met) == 1
    monkeypatch.setattr(audit, "LEGS_A_ROUND", 30)
    parts = sorted(tuple(row) for row in run().select(*names).collect())
    assert len(met) > 2 and [row[:3] for row in parts] == [row[:3] for row in whole]
    for one, other in zip(parts, whole):
        assert list(one[3:]) == [pytest.approx(value, abs=1e-12) for value in other[3:]] or one[2] == "contract_missing"
    lost = {row[0] for row in whole if row[2] == "contract_missing"}
    assert lost == set(range(0, 40, 7))
    held = [leg["book_id"] for legs in met[1:] for leg in legs]
    assert set(held) == set(range(40)) - lost and len(held) == len(met[0]) == given.where("book_id % 7 <> 0").count()


def test_books_that_another_limit_rules_out_send_no_cells(world, table, monkeypatch):
    _, _, flat, books = world
    contracts, scenarios, given = many_books(table, books)
    rules = policy.Policy(**{**policy.FIRST_POLICY.__dict__, "cvar_loss_nav": 0.02})
    full = {row["book_id"]: row for row in audit.portfolio_audit(given, contracts, scenarios, flat, LOOSE, rules).collect()}
    met, tails = [], audit.tail_losses
    monkeypatch.setattr(audit, "tail_losses", lambda rows, *rest: met.extend(rows.collect()) or tails(rows, *rest))
    got = {row["book_id"]: row for row in audit.feasible_books(given, contracts, scenarios, flat, LOOSE, rules).collect()}
    assert {b: row["feasible"] for b, row in got.items()} == {b: row["feasible"] for b, row in full.items()}
    assert {row["feasible"] for row in got.values()} == {True, False}
    for b, row in got.items():
        want = {name: full[b][name] if row["feasible"] else None for name in ("cost", "gross", "volatility")}
        assert {name: row[name] for name in want} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    others = [name for name in next(iter(full.values())).asDict() if name.startswith("breach_") and name != "breach_cvar"]
    passing = {b for b, row in full.items() if row["problem"] is None and all(row[name] <= policy.FEASIBLE for name in others)}
    assert {leg["book_id"] for leg in met} == passing and any(full[b]["breach_cvar"] > 0 for b in passing)


def test_rounded_books_are_stored_before_the_audit_reads_them(world, monkeypatch):
    contracts, scenarios, flat, books = world
    stored, rounds = [], audit.audit_rounds
    monkeypatch.setattr(audit, "audit_rounds", lambda legs, *rest, **more: stored.append(legs.inputFiles()) or rounds(legs, *rest, **more))
    audit.integer_or_cash(books([(1, 1, 0.15)]), contracts, scenarios, flat, LOOSE, policy.FIRST_POLICY, nav=10_000.0)
    assert stored and all(stored)
