import datetime as dt
import random

import pytest

from premia.operators import quotes as ops

BASE = dt.datetime(2024, 1, 5, 22, 0)
SCHEMA = "symbol int, trade_ts timestamp, trade_id int"
QUOTES = "symbol int, quote_ts timestamp, quote_id int, bid double, ask double"


@pytest.mark.parametrize("forward", [False, True])
def test_asof_matches_brute_force(table, forward):
    rng = random.Random(2)
    hours = lambda: BASE + dt.timedelta(hours=rng.randint(0, 200))
    trades = [(rng.choice([1, 1, 1, 2, 3]), hours(), i) for i in range(120)]
    quotes = [(rng.choice([1, 1, 2]), hours(), i, 1.0, 2.0) for i in range(90)]
    got = ops.asof_join(
        table(trades, SCHEMA), table(quotes, QUOTES), ["symbol"], "trade_ts", "quote_ts", ["quote_id"], "quote_id",
        forward=forward,
    ).collect()
    assert len(got) == len(trades)
    for r in got:
        pool = [q for q in quotes if q[0] == r["symbol"]]
        if forward:
            pool = [(q[1], q[2]) for q in pool if q[1] >= r["trade_ts"]]
            want = min(pool, default=None)
        else:
            pool = [(q[1], q[2]) for q in pool if q[1] <= r["trade_ts"]]
            want = max(pool, default=None)
        assert r["quote_id"] == (want and want[1]) or (want is not None and r["quote_id"] == want[1])


def test_next_session_skips_the_weekend_and_needs_every_leg(table):
    legs = table([(dt.date(2024, 1, 5), 1), (dt.date(2024, 1, 5), 2)], "trigger_day date, symbol int")
    monday = dt.datetime(2024, 1, 8, 9, 30)
    quotes = table(
        [(1, dt.datetime(2024, 1, 6, 12, 0), 1, 1.0, 2.0), (1, monday, 2, 1.0, 2.0),
         (2, monday + dt.timedelta(hours=8), 3, 1.0, 2.0)],
        QUOTES,
    )
    rows = ops.next_executable_quotes(legs, quotes)
    got = {r["symbol"]: (r["quote_id"], r["covered"]) for r in rows.collect()}
    assert got == {1: (2, True), 2: (None, False)}
    score = ops.trigger_scores(rows).first()
    assert score["legs"] == 2 and score["covered_legs"] == 1 and score["scored"] is False


def test_cost_scenarios_and_their_domain(table):
    schema = (
        "id int, gross_return double, modeled_cost double, midpoint_cost double, touch_cost double, worst_cost double, "
        "entry_coverage double, roundtrip_coverage double, evidence_label string"
    )
    good = (1, 0.10, 0.01, 0.02, 0.03, 0.04, 0.941, 0.255, "observed-quote sensitivity")
    rows = [good, (2, *good[1:2], -0.01, *good[3:]), (3, float("nan"), *good[2:]), (4, *good[1:6], 0.5, None, "x"),
            (5, *good[1:6], 1.5, 0.2, "x"), (6, *good[1:8], "Realized fills"), (7, *good[1:6], None, None, "x")]
    df = table(rows, schema)
    got = {r["id"]: r["reason"] for r in df.select("id", ops.cost_scenario_reject().alias("reason")).collect()}
    assert got == {1: None, 2: "negative_cost", 3: "return_not_finite", 4: "coverage_incomplete", 5: "coverage_outside",
                   6: "label_claims_fills", 7: None}
    rets = {r["scenario"]: r["scenario_return"] for r in ops.cost_scenarios(df.where("id = 1"), ["id"]).collect()}
    assert rets == pytest.approx({"modeled": 0.09, "midpoint": 0.08, "touch_price": 0.07, "worst_case": 0.06})


def test_missing_quotes_keep_the_model(table):
    legs = table(
        [(1, 0.5, 0.1, 0.02, 0.001, 0.04, 0.06, 0.08), (1, -0.5, 0.0, 0.02, 0.001, None, None, None)],
        "book int, weight double, ret double, modeled_spread double, other_cost double, entry_spread double, exit_spread double, worst_spread double",
    )
    row = ops.quote_scenario_costs(legs, ["book"]).first()
    assert row["modeled_cost"] == pytest.approx(0.021) and row["midpoint_cost"] == pytest.approx(0.001)
    assert row["touch_cost"] == pytest.approx(0.5 * 0.05 + 0.5 * 0.02 + 0.001)
    assert row["worst_cost"] == pytest.approx(0.5 * 0.07 + 0.5 * 0.02 + 0.001)
    assert row["missing_quotes"] == 1
