import pytest
from pyspark.sql import functions as F

from premia.functions.pricing import pricing_reject, with_black_scholes
from premia.operators import chain

SCHEMA = "id int, spot double, strike double, maturity double, rate double, volatility double, kind string, dividend_yield double"
GOOD = (100.0, 100.0, 1.0, 0.05, 0.20)


def test_textbook_prices_parity_and_expiry(table):
    df = table(
        [(1, *GOOD, "call", 0.0), (2, *GOOD, "put", 0.0), (3, 110.0, 100.0, 0.0, 0.05, 0.0, "call", 0.0),
         (4, 110.0, 100.0, 0.0, 0.05, 0.2, "put", 0.0)],
        SCHEMA,
    )
    got = {r["id"]: r for r in with_black_scholes(df).collect()}
    assert got[1]["price"] == pytest.approx(10.4506, abs=5e-5)
    assert got[1]["price"] - got[2]["price"] == pytest.approx(100 - 100 * 2.718281828459045**-0.05)
    assert got[1]["delta"] - got[2]["delta"] == pytest.approx(1.0)
    assert got[3]["price"] == 10.0 and got[3]["delta"] == 1.0 and got[3]["gamma"] == 0.0
    assert got[4]["price"] == 0.0 and got[4]["delta"] == 0.0


def test_greeks_match_finite_differences(table):
    h = 1e-4
    base = (100.0, 95.0, 0.7, 0.03, 0.25)

    def row(i, ds=0.0, dv=0.0, dt=0.0, kind="put"):
        return (i, base[0] + ds, base[1], base[2] + dt, base[3], base[4] + dv, kind, 0.01)

    df = table([row(0), row(1, ds=h), row(2, ds=-h), row(3, dv=h), row(4, dv=-h), row(5, dt=h), row(6, dt=-h)], SCHEMA)
    p = {r["id"]: r for r in with_black_scholes(df).collect()}
    assert p[0]["delta"] == pytest.approx((p[1]["price"] - p[2]["price"]) / (2 * h), abs=1e-6)
    assert p[0]["gamma"] == pytest.approx((p[1]["delta"] - p[2]["delta"]) / (2 * h), abs=1e-6)
    assert p[0]["vega"] == pytest.approx((p[3]["price"] - p[4]["price"]) / (2 * h), abs=1e-4)
    assert p[0]["theta"] == pytest.approx(-(p[5]["price"] - p[6]["price"]) / (2 * h), abs=1e-4)


def test_rows_outside_the_domain_are_named(table):
    bad = [
        (1, float("nan"), 100.0, 1.0, 0.0, 0.2, "call", 0.0), (2, 0.0, 100.0, 1.0, 0.0, 0.2, "call", 0.0),
        (3, 100.0, -1.0, 1.0, 0.0, 0.2, "call", 0.0), (4, 100.0, 100.0, -1.0, 0.0, 0.2, "call", 0.0),
        (5, 100.0, 100.0, 1.0, 0.0, 0.2, "swap", 0.0), (6, 100.0, 100.0, 1.0, 0.0, 0.0, "put", 0.0),
    ]
    df = with_black_scholes(table(bad, SCHEMA)).withColumn("reason", pricing_reject())
    rows = df.orderBy("id").collect()
    assert [r["reason"] for r in rows] == [
        "not_finite", "spot_not_positive", "strike_not_positive", "maturity_negative", "kind_unknown",
        "volatility_not_positive",
    ]
    assert all(r["price"] is None for r in rows)


def test_two_gamma_scales_and_vix_names(table):
    df = table(
        [(1, "vix", None, 2.0, 50.0, 0.5, 0.02, 3.0, 0.0), (2, "AAA", "equity_option", 2.0, 50.0, 0.5, 0.02, 3.0, 0.0)],
        "contract_id int, underlying string, asset_class string, mark double, spot double, delta double, gamma double, vega double, theta double",
    )
    risk = {r["contract_id"]: r for r in chain.with_risk_exposures(df).collect()}
    load = {(r["contract_id"], r["factor"]): r["loading"] for r in chain.greek_loadings(df).collect()}
    assert risk[1]["gamma_nav"] == pytest.approx(2 * load[(1, "r2_vix")])
    assert risk[1]["vix_vega_nav"] == 1.5 and risk[2]["vix_vega_nav"] == 0.0
    assert len(load) == 6


def test_neighbours_cross_block_borders(table):
    import datetime as dt

    days = [dt.date(2020, 12, 1), dt.date(2020, 12, 31), dt.date(2023, 5, 1)]
    marks = table([(1, d, float(i + 1)) for i, d in enumerate(days)], "contract_id int, period date, mark double")
    got = chain.neighbour(marks, ["contract_id"], "period", ["mark"], ahead=True).orderBy("period").collect()
    assert [r["next_mark"] for r in got] == [2.0, 3.0, None]
    back = chain.neighbour(marks, ["contract_id"], "period", ["mark"], ahead=False).orderBy("period").collect()
    assert [r["prev_mark"] for r in back] == [None, 1.0, 2.0]
    settled = table([(1, days[1], 9.0)], "contract_id int, period date, settlement double")
    rets = {r["period"]: r["ret"] for r in chain.option_returns(marks, settled).collect()}
    assert rets[days[0]] == pytest.approx(1.0) and rets[days[1]] == pytest.approx(3.5)


def test_contract_check_names_duplicates(table):
    df = table(
        [(1, "A", 1.0, 1.0, 0.1, 0.1, 0.1, 0.1), (1, "A", 1.0, 1.0, 0.1, 0.1, 0.1, 0.1), (2, "A", 0.0, 1.0, 0.1, 0.1, 0.1, 0.1),
         (3, "A", 1.0, 1.0, float("nan"), 0.1, 0.1, 0.1), (4, "A", 1.0, 1.0, 0.1, 0.1, 0.1, 0.1)],
        "contract_id int, underlying string, mark double, spot double, delta double, gamma double, vega double, theta double",
    )
    got = {r["contract_id"]: r["reason"] for r in chain.contract_check(df).collect()}
    assert got == {1: "duplicate_id", 2: "mark_not_positive", 3: "greeks_not_finite", 4: None}


def test_eligibility_is_a_column_and_missing_values_pass_no_rule(table):
    rows = table(
        [(1, 1.0, 0.5), (2, 0.4, 0.5), (3, None, 0.5), (4, 1.0, 0.0)], "contract_id int, mark double, maturity double"
    )
    flags = rows.withColumn("eligible", chain.is_eligible(chain.Eligibility()))
    assert {r["contract_id"]: r["eligible"] for r in flags.collect()} == {1: True, 2: False, 3: False, 4: False}
    assert [r["contract_id"] for r in chain.eligible(rows, chain.Eligibility()).collect()] == [1]
    anything = chain.Eligibility(min_mark=None, min_maturity=None)
    assert rows.where(chain.is_eligible(anything)).count() == 4


def test_a_contract_without_a_mark_has_no_mean_and_no_weight(table):
    contracts = table(
        [(1, 2.0, 10.0, 0.5, 0.1, 0.2, -0.3), (2, None, 10.0, 0.5, 0.1, 0.2, -0.3)],
        "contract_id int, mark double, spot double, delta double, gamma double, vega double, theta double",
    )
    for name in ("lambda_spot", "lambda_var", "lambda_vol", "lambda_skew", "lambda_rv"):
        contracts = contracts.withColumn(name, F.lit(0.01))
    means = {r["contract_id"]: r["expected_return"] for r in chain.structural_mean(contracts).collect()}
    assert means[1] is not None and means[2] is None
    arms = chain.channel_ablation(contracts).where("contract_id = 2").collect()
    assert len(arms) == len(chain.CHANNELS) and all(r["expected_return"] is None for r in arms)
    positions = table([(1, 1, 3), (1, 2, 3), (1, 9, 3)], "book_id int, contract_id int, contracts int")
    weights = {r["contract_id"]: r["weight"] for r in chain.premium_weights(positions, contracts, nav=1000.0).collect()}
    assert weights == {1: 0.6, 2: None, 9: None}
