"""Queries on contract chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions.pricing import pricing_reject, with_black_scholes
from premia.operators import chain as ops
from premia.plans.inputs import load, view
from premia.plans.oracles import cdf
from premia.plans.registry import VIEWS, oracle, query


def black_scholes_sql(source: str) -> str:
    """Oracle text: price and Greeks of a chain relation."""

    return f"""
SELECT q.*, CASE WHEN maturity > 0 THEN exp(-dividend_yield * maturity) * phi / (spot * sd) ELSE 0.0e0 END AS gamma,
  CASE WHEN maturity > 0 THEN s * phi * sqrt(maturity) ELSE 0.0e0 END AS vega,
  CASE WHEN maturity > 0 THEN CASE WHEN kind = 'call'
    THEN -s * phi * volatility / (2 * sqrt(maturity)) - rate * k * n2 + dividend_yield * s * n1
    ELSE -s * phi * volatility / (2 * sqrt(maturity)) + rate * k * (1 - n2) - dividend_yield * s * (1 - n1) END
    ELSE 0.0e0 END AS theta,
  CASE WHEN maturity > 0 THEN CASE WHEN kind = 'call' THEN exp(-dividend_yield * maturity) * n1
    ELSE -exp(-dividend_yield * maturity) * (1 - n1) END
    WHEN kind = 'call' AND spot > strike THEN 1.0e0 WHEN kind = 'put' AND spot < strike THEN -1.0e0 ELSE 0.0e0 END AS delta,
  CASE WHEN maturity > 0 THEN CASE WHEN kind = 'call' THEN s * n1 - k * n2 ELSE k * (1 - n2) - s * (1 - n1) END
    WHEN kind = 'call' THEN greatest(spot - strike, 0.0e0) ELSE greatest(strike - spot, 0.0e0) END AS price
FROM (SELECT d.*, {cdf('d1')} AS n1, {cdf('(d1 - sd)')} AS n2, exp(-0.5e0 * d1 * d1) / sqrt(2 * pi()) AS phi,
        spot * exp(-dividend_yield * maturity) AS s, strike * exp(-rate * maturity) AS k
      FROM (SELECT c.*, CASE WHEN maturity > 0 THEN volatility * sqrt(maturity) END AS sd,
              CASE WHEN maturity > 0 THEN (ln(spot / strike) + (rate - dividend_yield
                + 0.5e0 * volatility * volatility) * maturity) / (volatility * sqrt(maturity)) END AS d1
            FROM {source} c) d) q"""


VIEWS.add("priced", black_scholes_sql("fx_chain"), "fx_chain")
VIEWS.add(
    "universe",
    """SELECT *, delta * spot / mark AS delta_nav, gamma * spot * spot / mark AS gamma_nav, vega / mark AS vega_nav,
              CASE WHEN asset_class = 'vix_option' THEN vega / mark ELSE 0.0e0 END AS vix_vega_nav,
              delta * spot / mark * underlying_beta_spy AS beta_spy_nav,
              coalesce(mark >= 0.5 AND maturity >= 0.02, false) AS eligible
       FROM (SELECT *, CASE WHEN price >= 0.01 THEN price END AS mark FROM priced) m""",
    "priced",
)
VIEWS.add("traded", "SELECT * FROM universe WHERE eligible", "universe")
#: A contract worth less than a cent has no mark, and nothing that is measured per unit of mark.
CENT = 0.01


def universe(t):
    """The whole chain, priced, with NAV exposures and whether a contract may be bought or sold (``eligible``)."""

    priced = with_black_scholes(load(t, "fx_chain"), "mark")
    marked = priced.withColumn("mark", F.when(F.col("mark") >= CENT, F.col("mark")))
    return ops.with_risk_exposures(marked).withColumn("eligible", ops.is_eligible(ops.Eligibility()))


@query("bs_price", oracle("priced", "SELECT * FROM priced", "contract_id kind", "price"))
def bs_price(t):
    table = with_black_scholes(load(t, "fx_chain"), greeks=False)
    return table.select("contract_id", "kind", "price")


@query("bs_greeks", oracle("priced", "SELECT * FROM priced", "contract_id kind", "delta gamma vega theta"))
def bs_greeks(t):
    return with_black_scholes(load(t, "fx_chain")).select(
        "contract_id", "kind", "delta", "gamma", "vega", "theta"
    )


SHOCKS = {
    "crash": (0.80, 0.10, 0.0),
    "dip": (0.95, 0.03, 0.0),
    "rally": (1.08, -0.02, 0.0),
    "vol_up": (1.0, 0.15, 0.0),
}
VIEWS.add(
    "shocked_chain",
    """SELECT c.* REPLACE (c.spot * h.factor AS spot, c.volatility + h.shift AS volatility), h.shock, c.price AS mark0
       FROM (SELECT contract_id, kind, spot, strike, maturity, rate, dividend_yield, volatility, price FROM priced) c,
            (VALUES """
    + ", ".join(f"('{n}', {f}::DOUBLE, {s}::DOUBLE)" for n, (f, s, _) in SHOCKS.items())
    + ") h(shock, factor, shift)",
    "priced",
)
VIEWS.add("shocked_base", black_scholes_sql("(SELECT * EXCLUDE (price) FROM shocked_chain)"), "shocked_chain")
VIEWS.add(
    "shocked",
    """SELECT contract_id, shock, price AS shocked_mark, mark0 AS mark,
              CASE WHEN mark0 > 0 THEN price / mark0 - 1.0e0 END AS ret FROM shocked_base""",
    "shocked_base",
)


@query(
    "reprice_chain",
    oracle("shocked", "SELECT contract_id, shock, shocked_mark, CASE WHEN mark >= 0.01 THEN ret END AS ret FROM shocked",
           "contract_id shock", "shocked_mark ret"),
)
def reprice_chain(t):
    table = ops.repriced(load(t, "fx_chain"), SHOCKS)
    # Below a cent the return of a mark is rounding noise; the contract is priced all the same.
    told = F.when(F.col("mark") >= 0.01, F.col("ret")).alias("ret")
    return table.select("contract_id", "shock", "shocked_mark", told)


view(
    "fx_dirty_chain",
    """
SELECT contract_id, CASE WHEN contract_id % 29 = 0 THEN 'swap' ELSE kind END AS kind,
       CASE WHEN contract_id % 31 = 0 THEN NULL ELSE spot END AS spot,
       CASE WHEN contract_id % 37 = 0 THEN -strike ELSE strike END AS strike,
       CASE WHEN contract_id % 41 = 0 THEN -maturity - 0.01e0 ELSE maturity END AS maturity,
       rate, CASE WHEN contract_id % 43 = 0 THEN 0.0e0 WHEN maturity = 0 OR contract_id % 47 = 0 THEN -volatility
                  ELSE volatility END AS volatility, dividend_yield
FROM {fx_chain}
""",
    "fx_chain",
)


@query(
    "pricing_domain_check",
    oracle(
        "fx_dirty_chain",
        """SELECT contract_id, CASE WHEN spot IS NULL THEN 'not_finite' WHEN spot <= 0 THEN 'spot_not_positive'
             WHEN strike <= 0 THEN 'strike_not_positive' WHEN maturity < 0 THEN 'maturity_negative'
             WHEN kind NOT IN ('call', 'put') THEN 'kind_unknown'
             WHEN volatility < 0 THEN 'volatility_negative'
             WHEN maturity > 0 AND volatility = 0 THEN 'volatility_not_positive' END AS reason FROM fx_dirty_chain""",
        "contract_id reason",
    ),
)
def pricing_domain_check(t):
    return load(t, "fx_dirty_chain").select("contract_id", pricing_reject().alias("reason"))


@query(
    "contract_check",
    oracle(
        "priced",
        """SELECT contract_id, count(*) AS copies,
                  CASE WHEN count(*) > 1 THEN 'duplicate_id' WHEN max(mark) IS NULL OR min(mark) <= 0 THEN 'mark_not_positive' END AS reason,
                  NOT (count(*) > 1 OR max(mark) IS NULL OR min(mark) <= 0) AS valid
           FROM (SELECT contract_id, CASE WHEN price >= 1e-6 THEN price END AS mark FROM priced
                 UNION ALL SELECT contract_id, price FROM priced WHERE contract_id % 50 = 0) s GROUP BY 1""",
        "contract_id reason valid", "", "copies",
    ),
)
def contract_check(t):
    priced = with_black_scholes(load(t, "fx_chain"), "mark")
    shown = priced.withColumn("mark", F.when(F.col("mark") >= 1e-6, F.col("mark")))
    return ops.contract_check(shown.unionByName(priced.where("contract_id % 50 = 0")))


@query(
    "greek_loadings",
    oracle(
        "universe",
        """SELECT contract_id, 'r_' || underlying AS factor, delta * spot / mark AS loading FROM universe
           UNION ALL SELECT contract_id, 'r2_' || underlying, 0.5e0 * gamma * spot * spot / mark FROM universe
           UNION ALL SELECT contract_id, 'dv_' || underlying, vega / mark FROM universe""",
        "contract_id factor", "loading",
    ),
)
def greek_loadings(t):
    return ops.greek_loadings(universe(t))


EXPOSURES = "delta_nav gamma_nav vega_nav vix_vega_nav beta_spy_nav"


@query("risk_exposures", oracle("universe", "SELECT * FROM universe", "contract_id underlying eligible", EXPOSURES))
def risk_exposures(t):
    return universe(t).select("contract_id", "underlying", "eligible", *EXPOSURES.split())


view(
    "fx_eligibility",
    """
SELECT contract_id, kind, spot, strike, maturity, rate, volatility, dividend_yield, short_allowed,
       contract_id % 97 AS volume, contract_id % 211 AS open_interest,
       0.01e0 * (contract_id % 13) AS relative_spread
FROM {fx_chain}
""",
    "fx_chain",
)
RULES = ops.Eligibility(
    min_mark=0.5, min_maturity=0.04, max_maturity=0.9, min_moneyness=0.85, max_moneyness=1.15,
    min_volume=10, min_open_interest=20, max_relative_spread=0.10, assignable=True,
)


@query(
    "eligibility_filter",
    oracle(
        "priced fx_eligibility",
        """SELECT e.contract_id, p.price AS mark, e.strike / e.spot AS moneyness
           FROM fx_eligibility e JOIN priced p ON p.contract_id = e.contract_id
           WHERE p.price >= 0.5 AND e.maturity BETWEEN 0.04e0 AND 0.9e0 AND e.strike / e.spot BETWEEN 0.85e0 AND 1.15e0
             AND e.volume >= 10 AND e.open_interest >= 20 AND e.relative_spread <= 0.10e0 AND e.short_allowed""",
        "contract_id", "mark moneyness",
    ),
)
def eligibility_filter(t):
    priced = with_black_scholes(load(t, "fx_eligibility"), "mark", greeks=False)
    return ops.eligible(priced, RULES).select(
        "contract_id", "mark", (F.col("strike") / F.col("spot")).alias("moneyness")
    )


PREMIA = {
    "lambda_spot": "0.004e0 * underlying_beta_spy",
    "lambda_var": "0.001e0 * (1 + contract_id % 3)",
    "lambda_vol": "-0.002e0 * (1 + contract_id % 4)",
    "lambda_skew": "0.01e0 * (contract_id % 5 - 2)",
    "lambda_rv": "0.02e0 * (contract_id % 7 - 3)",
}
PREMIA_SQL = ", ".join(f"{text} AS {name}" for name, text in PREMIA.items())
VIEWS.add(
    "mean_ledger",
    f"""SELECT *, theta / mark / 12.0e0 AS carry, delta * spot / mark * lambda_spot AS delta_premium,
              0.5e0 * gamma * spot * spot / mark * lambda_var AS variance_premium, vega / mark * lambda_vol AS volatility_premium,
              lambda_skew AS skew_premium, lambda_rv AS relative_value
       FROM (SELECT *, {PREMIA_SQL} FROM universe) u""",
    "universe",
)
VIEWS.add(
    "means",
    """SELECT *, carry + delta_premium + variance_premium + volatility_premium + skew_premium + relative_value AS structural_mean,
              CASE WHEN mark IS NOT NULL THEN greatest(-0.35e0, least(0.35e0, 0.1875e0 * (carry + delta_premium + variance_premium + volatility_premium
                + skew_premium + relative_value))) END AS expected_return
       FROM mean_ledger""",
    "mean_ledger",
)


def with_premia(t):
    return universe(t).withColumns({name: F.expr(text) for name, text in PREMIA.items()})


def means(t):
    """Universe with expected returns from the structural mean."""

    return ops.structural_mean(with_premia(t))


@query("structural_mean", oracle("means", "SELECT * FROM means", "contract_id", "structural_mean expected_return"))
def structural_mean(t):
    return means(t).select("contract_id", "structural_mean", "expected_return")


@query(
    "channel_ablation",
    oracle(
        "mean_ledger",
        """SELECT contract_id, a.arm, CASE WHEN mark IS NOT NULL THEN greatest(-0.35e0, least(0.35e0, 0.1875e0 * (
             CASE WHEN a.arm = 'No carry' THEN 0 ELSE carry END
             + CASE WHEN a.arm = 'No delta' THEN 0 ELSE delta_premium END
             + CASE WHEN a.arm = 'No vol/VRP' THEN 0 ELSE variance_premium + volatility_premium END
             + CASE WHEN a.arm = 'No skew/tail' THEN 0 ELSE skew_premium END
             + CASE WHEN a.arm = 'No relative value' THEN 0 ELSE relative_value END))) END AS expected_return
           FROM mean_ledger, (VALUES ('Full'), ('No carry'), ('No delta'), ('No vol/VRP'), ('No skew/tail'),
             ('No relative value')) a(arm)""",
        "contract_id arm", "expected_return",
    ),
)
def channel_ablation(t):
    return ops.channel_ablation(with_premia(t))


VIEWS.add(
    "premium_rows",
    """SELECT p.book_id, p.contract_id, p.q * u.mark * 100.0e0 / 1e8 AS weight,
              (p.contract_id % 21 - 10) / 100.0e0 AS ret
       FROM fx_quarter_positions p LEFT JOIN universe u ON u.contract_id = p.contract_id""",
    "fx_quarter_positions", "universe",
)


@query(
    "premium_weight",
    oracle(
        "premium_rows",
        """SELECT book_id, legs, unmarked, CASE WHEN unmarked = 0 THEN share END AS premium_share,
                  CASE WHEN unmarked = 0 THEN 1.0e0 - share END AS cash_share, CASE WHEN unmarked = 0 THEN gain END AS contribution
           FROM (SELECT book_id, sum(weight) AS share, sum(weight * ret) AS gain, count(*) AS legs,
                        count(*) FILTER (weight IS NULL) AS unmarked FROM premium_rows GROUP BY 1) s""",
        "book_id", "premium_share cash_share contribution", "legs unmarked",
    ),
)
def premium_weight(t):
    """Premium and cash shares of whole books; a book with a leg that has no mark has none."""

    positions = load(t, "fx_quarter_positions").withColumnRenamed("q", "contracts")
    weights = ops.premium_weights(positions, universe(t), nav=1e8)
    leg = F.col("weight") * ((F.col("contract_id") % 21 - 10) / 100.0)
    unmarked = F.count_if(F.col("weight").isNull())
    return weights.groupBy("book_id").agg(
        F.when(unmarked == 0, F.sum("weight")).alias("premium_share"),
        F.when(unmarked == 0, 1.0 - F.sum("weight")).alias("cash_share"),
        F.when(unmarked == 0, F.sum(leg)).alias("contribution"),
        F.count("*").alias("legs"),
        unmarked.alias("unmarked"),
    )


view(
    "fx_marks",
    """
SELECT l_partkey AS contract_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
       avg(l_extendedprice / l_quantity) AS mark
FROM {lineitem} GROUP BY 1, 2
""",
)
view(
    "fx_settlements",
    """
SELECT l_partkey AS contract_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
       max(l_extendedprice / l_quantity) * 1.1e0 AS settlement
FROM {lineitem} WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1, 2
""",
)


@query(
    "option_return",
    oracle(
        "fx_marks fx_settlements",
        """SELECT m.contract_id, m.period, CASE WHEN s.settlement IS NULL THEN 'mark' ELSE 'settlement' END AS exit_source,
                  coalesce(s.settlement, m.later) / m.mark - 1.0e0 AS ret
           FROM (SELECT *, lead(mark) OVER (PARTITION BY contract_id ORDER BY period) AS later FROM fx_marks) m
           LEFT JOIN fx_settlements s ON s.contract_id = m.contract_id AND s.period = m.period
           WHERE coalesce(s.settlement, m.later) IS NOT NULL""",
        "contract_id period exit_source", "ret",
    ),
)
def option_return(t):
    return ops.option_returns(load(t, "fx_marks"), load(t, "fx_settlements"))


view(
    "fx_states",
    """
SELECT p.p_brand AS underlying, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS period,
       avg(l.l_extendedprice / l.l_quantity) AS spot, avg(l.l_discount) + 0.2e0 AS volatility
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY 1, 2
""",
)
VIEWS.add(
    "state_moves",
    """SELECT * FROM (SELECT underlying, period, spot / lag(spot) OVER w - 1.0e0 AS u, volatility - lag(volatility) OVER w AS dv
       FROM fx_states WINDOW w AS (PARTITION BY underlying ORDER BY period)) s WHERE u IS NOT NULL""",
    "fx_states",
)


@query(
    "factor_returns",
    oracle(
        "state_moves",
        "SELECT *, u * u - avg(u * u) OVER (PARTITION BY underlying) AS u2_centred FROM state_moves",
        "underlying period", "u u2_centred dv",
    ),
)
def factor_returns(t):
    return ops.factor_returns(load(t, "fx_states"))


MOVE = {"step": (1.03, 0.01, 1.0 / 12.0)}
VIEWS.add(
    "moved_chain",
    """SELECT contract_id, kind, spot * 1.03e0 AS spot, strike, greatest(maturity - 1.0e0 / 12.0e0, 0.0e0) AS maturity,
              rate, dividend_yield, volatility + 0.01e0 AS volatility FROM fx_chain""",
    "fx_chain",
)
VIEWS.add("moved", black_scholes_sql("moved_chain"), "moved_chain")


@query(
    "taylor_pnl",
    oracle(
        "universe moved",
        """SELECT *, pnl - delta_pnl - gamma_pnl - vega_pnl - theta_pnl AS residual FROM (
             SELECT u.contract_id, u.delta * (m.spot - u.spot) AS delta_pnl,
                    0.5e0 * u.gamma * (m.spot - u.spot) * (m.spot - u.spot) AS gamma_pnl,
                    u.vega * (m.volatility - u.volatility) AS vega_pnl, u.theta / 12.0e0 AS theta_pnl,
                    m.price - u.mark AS pnl
             FROM universe u JOIN moved m ON m.contract_id = u.contract_id) s""",
        "contract_id", "delta_pnl gamma_pnl vega_pnl theta_pnl pnl residual",
    ),
)
def taylor_pnl(t):
    end = ops.repriced(load(t, "fx_chain"), MOVE).select(
        "contract_id",
        F.col("shocked_mark").alias("end_mark"),
        F.col("spot").alias("end_spot"),
        F.col("volatility").alias("end_volatility"),
        F.lit(1.0 / 12.0).alias("years"),
    )
    return ops.taylor_attribution(universe(t), end, ["contract_id"])
