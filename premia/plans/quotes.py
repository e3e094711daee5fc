"""Queries on quotes and execution evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.operators import quotes as ops
from premia.plans.inputs import load, view
from premia.plans.registry import VIEWS, oracle, query
from premia.session import written

VIEWS.add(
    "entry_rows",
    """SELECT t.*, q.quote_id, q.quote_ts, q.bid, q.ask FROM fx_trades t
       LEFT JOIN LATERAL (SELECT * FROM fx_quotes q WHERE q.symbol = t.symbol AND q.quote_ts <= t.trade_ts
                          ORDER BY q.quote_ts DESC, q.quote_id DESC LIMIT 1) q ON true""",
    "fx_trades", "fx_quotes",
)
VIEWS.add(
    "exit_rows",
    """SELECT t.trade_id, q.quote_id AS exit_id, q.quote_ts AS exit_ts, q.bid AS exit_bid, q.ask AS exit_ask FROM fx_trades t
       LEFT JOIN LATERAL (SELECT * FROM fx_quotes q WHERE q.symbol = t.symbol AND q.quote_ts >= t.trade_ts
                          ORDER BY q.quote_ts, q.quote_id LIMIT 1) q ON true""",
    "fx_trades", "fx_quotes",
)


@query("asof_entry_quote", oracle("entry_rows", "SELECT * FROM entry_rows", "", "mark bid ask", "trade_id symbol quote_id"))
def asof_entry_quote(t):
    return ops.entry_quotes(load(t, "fx_trades"), load(t, "fx_quotes")).select(
        "trade_id", "symbol", "quote_id", "mark", "bid", "ask"
    )


view(
    "fx_trigger_legs",
    """
SELECT DISTINCT d.trigger_day, e.user_id AS symbol
FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS trigger_day FROM {events} WHERE event_type = 'error'
      GROUP BY 1 HAVING max(value) > 100) d
JOIN {events} e ON CAST(date_trunc('day', e.ts) AS DATE) = d.trigger_day AND e.event_type = 'purchase'
""",
)
VIEWS.add(
    "trigger_rows",
    """SELECT l.*, q.quote_id, (q.bid + q.ask) / 2 AS mid, q.quote_id IS NOT NULL AS covered FROM (
         SELECT trigger_day, symbol, CAST(trigger_day AS TIMESTAMP)
           + to_days(CAST(CASE dayofweek(trigger_day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER))
           + INTERVAL 570 MINUTES AS open_ts FROM fx_trigger_legs) l
       LEFT JOIN LATERAL (SELECT * FROM fx_quotes q WHERE q.symbol = l.symbol AND q.quote_ts >= l.open_ts
                  AND q.quote_ts <= l.open_ts + INTERVAL 390 MINUTES ORDER BY q.quote_ts, q.quote_id LIMIT 1) q ON true""",
    "fx_trigger_legs", "fx_quotes",
)


@query(
    "next_executable_quote",
    oracle(
        "trigger_rows",
        """SELECT trigger_day, count(*) AS legs, count(*) FILTER (WHERE covered) AS covered_legs, bool_and(covered) AS scored,
                  avg(mid) AS mean_mid FROM trigger_rows GROUP BY 1""",
        "trigger_day scored", "mean_mid", "legs covered_legs",
    ),
)
def next_executable_quote(t):
    legs = written(ops.next_executable_quotes(load(t, "fx_trigger_legs"), load(t, "fx_quotes")), "legs")
    mids = legs.groupBy("trigger_day").agg(F.avg("mid").alias("mean_mid"))
    return ops.trigger_scores(legs).join(mids, "trigger_day")


VIEWS.add(
    "quote_days",
    """SELECT symbol, CAST(quote_ts AS DATE) AS day, avg((ask - bid) / nullif((ask + bid) / 2, 0)) AS day_spread,
              max((ask - bid) / nullif((ask + bid) / 2, 0)) AS day_worst_spread, sum(volume) AS day_volume_sum,
              max(volume) AS day_volume_max, max(open_interest) AS day_open_interest FROM fx_quotes GROUP BY 1, 2""",
    "fx_quotes",
)
VIEWS.add(
    "ladder",
    """SELECT t.trade_id, t.arm, t.trade_ts, coalesce(d.day_spread, p.proxy, 0.05e0) AS relative_spread,
              CASE WHEN d.day_spread IS NOT NULL THEN 'exact' WHEN p.proxy IS NOT NULL THEN 'proxy' ELSE 'default' END AS source
       FROM fx_trades t LEFT JOIN quote_days d ON d.symbol = t.symbol AND d.day = CAST(t.trade_ts AS DATE)
       LEFT JOIN (SELECT symbol, avg(day_spread) AS proxy FROM quote_days WHERE symbol % 4 <> 0 GROUP BY 1) p ON p.symbol = t.symbol""",
    "fx_trades", "quote_days",
)


def ladder(t):
    days = ops.daily_quotes(load(t, "fx_quotes"))
    proxy = days.where("symbol % 4 <> 0").groupBy("symbol").agg(F.avg("day_spread").alias("proxy_spread"))
    return ops.spread_ladder(load(t, "fx_trades"), days, proxy, 0.05)


@query("spread_ladder", oracle("ladder", "SELECT * FROM ladder", "source", "relative_spread", "trade_id"))
def spread_ladder(t):
    return ladder(t).select("trade_id", "relative_spread", "source")


@query(
    "proxy_share",
    oracle(
        "ladder",
        """SELECT arm, count(*) FILTER (WHERE source = 'exact') AS exact_rows, count(*) FILTER (WHERE source <> 'exact') AS proxy_rows,
                  quantile_cont(relative_spread, 0.5) AS median_relative_spread,
                  avg((source <> 'exact')::INT::DOUBLE) AS proxy_row_share FROM ladder GROUP BY 1""",
        "arm", "median_relative_spread proxy_row_share", "exact_rows proxy_rows",
    ),
)
def proxy_share(t):
    return ops.proxy_share(ladder(t), ["arm"])


CUT = "2024-01-16"
REGIME = f"CASE WHEN trade_ts < TIMESTAMP '{CUT}' THEN 'pre_2024_01_16' ELSE 'post_2024_01_16' END"
PCTS = "quantile_cont({0}, 0.25) AS p25, quantile_cont({0}, 0.5) AS p50, quantile_cont({0}, 0.75) AS p75, quantile_cont({0}, 0.9) AS p90"


@query(
    "spread_quantiles",
    oracle(
        "ladder",
        f"SELECT arm, {REGIME} AS regime, source, count(*) AS size, {PCTS.format('relative_spread')} FROM ladder GROUP BY 1, 2, 3",
        "arm regime source", "p25 p50 p75 p90", "size",
    ),
)
def spread_quantiles(t):
    rows = ladder(t).withColumn("regime", ops.regime("trade_ts", CUT))
    return ops.spread_quantiles(rows, ["arm", "regime", "source"])


@query(
    "mark_accuracy",
    oracle(
        "entry_rows",
        f"""SELECT arm, {REGIME} AS regime, count(err) AS size, {PCTS.format('err')} FROM (
              SELECT *, abs(mark / nullif((bid + ask) / 2, 0) - 1) AS err FROM entry_rows WHERE bid + ask > 0) s GROUP BY 1, 2""",
        "arm regime", "p25 p50 p75 p90", "size",
    ),
)
def mark_accuracy(t):
    rows = ops.entry_quotes(load(t, "fx_trades"), load(t, "fx_quotes"))
    error = F.abs(F.try_divide(F.col("mark"), (F.col("bid") + F.col("ask")) / 2.0) - 1.0)
    scored = rows.withColumn("error", error).withColumn("regime", ops.regime("trade_ts", CUT))
    return ops.spread_quantiles(scored, ["arm", "regime"], "error")


@query(
    "participation",
    oracle(
        "fx_trades quote_days",
        """SELECT arm, quantile_cont(a, 0.5) AS participation_volume_sum, quantile_cont(b, 0.5) AS participation_volume_max,
                  quantile_cont(c, 0.5) AS participation_open_interest, count(*) FILTER (WHERE a > 0.05e0) AS breach_optimizer_volume,
                  count(*) FILTER (WHERE b > 0.10e0) AS breach_capacity_volume, count(*) FILTER (WHERE c > 0.02e0) AS breach_capacity_oi
           FROM (SELECT t.arm, t.contracts / d.day_volume_sum AS a, t.contracts / d.day_volume_max AS b, t.contracts / d.day_open_interest AS c
                 FROM fx_trades t JOIN quote_days d ON d.symbol = t.symbol AND d.day = CAST(t.trade_ts AS DATE)) s GROUP BY 1""",
        "arm", "participation_volume_sum participation_volume_max participation_open_interest",
        "breach_optimizer_volume breach_capacity_volume breach_capacity_oi",
    ),
)
def participation(t):
    days = ops.daily_quotes(load(t, "fx_quotes"))
    rows = load(t, "fx_trades").withColumn("day", F.to_date("trade_ts")).join(days, ["symbol", "day"])
    return ops.participation(
        rows, "arm",
        {
            "breach_optimizer_volume": ("participation_volume_sum", 0.05),
            "breach_capacity_volume": ("participation_volume_max", 0.10),
            "breach_capacity_oi": ("participation_open_interest", 0.02),
        },
    )


VIEWS.add(
    "covered_legs",
    """SELECT e.*, x.exit_id, x.exit_ts, x.exit_bid, x.exit_ask, e.symbol % 9 = 0 AS placeholder,
              coalesce(e.trade_ts - e.quote_ts <= INTERVAL 12 HOURS, false) AS entry_covered,
              coalesce(x.exit_ts - e.trade_ts <= INTERVAL 12 HOURS, false) AS exit_covered
       FROM entry_rows e JOIN exit_rows x ON x.trade_id = e.trade_id""",
    "entry_rows", "exit_rows",
)


def covered_legs(t):
    """Trades with entry and exit quotes and whether each is fresh enough; written once."""

    trades, quotes = load(t, "fx_trades"), load(t, "fx_quotes")
    entered = ops.entry_quotes(trades, quotes)
    later = quotes.select(
        "symbol", F.col("quote_id").alias("exit_id"), F.col("quote_ts").alias("exit_ts"),
        F.col("bid").alias("exit_bid"), F.col("ask").alias("exit_ask"),
    )
    both = ops.asof_join(
        entered, later, ["symbol"], "trade_ts", "exit_ts",
        ["exit_id", "exit_ts", "exit_bid", "exit_ask"], "exit_id", forward=True,
    )
    half_day = F.make_dt_interval(F.lit(0), F.lit(12), F.lit(0), F.lit(0))
    fresh_in = F.col("trade_ts") - F.col("quote_ts") <= half_day
    fresh_out = F.col("exit_ts") - F.col("trade_ts") <= half_day
    table = both.withColumns(
        {
            "placeholder": F.col("symbol") % 9 == 0,
            "entry_covered": F.coalesce(fresh_in, F.lit(False)),
            "exit_covered": F.coalesce(fresh_out, F.lit(False)),
        }
    )
    return written(table, "covered_legs")


@query(
    "quote_coverage",
    oracle(
        "covered_legs",
        """SELECT CASE WHEN ga = 1 THEN 'all' ELSE arm END AS arm, CASE WHEN gc = 1 THEN 'all' ELSE asset_class END AS asset_class, positions, aw AS absolute_weight,
                  ew AS entry_covered_weight, rw AS roundtrip_covered_weight, ew / aw AS entry_coverage, rw / aw AS roundtrip_coverage FROM (
             SELECT arm, asset_class, grouping(arm) AS ga, grouping(asset_class) AS gc, count(*) AS positions, sum(abs(weight)) AS aw, coalesce(sum(abs(weight)) FILTER (WHERE entry_covered), 0) AS ew,
                    coalesce(sum(abs(weight)) FILTER (WHERE entry_covered AND exit_covered), 0) AS rw
             FROM covered_legs WHERE symbol % 13 <> 0 GROUP BY ROLLUP (arm, asset_class)) s""",
        "arm asset_class", "absolute_weight entry_covered_weight roundtrip_covered_weight entry_coverage roundtrip_coverage",
        "positions",
    ),
)
def quote_coverage(t):
    # Legs whose arm is unknown belong to no level.
    known = F.when(F.col("symbol") % 13 != 0, F.col("arm"))
    return ops.quote_coverage(covered_legs(t).withColumn("arm", known), ["arm", "asset_class"])


@query(
    "symbol_alignment",
    oracle(
        "covered_legs",
        """SELECT arm, count(*) AS active_position_rows, count(*) FILTER (WHERE NOT placeholder) AS exact_position_rows,
                  count(*) FILTER (WHERE NOT placeholder AND entry_covered) AS exact_entry_covered_rows,
                  count(*) FILTER (WHERE NOT placeholder AND NOT entry_covered) AS exact_entry_missing_rows,
                  count(DISTINCT CASE WHEN NOT placeholder THEN symbol END) AS exact_unique_symbols,
                  count(*) FILTER (WHERE NOT exit_covered) AS exit_missing_rows,
                  count(*) FILTER (WHERE placeholder) AS unresolved_placeholder_rows FROM covered_legs GROUP BY 1""",
        "arm", "",
        "active_position_rows exact_position_rows exact_entry_covered_rows exact_entry_missing_rows exact_unique_symbols "
        "exit_missing_rows unresolved_placeholder_rows",
    ),
)
def symbol_alignment(t):
    return ops.symbol_alignment(covered_legs(t), ["arm"])


VIEWS.add(
    "scenario_costs",
    """SELECT arm, day, sum(weight * ret) AS gross_return, sum(w * ms) + sum(w * oc) AS modeled_cost, sum(w * oc) AS midpoint_cost,
              sum(w * (coalesce(es, ms) + coalesce(xs, ms)) / 2) + sum(w * oc) AS touch_cost,
              sum(w * (greatest(coalesce(ws, ms), coalesce(es, ms)) + coalesce(xs, ms)) / 2) + sum(w * oc) AS worst_cost,
              count(*) FILTER (WHERE es IS NULL) AS missing_quotes FROM (
         SELECT c.arm, CAST(c.trade_ts AS DATE) AS day, c.weight, abs(c.weight) AS w, (c.trade_id % 11 - 5) / 20.0e0 AS ret, 0.02e0 AS ms,
                0.001e0 * (1 + c.trade_id % 3) AS oc,
                CASE WHEN c.entry_covered THEN (c.ask - c.bid) / nullif((c.ask + c.bid) / 2, 0) END AS es,
                CASE WHEN c.exit_covered THEN (c.exit_ask - c.exit_bid) / nullif((c.exit_ask + c.exit_bid) / 2, 0) END AS xs,
                d.day_worst_spread AS ws
         FROM covered_legs c LEFT JOIN quote_days d ON d.symbol = c.symbol AND d.day = CAST(c.trade_ts AS DATE)) s GROUP BY 1, 2""",
    "covered_legs", "quote_days",
)


def scenario_costs(t):
    days = ops.daily_quotes(load(t, "fx_quotes")).select("symbol", "day", F.col("day_worst_spread").alias("worst_spread"))
    legs = covered_legs(t).withColumn("day", F.to_date("trade_ts")).join(days, ["symbol", "day"], "left")
    exit_mid = (F.col("exit_ask") + F.col("exit_bid")) / 2.0
    ready = legs.withColumns(
        {
            "ret": (F.col("trade_id") % 11 - 5) / 20.0,
            "modeled_spread": F.lit(0.02),
            "other_cost": (F.col("trade_id") % 3 + 1) * 0.001,
            "entry_spread": F.when(F.col("entry_covered"), ops.relative_spread()),
            "exit_spread": F.when(
                F.col("exit_covered"), F.try_divide(F.col("exit_ask") - F.col("exit_bid"), exit_mid)
            ),
        }
    )
    return ops.quote_scenario_costs(ready, ["arm", "day"])


@query(
    "quote_scenario_returns",
    oracle(
        "scenario_costs",
        """SELECT *, gross_return - modeled_cost AS modeled_return, gross_return - midpoint_cost AS midpoint_return,
                  gross_return - touch_cost AS touch_price_return, gross_return - worst_cost AS worst_case_return FROM scenario_costs""",
        "arm day", "modeled_return midpoint_return touch_price_return worst_case_return", "missing_quotes",
    ),
)
def quote_scenario_returns(t):
    table = scenario_costs(t)
    gross = F.col("gross_return")
    return table.select(
        "arm", "day", "missing_quotes",
        (gross - F.col("modeled_cost")).alias("modeled_return"),
        (gross - F.col("midpoint_cost")).alias("midpoint_return"),
        (gross - F.col("touch_cost")).alias("touch_price_return"),
        (gross - F.col("worst_cost")).alias("worst_case_return"),
    )


view(
    "fx_costs",
    """
SELECT config, strategy, return_date, net_return + 0.01e0 * gross_nav AS gross_return, 0.010e0 * gross_nav AS modeled_cost,
       0.008e0 * gross_nav AS midpoint_cost,
       CASE WHEN gross_nav > 0.56e0 THEN -0.001e0 ELSE 0.015e0 * gross_nav END AS touch_cost, 0.02e0 * gross_nav AS worst_cost,
       CASE WHEN integer_repair_failed THEN NULL ELSE gross_nav * 2.0e0 - 0.1e0 END AS entry_coverage,
       CASE WHEN integer_execution_abstained IS NULL THEN NULL ELSE 0.25e0 END AS roundtrip_coverage,
       CASE WHEN strategy = '5-LOW' AND integer_repair_failed THEN 'Realized Fills' ELSE 'observed-quote sensitivity' END AS evidence_label
FROM {fx_returns}
""",
    "fx_returns",
)


@query(
    "cost_scenarios",
    oracle(
        "fx_costs",
        """SELECT config, strategy, return_date, unnest(['modeled', 'midpoint', 'touch_price', 'worst_case']) AS scenario,
                  unnest([gross_return - modeled_cost, gross_return - midpoint_cost, gross_return - touch_cost, gross_return - worst_cost]) AS scenario_return
           FROM fx_costs""",
        "config strategy return_date scenario", "scenario_return",
    ),
)
def cost_scenarios(t):
    return ops.cost_scenarios(load(t, "fx_costs"), ["config", "strategy", "return_date"])


@query(
    "cost_scenario_check",
    oracle(
        "fx_costs",
        """SELECT config, strategy, return_date, CASE WHEN touch_cost < 0 THEN 'negative_cost'
             WHEN (entry_coverage IS NULL) <> (roundtrip_coverage IS NULL) THEN 'coverage_incomplete'
             WHEN entry_coverage > 1 OR entry_coverage < 0 THEN 'coverage_outside'
             WHEN lower(evidence_label) LIKE '%fill%' THEN 'label_claims_fills' END AS reason FROM fx_costs""",
        "config strategy return_date reason",
    ),
)
def cost_scenario_check(t):
    return load(t, "fx_costs").select(
        "config", "strategy", "return_date", ops.cost_scenario_reject().alias("reason")
    )


view(
    "fx_cost_terms",
    """
SELECT arm, trade_id, 0.01e0 * mark * abs(weight) AS spread, 0.002e0 * contracts AS fees, 0.001e0 * mark AS slippage,
       CASE WHEN weight < 0 THEN 0.0001e0 * mark ELSE 0.0e0 END AS short_call_borrow, 0.00005e0 * mark * contracts AS funding,
       0.00005e0 * mark * contracts + 0.001e0 * mark + 0.002e0 * contracts + 0.01e0 * mark * abs(weight)
         + CASE WHEN weight < 0 THEN 0.0001e0 * mark ELSE 0.0e0 END
         + CASE WHEN arm = 'larger' AND trade_id % 101 = 0 THEN 0.001e0 ELSE 0.0e0 END AS recorded_cost
FROM {fx_trades}
""",
    "fx_trades",
)


@query(
    "cost_reconstruction",
    oracle(
        "fx_cost_terms",
        """SELECT *, CASE WHEN max_absolute_gap <= 1e-12 THEN 'exact' ELSE 'differs' END AS status FROM (
             SELECT arm, max(abs(recorded_cost - (spread + fees + slippage + short_call_borrow + funding))) AS max_absolute_gap,
                    avg(abs(recorded_cost - (spread + fees + slippage + short_call_borrow + funding))) AS mean_absolute_gap,
                    sum(spread) AS total_spread, sum(fees) AS total_fees, sum(slippage) AS total_slippage,
                    sum(short_call_borrow) AS total_short_call_borrow, sum(funding) AS total_funding FROM fx_cost_terms GROUP BY 1) s""",
        "arm status",
        "max_absolute_gap mean_absolute_gap total_spread total_fees total_slippage total_short_call_borrow total_funding",
    ),
)
def cost_reconstruction(t):
    return ops.cost_reconstruction(load(t, "fx_cost_terms"), ["arm"])
