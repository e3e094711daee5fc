"""Queries on full metric sets, windows and small table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions.numeric import finite, flag, number
from premia.operators import metrics, paths
from premia.plans.inputs import load
from premia.plans.registry import VIEWS, oracle, query

GROUP = ["config", "strategy"]
MERGED = (
    "n_obs annualized_mean_return cagr annualized_volatility sharpe "
    "downside_annualized_deviation sortino max_drawdown calmar omega information_ratio "
    "var_95 cvar_95 terminal_wealth"
)

VIEWS.add(
    "active_rows",
    """SELECT f.config, f.strategy, f.return_date, f.net_return, b.benchmark_return,
              f.net_return - b.benchmark_return AS active
       FROM fx_returns f JOIN fx_benchmark b ON f.return_date = b.return_date""",
    "fx_returns",
    "fx_benchmark",
)
VIEWS.add(
    "full_metrics",
    """SELECT p.*, p.cagr / nullif(abs(p.max_drawdown), 0) AS calmar, -p.q05 AS var_95,
              (SELECT -avg(f.net_return) FROM fx_returns f WHERE f.config = p.config
                 AND f.strategy = p.strategy AND f.net_return <= p.q05) AS cvar_95,
              CASE WHEN p.defaulted THEN NULL ELSE a.ir END AS information_ratio
       FROM path_table p LEFT JOIN
            (SELECT config, strategy,
                    avg(active) * 12.0e0 / nullif(stddev_samp(active) * sqrt(12.0e0), 0) AS ir
             FROM active_rows GROUP BY 1, 2) a
         ON a.config = p.config AND a.strategy = p.strategy""",
    "path_table",
    "active_rows",
)


@query("perf_metrics", oracle("full_metrics", "SELECT * FROM full_metrics",
                              "config strategy defaulted", MERGED[6:], "n_obs"))
def perf_metrics(t):
    return metrics.performance_metrics(
        load(t, "fx_returns"), GROUP, benchmark=load(t, "fx_benchmark")
    )


@query("var_cvar_95", oracle("full_metrics", "SELECT * FROM full_metrics",
                             "config strategy", "var_95 cvar_95"))
def var_cvar_95(t):
    return metrics.value_at_risk(load(t, "fx_returns"), GROUP)


@query("information_ratio", oracle("full_metrics", "SELECT * FROM full_metrics",
                                   "config strategy", "information_ratio"))
def information_ratio(t):
    return metrics.information_ratio(load(t, "fx_returns"), load(t, "fx_benchmark"), GROUP)


@query("benchmark_align", oracle("active_rows", "SELECT * FROM active_rows",
                                 "config strategy return_date", "net_return benchmark_return"))
def benchmark_align(t):
    rows = metrics.benchmark_rows(load(t, "fx_returns"), load(t, "fx_benchmark"), ["return_date"])
    return rows.select(*GROUP, "return_date", "net_return", "benchmark_return")


@query(
    "integer_outcomes",
    oracle(
        "fx_returns",
        """SELECT config, count(*) AS candidates,
                  count(*) FILTER (WHERE integer_conversion_feasible) AS feasible,
                  count(*) FILTER (WHERE integer_execution_abstained) AS abstentions
           FROM fx_returns WHERE evidence_status = 'retrospective_development_sample' GROUP BY 1""",
        "config", "", "candidates feasible abstentions",
    ),
)
def integer_outcomes(t):
    scored = load(t, "fx_returns").where("evidence_status = 'retrospective_development_sample'")
    return scored.groupBy("config").agg(
        F.count("*").alias("candidates"),
        F.count_if(flag("integer_conversion_feasible")).alias("feasible"),
        F.count_if(flag("integer_execution_abstained")).alias("abstentions"),
    )


PROGRESSION = """
SELECT return_date,
       avg(CASE WHEN strategy = '1-URGENT' THEN net_return END) / 4.0e0 AS first_net_return,
       avg(CASE WHEN strategy = '2-HIGH' THEN net_return END) / 4.0e0 AS second_net_return,
       avg(CASE WHEN strategy = '5-LOW' THEN net_return END) / 4.0e0 AS third_net_return
FROM {fx_returns} GROUP BY 1"""
VIEWS.add("progression", PROGRESSION.replace("{fx_returns}", "fx_returns"), "fx_returns")


@query(
    "terminal_wealth_pivot",
    oracle(
        "progression",
        """SELECT strategy, product(1.0e0 + ret) AS terminal_wealth, count(*) AS months FROM (
             SELECT unnest(['first_net_return', 'second_net_return', 'third_net_return']) AS strategy,
                    unnest([first_net_return, second_net_return, third_net_return]) AS ret
             FROM progression WHERE first_net_return IS NOT NULL AND second_net_return IS NOT NULL
               AND third_net_return IS NOT NULL) GROUP BY 1""",
        "strategy", "terminal_wealth", "months",
    ),
)
def terminal_wealth_pivot(t):
    wide = t.sql(PROGRESSION, fx_returns=load(t, "fx_returns"))
    return metrics.terminal_wealth(
        wide, ["first_net_return", "second_net_return", "third_net_return"]
    )


WINDOWS = {"aligned_full": ("1995-01-01", "2001-12-31"), "aligned_late": ("1998-01-01", "2001-12-31")}
VIEWS.add(
    "window_rows",
    """SELECT f.config, f.strategy, w.name AS win, f.return_date, f.net_return AS r FROM fx_returns f
       JOIN (VALUES ('aligned_full', DATE '1995-01-01', DATE '2001-12-31'),
                    ('aligned_late', DATE '1998-01-01', DATE '2001-12-31')) w(name, a, b)
         ON f.return_date BETWEEN w.a AND w.b
       WHERE (SELECT count(DISTINCT g.strategy) FROM fx_returns g
              WHERE g.config = f.config AND g.return_date = f.return_date)
           = (SELECT count(DISTINCT g.strategy) FROM fx_returns g WHERE g.config = f.config)""",
    "fx_returns",
)


@query(
    "aligned_window_summary",
    oracle(
        "window_rows",
        """SELECT config, strategy, win AS "window", min(return_date) AS "start", max(return_date) AS "end",
                  count(*) AS n_obs, avg(r) * 12.0e0 AS annualized_mean_return,
                  stddev_samp(r) * sqrt(12.0e0) AS annualized_volatility,
                  CASE WHEN min(r) <= -1 THEN NULL ELSE avg(r) * sqrt(12.0e0) / stddev_samp(r) END AS sharpe,
                  -quantile_cont(r, 0.05) AS var_95,
                  CASE WHEN min(r) <= -1 THEN 0.0e0 ELSE product(1.0e0 + r) END AS terminal_wealth,
                  min(r) <= -1 AS defaulted,
                  CASE WHEN min(r) <= -1 THEN NULL ELSE true END AS mean_is_sharpe_times_volatility
           FROM window_rows GROUP BY 1, 2, 3""",
        'config strategy "window" "start" "end" defaulted mean_is_sharpe_times_volatility',
        "annualized_mean_return annualized_volatility sharpe var_95 terminal_wealth",
        "n_obs",
    ),
)
def aligned_window_summary(t):
    table = metrics.aligned_windows(load(t, "fx_returns"), "config", "strategy", WINDOWS)
    gap = F.abs(
        F.col("annualized_mean_return") - F.col("sharpe") * F.col("annualized_volatility")
    )
    return table.select(
        *GROUP, "window", "start", "end", "n_obs", "annualized_mean_return",
        "annualized_volatility", "sharpe", "var_95", "terminal_wealth", "defaulted",
        (gap <= 1e-8).alias("mean_is_sharpe_times_volatility"),
    )


@query(
    "trailing_window",
    oracle(
        "fx_returns",
        """SELECT config, strategy, return_date, count(net_return) OVER w AS trailing_n,
                  avg(net_return) OVER w AS trailing_mean, stddev_samp(net_return) OVER w AS trailing_std
           FROM fx_returns WINDOW w AS (PARTITION BY config, strategy ORDER BY return_date
             RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
        "config strategy return_date", "trailing_mean trailing_std", "trailing_n",
    ),
)
def trailing_window(t):
    rows = load(t, "fx_returns").select(*GROUP, "return_date", "net_return")
    return metrics.trailing_statistics(rows, GROUP, "return_date", "net_return", 365).drop("net_return")


@query(
    "rolling_oos",
    oracle(
        "fx_returns",
        """SELECT *, sign(train_mean) * net_return AS scored_return FROM (
             SELECT config, strategy, return_date, net_return, count(*) OVER w AS train_rows,
                    avg(net_return) OVER w AS train_mean
             FROM fx_returns WINDOW w AS (PARTITION BY config, strategy ORDER BY return_date
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE train_rows >= 12""",
        "config strategy return_date", "train_mean scored_return", "train_rows",
    ),
)
def rolling_oos(t):
    return metrics.rolling_out_of_sample(load(t, "fx_returns"), GROUP)


@query(
    "sorted_output",
    oracle("path_table", "SELECT * FROM path_table", "config strategy", "terminal_wealth", "n_obs"),
)
def sorted_output(t):
    table = paths.return_moments(load(t, "fx_returns"), GROUP)
    return table.select(*GROUP, "n_obs", "terminal_wealth").orderBy(*GROUP)


ARMS = """
SELECT return_date, config, 'gross' AS arm, net_return + 0.01e0 * gross_nav AS ret FROM fx_returns
UNION ALL SELECT return_date, config, 'net', net_return FROM fx_returns"""


@query(
    "union_arms",
    oracle("fx_returns", f"SELECT config, arm, count(*) AS rows, avg(ret) AS mean_return FROM ({ARMS}) GROUP BY 1, 2",
           "config arm", "mean_return", "rows"),
)
def union_arms(t):
    rows = load(t, "fx_returns")
    gross = rows.select(
        "return_date", "config", F.lit("gross").alias("arm"),
        (F.col("net_return") + F.col("gross_nav") * 0.01).alias("ret"),
    )
    net = rows.select("config", "return_date", F.col("net_return").alias("ret"), F.lit("net").alias("arm"))
    return (
        gross.unionByName(net)
        .groupBy("config", "arm")
        .agg(F.count("*").alias("rows"), F.avg("ret").alias("mean_return"))
    )


@query(
    "merge_on_key",
    oracle(
        "fx_returns",
        """SELECT m.strategy, m.median_nav, b.breaches FROM
             (SELECT strategy, quantile_cont(gross_nav, 0.5) AS median_nav FROM fx_returns GROUP BY 1) m
           JOIN (SELECT strategy, count(*) AS breaches FROM fx_returns WHERE gross_nav > 0.5 GROUP BY 1) b
             ON m.strategy = b.strategy""",
        "strategy", "median_nav", "breaches",
    ),
)
def merge_on_key(t):
    from premia.operators.ranks import exact_quantiles

    rows = load(t, "fx_returns")
    medians = exact_quantiles(rows, ["strategy"], "gross_nav", {"median_nav": 0.5}).drop("size")
    breaches = rows.where("gross_nav > 0.5").groupBy("strategy").agg(F.count("*").alias("breaches"))
    return medians.join(breaches, "strategy")


@query(
    "coerce_numeric",
    """SELECT role, count(*) AS rows, count(TRY_CAST(word AS DOUBLE)) AS numbers,
              round(avg(TRY_CAST(word AS DOUBLE)) + 1e-11::DOUBLE, 6) + 0.0e0 AS mean_number
       FROM (SELECT event_type AS role, CASE WHEN event_id % 3 = 0 THEN 'n/a'
                    ELSE CAST(event_id % 1000 AS VARCHAR) || '.5' END AS word FROM events) GROUP BY 1""",
)
def coerce_numeric(t):
    text = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(
        F.concat((F.col("event_id") % 1000).cast("string"), F.lit(".5"))
    )
    value = number(F.col("word"))
    return (
        t.events.select(F.col("event_type").alias("role"), text.alias("word"))
        .groupBy("role")
        .agg(
            F.count("*").alias("rows"),
            F.count(value).alias("numbers"),
            F.avg(value).alias("mean_number"),
        )
    )


@query(
    "finite_filter",
    """SELECT event_type, count(x) AS finite_rows, count(*) - count(x) AS dropped_rows,
              round(avg(x) + 1e-11::DOUBLE, 6) + 0.0e0 AS mean_value
       FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL
                    ELSE value END AS x FROM events) GROUP BY 1""",
)
def finite_filter(t):
    dirty = (
        F.when(F.col("event_id") % 7 == 0, float("inf"))
        .when(F.col("event_id") % 11 == 0, float("nan"))
        .otherwise(F.col("value"))
    )
    x = finite("dirty")
    return (
        t.events.select("event_type", dirty.alias("dirty"))
        .groupBy("event_type")
        .agg(
            F.count(x).alias("finite_rows"),
            (F.count("*") - F.count(x)).alias("dropped_rows"),
            F.avg(x).alias("mean_value"),
        )
    )
