"""Queries on return paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions.numeric import finite, flag, number
from premia.operators import paths
from premia.plans.inputs import load
from premia.plans.registry import VIEWS, oracle, query

GROUP = ["config", "strategy"]

VIEWS.add(
    "path_rows",
    """
SELECT config, strategy, return_date, net_return AS r, gross_nav, integer_repair_failed,
       integer_execution_abstained,
       CASE WHEN min(1.0e0 + net_return) OVER w <= 0 THEN 0.0e0
            ELSE product(1.0e0 + net_return) OVER w END AS wealth,
       min(1.0e0 + net_return) OVER w <= 0 AS ruined
FROM fx_returns
WINDOW w AS (PARTITION BY config, strategy ORDER BY return_date ROWS UNBOUNDED PRECEDING)
""",
    "fx_returns",
)
VIEWS.add(
    "path_dips",
    """
SELECT *, CASE WHEN ruined THEN -1.0e0 ELSE wealth / greatest(1.0e0, max(wealth) OVER w) - 1.0e0 END AS dip
FROM path_rows
WINDOW w AS (PARTITION BY config, strategy ORDER BY return_date ROWS UNBOUNDED PRECEDING)
""",
    "path_rows",
)
VIEWS.add(
    "path_table",
    """
SELECT *,
       annualized_mean_return / nullif(annualized_volatility, 0) AS raw_sharpe,
       CASE WHEN defaulted THEN NULL ELSE annualized_mean_return / nullif(annualized_volatility, 0) END AS sharpe,
       CASE WHEN defaulted THEN NULL
            ELSE annualized_mean_return / nullif(downside_annualized_deviation, 0) END AS sortino,
       CASE WHEN defaulted THEN -1.0e0 ELSE pow(terminal_wealth, 12.0e0 / n_obs) - 1.0e0 END AS cagr
FROM (
SELECT config, strategy, count(*) AS n_obs, avg(r) * 12.0e0 AS annualized_mean_return,
       stddev_samp(r) * sqrt(12.0e0) AS annualized_volatility,
       sqrt(avg(least(r, 0.0e0) * least(r, 0.0e0))) * sqrt(12.0e0) AS downside_annualized_deviation,
       sum(greatest(r, 0.0e0)) / nullif(-sum(least(r, 0.0e0)), 0) AS omega,
       CASE WHEN bool_or(ruined) THEN -1.0e0 ELSE min(dip) END AS max_drawdown,
       CASE WHEN bool_or(ruined) THEN 0.0e0 ELSE product(1.0e0 + r) END AS terminal_wealth,
       bool_or(ruined) AS defaulted, min(r) AS worst_month,
       count(*) FILTER (WHERE integer_repair_failed) AS integer_failures,
       count(*) FILTER (WHERE integer_execution_abstained) AS integer_abstentions,
       avg(gross_nav) AS mean_gross_nav,
       quantile_cont(r, 0.05) AS q05
FROM path_dips GROUP BY 1, 2) s
""",
    "path_dips",
)

SUMMARY_REAL = (
    "annualized_mean_return cagr annualized_volatility sharpe sortino max_drawdown "
    "terminal_wealth worst_month mean_gross_nav"
)


@query(
    "perf_summary",
    oracle(
        "path_table",
        "SELECT *, n_obs AS observations FROM path_table",
        "config strategy defaulted",
        SUMMARY_REAL,
        "observations integer_failures integer_abstentions",
    ),
)
def perf_summary(t):
    return paths.performance_summary(load(t, "fx_returns"), GROUP)


@query(
    "wealth_path",
    oracle("path_dips", "SELECT *, r AS net_return FROM path_dips", "config strategy return_date", "net_return wealth"),
)
def wealth_path(t):
    return paths.wealth_path(load(t, "fx_returns"), GROUP).drop("drawdown", "defaulted")


@query(
    "drawdown",
    oracle(
        "path_table",
        "SELECT * FROM path_table",
        "config strategy defaulted",
        "max_drawdown",
    ),
)
def drawdown(t):
    table = paths.path_statistics(load(t, "fx_returns"), GROUP)
    return table.select(*GROUP, "max_drawdown", "defaulted")


def _simple(name: str, *columns: str) -> None:
    """Register an order-free metric of the moments table."""

    @query(
        name,
        oracle("path_table", "SELECT * FROM path_table", "config strategy", " ".join(columns), "n_obs"),
    )
    def plan(t):
        table = paths.return_moments(load(t, "fx_returns"), GROUP)
        return table.select(*GROUP, "n_obs", *columns)


_simple("ann_mean", "annualized_mean_return")
_simple("ann_vol", "annualized_volatility")
_simple("cagr", "cagr", "terminal_wealth")
_simple("sharpe", "sharpe")
_simple("sortino", "sortino", "downside_annualized_deviation")
_simple("omega", "omega")


@query(
    "calmar",
    oracle(
        "path_table",
        "SELECT *, cagr / nullif(abs(max_drawdown), 0) AS calmar FROM path_table",
        "config strategy",
        "cagr max_drawdown calmar",
    ),
)
def calmar(t):
    table = paths.path_statistics(load(t, "fx_returns"), GROUP)
    return table.select(*GROUP, "cagr", "max_drawdown", "calmar")


@query(
    "flag_counts",
    oracle(
        "path_table",
        "SELECT * FROM path_table",
        "config strategy",
        "",
        "integer_failures integer_abstentions",
    ),
)
def flag_counts(t):
    return (
        paths.keyed(load(t, "fx_returns"), GROUP)
        .groupBy(*GROUP)
        .agg(
            F.count_if(flag("integer_repair_failed")).alias("integer_failures"),
            F.count_if(flag("integer_execution_abstained")).alias("integer_abstentions"),
        )
    )


@query(
    "fill_flag",
    oracle(
        "fx_returns",
        """SELECT config, strategy, return_date,
                  coalesce(integer_execution_abstained, false) AS abstained,
                  coalesce(integer_conversion_feasible, false) AS feasible FROM fx_returns""",
        "config strategy return_date abstained feasible",
    ),
)
def fill_flag(t):
    return load(t, "fx_returns").select(
        *GROUP,
        "return_date",
        flag("integer_execution_abstained").alias("abstained"),
        flag("integer_conversion_feasible").alias("feasible"),
    )


@query(
    "first_default",
    oracle(
        "fx_returns",
        """SELECT config, strategy, min(return_date) AS absorbed_on FROM fx_returns
           WHERE net_return <= -1 GROUP BY 1, 2""",
        "config strategy absorbed_on",
    ),
)
def first_default(t):
    return paths.first_default(load(t, "fx_returns"), GROUP)


@query(
    "path_sizes",
    oracle(
        "fx_returns",
        """SELECT config, strategy, count(*) AS rows, count(DISTINCT return_date) AS dates,
                  count(DISTINCT return_date) = (SELECT count(DISTINCT return_date) FROM fx_returns) AS complete,
                  count(*) > count(DISTINCT return_date) AS has_duplicates
           FROM fx_returns GROUP BY 1, 2""",
        "config strategy complete has_duplicates",
        "",
        "rows dates",
    ),
)
def path_sizes(t):
    return paths.path_sizes(load(t, "fx_returns"), GROUP)
