"""Queries on Sharpe inference and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions.status import validation_status
from premia.operators import inference
from premia.plans.inputs import load
from premia.plans.oracles import cdf, maxima
from premia.plans.registry import VIEWS, oracle, query

GROUP = ["config", "strategy"]

VIEWS.add(
    "moments_table",
    """SELECT config, strategy, count(*) AS n_obs, avg(net_return) AS mean, stddev_samp(net_return) AS std,
              skewness(net_return) AS skew, kurtosis(net_return) + 3.0e0 AS kurtosis,
              min(net_return) > -1 AS available, 1 + count(*) % 40 AS trials
       FROM fx_returns GROUP BY 1, 2""",
    "fx_returns",
)


@query("sharpe_moments", oracle("moments_table", "SELECT * FROM moments_table",
                                "config strategy", "mean std skew kurtosis", "n_obs"))
def sharpe_moments(t):
    return inference.sharpe_moments(load(t, "fx_returns"), GROUP).drop("available")


@query("sharpe_available", oracle("moments_table", "SELECT * FROM moments_table",
                                  "config strategy available"))
def sharpe_available(t):
    return inference.sharpe_moments(load(t, "fx_returns"), GROUP).select(*GROUP, "available")


def _probability(bench: str) -> str:
    return f"""SELECT *, CASE WHEN available THEN {cdf('z')} END AS prob FROM (
        SELECT *, (s - bench) / sqrt((1 - skew * s + 0.25e0 * (kurtosis - 1) * s * s) / (n_obs - 1)) AS z
        FROM (SELECT *, {bench} AS bench FROM (SELECT *, mean / std AS s FROM moments_table) a) b) c"""


@query("psr", oracle("moments_table", f"SELECT *, prob AS psr FROM ({_probability('0.25e0 / sqrt(12.0e0)')}) d",
                     "config strategy", "psr", "n_obs"))
def psr(t):
    table = inference.probabilistic_sharpe(load(t, "fx_returns"), GROUP, benchmark_sharpe=0.25)
    return table.select(*GROUP, "psr", "n_obs")


DSR_BENCH = """greatest(0.0e0, sqrt((1.0e0 + 0.5e0 * s * s) / (n_obs - 1)) *
   (SELECT v.m FROM (VALUES {values}) v(k, m) WHERE v.k = trials))""".format(values=maxima(40))


@query("dsr", oracle("moments_table", f"SELECT *, prob AS dsr FROM ({_probability(DSR_BENCH)}) d",
                     "config strategy", "dsr bench", "trials").replace(" AS bench,", " AS bench,"))
def dsr(t):
    rows = load(t, "fx_returns")
    trials = rows.groupBy(*GROUP).agg((F.count("*") % 40 + 1).alias("trials"))
    table = inference.deflated_sharpe(rows, trials, GROUP)
    return table.select(*GROUP, "trials", F.col("benchmark").alias("bench"), "dsr")


@query(
    "jobson_korkie",
    oracle(
        "active_rows",
        f"""SELECT *, 2 * ({cdf('(-abs(z))')}) AS p FROM (
              SELECT config, strategy, n_obs, sa - sb AS difference,
                     (sa - sb) / sqrt((2 - 2 * rho + 0.5e0 * (sa*sa + sb*sb - 2*sa*sb*rho*rho)) / n_obs) AS z
              FROM (SELECT config, strategy, count(*) AS n_obs, avg(net_return) / stddev_samp(net_return) AS sa,
                           avg(benchmark_return) / stddev_samp(benchmark_return) AS sb,
                           corr(net_return, benchmark_return) AS rho
                    FROM active_rows GROUP BY 1, 2) a) b""",
        "config strategy", "difference z p", "n_obs",
    ),
)
def jobson_korkie(t):
    return inference.sharpe_difference(load(t, "fx_returns"), load(t, "fx_benchmark"), GROUP)


DRAWS, BLOCK, SEED = 1000, 8, 20260625


def _draws(replicates: int) -> str:
    return f"""
SELECT d.config, d.strategy, d.replicate, d.pos, d.source_pos, v.r AS net_return FROM (
  SELECT p.config, p.strategy, s.replicate, p.pos,
         (('0x' || substr(md5('{SEED}|' || s.replicate || '|' || (p.pos // {BLOCK})), 1, 8))::BIGINT % p.n
          + p.pos % {BLOCK}) % p.n AS source_pos
  FROM placed p, (SELECT unnest(range({replicates})) AS replicate) s) d
JOIN placed v ON v.config = d.config AND v.strategy = d.strategy AND v.pos = d.source_pos"""


VIEWS.add(
    "placed",
    """SELECT config, strategy, net_return AS r,
              row_number() OVER (PARTITION BY config, strategy ORDER BY return_date) - 1 AS pos,
              count(*) OVER (PARTITION BY config, strategy) AS n FROM fx_returns""",
    "fx_returns",
)


@query(
    "bootstrap_panel",
    oracle("placed", _draws(DRAWS), "config strategy", "net_return", "replicate pos source_pos"),
)
def bootstrap_panel(t):
    return inference.bootstrap_panel(load(t, "fx_returns"), GROUP, DRAWS, BLOCK, SEED)


INTERVALS = f"""
SELECT config, strategy, count(*) AS usable_draws,
       quantile_cont(sharpe, 0.05) AS sharpe_lo, quantile_cont(sharpe, 0.95) AS sharpe_hi,
       quantile_cont(sortino, 0.05) AS sortino_lo, quantile_cont(sortino, 0.95) AS sortino_hi
FROM (SELECT config, strategy, replicate, avg(net_return) * sqrt(12.0e0) / stddev_samp(net_return) AS sharpe,
             avg(net_return) * sqrt(12.0e0) / sqrt(avg(pow(least(net_return, 0), 2))) AS sortino,
             min(net_return) AS low
      FROM ({_draws(DRAWS)}) p GROUP BY 1, 2, 3) q WHERE low > -1 GROUP BY 1, 2"""


@query(
    "bootstrap_ci",
    oracle("placed", INTERVALS, "config strategy", "sharpe_lo sharpe_hi sortino_lo sortino_hi", "usable_draws"),
)
def bootstrap_ci(t):
    return inference.bootstrap_intervals(
        load(t, "fx_returns"), GROUP, replicates=DRAWS, block_size=BLOCK, seed=SEED
    )


RESAMPLED = f"""
WITH base AS (SELECT *, 1.0e0 + net_return AS g FROM ({_draws(DRAWS)}) p),
run AS (SELECT *, CASE WHEN min(g) OVER w <= 0 THEN 0.0e0 ELSE product(g) OVER w END AS wealth,
               min(g) OVER w <= 0 AS ruined FROM base
        WINDOW w AS (PARTITION BY config, strategy, replicate ORDER BY pos ROWS UNBOUNDED PRECEDING)),
dip AS (SELECT *, CASE WHEN ruined THEN -1.0e0 ELSE wealth / greatest(1.0e0, max(wealth) OVER w) - 1 END AS d
        FROM run WINDOW w AS (PARTITION BY config, strategy, replicate ORDER BY pos ROWS UNBOUNDED PRECEDING)),
per AS (SELECT config, strategy, replicate, bool_or(ruined) AS defaulted, min(d) AS dd,
               CASE WHEN bool_or(ruined) THEN 0.0e0 ELSE product(g) END AS tw,
               CASE WHEN bool_or(ruined) THEN NULL ELSE avg(net_return) * sqrt(12.0e0) / stddev_samp(net_return) END AS sharpe
        FROM dip GROUP BY 1, 2, 3),
stat AS (SELECT config, strategy, count(*) AS paths, avg(defaulted::INT::DOUBLE) AS default_share,
       min(tw) AS minimum_terminal_wealth, quantile_cont(sharpe, 0.05) AS sharpe_p05,
       quantile_cont(sharpe, 0.5) AS sharpe_p50, quantile_cont(dd, 0.05) AS drawdown_p05,
       quantile_cont(dd, 0.5) AS drawdown_p50 FROM per GROUP BY 1, 2)
SELECT *, CASE WHEN default_share > 0 OR minimum_terminal_wealth <= 0 THEN 'fail_default'
               WHEN sharpe_p05 > 0 THEN 'pass' WHEN sharpe_p50 > 0 THEN 'mixed' ELSE 'fail_sharpe' END AS status
FROM stat"""
RESAMPLED_REAL = "default_share minimum_terminal_wealth sharpe_p05 sharpe_p50 drawdown_p05 drawdown_p50"


def _resampled(t):
    table = inference.resampled_paths(load(t, "fx_returns"), GROUP, DRAWS, BLOCK, SEED)
    return table.withColumn("status", validation_status())


@query("mc_resample", oracle("placed", RESAMPLED, "config strategy status", RESAMPLED_REAL, "paths"))
def mc_resample(t):
    return _resampled(t)


@query(
    "validation_status",
    oracle(
        "path_table",
        """SELECT config, n, p05, p50, share, low,
                  CASE WHEN config = 'BUILDING' THEN 'fail_infeasible' WHEN share > 0 OR low <= 0 THEN 'fail_default'
                       WHEN p05 > 0 THEN 'pass' WHEN p50 > 0 THEN 'mixed' ELSE 'fail_sharpe' END AS status
           FROM (SELECT config, count(*) AS n, avg(defaulted::INT::DOUBLE) AS share, min(terminal_wealth) AS low,
                        quantile_cont(sharpe, 0.05) AS p05, quantile_cont(sharpe, 0.5) AS p50
                 FROM path_table GROUP BY 1) s""",
        "config status", "p05 p50 share low", "n",
    ),
)
def validation_status_query(t):
    from premia.operators.paths import return_moments
    from premia.operators.ranks import exact_quantiles

    table = return_moments(load(t, "fx_returns"), GROUP)
    spread = table.groupBy("config").agg(
        F.count("*").alias("n"),
        F.avg(F.col("defaulted").cast("double")).alias("share"),
        F.min("terminal_wealth").alias("low"),
    )
    cuts = exact_quantiles(table, ["config"], "sharpe", {"p05": 0.05, "p50": 0.5}).drop("size")
    status = validation_status("p05", "p50", "share", "low", F.col("config") != "BUILDING")
    return spread.join(cuts, "config", "left").withColumn("status", status)
