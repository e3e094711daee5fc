"""Queries on cross-validation, overfitting and statuses."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from premia.operators import paths, validation as ops
from premia.plans.inputs import load, view
from premia.plans.registry import VIEWS, oracle, query
from premia.session import written

GROUP = ["config", "strategy"]
BLOCKS, PBO_BLOCKS, HOLD, EMBARGO = 12, 13, 40, 2

view(
    "fx_labels",
    f"SELECT config, strategy, return_date, CAST(return_date + INTERVAL '{HOLD}' DAY AS DATE) AS label_end, net_return FROM {{fx_returns}}",
    "fx_returns",
)


def _pairs(count: int) -> str:
    return ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(combinations(range(count), 2)))


VIEWS.add(
    "cv_blocks",
    f"""SELECT *, ntile({BLOCKS}) OVER w - 1 AS block, row_number() OVER w - 1 AS pos FROM fx_labels
        WINDOW w AS (PARTITION BY config, strategy ORDER BY return_date)""",
    "fx_labels",
)
VIEWS.add(
    "cv_bounds",
    """SELECT config, strategy, block, min(return_date) AS d0, max(label_end) AS d1, min(pos) AS p0, max(pos) AS p1
       FROM cv_blocks GROUP BY 1, 2, 3""",
    "cv_blocks",
)
VIEWS.add(
    "cv_rows",
    f"""SELECT r.config, r.strategy, r.return_date, r.net_return, r.block, h.split_id,
               CASE WHEN r.block IN (h.a, h.b) THEN 'test'
                    WHEN (r.return_date <= x.d1 AND r.label_end >= x.d0) OR (r.return_date <= y.d1 AND r.label_end >= y.d0) THEN 'purged'
                    WHEN r.pos BETWEEN x.p0 - {EMBARGO} AND x.p1 + {EMBARGO} OR r.pos BETWEEN y.p0 - {EMBARGO} AND y.p1 + {EMBARGO} THEN 'embargo'
                    ELSE 'train' END AS role
        FROM cv_blocks r CROSS JOIN (VALUES {_pairs(BLOCKS)}) h(split_id, a, b)
        JOIN cv_bounds x ON x.config = r.config AND x.strategy = r.strategy AND x.block = h.a
        JOIN cv_bounds y ON y.config = r.config AND y.strategy = r.strategy AND y.block = h.b""",
    "cv_blocks", "cv_bounds",
)


def splits(t):
    return ops.cpcv_splits(load(t, "fx_labels"), GROUP, BLOCKS, EMBARGO)


@query(
    "cpcv_splits",
    oracle("cv_rows", "SELECT * FROM cv_rows", "config strategy return_date role", "", "split_id block"),
)
def cpcv_splits(t):
    return splits(t).select(*GROUP, "return_date", "role", "split_id", "block")


@query(
    "purge_overlap",
    oracle(
        "cv_blocks cv_bounds",
        """SELECT r.config, r.strategy, r.return_date, r.label_end FROM cv_blocks r WHERE NOT EXISTS (
             SELECT 1 FROM cv_bounds b WHERE b.config = r.config AND b.strategy = r.strategy AND b.block IN (3, 7)
               AND r.return_date <= b.d1 AND r.label_end >= b.d0)""",
        "config strategy return_date label_end",
    ),
)
def purge_overlap(t):
    blocks = ops.time_blocks(load(t, "fx_labels"), GROUP, BLOCKS)
    test = ops.block_bounds(blocks, GROUP, "return_date", "label_end").where("block IN (3, 7)")
    train = load(t, "fx_labels").select(*GROUP, "return_date", "label_end")
    return ops.purge_overlap(train, test.select(*GROUP, "from_date", "to_date"), GROUP, "return_date", "label_end")


VIEWS.add(
    "cv_paths",
    """SELECT r.config, r.strategy, p.path_id, r.split_id, r.return_date, r.net_return * sign(m.mean) AS net_return FROM cv_rows r
       JOIN (SELECT config, strategy, split_id, avg(net_return) AS mean FROM cv_rows WHERE role = 'train' GROUP BY 1, 2, 3) m
         ON m.config = r.config AND m.strategy = r.strategy AND m.split_id = r.split_id
       JOIN (SELECT DISTINCT split_id, block, dense_rank() OVER (PARTITION BY block ORDER BY split_id) - 1 AS path_id
             FROM cv_rows WHERE role = 'test') p ON p.split_id = r.split_id AND p.block = r.block
       WHERE r.role = 'test'""",
    "cv_rows",
)


@query(
    "cpcv_paths",
    oracle("cv_paths", "SELECT * FROM cv_paths", "config strategy return_date", "net_return", "path_id split_id"),
)
def cpcv_paths(t):
    return ops.cpcv_paths(written(splits(t), "splits"), GROUP, BLOCKS)


VIEWS.add(
    "cv_summary",
    """SELECT config, paths, default_share, minimum_terminal_wealth, CASE WHEN default_share > 0 THEN NULL ELSE a END AS sharpe_p05,
              CASE WHEN default_share > 0 THEN NULL ELSE b END AS sharpe_p50, CASE WHEN default_share > 0 THEN NULL ELSE c END AS sharpe_p95,
              CASE WHEN default_share > 0 THEN 'fail_default' ELSE 'survived' END AS status FROM (
         SELECT config, count(*) AS paths, avg(ruined::INT::DOUBLE) AS default_share, min(tw) AS minimum_terminal_wealth,
                quantile_cont(sharpe, 0.05) AS a, quantile_cont(sharpe, 0.5) AS b, quantile_cont(sharpe, 0.95) AS c FROM (
           SELECT config, strategy, path_id, min(net_return) <= -1 AS ruined,
                  CASE WHEN min(net_return) <= -1 THEN 0 ELSE product(1 + net_return) END AS tw,
                  CASE WHEN min(net_return) > -1 THEN avg(net_return) * sqrt(12.0e0) / stddev_samp(net_return) END AS sharpe
           FROM cv_paths GROUP BY 1, 2, 3) s GROUP BY 1) u""",
    "cv_paths",
)


@query(
    "cpcv_summary",
    oracle("cv_summary", "SELECT * FROM cv_summary", "config status",
           "default_share minimum_terminal_wealth sharpe_p05 sharpe_p50 sharpe_p95", "paths"),
)
def cpcv_summary(t):
    made = written(ops.cpcv_paths(written(splits(t), "splits"), GROUP, BLOCKS), "paths")
    return ops.cpcv_summary(made, GROUP, ["config"])


VIEWS.add(
    "io_sharpes",
    f"""SELECT b.config, b.strategy, h.split_id,
               avg(r) FILTER (WHERE block NOT IN (h.a, h.b)) / stddev_samp(r) FILTER (WHERE block NOT IN (h.a, h.b)) AS in_sharpe,
               avg(r) FILTER (WHERE block IN (h.a, h.b)) / stddev_samp(r) FILTER (WHERE block IN (h.a, h.b)) AS out_sharpe
        FROM (SELECT config, strategy, net_return AS r, ntile({PBO_BLOCKS}) OVER (PARTITION BY config, strategy ORDER BY return_date) - 1 AS block
              FROM fx_returns) b CROSS JOIN (VALUES {_pairs(PBO_BLOCKS)}) h(split_id, a, b)
        GROUP BY 1, 2, 3""",
    "fx_returns",
)
VIEWS.add(
    "io_ranks",
    """SELECT *, rank() OVER (PARTITION BY config, split_id ORDER BY in_sharpe)
                 + (count(*) OVER (PARTITION BY config, split_id, in_sharpe) - 1) / 2.0e0 AS in_rank,
              rank() OVER (PARTITION BY config, split_id ORDER BY out_sharpe)
                 + (count(*) OVER (PARTITION BY config, split_id, out_sharpe) - 1) / 2.0e0 AS out_rank FROM io_sharpes""",
    "io_sharpes",
)


def ranks(t):
    sharpes = ops.in_out_sharpes(load(t, "fx_returns"), "config", "strategy", PBO_BLOCKS)
    return ops.in_out_ranks(written(sharpes, "sharpes"), "config")


@query(
    "in_out_rank",
    oracle("io_ranks", "SELECT * FROM io_ranks", "config strategy", "in_sharpe out_sharpe in_rank out_rank", "split_id"),
)
def in_out_rank(t):
    return ranks(t)


@query(
    "pbo",
    oracle(
        "io_ranks",
        """SELECT l.*, c.rank_correlation FROM (
             SELECT config, count(*) AS splits, max(n) AS strategies, avg((logit < 0)::INT::DOUBLE) AS pbo, quantile_cont(logit, 0.5) AS median_logit
             FROM (SELECT config, split_id, n, ln((out_rank / (n + 1)) / (1 - out_rank / (n + 1))) AS logit FROM (
                     SELECT *, count(out_sharpe) OVER (PARTITION BY config, split_id) AS n,
                            row_number() OVER (PARTITION BY config, split_id ORDER BY in_rank DESC, strategy DESC) AS k FROM io_ranks) a WHERE k = 1) b
             GROUP BY 1) l JOIN (SELECT config, corr(in_rank, out_rank) AS rank_correlation FROM io_ranks GROUP BY 1) c ON c.config = l.config""",
        "config", "pbo median_logit rank_correlation", "splits strategies",
    ),
)
def pbo(t):
    return ops.overfitting_probability(written(ranks(t), "ranks"), "config", "strategy")


view(
    "fx_checks",
    """
SELECT s.config, k.name AS "check", s.mean * k.a + k.b AS primary_value, s.top * k.a AS secondary_value FROM
  (SELECT config, avg(net_return) AS mean, max(net_return) AS top FROM {fx_returns} GROUP BY 1) s
CROSS JOIN (SELECT 'MC refit' AS name, 1.0e0 AS a, 0.0e0 AS b UNION ALL SELECT 'MC resample', 1.0e0, 0.003e0
  UNION ALL SELECT 'Repriced', -1.0e0, 0.0e0 UNION ALL SELECT 'Rolling OOS', 1.0e0, 0.001e0 UNION ALL SELECT 'PBO rank', 20.0e0, 0.33e0
  UNION ALL SELECT 'Claim CPCV', 0.0e0, 0.0e0 UNION ALL SELECT 'Liquid CPCV', 0.0e0, 0.0e0) k
""".replace('"check"', "check_name"),
    "fx_returns",
)
view(
    "fx_path_status",
    """
SELECT config, 'liquid_era_2018_plus' AS scope, CASE WHEN min(net_return) <= -1 THEN 'fail_default' ELSE 'survived' END AS status
FROM {fx_returns} GROUP BY 1
UNION ALL SELECT config, 'claim_window_2020_plus', CASE WHEN avg(net_return) <= 0 THEN 'fail_sharpe' ELSE 'survived' END
FROM {fx_returns} GROUP BY 1
""",
    "fx_returns",
)


@query(
    "robustness_status",
    oracle(
        "fx_checks fx_path_status",
        """SELECT c.config, c.check_name, c.primary_value, c.secondary_value, CASE
             WHEN c.check_name IN ('MC refit', 'MC resample', 'Repriced') THEN CASE WHEN primary_value > 0 THEN 'pass' WHEN secondary_value > 0 THEN 'mixed' ELSE 'fail' END
             WHEN c.check_name = 'Rolling OOS' THEN CASE WHEN primary_value > 0 THEN 'pass' ELSE 'fail' END
             WHEN c.check_name = 'PBO rank' THEN CASE WHEN primary_value <= 0.30e0 THEN 'pass' WHEN primary_value <= 0.50e0 THEN 'mixed' ELSE 'fail' END
             ELSE (SELECT CASE WHEN p.status = 'survived' THEN 'pass' ELSE p.status END FROM fx_path_status p WHERE p.config = c.config
                   AND p.scope = CASE WHEN c.check_name = 'Liquid CPCV' THEN 'liquid_era_2018_plus' ELSE 'claim_window_2020_plus' END) END AS status
           FROM fx_checks c""",
        "config check_name status", "primary_value secondary_value",
    ),
)
def robustness_status(t):
    checks = load(t, "fx_checks").withColumnRenamed("check_name", "check")
    table = ops.with_robustness_status(checks, load(t, "fx_path_status"))
    return table.withColumnRenamed("check", "check_name")


@query(
    "scoreboard",
    oracle(
        "path_table",
        """SELECT *, edge_vs_best_naive > 0 AS beats_best_naive, edge_vs_stock > 0 AS beats_stock FROM (
             SELECT *, net_sharpe - best_naive_sharpe AS edge_vs_best_naive, net_sharpe - stock_sharpe AS edge_vs_stock FROM (
               SELECT config, max(raw_sharpe) FILTER (WHERE strategy = '1-URGENT') AS net_sharpe,
                      max(raw_sharpe) FILTER (WHERE strategy = '5-LOW') AS stock_sharpe,
                      max(raw_sharpe) FILTER (WHERE strategy NOT IN ('1-URGENT', '5-LOW')) AS best_naive_sharpe,
                      arg_max(strategy, raw_sharpe) FILTER (WHERE strategy NOT IN ('1-URGENT', '5-LOW')) AS best_naive_strategy
               FROM path_table GROUP BY 1) a) b""",
        "config best_naive_strategy beats_best_naive beats_stock",
        "net_sharpe stock_sharpe best_naive_sharpe edge_vs_best_naive edge_vs_stock",
    ),
)
def scoreboard(t):
    table = paths.return_moments(load(t, "fx_returns"), GROUP)
    scores = table.select(
        *GROUP, F.try_divide("annualized_mean_return", "annualized_volatility").alias("net_sharpe")
    )
    return ops.scoreboard(scores, "1-URGENT", "5-LOW")
