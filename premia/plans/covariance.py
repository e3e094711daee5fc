"""Queries on joint moments and book volatility."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.operators import covariance as ops
from premia.plans.inputs import load, view
from premia.plans.registry import VIEWS, oracle, query
from premia.session import written

ERA = "CASE WHEN period < DATE '1998-07-01' THEN 'early' ELSE 'late' END AS universe_id"
view("fx_option_panel", f"SELECT {ERA}, period, label, ret FROM {{fx_panel}}", "fx_panel")
view("fx_factor_panel", f"SELECT {ERA}, period, label, ret FROM {{fx_factors}}", "fx_factors")
view(
    "fx_era_loadings",
    """SELECT 'early' AS universe_id, contract_id, factor, loading FROM {fx_loadings}
       UNION ALL SELECT 'late', contract_id, factor, 0.8e0 * loading FROM {fx_loadings}""",
    "fx_loadings",
)
view(
    "fx_era_books",
    """SELECT CASE WHEN book_id % 2 = 0 THEN 'early' ELSE 'late' END AS universe_id, book_id, contract_id, weight
       FROM {fx_label_books}""",
    "fx_label_books",
)

VIEWS.add(
    "complete_periods",
    """SELECT o.universe_id, o.period FROM
         (SELECT universe_id, period, count(*) n FROM fx_option_panel GROUP BY 1, 2) o
       JOIN (SELECT universe_id, period, count(*) n FROM fx_factor_panel GROUP BY 1, 2) f
         ON o.universe_id = f.universe_id AND o.period = f.period
       WHERE o.n = (SELECT count(DISTINCT contract_id) FROM fx_loadings)
         AND f.n = (SELECT count(DISTINCT factor) FROM fx_loadings)""",
    "fx_option_panel", "fx_factor_panel", "fx_loadings",
)
VIEWS.add(
    "states",
    """SELECT p.universe_id, p.period, p.label, p.ret - avg(p.ret) OVER (PARTITION BY p.universe_id, p.label) AS x
       FROM fx_factor_panel p JOIN complete_periods c ON c.universe_id = p.universe_id AND c.period = p.period""",
    "complete_periods",
)
VIEWS.add(
    "option_rows",
    """SELECT p.universe_id, p.period, p.label, p.ret - avg(p.ret) OVER (PARTITION BY p.universe_id, p.label) AS x
       FROM fx_option_panel p JOIN complete_periods c ON c.universe_id = p.universe_id AND c.period = p.period""",
    "complete_periods",
)
VIEWS.add(
    "fitted",
    """SELECT s.universe_id, s.period, b.contract_id AS label, sum(s.x * b.loading) AS fit
       FROM states s JOIN fx_era_loadings b ON b.universe_id = s.universe_id AND b.factor = s.label
       GROUP BY 1, 2, 3""",
    "states", "fx_era_loadings",
)
VIEWS.add(
    "joint_rows",
    """SELECT *, x / s AS y FROM (SELECT *, stddev_samp(x) OVER (PARTITION BY universe_id, role, label) AS s FROM (
         SELECT universe_id, period, 0 AS role, label, x FROM states
         UNION ALL SELECT o.universe_id, o.period, 1, o.label, o.x - f.fit FROM option_rows o JOIN fitted f
           ON f.universe_id = o.universe_id AND f.period = o.period AND f.label = o.label) j) k""",
    "states", "option_rows", "fitted",
)
VIEWS.add(
    "products",
    """SELECT a.universe_id, a.role AS row_role, a.label AS row_label, b.role AS col_role, b.label AS col_label,
              sum(a.y * b.y) AS total, sum(a.x * b.x) AS raw, count(*) AS n_obs, any_value(a.s * b.s) AS ss
       FROM joint_rows a JOIN joint_rows b ON a.universe_id = b.universe_id AND a.period = b.period
        AND (a.role < b.role OR (a.role = b.role AND a.label <= b.label)) GROUP BY 1, 2, 3, 4, 5""",
    "joint_rows",
)
VIEWS.add(
    "lw_stats",
    """SELECT *, CASE WHEN delta <= 0 THEN 0 ELSE least(greatest(beta, 0), delta) / delta END AS shrinkage FROM (
       SELECT *, (bsum / n_obs - dsum) / (n_columns * n_obs) AS beta,
              (dsum - 2 * target_scale * tr + n_columns * target_scale * target_scale) / n_columns AS delta FROM (
       SELECT n.universe_id, n.n_obs, n.n_columns, n.bsum, n.tsum / n.n_obs AS tr, n.tsum / n.n_obs / n.n_columns AS target_scale,
              (SELECT sum(CASE WHEN p.row_role = p.col_role AND p.row_label = p.col_label THEN 1 ELSE 2 END
                          * p.total * p.total) / (n.n_obs * n.n_obs) FROM products p WHERE p.universe_id = n.universe_id) AS dsum
       FROM (SELECT universe_id, count(*) AS n_obs, max(q) AS n_columns, sum(norm * norm) AS bsum, sum(norm) AS tsum
             FROM (SELECT universe_id, period, sum(y * y) AS norm, count(*) AS q FROM joint_rows GROUP BY 1, 2) z
             GROUP BY 1) n) m) l""",
    "products",
)
VIEWS.add(
    "shrunk_moments",
    """SELECT p.universe_id, CASE WHEN col_role = 0 THEN 'factor_cov' WHEN row_role = 1 THEN 'residual_cov'
                ELSE 'factor_residual_cov' END AS block, row_label, col_label,
              ((1 - l.shrinkage) * total / l.n_obs + CASE WHEN row_role = col_role AND row_label = col_label
                THEN l.shrinkage * l.target_scale ELSE 0 END) * ss AS value, l.n_obs
       FROM products p JOIN lw_stats l ON l.universe_id = p.universe_id""",
    "lw_stats",
)


def _inputs(t):
    """The three long inputs, each written once: they are read several times below."""

    names = ("fx_option_panel", "fx_factor_panel", "fx_era_loadings")
    return tuple(written(load(t, name), name) for name in names)


def joint(t):
    """Standardized joint rows, T x (k + n) per universe, written once."""

    return written(ops.standardized(ops.joint_observations(*_inputs(t))), "joint")


@query(
    "panel_intersect",
    oracle("complete_periods", "SELECT * FROM complete_periods", "universe_id period"),
)
def panel_intersect(t):
    options, factors, loadings = _inputs(t)
    return ops.panel_intersect(
        options,
        factors,
        loadings.select("universe_id", F.col("contract_id").alias("label")).distinct(),
        loadings.select("universe_id", F.col("factor").alias("label")).distinct(),
    )


@query(
    "loadings_apply",
    oracle(
        "fx_factor_panel fx_era_loadings",
        """SELECT s.universe_id, s.period, b.contract_id AS label, sum(s.ret * b.loading) AS ret
           FROM fx_factor_panel s JOIN fx_era_loadings b ON b.universe_id = s.universe_id AND b.factor = s.label
           GROUP BY 1, 2, 3""",
        "universe_id period label", "ret",
    ),
)
def loadings_apply(t):
    return ops.loadings_apply(load(t, "fx_factor_panel"), load(t, "fx_era_loadings"))


@query(
    "gram",
    oracle("products", "SELECT * FROM products", "universe_id row_label col_label", "total", "row_role col_role"),
)
def gram(t):
    return ops.gram(joint(t), tiles=2)


@query(
    "ledoit_wolf_stats",
    oracle("lw_stats", "SELECT * FROM lw_stats", "universe_id", "target_scale beta delta shrinkage", "n_obs n_columns"),
)
def ledoit_wolf_stats(t):
    rows = joint(t)
    return ops.shrinkage_statistics(rows)


@query(
    "joint_moments",
    oracle("shrunk_moments", "SELECT * FROM shrunk_moments", "universe_id block row_label col_label", "value", "n_obs", 9),
    value=9,
)
def joint_moments(t):
    return ops.joint_moments(*_inputs(t)).drop("estimator")


# Without regularization the assembled covariance is the plain sample covariance.
@query(
    "option_covariance",
    oracle(
        "option_rows",
        """SELECT a.universe_id, a.label AS row_label, b.label AS col_label, sum(a.x * b.x) / (count(*) - 1) AS value
           FROM option_rows a JOIN option_rows b ON a.universe_id = b.universe_id AND a.period = b.period
             AND a.label <= b.label GROUP BY 1, 2, 3""",
        "universe_id row_label col_label", "value", "", 9,
    ),
    value=9,
)
def option_covariance(t):
    options, factors, loadings = _inputs(t)
    moments = ops.joint_moments(options, factors, loadings, regularize=False)
    return ops.option_covariance(moments, loadings)


VIEWS.add(
    "label_cov",
    """SELECT a.universe_id, a.label AS row_label, b.label AS col_label, covar_samp(a.ret, b.ret) AS value
       FROM fx_option_panel a JOIN fx_option_panel b ON a.universe_id = b.universe_id AND a.period = b.period
       GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "fx_option_panel",
)


def label_covariance(t):
    """Covariance of the option panel's labels over their complete periods (full matrix)."""

    panel = written(load(t, "fx_option_panel"), "panel")
    labels = panel.select("universe_id", "label").distinct()
    periods = ops.panel_intersect(panel, panel, labels, labels)
    rows = ops.centred(panel.join(periods, ["universe_id", "period"], "left_semi"))
    n = periods.groupBy("universe_id").agg(F.count("*").alias("_n"))
    upper = (
        ops.gram(rows.select("universe_id", "period", F.lit(1).alias("role"), "label", F.col("ret").alias("y")))
        .join(n, "universe_id")
        .select("universe_id", "row_label", "col_label", (F.col("total") / (F.col("_n") - 1)).alias("value"))
    )
    lower = upper.where("row_label <> col_label").select(
        "universe_id", F.col("col_label").alias("row_label"), F.col("row_label").alias("col_label"), "value"
    )
    return upper.unionByName(lower)


VIEWS.add(
    "complete_label_cov",
    """SELECT a.universe_id, a.label AS row_label, b.label AS col_label, covar_samp(a.ret, b.ret) AS value
       FROM fx_option_panel a JOIN fx_option_panel b ON a.universe_id = b.universe_id AND a.period = b.period
       JOIN (SELECT universe_id, period FROM fx_option_panel GROUP BY 1, 2
             HAVING count(*) = (SELECT count(DISTINCT label) FROM fx_option_panel)) c
         ON c.universe_id = a.universe_id AND c.period = a.period
       GROUP BY 1, 2, 3""",
    "fx_option_panel",
)


@query(
    "diagonal_shrink",
    oracle(
        "complete_label_cov",
        "SELECT * REPLACE (CASE WHEN row_label = col_label THEN value ELSE 0.9e0 * value END AS value) FROM complete_label_cov",
        "universe_id row_label col_label", "value", "", 9,
    ),
    value=9,
)
def diagonal_shrink(t):
    return ops.diagonal_shrink(label_covariance(t), 0.10)


FACTOR_COV = """
SELECT universe_id, 'r_' || row_label AS row_label, 'r_' || col_label AS col_label, value FROM complete_label_cov
UNION ALL SELECT universe_id, 'r2_' || row_label, 'r2_' || col_label, 2.0e0 * value * value FROM complete_label_cov
UNION ALL SELECT universe_id, 'dv_' || row_label, 'dv_' || col_label, greatest(0.25e0 * value, 1e-8::DOUBLE)
  FROM complete_label_cov WHERE row_label = col_label
UNION ALL SELECT universe_id, 'r_' || row_label, 'dv_' || col_label, -0.1e0 * value FROM complete_label_cov
UNION ALL SELECT universe_id, 'dv_' || col_label, 'r_' || row_label, -0.1e0 * value FROM complete_label_cov"""
VIEWS.add("factor_cov", FACTOR_COV, "complete_label_cov")


def factor_covariance(t):
    base = label_covariance(t)
    cross = base.withColumn("value", F.col("value") * -0.1)
    return ops.factor_covariance_default(base, spot_vol_cov=cross)


@query(
    "factor_cov_default",
    oracle("factor_cov", "SELECT * FROM factor_cov", "universe_id row_label col_label", "value", "", 9),
    value=9,
)
def factor_cov_default(t):
    return factor_covariance(t)


view(
    "fx_greek_loadings",
    """
SELECT u.universe_id, p.p_brand AS contract_id, f.prefix || p.p_brand AS factor,
       avg(f.scale * ((p.p_partkey % 13) - 5.0e0)) AS loading
FROM {part} p CROSS JOIN (SELECT 'early' AS universe_id UNION ALL SELECT 'late') u
CROSS JOIN (SELECT 'r_' AS prefix, 1.0e0 AS scale UNION ALL SELECT 'r2_', 0.5e0 UNION ALL SELECT 'dv_', 0.2e0) f
GROUP BY 1, 2, 3
""",
)


@query(
    "residual_default",
    oracle(
        "factor_cov fx_greek_loadings",
        """SELECT a.universe_id, a.contract_id, greatest(0.05e0 * sum(a.loading * c.value * b.loading), 1e-8::DOUBLE) AS residual_variance
           FROM factor_cov c JOIN fx_greek_loadings a ON a.universe_id = c.universe_id AND a.factor = c.row_label
           JOIN fx_greek_loadings b ON b.universe_id = c.universe_id AND b.factor = c.col_label AND b.contract_id = a.contract_id
           GROUP BY 1, 2""",
        "universe_id contract_id", "residual_variance", "", 9,
    ),
    residual_variance=9,
)
def residual_default(t):
    return ops.residual_default(load(t, "fx_greek_loadings"), factor_covariance(t))


# Dense check: w' (B Omega B' + B Gamma + Gamma' B' + Sigma) w from the shrunk blocks.
VIEWS.add(
    "book_loads",
    """SELECT universe_id, book_id, 0 AS role, factor AS label, sum(weight * loading) AS e FROM (
         SELECT k.universe_id, k.book_id, b.factor, k.weight, b.loading FROM fx_era_books k
         JOIN fx_era_loadings b ON b.universe_id = k.universe_id AND b.contract_id = k.contract_id) s GROUP BY 1, 2, 3, 4
       UNION ALL SELECT universe_id, book_id, 1, contract_id, weight FROM fx_era_books""",
    "fx_era_books", "fx_era_loadings",
)
VIEWS.add(
    "book_vols",
    """SELECT a.universe_id, a.book_id, sqrt(greatest(sum(CASE WHEN m.block <> 'factor_residual_cov' AND m.row_label = m.col_label
              THEN 1 ELSE 2 END * a.e * b.e * m.value), 0)) AS volatility
       FROM shrunk_moments m
       JOIN book_loads a ON a.universe_id = m.universe_id AND a.label = m.row_label
         AND a.role = CASE WHEN m.block = 'residual_cov' THEN 1 ELSE 0 END
       JOIN book_loads b ON b.universe_id = m.universe_id AND b.book_id = a.book_id AND b.label = m.col_label
         AND b.role = CASE WHEN m.block = 'factor_cov' THEN 0 ELSE 1 END
       GROUP BY 1, 2""",
    "shrunk_moments", "book_loads",
)


def book_volatility_table(t):
    rows = joint(t)
    stats = written(ops.shrinkage_statistics(rows), "shrinkage")
    return ops.book_volatility(load(t, "fx_era_books"), rows, stats, load(t, "fx_era_loadings"))


@query(
    "book_volatility",
    oracle("book_vols", "SELECT * FROM book_vols", "universe_id book_id", "volatility"),
)
def book_volatility(t):
    return book_volatility_table(t)


VIEWS.add(
    "label_means",
    "SELECT universe_id, label AS contract_id, 0.1e0 * avg(ret) AS expected_return FROM fx_option_panel GROUP BY 1, 2",
    "fx_option_panel",
)
VIEWS.add(
    "book_means",
    """SELECT *, CASE WHEN gross_nav >= 0.1e0 AND volatility > 0 THEN expected_return / volatility END AS sharpe FROM (
         SELECT k.universe_id, k.book_id, sum(k.weight * m.expected_return) AS expected_return, sum(abs(k.weight)) AS gross_nav,
                sum(k.weight) AS net_nav, any_value(v.volatility) AS volatility
         FROM fx_era_books k JOIN label_means m ON m.universe_id = k.universe_id AND m.contract_id = k.contract_id
         JOIN book_vols v ON v.universe_id = k.universe_id AND v.book_id = k.book_id GROUP BY 1, 2) s""",
    "book_vols", "label_means",
)


def label_means(t):
    return (
        load(t, "fx_option_panel")
        .groupBy("universe_id", F.col("label").alias("contract_id"))
        .agg((F.avg("ret") * 0.1).alias("expected_return"))
    )


def book_table(t):
    return ops.book_returns(
        load(t, "fx_era_books"), label_means(t), book_volatility_table(t), F.col("gross_nav") >= 0.1
    )


@query(
    "book_return",
    oracle("book_means", "SELECT * FROM book_means", "universe_id book_id",
           "expected_return gross_nav net_nav volatility sharpe"),
)
def book_return(t):
    return book_table(t)


view(
    "fx_matrix",
    """
SELECT a.config, a.strategy AS row_label, b.strategy AS col_label,
       avg(a.gross_nav * b.gross_nav)
         + CASE WHEN a.config = 'BUILDING' AND a.strategy < b.strategy THEN 0.01e0 ELSE 0.0e0 END AS value
FROM {fx_returns} a JOIN {fx_returns} b ON a.config = b.config AND a.return_date = b.return_date
WHERE NOT (a.config = 'MACHINERY' AND a.strategy = '1-URGENT' AND b.strategy = '5-LOW')
GROUP BY 1, 2, 3
""",
    "fx_returns",
)


@query(
    "moment_check",
    oracle(
        "fx_matrix",
        """SELECT a.config, a.row_label AS low_label, a.col_label AS high_label, 'not_symmetric' AS reason
           FROM fx_matrix a JOIN fx_matrix b ON a.config = b.config AND a.row_label = b.col_label AND a.col_label = b.row_label
           WHERE a.row_label < a.col_label AND abs(a.value - b.value) > 1e-10 + 1e-5 * abs(b.value)
           UNION ALL SELECT a.config, least(a.row_label, a.col_label), greatest(a.row_label, a.col_label), 'missing_cell'
           FROM fx_matrix a WHERE NOT EXISTS (SELECT 1 FROM fx_matrix b WHERE b.config = a.config
             AND b.row_label = a.col_label AND b.col_label = a.row_label)""",
        "config low_label high_label reason",
    ),
)
def moment_check(t):
    return ops.moment_check(load(t, "fx_matrix"), ["config"])
