"""Joint factor and residual covariance over long panels.

All tables carry ``universe_id``; a universe is one decision's training window. Rows are
(universe_id, period, label, value). A book's volatility needs no label products at all; ``gram`` (for users who want the matrix) multiplies numpy tiles of
(period block x label tile) and sums the small products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import finite
from premia.session import written

U = "universe_id"
TINY_SCALE = 1e-14
#: Slots of a book that are summed side by side.
TILE = 64


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], salts: int = 8
) -> DataFrame:
    """Inner many-to-many join whose few keys are spread over ``salts`` tasks each.

    Left rows of one key are divided by a hash of ``spread_by``; right rows are repeated
    once per salt, so every pair meets exactly once.
    """

    if salts <= 1:
        return left.join(right, on)
    hashed = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        left.withColumn("_salt", hashed)
        .join(right.withColumn("_salt", copies), [*on, "_salt"])
        .drop("_salt")
    )


def panel_intersect(
    options: DataFrame, factors: DataFrame, contracts: DataFrame, factor_labels: DataFrame
) -> DataFrame:
    """Periods where every contract and every factor of the universe has a finite value."""

    def covered(panel: DataFrame, spine: DataFrame, name: str) -> DataFrame:
        have = (
            panel.where(finite("ret").isNotNull())
            .join(spine, [U, "label"], "left_semi")
            .groupBy(U, "period", "label")
            .agg(F.lit(1).alias("_one"))
            .groupBy(U, "period")
            .agg(F.count("*").alias(f"_{name}"))
        )
        need = spine.distinct().groupBy(U).agg(F.count("*").alias(f"_need_{name}"))
        return have.join(need, U).where(F.col(f"_{name}") == F.col(f"_need_{name}")).select(U, "period")

    return covered(options, contracts, "options").join(
        covered(factors, factor_labels, "factors"), [U, "period"]
    )


def centred(panel: DataFrame) -> DataFrame:
    """Subtract each label's mean over its rows."""

    means = panel.groupBy(U, "label").agg(F.avg("ret").alias("_mean"))
    return panel.join(means, [U, "label"]).select(
        U, "period", "label", (F.col("ret") - F.col("_mean")).alias("ret")
    )


def loadings_apply(states: DataFrame, loadings: DataFrame, salts: int = 8) -> DataFrame:
    """States times loadings: (universe, period, contract) -> sum of factor x loading."""

    paired = salted_join(
        states.withColumnRenamed("label", "factor"), loadings, [U, "factor"], ["period"], salts
    )
    return (
        paired.groupBy(U, "period", "contract_id")
        .agg(F.sum(F.col("ret") * F.col("loading")).alias("ret"))
        .withColumnRenamed("contract_id", "label")
    )


def joint_observations(options: DataFrame, factors: DataFrame, loadings: DataFrame) -> DataFrame:
    """Centred factors (role 0) and Greek residuals (role 1) on complete periods."""

    contracts = loadings.select(U, F.col("contract_id").alias("label")).distinct()
    factor_labels = loadings.select(U, F.col("factor").alias("label")).distinct()
    periods = panel_intersect(options, factors, contracts, factor_labels)
    states = centred(
        factors.join(factor_labels, [U, "label"], "left_semi").join(periods, [U, "period"], "left_semi")
    )
    returns = centred(
        options.join(contracts, [U, "label"], "left_semi").join(periods, [U, "period"], "left_semi")
    )
    explained = loadings_apply(states, loadings).withColumnRenamed("ret", "_fit")
    residuals = returns.join(explained, [U, "period", "label"], "left").select(
        U, "period", F.lit(1).alias("role"), "label",
        (F.col("ret") - F.coalesce("_fit", F.lit(0.0))).alias("value"),
    )
    return states.select(
        U, "period", F.lit(0).alias("role"), "label", F.col("ret").alias("value")
    ).unionByName(residuals)


def standardized(joint: DataFrame) -> DataFrame:
    """Add the sample scale of each column and the value divided by it (by 1 if tiny)."""

    scales = joint.groupBy(U, "role", "label").agg(F.stddev_samp("value").alias("scale"))
    divisor = F.when(F.col("scale") > TINY_SCALE, F.col("scale")).otherwise(1.0)
    return joint.join(scales, [U, "role", "label"]).withColumn("y", F.col("value") / divisor)


GRAM_SCHEMA = (
    f"{U} string, row_role int, row_label string, col_role int, col_label string, total double"
)


def gram(
    rows: DataFrame, value: str = "y", tiles: int = 1, block: Column | None = None
) -> DataFrame:
    """Sum over periods of x_i x_j for each label pair (row before column by role, label).

    Work is split by universe, period block and pair of label tiles; each task multiplies
    one dense block and emits one number per pair and block instead of one per period.
    """

    # Defined here so that it travels by value: executors need no copy of this package.
    def _tile_product(rows: pd.DataFrame) -> pd.DataFrame:
        """Products of the label pairs of one tile pair over one block of periods."""

        low, high = int(rows["_low"].iloc[0]), int(rows["_high"].iloc[0])
        wide = rows.pivot(index="period", columns=["role", "label"], values="_x").fillna(0.0)
        wide = wide.sort_index(axis=1)
        tile = rows.drop_duplicates(["role", "label"]).set_index(["role", "label"])["_tile"]
        sides = tile.reindex(wide.columns).to_numpy()
        values = wide.to_numpy()
        first = np.flatnonzero(sides == low)
        second = np.flatnonzero(sides == high)
        product = values[:, first].T @ values[:, second]
        i, j = np.meshgrid(first, second, indexing="ij")
        keep = (i <= j) if low == high else np.ones_like(i, dtype=bool)
        a, b = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
        roles = np.array([key[0] for key in wide.columns])
        labels = np.array([key[1] for key in wide.columns], dtype=object)
        return pd.DataFrame(
            {
                U: rows[U].iloc[0],
                "row_role": roles[a],
                "row_label": labels[a],
                "col_role": roles[b],
                "col_label": labels[b],
                "total": product[keep],
            }
        )

    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    tiled = (
        rows.select(
            U, "period", F.col("role").cast("int").alias("role"), "label", F.col(value).alias("_x")
        )
        .withColumn("_block", F.year("period") if block is None else block)
        .withColumn("_tile", F.pmod(F.xxhash64("role", "label"), F.lit(tiles)).cast("int"))
        .withColumn("_other", other)
        .withColumn("_low", F.least("_tile", "_other"))
        .withColumn("_high", F.greatest("_tile", "_other"))
    )
    products = tiled.groupBy(U, "_block", "_low", "_high").applyInPandas(_tile_product, GRAM_SCHEMA)
    return products.groupBy(U, "row_role", "row_label", "col_role", "col_label").agg(
        F.sum("total").alias("total")
    )


def period_products(rows: DataFrame) -> DataFrame:
    """Dot products of the rows of each pair of periods (first before second) over all labels.

    Their squares sum to the same number as those of the label products, and there are T x T of them
    instead of n x n. A label's series, at most one value a period, is paired with itself
    and summed map-side, so each task sends T x T numbers per universe.
    """

    series = rows.groupBy(U, "role", "label").agg(
        F.sort_array(F.collect_list(F.struct("period", "y"))).alias("_series")
    )
    first = series.select(U, "_series", F.posexplode("_series").alias("_i", "_a"))
    rest = F.slice("_series", F.col("_i") + 1, F.size("_series"))
    both = first.select(U, "_a", F.explode(rest).alias("_b"))
    return both.groupBy(U, F.col("_a.period").alias("first"), F.col("_b.period").alias("second")).agg(
        F.sum(F.col("_a.y") * F.col("_b.y")).alias("dot")
    )


def shrinkage_statistics(rows: DataFrame) -> DataFrame:
    """T, q, target scale and shrinkage intensity of each universe's standardized panel."""

    per_period = rows.groupBy(U, "period").agg(
        F.sum(F.col("y") * F.col("y")).alias("_norm"), F.count("*").alias("_q")
    )
    norms = per_period.groupBy(U).agg(
        F.count("*").alias("n_obs"),
        F.max("_q").alias("n_columns"),
        F.sum(F.col("_norm") * F.col("_norm")).alias("_beta_sum"),
        F.sum("_norm").alias("_trace_sum"),
    )
    twice = F.when(F.col("first") == F.col("second"), 1.0).otherwise(2.0)
    squares = period_products(rows).groupBy(U).agg(F.sum(twice * F.col("dot") * F.col("dot")).alias("_squares"))
    t, q = F.col("n_obs").cast("double"), F.col("n_columns").cast("double")
    return (
        norms.join(squares, U)
        .withColumn("target_scale", F.col("_trace_sum") / t / q)
        .withColumn("_delta_sum", F.col("_squares") / (t * t))
        .withColumn("beta", (F.col("_beta_sum") / t - F.col("_delta_sum")) / (q * t))
        .withColumn(
            "delta",
            (
                F.col("_delta_sum")
                - F.col("target_scale") * (F.col("_trace_sum") / t) * 2.0
                + q * F.col("target_scale") * F.col("target_scale")
            )
            / q,
        )
        .withColumn(
            "shrinkage",
            F.when(F.col("delta") <= 0.0, 0.0).otherwise(
                F.try_divide(
                    F.least(F.greatest(F.col("beta"), F.lit(0.0)), F.col("delta")), F.col("delta")
                )
            ),
        )
        .select(U, "n_obs", "n_columns", "target_scale", "beta", "delta", "shrinkage")
    )


def joint_moments(
    options: DataFrame,
    factors: DataFrame,
    loadings: DataFrame,
    regularize: bool = True,
    tiles: int = 1,
) -> DataFrame:
    """Long joint covariance: block, row_label, col_label, value (upper triangle), n_obs.

    The joint rows (T x (k + n) per universe) and the products feed several aggregates,
    so both are written once to the shared folder.
    """

    joint = written(standardized(joint_observations(options, factors, loadings)), "joint")
    diagonal = (F.col("row_role") == F.col("col_role")) & (F.col("row_label") == F.col("col_label"))
    if regularize:
        products = written(gram(joint, "y", tiles), "products")
        stats = shrinkage_statistics(joint)
        scales = joint.select(U, "role", "label", "scale").distinct()

        def side(prefix: str) -> DataFrame:
            return scales.select(
                U,
                F.col("role").cast("int").alias(f"{prefix}_role"),
                F.col("label").alias(f"{prefix}_label"),
                F.col("scale").alias(f"_{prefix}_scale"),
            )

        value = (
            (1.0 - F.col("shrinkage")) * F.col("total") / F.col("n_obs")
            + F.when(diagonal, F.col("shrinkage") * F.col("target_scale")).otherwise(0.0)
        ) * F.col("_row_scale") * F.col("_col_scale")
        table = (
            products.join(stats, U)
            .join(side("row"), [U, "row_role", "row_label"])
            .join(side("col"), [U, "col_role", "col_label"])
            .withColumn("value", value)
            .withColumn("estimator", F.lit("ledoit_wolf_correlation"))
        )
    else:
        counts = joint.select(U, "period").distinct().groupBy(U).agg(F.count("*").alias("n_obs"))
        table = (
            gram(joint, "value", tiles)
            .join(counts, U)
            .withColumn("value", F.col("total") / (F.col("n_obs") - 1.0))
            .withColumn("estimator", F.lit("sample"))
        )
    block = (
        F.when(F.col("col_role") == 0, "factor_cov")
        .when(F.col("row_role") == 1, "residual_cov")
        .otherwise("factor_residual_cov")
    )
    return table.select(
        U, block.alias("block"), "row_label", "col_label", "value", "n_obs", "estimator"
    )


def _both_triangles(block: DataFrame) -> DataFrame:
    flipped = block.where(F.col("row_label") != F.col("col_label")).select(
        U, F.col("col_label").alias("row_label"), F.col("row_label").alias("col_label"), "value"
    )
    return block.select(U, "row_label", "col_label", "value").unionByName(flipped)


def option_covariance(moments: DataFrame, loadings: DataFrame) -> DataFrame:
    """B Omega B' + B Gamma + Gamma' B' + Sigma, upper triangle of contract pairs."""

    left = loadings.select(
        U, F.col("contract_id").alias("a"), F.col("factor").alias("row_label"), F.col("loading").alias("_la")
    )
    right = loadings.select(
        U, F.col("contract_id").alias("b"), F.col("factor").alias("col_label"), F.col("loading").alias("_lb")
    )
    omega = _both_triangles(moments.where("block = 'factor_cov'"))
    half = (
        omega.join(left, [U, "row_label"])
        .groupBy(U, "a", "col_label")
        .agg(F.sum(F.col("_la") * F.col("value")).alias("_half"))
    )
    systematic = salted_join(half, right, [U, "col_label"], ["a"]).select(
        U, "a", "b", (F.col("_half") * F.col("_lb")).alias("value")
    )
    cross = (
        moments.where("block = 'factor_residual_cov'")
        .join(left, [U, "row_label"])
        .groupBy(U, "a", F.col("col_label").alias("b"))
        .agg(F.sum(F.col("_la") * F.col("value")).alias("value"))
    )
    flipped = cross.select(U, F.col("b").alias("a"), F.col("a").alias("b"), "value")
    own = _both_triangles(moments.where("block = 'residual_cov'")).select(
        U, F.col("row_label").alias("a"), F.col("col_label").alias("b"), "value"
    )
    return (
        systematic.unionByName(cross)
        .unionByName(flipped)
        .unionByName(own)
        .where(F.col("a") <= F.col("b"))
        .groupBy(U, F.col("a").alias("row_label"), F.col("b").alias("col_label"))
        .agg(F.sum("value").alias("value"))
    )


def diagonal_shrink(covariance: DataFrame, shrinkage: float) -> DataFrame:
    """(1 - s) S + s diag(S)."""

    if not 0.0 <= shrinkage <= 1.0:
        raise ValueError("shrinkage must lie between zero and one")
    off = F.col("row_label") != F.col("col_label")
    return covariance.withColumn(
        "value", F.when(off, F.col("value") * (1.0 - shrinkage)).otherwise(F.col("value"))
    )


def factor_covariance_default(
    underlying_cov: DataFrame,
    gamma_cov: DataFrame | None = None,
    volatility_cov: DataFrame | None = None,
    spot_vol_cov: DataFrame | None = None,
) -> DataFrame:
    """Block covariance of (r, r2, dv) factors from complete shock covariances."""

    def named(block: DataFrame, row: str, column: str, value: Column) -> DataFrame:
        return block.select(
            U,
            F.concat(F.lit(row), "row_label").alias("row_label"),
            F.concat(F.lit(column), "col_label").alias("col_label"),
            value.alias("value"),
        )

    value = F.col("value")
    spot = named(underlying_cov, "r_", "r_", value)
    gamma = (
        named(underlying_cov, "r2_", "r2_", value * value * 2.0)
        if gamma_cov is None
        else named(gamma_cov, "r2_", "r2_", value)
    )
    volatility = (
        named(
            underlying_cov.where(F.col("row_label") == F.col("col_label")),
            "dv_",
            "dv_",
            F.greatest(value * 0.25, F.lit(1e-8)),
        )
        if volatility_cov is None
        else named(volatility_cov, "dv_", "dv_", value)
    )
    parts = spot.unionByName(gamma).unionByName(volatility)
    if spot_vol_cov is not None:
        cross = named(spot_vol_cov, "r_", "dv_", value)
        turned = cross.select(
            U, F.col("col_label").alias("row_label"), F.col("row_label").alias("col_label"), "value"
        )
        parts = parts.unionByName(cross).unionByName(turned)
    return parts


def residual_default(loadings: DataFrame, factor_cov: DataFrame) -> DataFrame:
    """Five percent of each contract's systematic variance, at least 1e-8."""

    left = loadings.select(U, "contract_id", F.col("factor").alias("row_label"), F.col("loading").alias("_l"))
    half = (
        factor_cov.join(left, [U, "row_label"])
        .groupBy(U, "contract_id", F.col("col_label").alias("factor"))
        .agg(F.sum(F.col("_l") * F.col("value")).alias("_half"))
    )
    return (
        half.join(loadings, [U, "contract_id", "factor"])
        .groupBy(U, "contract_id")
        .agg(
            F.greatest(F.sum(F.col("_half") * F.col("loading")) * 0.05, F.lit(1e-8)).alias(
                "residual_variance"
            )
        )
    )


def packed_moves(joint: DataFrame, loadings: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per contract and tile: ``_cells``, what a unit of the contract adds to each of ``tile`` slots of a book.

    Slots of ``_kind`` 0 are periods (the contract's own standardized row and its factors' rows, rescaled), those of
    ``_kind`` 1 factors (scaled loadings). ``_own`` is the contract's own scale, on one of its rows.
    """

    def numbered(table: DataFrame, kind: int, by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(U).orderBy(by)) - 1
        return table.select(
            U, by, F.lit(kind).alias("_kind"), F.floor(place / tile).alias("_tile"), (place % tile).alias("_slot")
        )

    states, own = joint.where("role = 0"), joint.where("role = 1")
    periods = numbered(joint.select(U, "period").distinct(), 0, "period")
    scales = states.select(U, F.col("label").alias("factor"), "scale").distinct()
    factors = numbered(scales.select(U, "factor").distinct(), 1, "factor")
    y = F.col("scale") * F.col("y")
    moves = (
        own.select(U, F.col("label").alias("contract_id"), "period", y.alias("_value"))
        .unionByName(
            loadings.join(states.withColumnRenamed("label", "factor"), [U, "factor"]).select(
                U, "contract_id", "period", (F.col("loading") * y).alias("_value")
            )
        )
        .join(periods, [U, "period"])
    )
    scaled = loadings.join(scales, [U, "factor"]).withColumn("_value", F.col("loading") * F.col("scale"))
    place = [U, "contract_id", "_kind", "_tile", "_slot", "_value"]
    alone = own.select(U, F.col("label").alias("contract_id"), F.col("scale").alias("_own")).distinct()
    alone = alone.select(
        U, "contract_id", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tile"), F.lit(0).alias("_slot"),
        F.lit(0.0).alias("_value"), "_own",
    )
    cells = moves.select(*place).unionByName(scaled.join(factors, [U, "factor"]).select(*place))
    slots = [F.coalesce(F.sum(F.when(F.col("_slot") == i, F.col("_value"))), F.lit(0.0)) for i in range(tile)]
    return (
        cells.withColumn("_own", F.lit(None).cast("double"))
        .unionByName(alone)
        .groupBy(U, "contract_id", "_kind", "_tile")
        .agg(F.array(*slots).alias("_cells"), F.max("_own").alias("_own"))
    )


def book_volatility(
    books: DataFrame, joint: DataFrame, stats: DataFrame, loadings: DataFrame, salts: int = 8
) -> DataFrame:
    """Per-period volatility of each book under the shrunk joint covariance, matrix-free.

    With y the standardized rows and v = scale x (B'w, w):
    variance = (1 - rho)/T sum_t (y_t.v)^2 + rho tau sum v^2.

    Books are (universe, book_id, contract_id, weight), a row a contract. What a contract adds to the moves y_t.v and to B'w
    is packed by contract, 64 slots a row, and written once. Books are dealt by id before they meet it, so all slots of a
    book are summed where it lies: its weights move, never a row per book and period. A packed table small
    enough for the engine's own broadcast (contracts x periods numbers) keeps the books in place.
    """

    packed = written(packed_moves(joint, loadings), "moves")
    w = F.col("weight")
    slots = [F.sum(F.col("_cells")[i] * w) for i in range(TILE)]
    square = F.aggregate("_slots", F.lit(0.0), lambda a, b: a + b * b)
    dealt = books.select(U, "book_id", "contract_id", "weight").repartition(U, "book_id")
    sums = (
        salted_join(dealt, packed, [U, "contract_id"], ["book_id"], salts)
        .groupBy(U, "book_id", "_kind", "_tile")
        .agg(F.array(*slots).alias("_slots"), F.coalesce(F.sum(w * w * F.col("_own") * F.col("_own")), F.lit(0.0)).alias("_own"))
        .select(U, "book_id", "_kind", square.alias("_square"), "_own")
        .groupBy(U, "book_id")
        .agg(
            F.sum(F.when(F.col("_kind") == 0, F.col("_square"))).alias("_energy"),
            (F.sum(F.when(F.col("_kind") == 1, F.col("_square")).otherwise(0.0)) + F.sum("_own")).alias("_norm"),
        )
        .where("_energy IS NOT NULL")
    )
    rho = F.col("shrinkage")
    variance = (1.0 - rho) / F.col("n_obs") * F.col("_energy") + rho * F.col("target_scale") * F.col("_norm")
    return sums.join(stats.select(U, "n_obs", "shrinkage", "target_scale"), U).select(
        U, "book_id", F.sqrt(F.greatest(variance, F.lit(0.0))).alias("volatility")
    )


def book_returns(books: DataFrame, means: DataFrame, volatility: DataFrame, accepted: Column) -> DataFrame:
    """Expected return, gross, net and (for accepted books) mean over volatility."""

    w = F.col("weight")
    sums = (
        books.join(means, [U, "contract_id"])
        .groupBy(U, "book_id")
        .agg(
            F.sum(w * F.col("expected_return")).alias("expected_return"),
            F.sum(F.abs(w)).alias("gross_nav"),
            F.sum(w).alias("net_nav"),
        )
    )
    table = sums.join(volatility, [U, "book_id"])
    return table.withColumn(
        "sharpe",
        F.when(
            accepted & (F.col("volatility") > 0.0),
            F.try_divide(F.col("expected_return"), F.col("volatility")),
        ),
    )


def moment_check(matrix: DataFrame, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Problems of a long labelled matrix: missing mirror cells, asymmetry, not finite.

    Cells of a pair meet by their unordered key, so no self-join is needed.
    """

    upper = F.col("row_label") <= F.col("col_label")
    value = finite("value")
    pairs = matrix.groupBy(
        *keys,
        F.least("row_label", "col_label").alias("low_label"),
        F.greatest("row_label", "col_label").alias("high_label"),
    ).agg(
        F.count("*").alias("_cells"),
        F.count_if(value.isNull()).alias("_bad"),
        F.max(F.when(upper, value)).alias("_up"),
        F.max(F.when(F.col("row_label") >= F.col("col_label"), value)).alias("_down"),
    )
    need = F.when(F.col("low_label") == F.col("high_label"), 1).otherwise(2)
    apart = F.abs(F.col("_up") - F.col("_down")) > F.abs("_down") * 1e-5 + 1e-10
    reason = (
        F.when(F.col("_cells") > need, "duplicate_cell")
        .when(F.col("_cells") < need, "missing_cell")
        .when(F.col("_bad") > 0, "not_finite")
        .when(apart, "not_symmetric")
    )
    found = pairs.withColumn("reason", reason).where(F.col("reason").isNotNull())
    problems = found.select(*keys, "low_label", "high_label", "reason")
    if expected is None:
        return problems
    labels = matrix.select(*keys, F.col("row_label").alias("label")).distinct()
    gaps = expected.join(labels, [*keys, "label"], "left_anti").select(
        *keys, F.col("label").alias("low_label"), F.col("label").alias("high_label"),
        F.lit("missing_label").alias("reason"),
    )
    extra = labels.join(expected, [*keys, "label"], "left_anti").select(
        *keys, F.col("label").alias("low_label"), F.col("label").alias("high_label"),
        F.lit("unexpected_label").alias("reason"),
    )
    return problems.unionByName(gaps).unionByName(extra)
