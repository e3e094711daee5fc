"""Cleaning, guarded division and the normal distribution."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: str | Column) -> Column:
    """DOUBLE or NULL: text that is no number and NaN become NULL, infinities stay."""

    parsed = col(value).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def finite(value: str | Column) -> Column:
    """DOUBLE or NULL: NaN and infinities become NULL."""

    parsed = col(value).try_cast("double")
    return F.when(F.abs(parsed) < INFINITY, parsed)


def flag(value: str | Column) -> Column:
    """A missing boolean counts as false."""

    return F.coalesce(col(value).cast("boolean"), F.lit(False))


def positive(value: str | Column) -> Column:
    """max(value, 0), NULL stays NULL."""

    value = col(value)
    return F.when(value > 0.0, value).when(value.isNotNull(), F.lit(0.0))


def negative(value: str | Column) -> Column:
    """min(value, 0), NULL stays NULL."""

    value = col(value)
    return F.when(value < 0.0, value).when(value.isNotNull(), F.lit(0.0))


def breach(value: str | Column, limit: str | Column) -> Column:
    """How far a value is over its limit; an inactive (NULL) limit is never breached."""

    excess = col(value) - col(limit)
    return F.when(excess > 0.0, excess).otherwise(0.0)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom where bottom > 0, else NULL."""

    return F.when(bottom > 0.0, F.try_divide(top, bottom))


def total(value: str | Column) -> Column:
    """Sum that is 0 for a group without values."""

    return F.coalesce(F.sum(col(value)), F.lit(0.0))


# Rational approximation of the normal tail (Hart 1968, in West 2005),
# coefficients from the highest power down.
TAIL_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
TAIL_LIMIT = 37.0
TAIL_ROOT = 2.506628274631
EULER_GAMMA = 0.5772156649015329


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    value = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        value = value * x + F.lit(coefficient)
    return value


def materialized(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that later filters and projections refer to instead of repeating.

    A filter on a plain column is rewritten below the projection with the whole
    expression in its place, which multiplies long formulas; an inlined one-row array is
    a stage boundary for that rewrite and still runs inside generated code.
    """

    return df.select("*", F.inline(F.array(F.struct(*columns))))


def with_normal_cdf(df: DataFrame, x: str | Column, below: str, above: str | None = None):
    """Add ``below`` = P(Z <= x) and, if named, ``above`` = P(Z > x).

    Built in stages of columns: each step is computed once per row and the generated
    code stays small, where one nested expression would repeat its parts many times.
    """

    a, e = F.col("_cdf_a"), F.col("_cdf_e")
    chain = a + 0.65
    for step in (4.0, 3.0, 2.0, 1.0):
        chain = a + F.lit(step) / chain
    tail = (
        F.when(a < TAIL_SWITCH, e * _polynomial(a, TAIL_TOP) / _polynomial(a, TAIL_BOTTOM))
        .when(a <= TAIL_LIMIT, e / (chain * TAIL_ROOT))
        .when(a.isNotNull(), F.lit(0.0))
    )
    t = F.col("_cdf_t")
    right = F.col("_cdf_x") > 0.0
    sides = [F.when(right, 1.0 - t).otherwise(t).alias(below)]
    if above is not None:
        sides.append(F.when(right, t).otherwise(1.0 - t).alias(above))
    staged = (
        df.withColumn("_cdf_x", col(x))
        .withColumns({"_cdf_a": F.abs("_cdf_x"), "_cdf_e": F.exp(F.pow("_cdf_x", 2) * -0.5)})
        .withColumn("_cdf_t", tail)
    )
    return materialized(staged, *sides).drop("_cdf_x", "_cdf_a", "_cdf_e", "_cdf_t")


def normal_pdf(x: str | Column) -> Column:
    x = col(x)
    return F.exp(x * x * -0.5) / math.sqrt(2.0 * math.pi)


def expected_maximum(trials: int) -> float:
    """Expected maximum of that many standard normals (0 for a single trial)."""

    if trials < 1:
        raise ValueError("trials must be positive")
    if trials == 1:
        return 0.0
    quantile = NormalDist().inv_cdf
    return (1.0 - EULER_GAMMA) * quantile(1.0 - 1.0 / trials) + EULER_GAMMA * quantile(
        1.0 - 1.0 / (trials * math.e)
    )


def corrected_skew(n: Column, biased: Column) -> Column:
    """Bias-corrected skewness; the biased value up to two observations."""

    return F.when(n > 2, biased * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))).otherwise(
        biased
    )


def corrected_kurtosis(n: Column, excess: Column) -> Column:
    """Bias-corrected Pearson kurtosis from the biased excess form."""

    scale = (n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0))
    return F.when(n > 3, scale * ((n + 1.0) * excess + 6.0) + 3.0).otherwise(excess + 3.0)


# Moves exact ties (k/128 and the like) off the rounding edge, so that the last bit of a
# sum, which depends on the order of addition, cannot change a rounded result.
NUDGE = 1e-11


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Comparable output: rounded doubles without -0.0, counts as BIGINT."""

    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            places = special.get(field.name, digits)
            value = F.round(value.cast("double") + NUDGE, places) + F.lit(0.0)
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            value = value.cast("bigint")
        columns.append(value.alias(field.name))
    return df.select(*columns)


# Rational start of the normal quantile (Acklam), highest power first.
CENTRE_TOP = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
CENTRE_BOTTOM = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
OUTER_TOP = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
OUTER_BOTTOM = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
OUTER_SHARE = 0.02425


def with_normal_quantile(df: DataFrame, p: str | Column, name: str) -> DataFrame:
    """Add the inverse normal distribution function on (0, 1), NULL outside it.

    A rational start and one Halley step with the accurate distribution function.
    """

    q, c, p_ = F.col("_nq_q"), F.col("_nq_c"), F.col("_nq_p")
    start, error = F.col("_nq_start"), F.col("_nq_error")
    outer = _polynomial(q, OUTER_TOP) / _polynomial(q, OUTER_BOTTOM)
    square = F.col("_nq_c2")
    centre = _polynomial(square, CENTRE_TOP) * c / _polynomial(square, CENTRE_BOTTOM)
    staged = (
        df.withColumn("_nq_p", F.when((col(p) > 0.0) & (col(p) < 1.0), col(p)))
        .withColumn("_nq_c", p_ - 0.5)
        .withColumns({"_nq_c2": c * c, "_nq_q": F.sqrt(F.ln(0.5 - F.abs(c)) * -2.0)})
        .withColumn(
            "_nq_start",
            F.when(F.abs(c) <= 0.5 - OUTER_SHARE, centre).otherwise(-F.signum(c) * outer),
        )
    )
    staged = with_normal_cdf(staged, start, "_nq_cdf").withColumn(
        "_nq_error",
        (F.col("_nq_cdf") - p_) * math.sqrt(2.0 * math.pi) * F.exp(start * start * 0.5),
    )
    return staged.withColumn(name, start - error / (start * error * 0.5 + 1.0)).drop(
        "_nq_p", "_nq_c", "_nq_c2", "_nq_q", "_nq_start", "_nq_cdf", "_nq_error"
    )


def with_expected_maximum(df: DataFrame, trials: str, name: str) -> DataFrame:
    """Column form of ``expected_maximum``; NULL below one trial."""

    share = F.try_divide(F.lit(1.0), F.col(trials).cast("double"))
    staged = with_normal_quantile(df, 1.0 - share, "_em_a")
    staged = with_normal_quantile(staged, 1.0 - share / math.e, "_em_b")
    value = F.col("_em_a") * (1.0 - EULER_GAMMA) + F.col("_em_b") * EULER_GAMMA
    return staged.withColumn(
        name, F.when(F.col(trials) == 1, F.lit(0.0)).when(F.col(trials) > 1, value)
    ).drop("_em_a", "_em_b")
