"""Return paths: wealth, drawdown and the performance table.

A path may hold a large share of all rows, so nothing here orders a whole path in
one task. Rows are ordered inside (path, time block); each block is reduced to one
row (growth product, running extremes, moments); only those block rows are ordered
per path. With unique dates a year block has at most 366 rows. For finer clocks pass
a finer ``block``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import finite, flag, negative, number, positive, ratio, total

Keys = Sequence[str]


def check_scale(periods: float, target: float = 0.0) -> None:
    if not math.isfinite(periods) or periods <= 0.0:
        raise ValueError("periods_per_year must be finite and positive")
    if not math.isfinite(target):
        raise ValueError("target_return must be finite")


def keyed(df: DataFrame, keys: Keys) -> DataFrame:
    """Rows with a missing key belong to no group."""

    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def _blocked(df: DataFrame, keys: Keys, order: Keys, ret: str, block: Column | None) -> DataFrame:
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        keyed(df, keys)
        .withColumn("_raw", number(ret))
        .withColumn("_r", finite(ret))
        .withColumn("_g", F.col("_r") + 1.0)
        .withColumn("_block", F.year(order[0]) if block is None else block)
        .withColumn("_wealth", F.coalesce(F.product("_g").over(inside), F.lit(1.0)))
        .withColumn("_peak", F.max("_wealth").over(inside))
        .withColumn("_low", F.min("_g").over(inside))
    )


def _carried(blocks: DataFrame, keys: Keys) -> DataFrame:
    """Wealth, peak and lowest growth factor of each path before each block."""

    before = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        blocks.withColumn("_wealth_in", F.coalesce(F.product("_growth").over(before), F.lit(1.0)))
        .withColumn("_top", F.col("_wealth_in") * F.col("_block_peak"))
        .withColumn("_peak_in", F.greatest(F.lit(1.0), F.max("_top").over(before)))
        .withColumn("_low_in", F.min("_block_low").over(before))
    )


def _block_extremes() -> list[Column]:
    return [
        F.product("_g").alias("_growth"),
        F.max("_wealth").alias("_block_peak"),
        F.min("_wealth").alias("_block_floor"),
        F.min("_g").alias("_block_low"),
        F.min(F.try_divide("_wealth", "_peak")).alias("_block_dip"),
    ]


def wealth_path(
    df: DataFrame,
    keys: Keys,
    order: Keys = ("return_date",),
    ret: str = "net_return",
    block: Column | None = None,
) -> DataFrame:
    """Each finite return with wealth (absorbed at 0), running peak and drawdown."""

    rows = _blocked(df, keys, order, ret, block)
    blocks = rows.groupBy(*keys, "_block").agg(*_block_extremes())
    carry = _carried(blocks, keys).select(*keys, "_block", "_wealth_in", "_peak_in", "_low_in")
    ruined = F.least("_low", "_low_in") <= 0.0
    wealth = F.when(ruined, 0.0).otherwise(F.col("_wealth_in") * F.col("_wealth"))
    peak = F.greatest(F.col("_peak_in"), F.col("_wealth_in") * F.col("_peak"))
    return (
        rows.join(carry, [*keys, "_block"])
        .where(F.col("_r").isNotNull())
        .select(
            *keys,
            *order,
            F.col("_r").alias(ret),
            wealth.alias("wealth"),
            F.when(ruined, -1.0).otherwise(F.try_divide(wealth, peak) - 1.0).alias("drawdown"),
            ruined.alias("defaulted"),
        )
    )


def _path_blocks(
    df: DataFrame,
    keys: Keys,
    order: Keys,
    ret: str,
    target: float,
    block: Column | None,
    extra: Sequence[Column],
) -> DataFrame:
    rows = _blocked(df, keys, order, ret, block)
    excess = F.col("_r") - target
    return rows.groupBy(*keys, "_block").agg(
        F.count("_r").alias("_n"),
        F.sum("_r").alias("_sum"),
        (F.var_pop("_r") * F.count("_r")).alias("_m2"),
        F.sum(F.pow(negative(excess), 2)).alias("_down"),
        F.sum(positive(excess)).alias("_gains"),
        (-F.sum(negative(excess))).alias("_losses"),
        F.min("_raw").alias("_worst"),
        *_block_extremes(),
        *extra,
    )


def path_statistics(
    df: DataFrame,
    keys: Keys,
    order: Keys = ("return_date",),
    ret: str = "net_return",
    periods: float = 12.0,
    target: float = 0.0,
    block: Column | None = None,
    block_extra: Sequence[Column] = (),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """All order-dependent and moment metrics of each path in one pass.

    ``block_extra`` are aggregates per block, ``extra`` combine them per path.
    """

    check_scale(periods, target)
    blocks = _path_blocks(df, keys, order, ret, target, block, block_extra)
    whole = Window.partitionBy(*keys)
    n_in = F.coalesce(F.col("_n"), F.lit(0))
    spread = F.pow(F.try_divide("_sum", F.col("_n").cast("double")) - F.col("_mean"), 2)
    per_path = (
        _carried(blocks, keys)
        .withColumn(
            "_mean",
            F.try_divide(F.sum("_sum").over(whole), F.sum("_n").over(whole).cast("double")),
        )
        .groupBy(*keys)
        .agg(
            F.sum(n_in).alias("n_obs"),
            F.max("_mean").alias("_mean"),
            F.sum(F.col("_m2") + F.col("_n") * spread).alias("_m2"),
            F.sum("_down").alias("_down"),
            F.sum("_gains").alias("_gains"),
            F.sum("_losses").alias("_losses"),
            F.min("_worst").alias("worst_month"),
            F.product("_growth").alias("_wealth"),
            F.min("_block_low").alias("_low"),
            F.min(
                F.least(
                    F.col("_block_dip"),
                    F.try_divide(F.col("_wealth_in") * F.col("_block_floor"), F.col("_peak_in")),
                )
            ).alias("_dip"),
            *extra,
        )
    )
    n = F.col("n_obs")
    some = n > 0
    ruined = F.coalesce(F.col("_low") <= 0.0, F.lit(False))
    root = math.sqrt(periods)
    volatility = F.when(n > 1, F.sqrt(F.col("_m2") / F.nullif(n - 1.0, F.lit(0.0))) * root)
    downside = F.when(some, F.sqrt(F.try_divide(F.col("_down"), n.cast("double"))) * root)
    excess = (F.col("_mean") - target) * periods
    wealth = F.when(ruined, 0.0).otherwise(F.col("_wealth"))
    cagr = F.when(ruined, -1.0).when(
        some, F.pow(F.col("_wealth"), F.try_divide(F.lit(float(periods)), n.cast("double"))) - 1.0
    )
    dip = F.when(ruined, -1.0).when(some, F.col("_dip") - 1.0)
    return (
        per_path.withColumn("annualized_mean_return", F.col("_mean") * periods)
        .withColumn("cagr", cagr)
        .withColumn("annualized_volatility", volatility)
        .withColumn("downside_annualized_deviation", downside)
        .withColumn("sharpe", F.when(~ruined, ratio(excess, volatility)))
        .withColumn("sortino", F.when(~ruined, ratio(excess, downside)))
        .withColumn("max_drawdown", dip)
        .withColumn("calmar", ratio(cagr, -dip))
        .withColumn("omega", ratio(F.col("_gains"), F.col("_losses")))
        .withColumn("terminal_wealth", wealth)
        .withColumn("defaulted", ruined)
        .drop("_mean", "_m2", "_down", "_gains", "_losses", "_wealth", "_low", "_dip")
    )


PERFORMANCE = (
    "annualized_mean_return cagr annualized_volatility sharpe sortino max_drawdown "
    "terminal_wealth defaulted worst_month"
).split()


def performance_summary(
    df: DataFrame,
    keys: Keys,
    order: Keys = ("return_date",),
    ret: str = "net_return",
    periods: float = 12.0,
    block: Column | None = None,
) -> DataFrame:
    """One row per group with metrics, flag counts and mean exposure."""

    block_extra, extra, names = [], [], []
    for source, name in (
        ("integer_repair_failed", "integer_failures"),
        ("integer_execution_abstained", "integer_abstentions"),
    ):
        if source in df.columns:
            block_extra.append(F.count_if(flag(source)).alias(f"_{name}"))
            extra.append(F.sum(f"_{name}").alias(name))
            names.append(name)
    if "gross_nav" in df.columns:
        block_extra += [
            F.sum(number("gross_nav")).alias("_nav"),
            F.count(number("gross_nav")).alias("_nav_n"),
        ]
        extra.append(
            F.try_divide(F.sum("_nav"), F.sum("_nav_n").cast("double")).alias("mean_gross_nav")
        )
        names.append("mean_gross_nav")
    table = path_statistics(
        df, keys, order, ret, periods, block=block, block_extra=block_extra, extra=extra
    )
    return table.select(*keys, F.col("n_obs").alias("observations"), *PERFORMANCE, *names)


def return_moments(
    df: DataFrame,
    keys: Keys,
    ret: str = "net_return",
    periods: float = 12.0,
    target: float = 0.0,
) -> DataFrame:
    """Metrics that need no order: one shuffle with map-side combine, no sort."""

    check_scale(periods, target)
    r = finite(ret)
    excess = r - target
    sums = (
        keyed(df, keys)
        .groupBy(*keys)
        .agg(
            F.count(r).alias("n_obs"),
            F.avg(r).alias("mean"),
            F.stddev_samp(r).alias("std"),
            F.avg(F.pow(negative(excess), 2)).alias("_down"),
            total(positive(excess)).alias("gains"),
            total(-negative(excess)).alias("losses"),
            F.product(r + 1.0).alias("_wealth"),
            F.coalesce(F.min(r + 1.0) <= 0.0, F.lit(False)).alias("defaulted"),
        )
    )
    root = math.sqrt(periods)
    ruined = F.col("defaulted")
    volatility = F.col("std") * root
    downside = F.sqrt("_down") * root
    excess_mean = (F.col("mean") - target) * periods
    years = F.try_divide(F.lit(float(periods)), F.col("n_obs").cast("double"))
    return (
        sums.withColumn("annualized_mean_return", F.col("mean") * periods)
        .withColumn("annualized_volatility", volatility)
        .withColumn("downside_annualized_deviation", downside)
        .withColumn("sharpe", F.when(~ruined, ratio(excess_mean, volatility)))
        .withColumn("sortino", F.when(~ruined, ratio(excess_mean, downside)))
        .withColumn("omega", ratio(F.col("gains"), F.col("losses")))
        .withColumn("terminal_wealth", F.when(ruined, 0.0).otherwise(F.col("_wealth")))
        .withColumn(
            "cagr",
            F.when(ruined, -1.0).when(F.col("n_obs") > 0, F.pow("_wealth", years) - 1.0),
        )
        .drop("_down", "_wealth")
    )


def first_default(df: DataFrame, keys: Keys, date: str = "return_date", ret: str = "net_return"):
    """First date a path is absorbed; paths that survive have no row."""

    return (
        keyed(df, keys).where(finite(ret) <= -1.0).groupBy(*keys).agg(F.min(date).alias("absorbed_on"))
    )


def path_sizes(df: DataFrame, keys: Keys, date: str = "return_date") -> DataFrame:
    """Rows and distinct dates per path; complete when it has the longest date set."""

    per_date = keyed(df, keys).groupBy(*keys, date).agg(F.count("*").alias("_rows"))
    sizes = per_date.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"), F.count(date).alias("dates"), F.max("_rows").alias("_most")
    )
    spine = per_date.select(date).distinct().agg(F.count(date)).scalar()
    return sizes.select(
        *keys,
        "rows",
        "dates",
        (F.col("dates") == spine).alias("complete"),
        (F.col("_most") > 1).alias("has_duplicates"),
    )
