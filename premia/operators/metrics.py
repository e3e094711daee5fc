"""Metrics that join a path with something else: tails, benchmarks, windows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import finite, ratio
from premia.operators import paths
from premia.operators.ranks import exact_quantiles

Keys = Sequence[str]

METRICS = (
    "n_obs annualized_mean_return cagr annualized_volatility sharpe "
    "downside_annualized_deviation sortino max_drawdown calmar omega information_ratio "
    "var_95 cvar_95 terminal_wealth defaulted"
).split()


def value_at_risk(df: DataFrame, keys: Keys, ret: str = "net_return", level: float = 0.05):
    """Historical VaR and CVaR: minus the quantile, minus the mean up to it."""

    table = exact_quantiles(df, keys, ret, {"q": level}, tail_means=True)
    return table.select(*keys, (-F.col("q")).alias("var_95"), (-F.col("q_tail")).alias("cvar_95"))


def benchmark_rows(
    df: DataFrame,
    benchmark: DataFrame,
    on: Keys,
    ret: str = "net_return",
    reference: str = "benchmark_return",
) -> DataFrame:
    """Rows whose portfolio and benchmark returns both exist and are finite."""

    cleaned = benchmark.select(*on, finite(reference).alias(reference))
    return (
        df.withColumn(ret, finite(ret))
        .join(cleaned, list(on))
        .where(F.col(ret).isNotNull() & F.col(reference).isNotNull())
    )


def information_ratio(
    df: DataFrame,
    benchmark: DataFrame,
    keys: Keys,
    on: Keys = ("return_date",),
    ret: str = "net_return",
    reference: str = "benchmark_return",
    periods: float = 12.0,
) -> DataFrame:
    """Annual active mean over active volatility; NULL for a ruined path."""

    active = F.col(ret) - F.col(reference)
    sums = (
        benchmark_rows(paths.keyed(df, keys), benchmark, on, ret, reference)
        .groupBy(*keys)
        .agg(F.avg(active).alias("_mean"), F.stddev_samp(active).alias("_std"))
    )
    state = (
        paths.keyed(df, keys)
        .groupBy(*keys)
        .agg(F.coalesce(F.min(finite(ret)) <= -1.0, F.lit(False)).alias("_ruined"))
    )
    value = ratio(F.col("_mean") * periods, F.col("_std") * math.sqrt(periods))
    return state.join(sums, list(keys), "left").select(
        *keys, F.when(~F.col("_ruined"), value).alias("information_ratio")
    )


def performance_metrics(
    df: DataFrame,
    keys: Keys,
    order: Keys = ("return_date",),
    ret: str = "net_return",
    periods: float = 12.0,
    target: float = 0.0,
    benchmark: DataFrame | None = None,
    reference: str = "benchmark_return",
    block: Column | None = None,
) -> DataFrame:
    """The full metric set, one row per path."""

    table = paths.path_statistics(df, keys, order, ret, periods, target, block).join(
        value_at_risk(df, keys, ret), list(keys), "left"
    )
    if benchmark is None:
        table = table.withColumn("information_ratio", F.lit(None).cast("double"))
    else:
        ratios = information_ratio(df, benchmark, keys, order[:1], ret, reference, periods)
        table = table.join(ratios, list(keys), "left")
    return table.select(*keys, *METRICS)


def terminal_wealth(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Product of 1 + r of each return column over the rows all of them have."""

    common = df
    for name in columns:
        common = common.where(finite(name).isNotNull())
    return (
        common.unpivot([], list(columns), "strategy", "ret")
        .groupBy("strategy")
        .agg(F.product(F.col("ret") + 1.0).alias("terminal_wealth"), F.count("ret").alias("months"))
    )


def window_table(df: DataFrame, windows: Mapping[str, tuple[str, str]], date: str) -> DataFrame:
    """Repeat rows for every named date window they fall in."""

    named = [
        F.when(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(name))
        for name, (first, last) in windows.items()
    ]
    return df.withColumn("window", F.explode(F.array_compact(F.array(*named))))


def aligned_windows(
    df: DataFrame,
    config: str,
    strategy: str,
    windows: Mapping[str, tuple[str, str]],
    date: str = "return_date",
    ret: str = "net_return",
) -> DataFrame:
    """Metrics of every strategy of a config on the dates they all share, per window."""

    rows = window_table(df.where(finite(ret).isNotNull()), windows, date)
    strategies = rows.select(config, strategy).distinct().groupBy(config).agg(
        F.count(strategy).alias("_all")
    )
    shared = (
        rows.select(config, "window", date, strategy)
        .distinct()
        .groupBy(config, "window", date)
        .agg(F.count(strategy).alias("_have"))
        .join(strategies, config)
        .where(F.col("_have") == F.col("_all"))
        .select(config, "window", date)
    )
    aligned = rows.join(shared, [config, "window", date])
    keys = [config, strategy, "window"]
    span = aligned.groupBy(*keys).agg(F.min(date).alias("start"), F.max(date).alias("end"))
    return performance_metrics(aligned, keys, (date,), ret).join(span, keys)


def trailing_statistics(
    df: DataFrame,
    keys: Keys,
    order: str,
    ret: str,
    days: int,
    block_days: int | None = None,
) -> DataFrame:
    """Mean, deviation and count over the ``days`` before each row (the row not included).

    Rows are cut into time blocks of at least the window length and each block also gets
    the rows of the block before it, so that no path is ordered in one task.
    """

    width = max(block_days or 0, days, 1)
    clock = F.datediff(F.col(order), F.lit("1970-01-01").cast("date"))
    home = F.floor(clock / F.lit(width))
    rows = (
        paths.keyed(df, keys)
        .withColumn("_day", clock)
        .withColumn("_home", home)
        .withColumn("_block", F.explode(F.array(home, home + 1)))
    )
    past = Window.partitionBy(*keys, "_block").orderBy("_day").rangeBetween(-days, -1)
    r = finite(ret)
    return (
        rows.withColumn("trailing_n", F.count(r).over(past))
        .withColumn("trailing_mean", F.avg(r).over(past))
        .withColumn("trailing_std", F.stddev_samp(r).over(past))
        .where(F.col("_home") == F.col("_block"))
        .drop("_day", "_home", "_block")
    )


def rolling_out_of_sample(
    df: DataFrame,
    keys: Keys,
    order: str = "return_date",
    ret: str = "net_return",
    minimum: int = 12,
    block: Column | None = None,
) -> DataFrame:
    """Score each row with what was known before it: sign of the earlier mean times return."""

    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = (
        paths.keyed(df, keys)
        .withColumn("_r", finite(ret))
        .where(F.col("_r").isNotNull())
        .withColumn("_block", F.year(order) if block is None else block)
        .withColumn("_n", F.count("_r").over(inside))
        .withColumn("_s", F.coalesce(F.sum("_r").over(inside), F.lit(0.0)))
    )
    carry = (
        rows.groupBy(*keys, "_block")
        .agg(F.count("_r").alias("_bn"), F.sum("_r").alias("_bs"))
        .withColumn("_n_in", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
        .withColumn("_s_in", F.coalesce(F.sum("_bs").over(before), F.lit(0.0)))
        .select(*keys, "_block", "_n_in", "_s_in")
    )
    n = F.col("_n") + F.col("_n_in")
    mean = (F.col("_s") + F.col("_s_in")) / n
    return (
        rows.join(carry, [*keys, "_block"])
        .where(n >= minimum)
        .select(
            *keys,
            order,
            n.alias("train_rows"),
            mean.alias("train_mean"),
            (F.signum(mean) * F.col("_r")).alias("scored_return"),
        )
    )
