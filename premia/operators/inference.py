"""Sharpe inference: grouped moments, PSR, DSR, paired differences, block resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import (
    corrected_kurtosis,
    corrected_skew,
    finite,
    flag,
    negative,
    ratio,
    with_expected_maximum,
    with_normal_cdf,
)
from premia.operators.paths import check_scale, keyed, path_statistics
from premia.session import written

Keys = Sequence[str]


def sharpe_moments(
    df: DataFrame, keys: Keys, ret: str = "net_return", feasible: str | None = None
) -> DataFrame:
    """n, mean, std, corrected skew and kurtosis, and whether a Sharpe may be reported."""

    r = finite(ret)
    allowed = F.lit(True) if feasible is None else F.bool_and(flag(feasible))
    sums = (
        keyed(df, keys)
        .groupBy(*keys)
        .agg(
            F.count(r).alias("n_obs"),
            F.avg(r).alias("mean"),
            F.stddev_samp(r).alias("std"),
            F.skewness(r).alias("_skew"),
            F.kurtosis(r).alias("_kurt"),
            (F.coalesce(F.min(r) > -1.0, F.lit(False)) & allowed).alias("available"),
        )
    )
    n = F.col("n_obs").cast("double")
    return (
        sums.withColumn("skew", corrected_skew(n, F.col("_skew")))
        .withColumn("kurtosis", corrected_kurtosis(n, F.col("_kurt")))
        .drop("_skew", "_kurt")
    )


def with_sharpe_probability(moments: DataFrame, benchmark: Column, name: str) -> DataFrame:
    """Add the probability that the per-period Sharpe exceeds ``benchmark``."""

    s, bench = F.col("_s"), F.col("_bench")
    variance = F.try_divide(
        1.0 - F.col("skew") * s + (F.col("kurtosis") - 1.0) * s * s * 0.25, F.col("n_obs") - 1.0
    )
    staged = (
        moments.withColumn("_s", F.try_divide("mean", "std"))
        .withColumn("_bench", benchmark)
        .withColumn("_var", finite(variance))
        .withColumn("_z", F.when(F.col("_var") > 0.0, (s - bench) / F.sqrt("_var")))
    )
    staged = with_normal_cdf(staged, "_z", "_smooth")
    decided = F.when(s > bench, 1.0).otherwise(0.0)
    flat = F.when(F.col("mean") > 0.0, 1.0).otherwise(0.0)
    value = F.when(F.col("std") == 0.0, flat).otherwise(F.coalesce("_smooth", decided))
    return staged.withColumn(
        name, F.when(F.col("available") & (F.col("n_obs") >= 2), value)
    ).drop("_s", "_bench", "_var", "_z", "_smooth")


def probabilistic_sharpe(
    df: DataFrame,
    keys: Keys,
    ret: str = "net_return",
    benchmark_sharpe: float = 0.0,
    periods: float = 12.0,
    feasible: str | None = None,
) -> DataFrame:
    check_scale(periods)
    moments = sharpe_moments(df, keys, ret, feasible)
    return with_sharpe_probability(moments, F.lit(benchmark_sharpe / math.sqrt(periods)), "psr")


def deflated_sharpe(
    df: DataFrame,
    trials: DataFrame,
    keys: Keys,
    ret: str = "net_return",
    feasible: str | None = None,
) -> DataFrame:
    """PSR against the expected best of ``trials`` (keys, trials) unskilled strategies."""

    moments = sharpe_moments(df, keys, ret, feasible).join(trials, list(keys))
    moments = with_expected_maximum(moments, "trials", "_best")
    s = F.try_divide("mean", "std")
    error = F.sqrt(F.try_divide(s * s * 0.5 + 1.0, F.col("n_obs") - 1.0))
    moments = moments.withColumn("benchmark", F.greatest(F.lit(0.0), error * F.col("_best")))
    return with_sharpe_probability(moments, F.col("benchmark"), "dsr").drop("_best")


def sharpe_difference(
    df: DataFrame,
    other: DataFrame,
    keys: Keys,
    on: Keys = ("return_date",),
    ret: str = "net_return",
    reference: str = "benchmark_return",
) -> DataFrame:
    """z and two-sided p of a Sharpe difference on paired returns (Memmel's variance)."""

    a, b = F.col("_a"), F.col("_b")
    paired = (
        keyed(df, keys)
        .select(*keys, *on, finite(ret).alias("_a"))
        .join(other.select(*on, finite(reference).alias("_b")), list(on))
        .where(a.isNotNull() & b.isNotNull())
    )
    sums = paired.groupBy(*keys).agg(
        F.count("*").alias("n_obs"),
        F.try_divide(F.avg(a), F.stddev_samp(a)).alias("_sa"),
        F.try_divide(F.avg(b), F.stddev_samp(b)).alias("_sb"),
        F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias("_rho"),
    )
    sa, sb, rho = F.col("_sa"), F.col("_sb"), F.col("_rho")
    variance = (
        2.0 - rho * 2.0 + (sa * sa + sb * sb - sa * sb * rho * rho * 2.0) * 0.5
    ) / F.col("n_obs")
    z = F.try_divide(sa - sb, F.sqrt(F.when(variance > 0.0, variance)))
    staged = sums.withColumn("z", z).withColumn("difference", sa - sb)
    return with_normal_cdf(staged, -F.abs("z"), "_tail").select(
        *keys, "n_obs", "difference", "z", (F.col("_tail") * 2.0).alias("p")
    )


def positions(
    df: DataFrame, keys: Keys, order: str = "return_date", block: Column | None = None
) -> DataFrame:
    """Add ``pos`` (0-based place in the path) and ``path_n`` without ordering whole paths."""

    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    before = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = (
        keyed(df, keys)
        .withColumn("_block", F.year(order) if block is None else block)
        .withColumn("_rn", F.row_number().over(inside))
    )
    carry = (
        rows.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_n_in", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("path_n", F.sum("_n").over(Window.partitionBy(*keys)))
        .select(*keys, "_block", "_n_in", "path_n")
    )
    return (
        rows.join(carry, [*keys, "_block"])
        .withColumn("pos", (F.col("_n_in") + F.col("_rn") - 1).cast("bigint"))
        .drop("_block", "_rn", "_n_in")
    )


def block_start(seed: int, replicate: Column, block: Column, n: Column) -> Column:
    """Seeded start of a block in [0, n): the first 8 hex digits of an md5, modulo n."""

    text = F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), block.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def bootstrap_panel(
    df: DataFrame,
    keys: Keys,
    replicates: int,
    block_size: int,
    seed: int,
    order: str = "return_date",
    ret: str = "net_return",
    block: Column | None = None,
) -> DataFrame:
    """Circular block resamples of every path: keys, replicate, pos, source_pos, value.

    Each place of a path derives its own source place, so the draw is spread like the rows;
    the join back is on (path, place) and one long path stays spread over all tasks.
    """

    if block_size < 1:
        raise ValueError("a block has at least one place")
    if replicates < 1:
        raise ValueError("ask for at least one replicate")
    clean = df.select(*keys, order, finite(ret).alias("_r")).where(F.col("_r").isNotNull())
    placed = written(positions(clean, keys, order, block), "placed")
    part = F.expr(f"pos div {int(block_size)}")
    draws = (
        placed.select(*keys, "pos", "path_n")
        .withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("_start", block_start(seed, F.col("replicate"), part, F.col("path_n")))
        .withColumn(
            "source_pos", (F.col("_start") + F.col("pos") % block_size) % F.col("path_n")
        )
        .select(*keys, F.col("replicate").cast("bigint").alias("replicate"), "pos", "source_pos")
    )
    values = placed.select(*keys, F.col("pos").alias("source_pos"), F.col("_r").alias(ret))
    return draws.join(values, [*keys, "source_pos"])


def _window_sums(placed: DataFrame, keys: Keys, block_size: int, value: str) -> DataFrame:
    """Sums over the circular run that starts at each place: ``full`` runs of ``block_size`` places and ``tail`` runs
    of what is left of a path after its whole blocks. Sums are of deviations from the path's mean.
    """

    centers = placed.groupBy(*keys).agg(F.avg(value).alias("_center"))
    step = F.explode(F.sequence(F.lit(0), F.lit(block_size - 1)))
    spread = placed.join(centers, list(keys)).withColumn("_step", step)
    tail = F.when(F.col("_step") < F.col("path_n") % block_size, True)
    off = F.col(value) - F.col("_center")

    def sums(inside: Column) -> list[Column]:
        return [
            F.count(inside).alias("n"),
            F.coalesce(F.sum(F.when(inside, off)), F.lit(0.0)).alias("s"),
            F.coalesce(F.sum(F.when(inside, off * off)), F.lit(0.0)).alias("q"),
            F.coalesce(F.sum(F.when(inside, F.pow(negative(value), 2))), F.lit(0.0)).alias("d"),
            F.min(F.when(inside, F.col(value))).alias("low"),
        ]

    start = F.pmod(F.col("pos") - F.col("_step"), F.col("path_n"))
    whole = F.when(F.col("_step") < F.col("path_n"), True)
    return spread.groupBy(*keys, start.alias("_start")).agg(
        F.max("_center").alias("_center"), F.struct(*sums(whole)).alias("full"), F.struct(*sums(tail)).alias("tail")
    )


def bootstrap_intervals(
    df: DataFrame,
    keys: Keys,
    replicates: int = 1000,
    block_size: int = 8,
    seed: int = 20260625,
    alpha: float = 0.10,
    periods: float = 12.0,
    order: str = "return_date",
    ret: str = "net_return",
    block: Column | None = None,
) -> DataFrame:
    """Percentile intervals of Sharpe and Sortino over block resamples.

    The resamples are those of ``bootstrap_panel``, but a drawn block is one row of sums: replicates x blocks are
    joined instead of replicates x places.
    """

    if block_size < 1 or replicates < 1:
        raise ValueError("blocks and replicates are counted from one")
    clean = df.select(*keys, order, finite(ret).alias("_r")).where(F.col("_r").isNotNull())
    placed = positions(clean, keys, order, block).select(*keys, "pos", "path_n", "_r")
    number = F.expr(f"pos div {int(block_size)}")
    drawn = (
        placed.where(F.col("pos") % block_size == 0)
        .select(*keys, "pos", "path_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
        .withColumn("_start", block_start(seed, F.col("replicate"), number, F.col("path_n")))
        .withColumn("_whole", F.col("pos") + block_size <= F.col("path_n"))
        .select(*keys, "replicate", "_start", "_whole")
    )
    runs = drawn.join(_window_sums(placed, keys, block_size, "_r"), [*keys, "_start"])
    runs = runs.select(*keys, "replicate", "_center", F.when(F.col("_whole"), F.col("full")).otherwise(F.col("tail")).alias("_run"))
    root = math.sqrt(periods)
    n, s = F.col("_n").cast("double"), F.col("_s")
    mean = F.col("_center") + s / n
    per_draw = (
        runs.groupBy(*keys, "replicate")
        .agg(
            F.max("_center").alias("_center"),
            *[F.sum(f"_run.{name}").alias(f"_{name}") for name in ("n", "s", "q", "d")],
            F.min("_run.low").alias("_min"),
        )
        .where(F.col("_min") > -1.0)
        .withColumn("_mean", mean)
        .withColumn("_std", F.sqrt(F.greatest(F.try_divide(F.col("_q") - s * s / n, n - 1.0), F.lit(0.0))))
        .withColumn("_down", F.sqrt(F.col("_d") / n))
        .withColumn("_sharpe", ratio(F.col("_mean") * root, F.col("_std")))
        .withColumn("_sortino", ratio(F.col("_mean") * root, F.col("_down")))
    )
    # One row per replicate: the group size is the parameter, so a plain percentile is bounded.
    return per_draw.groupBy(*keys).agg(
        F.count("*").alias("usable_draws"),
        F.percentile("_sharpe", alpha / 2).alias("sharpe_lo"),
        F.percentile("_sharpe", 1 - alpha / 2).alias("sharpe_hi"),
        F.percentile("_sortino", alpha / 2).alias("sortino_lo"),
        F.percentile("_sortino", 1 - alpha / 2).alias("sortino_hi"),
    )


#: What a run of returns does to wealth, relative to wealth at its start: product, lowest and highest point (the start
#: among them), worst ratio to the highest point so far, loss of everything, and centered sums.
RUN = ("growth", "low", "high", "dip", "ruin", "n", "s", "q")
FOLDED = 512  # runs joined at a time


def _joined(a: Column, b: Column) -> Column:
    """The run that does ``a`` and then ``b``; joining is associative."""

    ahead = a["growth"]
    return F.struct(
        (ahead * b["growth"]).alias("growth"),
        F.least(a["low"], ahead * b["low"]).alias("low"),
        F.greatest(a["high"], ahead * b["high"]).alias("high"),
        F.least(a["dip"], b["dip"], ahead * b["low"] / a["high"]).alias("dip"),
        *[F.greatest(a[name], b[name]).alias(name) for name in ("ruin",)],
        *[(a[name] + b[name]).alias(name) for name in ("n", "s", "q")],
    )


def _standing() -> Column:
    """The run of no returns."""

    return F.struct(*[F.lit(1.0 if name in ("growth", "low", "high", "dip") else 0.0).alias(name) for name in RUN])


def _circular_runs(placed: DataFrame, keys: Keys, block_size: int) -> DataFrame:
    """For each place, the circular runs that start there: ``full`` of ``block_size`` places, ``tail`` of what is left of the
    path after its whole blocks. A doubling table: runs of 2, 4, 8, ... places are two runs of half, joined at the place between.
    """

    keys = list(keys)
    centers = placed.groupBy(*keys).agg(F.avg("_r").alias("_center"))
    g, off = F.lit(1.0) + F.col("_r"), F.col("_r") - F.col("_center")
    one = F.struct(
        g.alias("growth"), F.least(F.lit(1.0), g).alias("low"), F.greatest(F.lit(1.0), g).alias("high"),
        F.least(F.lit(1.0), g).alias("dip"), F.when(g <= 0, 1.0).otherwise(0.0).alias("ruin"), F.lit(1.0).alias("n"),
        off.alias("s"), (off * off).alias("q"),
    )
    level = placed.join(centers, keys).select(*keys, "pos", "path_n", "_center", one.alias("_run"))
    runs = level.select(*keys, "pos", "path_n", "_center", _standing().alias("full"), _standing().alias("tail"))
    size = 1
    while size <= block_size:
        # Each length takes the powers of two it is made of, the small ones first.
        for name, length in (("full", F.lit(block_size)), ("tail", F.col("path_n") % block_size)):
            lower = length.cast("int").bitwiseAND(F.lit(size - 1))
            there = level.select(*keys, F.col("pos").alias("_there"), F.col("_run").alias("_next"))
            at = runs.withColumn("_there", (F.col("pos") + lower) % F.col("path_n")).join(there, [*keys, "_there"])
            has = length.cast("int").bitwiseAND(F.lit(size)) != 0
            runs = at.withColumn(name, F.when(has, _joined(F.col(name), F.col("_next"))).otherwise(F.col(name))).drop("_there", "_next")
        if 2 * size <= block_size:
            second = level.select(*keys, F.col("pos").alias("_there"), F.col("_run").alias("_next"))
            pair = level.withColumn("_there", (F.col("pos") + size) % F.col("path_n")).join(second, [*keys, "_there"])
            level = pair.withColumn("_run", _joined(F.col("_run"), F.col("_next"))).drop("_there", "_next")
        size *= 2
    return runs.select(*keys, F.col("pos").alias("_start"), "_center", "full", "tail")


def resampled_paths(
    df: DataFrame,
    keys: Keys,
    replicates: int,
    block_size: int,
    seed: int,
    order: str = "return_date",
    ret: str = "net_return",
    periods: float = 12.0,
) -> DataFrame:
    """Path risk of reordered returns: p05 and p50 of Sharpe and drawdown, default share.

    The resamples are those of ``bootstrap_panel``. A drawn block is one row, the summary of its run; a replicate joins its
    blocks in order, ``FOLDED`` at a time, so replicates x places never exist.
    """

    if block_size < 1 or replicates < 1:
        raise ValueError("blocks and replicates are counted from one")
    keys = list(keys)
    clean = df.select(*keys, order, finite(ret).alias("_r")).where(F.col("_r").isNotNull())
    placed = written(positions(clean, keys, order).select(*keys, "pos", "path_n", "_r"), "placed")
    runs = written(_circular_runs(placed, keys, block_size), "runs")
    number = F.expr(f"pos div {int(block_size)}")
    drawn = (
        placed.where(F.col("pos") % block_size == 0)
        .select(*keys, "pos", "path_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
        .withColumn("_start", block_start(seed, F.col("replicate"), number, F.col("path_n")))
        .withColumn("_whole", F.col("pos") + block_size <= F.col("path_n"))
        .select(*keys, "replicate", number.alias("_at"), "_start", "_whole")
        .join(runs, [*keys, "_start"])
        .select(*keys, "replicate", "_at", "_center", F.when(F.col("_whole"), F.col("full")).otherwise(F.col("tail")).alias("_run"))
    )
    inner = [*keys, "replicate"]
    for group in ([*inner, F.expr(f"_at div {FOLDED}").alias("_at")], inner):
        listed = F.sort_array(F.collect_list(F.struct("_at", "_run")))  # at most FOLDED runs, then as many sums of them as a path has
        drawn = drawn.groupBy(*group).agg(F.max("_center").alias("_center"), listed.alias("_runs"))
        drawn = drawn.withColumn("_run", F.aggregate("_runs", _standing(), lambda done, item: _joined(done, item["_run"]))).drop("_runs")
    n, s, q = (F.col(f"_run.{name}") for name in ("n", "s", "q"))
    alive = F.col("_run.ruin") == 0
    spread = F.sqrt(F.greatest(F.try_divide(q - s * s / n, n - 1.0), F.lit(0.0)))
    sharpe = F.when(alive, ratio((F.col("_center") + s / n) * math.sqrt(periods), spread))
    table = drawn.select(
        *inner, (~alive).cast("double").alias("defaulted"), F.when(alive, F.col("_run.growth")).otherwise(0.0).alias("terminal_wealth"),
        F.when(alive, F.col("_run.dip") - 1.0).otherwise(-1.0).alias("max_drawdown"), sharpe.alias("sharpe"),
    )
    # One row per replicate: the group size is the parameter, so a plain percentile is bounded.
    return table.groupBy(*keys).agg(
        F.count("*").alias("paths"),
        F.avg("defaulted").alias("default_share"),
        F.min("terminal_wealth").alias("minimum_terminal_wealth"),
        F.percentile("sharpe", 0.05).alias("sharpe_p05"),
        F.percentile("sharpe", 0.50).alias("sharpe_p50"),
        F.percentile("max_drawdown", 0.05).alias("drawdown_p05"),
        F.percentile("max_drawdown", 0.50).alias("drawdown_p50"),
    )
