"""Combinatorial cross-validation, overfitting probability and scoreboards.

Block counts, test blocks per split and embargo are parameters; the defaults (12 or 13
blocks taken two at a time) are inferred from published path and split counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import finite
from premia.functions.status import SCOPE_OF_CHECK, robustness_status
from premia.operators.covariance import salted_join
from premia.operators.inference import positions
from premia.operators.paths import keyed, path_statistics
from premia.operators.ranks import average_rank, exact_quantiles

Keys = Sequence[str]
TEST_BLOCKS = 2


def time_blocks(df: DataFrame, keys: Keys, count: int, order: str = "return_date") -> DataFrame:
    """Add ``block`` 0..count-1: contiguous parts of each path, the first ones one longer."""

    placed = positions(df, keys, order)
    small = F.expr(f"path_n div {int(count)}")
    longer = F.col("path_n") % count
    edge = longer * (small + 1)
    tail = F.floor((F.col("pos") - edge) / F.nullif(small, F.lit(0)))
    head = F.floor(F.col("pos") / (small + 1))
    return placed.withColumn(
        "block", F.when(F.col("pos") < edge, head).otherwise(longer + tail).cast("int")
    )


def split_array(count: int) -> Column:
    """All test-block pairs as a literal array of (split_id, a, b); its size is a parameter."""

    return F.array(
        *[
            F.struct(F.lit(i).alias("split_id"), F.lit(a).alias("a"), F.lit(b).alias("b"))
            for i, (a, b) in enumerate(combinations(range(count), TEST_BLOCKS))
        ]
    )


def block_bounds(blocks: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """Calendar and position bounds of every block (``count`` rows per path)."""

    return blocks.groupBy(*keys, "block").agg(
        F.min(start).alias("from_date"),
        F.max(end).alias("to_date"),
        F.min("pos").alias("from_pos"),
        F.max("pos").alias("to_pos"),
    )


def purge_overlap(train: DataFrame, test: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """Training labels whose holding interval meets no test interval of their path.

    ``test`` (keys, from_date, to_date) has a few intervals per path.
    """

    same = [train[key] == test[key] for key in keys]
    meets = (train[start] <= test["to_date"]) & (train[end] >= test["from_date"])
    condition = meets
    for part in same:
        condition = condition & part
    return train.join(test, condition, "left_anti")


def cpcv_splits(
    df: DataFrame,
    keys: Keys,
    count: int = 12,
    embargo: int = 1,
    start: str = "return_date",
    end: str = "label_end",
) -> DataFrame:
    """Every row in every split with its role: test, purged, embargo or train."""

    blocks = time_blocks(df, keys, count, start)
    bounds = block_bounds(blocks, keys, start, end)

    def side(name: str) -> DataFrame:
        return bounds.select(
            *keys,
            F.col("block").alias(name),
            F.struct("from_date", "to_date", "from_pos", "to_pos").alias(f"_{name}"),
        )

    splits = (
        bounds.select(*keys)
        .distinct()
        .select(*keys, F.inline(split_array(count)))
        .join(side("a"), [*keys, "a"])
        .join(side("b"), [*keys, "b"])
    )
    rows = salted_join(blocks, splits, list(keys), [start])

    def meets(name: str) -> Column:
        return (F.col(start) <= F.col(f"_{name}.to_date")) & (F.col(end) >= F.col(f"_{name}.from_date"))

    def near(name: str) -> Column:
        return F.col("pos").between(
            F.col(f"_{name}.from_pos") - embargo, F.col(f"_{name}.to_pos") + embargo
        )

    role = (
        F.when((F.col("block") == F.col("a")) | (F.col("block") == F.col("b")), "test")
        .when(meets("a") | meets("b"), "purged")
        .when(near("a") | near("b"), "embargo")
        .otherwise("train")
    )
    return rows.select(*df.columns, "pos", "block", "split_id", role.alias("role"))


def cpcv_paths(splits: DataFrame, keys: Keys, count: int = 12, ret: str = "net_return") -> DataFrame:
    """Recombine the test blocks of all splits to full paths.

    Each split is trained on its training rows (sign of their mean) and scores its test
    blocks; the n-th split that tests a block supplies that block of path n.
    """

    spark = splits.sparkSession
    seen: dict[int, int] = {}
    places = []
    for split, pair in enumerate(combinations(range(count), TEST_BLOCKS)):
        for block in pair:
            places.append((split, block, seen.get(block, 0)))
            seen[block] = seen.get(block, 0) + 1
    # count * (count - 1) rows, fixed by the parameter.
    table = spark.createDataFrame(places, "split_id int, block int, path_id int")
    trained = (
        splits.where("role = 'train'")
        .groupBy(*keys, "split_id")
        .agg(F.signum(F.avg(finite(ret))).alias("_position"))
    )
    tested = splits.where("role = 'test'").join(F.broadcast(table), ["split_id", "block"])
    return tested.join(trained, [*keys, "split_id"]).select(
        *keys,
        F.col("path_id").cast("bigint").alias("path_id"),
        F.col("split_id").cast("bigint").alias("split_id"),
        "return_date",
        (F.col(ret) * F.col("_position")).alias(ret),
    )


def cpcv_summary(paths: DataFrame, keys: Keys, scope: Keys, ret: str = "net_return") -> DataFrame:
    """Paths, default share, lowest wealth, Sharpe percentiles (NULL after a default), status."""

    table = path_statistics(paths, [*keys, "path_id"], ("return_date",), ret)
    sums = keyed(table, scope).groupBy(*scope).agg(
        F.count("*").alias("paths"),
        F.avg(F.col("defaulted").cast("double")).alias("default_share"),
        F.min("terminal_wealth").alias("minimum_terminal_wealth"),
    )
    cuts = exact_quantiles(
        table, scope, "sharpe", {"sharpe_p05": 0.05, "sharpe_p50": 0.5, "sharpe_p95": 0.95}
    ).drop("size")
    ruined = F.col("default_share") > 0.0
    joined = sums.join(cuts, list(scope), "left")
    return joined.select(
        *scope, "paths", "default_share", "minimum_terminal_wealth",
        *[F.when(~ruined, F.col(c)).alias(c) for c in ("sharpe_p05", "sharpe_p50", "sharpe_p95")],
        F.when(ruined, "fail_default").otherwise("survived").alias("status"),
    )


def in_out_sharpes(
    df: DataFrame, scope: str, strategy: str, count: int = 13, ret: str = "net_return"
) -> DataFrame:
    """Per-period Sharpe of each strategy in and out of sample in every split.

    Rows are reduced to (strategy, block) sums once; the splits only recombine those, so
    the number of splits never multiplies the data.
    """

    keys = [scope, strategy]
    r = F.col("_r")
    rows = df.select(*keys, "return_date", finite(ret).alias("_r")).where(r.isNotNull())
    sums = (
        time_blocks(rows, keys, count)
        .groupBy(*keys, "block")
        .agg(F.count(r).alias("_n"), F.avg(r).alias("_m"), F.var_pop(r).alias("_v"))
    )
    # Sums are of deviations from the path's own mean, so a large mean does not swallow the variance.
    path = Window.partitionBy(*keys)
    center = F.sum(F.col("_n") * F.col("_m")).over(path) / F.sum("_n").over(path)
    off = F.col("_m") - F.col("_center")
    centered = sums.withColumn("_center", center).select(
        *keys, "block", "_center", "_n",
        (F.col("_n") * off).alias("_s"),
        (F.col("_n") * (F.col("_v") + off * off)).alias("_q"),
    )
    parts = centered.select(*keys, "block", "_center", "_n", "_s", "_q", F.inline(split_array(count)))
    tested = (F.col("block") == F.col("a")) | (F.col("block") == F.col("b"))

    def side(inside: Column) -> list[Column]:
        return [F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(c) for c in ("_n", "_s", "_q")]

    def sharpe(prefix: str) -> Column:
        n, s, q = (F.col(f"{prefix}.{c}") for c in ("_n", "_s", "_q"))
        mean = F.try_divide(s, n.cast("double"))
        variance = F.try_divide(q - mean * s, n - 1.0)
        return F.when(variance > 0.0, F.try_divide(mean + F.col("_center"), F.sqrt(variance)))

    combined = parts.groupBy(*keys, "split_id").agg(
        F.max("_center").alias("_center"),
        F.struct(*side(~tested)).alias("_in"), F.struct(*side(tested)).alias("_out")
    )
    return combined.select(
        *keys, "split_id", sharpe("_in").alias("in_sharpe"), sharpe("_out").alias("out_sharpe")
    )


def in_out_ranks(sharpes: DataFrame, scope: str) -> DataFrame:
    """Average ranks of the strategies of a scope, per split, in and out of sample."""

    ranked = average_rank(sharpes, [scope, "split_id"], "in_sharpe", "in_rank")
    return average_rank(ranked, [scope, "split_id"], "out_sharpe", "out_rank")


def overfitting_probability(ranks: DataFrame, scope: str, strategy: str) -> DataFrame:
    """Share of splits whose in-sample winner ranks below the middle out of sample."""

    winner = F.max(
        F.struct("in_rank", F.col(strategy).alias("winner"), "out_rank")
    ).alias("_win")
    per_split = ranks.groupBy(scope, "split_id").agg(winner, F.count("out_rank").alias("_n"))
    omega = F.col("_win.out_rank") / (F.col("_n") + 1.0)
    logits = per_split.withColumn("logit", F.ln(omega / (1.0 - omega)))
    sums = logits.groupBy(scope).agg(
        F.count("*").alias("splits"),
        F.max("_n").alias("strategies"),
        F.avg(F.when(F.col("logit") < 0.0, 1.0).otherwise(0.0)).alias("pbo"),
    )
    # One logit per split: the group size is the number of splits, a parameter.
    medians = logits.groupBy(scope).agg(F.median("logit").alias("median_logit"))
    correlation = ranks.groupBy(scope).agg(F.corr("in_rank", "out_rank").alias("rank_correlation"))
    return sums.join(medians, scope).join(correlation, scope)


def with_robustness_status(checks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Decide every robustness row; path checks look their status up by config and scope."""

    scope = F.lit(None).cast("string")
    for check, name in SCOPE_OF_CHECK.items():
        scope = F.when(F.col("check") == check, name).otherwise(scope)
    looked = summaries.select("config", "scope", F.col("status").alias("_looked"))
    joined = checks.withColumn("scope", scope).join(looked, ["config", "scope"], "left")
    status = robustness_status(
        F.col("check"), F.col("primary_value"), F.col("secondary_value"), F.col("_looked")
    )
    return joined.withColumn("status", status).drop("scope", "_looked")


def scoreboard(scores: DataFrame, ours: str, stock: str, group: str = "config") -> DataFrame:
    """Best naive strategy per group, edges over it and over the stock baseline, beat flags."""

    naive = ~F.col("strategy").isin(ours, stock)
    table = keyed(scores, [group]).groupBy(group).agg(
        F.max(F.when(F.col("strategy") == ours, F.col("net_sharpe"))).alias("net_sharpe"),
        F.max(F.when(F.col("strategy") == stock, F.col("net_sharpe"))).alias("stock_sharpe"),
        F.max(F.when(naive, F.struct("net_sharpe", "strategy"))).alias("_best"),
    )
    return table.withColumns(
        {
            "best_naive_strategy": F.col("_best.strategy"),
            "best_naive_sharpe": F.col("_best.net_sharpe"),
            "edge_vs_best_naive": F.col("net_sharpe") - F.col("_best.net_sharpe"),
            "edge_vs_stock": F.col("net_sharpe") - F.col("stock_sharpe"),
        }
    ).withColumns(
        {
            "beats_best_naive": F.col("edge_vs_best_naive") > 0.0,
            "beats_stock": F.col("edge_vs_stock") > 0.0,
        }
    ).drop("_best")
