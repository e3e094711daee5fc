"""Quotes and execution evidence: as-of joins, spread ladder, cost scenarios, coverage."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import finite, flag
from premia.operators.paths import keyed
from premia.operators.ranks import exact_quantiles


def minute_block(time: Column) -> Column:
    """Default scan block: short enough for a hot key, few enough to order per key."""

    return F.date_trunc("minute", time)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    tie: str,
    forward: bool = False,
    block: Callable[[Column], Column] = minute_block,
) -> DataFrame:
    """Each left row with the nearest right row at or before it (or at or after it).

    Both sides are stacked and scanned in time order inside (key, time block), so a hot
    key is spread over its blocks; the last right row of the earlier blocks is found from
    one row per block and filled in where a block starts without one. Right rows with
    equal times are ordered by ``tie`` (the latest wins, or the earliest when forward).
    """

    payload = F.struct(*[F.col(name) for name in columns])
    stacked = left.select(
        *on,
        F.col(left_time).alias("_time"),
        F.lit(1).alias("_side"),
        F.lit(None).cast("bigint").alias("_tie"),
        F.struct(*[F.col(name) for name in left.columns]).alias("_left"),
    ).unionByName(
        right.select(
            *on,
            F.col(right_time).alias("_time"),
            F.lit(0).alias("_side"),
            F.col(tie).cast("bigint").alias("_tie"),
            payload.alias("_pay"),
        ),
        allowMissingColumns=True,
    )
    stacked = stacked.withColumn("_block", block(F.col("_time")))
    if forward:
        order = [F.col("_time").desc(), F.col("_side"), F.col("_tie").desc()]
        blocks_order = F.col("_block").desc()
        edge = F.min_by
    else:
        order = [F.col("_time"), F.col("_side"), F.col("_tie")]
        blocks_order = F.col("_block")
        edge = F.max_by
    inside = (
        Window.partitionBy(*on, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = (
        Window.partitionBy(*on).orderBy(blocks_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        stacked.groupBy(*on, "_block")
        .agg(
            edge(
                F.col("_pay"), F.when(F.col("_side") == 0, F.struct("_time", "_tie"))
            ).alias("_edge")
        )
        .withColumn("_far", F.last("_edge", ignorenulls=True).over(across))
        .select(*on, "_block", "_far")
    )
    scanned = stacked.withColumn("_near", F.last("_pay", ignorenulls=True).over(inside)).where(
        F.col("_side") == 1
    )
    found = F.coalesce("_near", "_far")
    return scanned.join(carry, [*on, "_block"]).select(
        "_left.*", *[found[name].alias(name) for name in columns]
    )


def entry_quotes(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades with the last quote at or before them (NULL quote columns if there is none)."""

    return asof_join(
        trades, quotes, ["symbol"], "trade_ts", "quote_ts",
        ["quote_id", "quote_ts", "bid", "ask"], "quote_id",
    )


def next_session_open(day: Column, hour: int = 9, minute: int = 30) -> Column:
    """Opening time of the first weekday after ``day``."""

    ahead = F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1)
    opened = F.date_add(day.cast("date"), ahead).cast("timestamp")
    return opened + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute), F.lit(0))


def next_executable_quotes(
    legs: DataFrame, quotes: DataFrame, session_minutes: int = 390
) -> DataFrame:
    """First quote of the next session for every leg held at a trigger close.

    ``legs``: trigger_day, symbol. A leg without a quote in that session is uncovered.
    """

    opened = legs.withColumn("open_ts", next_session_open(F.col("trigger_day")))
    joined = asof_join(
        opened, quotes, ["symbol"], "open_ts", "quote_ts",
        ["quote_id", "quote_ts", "bid", "ask"], "quote_id", forward=True,
    )
    limit = F.col("open_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(session_minutes), F.lit(0))
    inside = F.coalesce(F.col("quote_ts") <= limit, F.lit(False))
    return joined.select(
        "trigger_day", "symbol", "open_ts",
        F.when(inside, F.col("quote_id")).alias("quote_id"),
        F.when(inside, (F.col("bid") + F.col("ask")) / 2.0).alias("mid"),
        inside.alias("covered"),
    )


def trigger_scores(legs: DataFrame) -> DataFrame:
    """A trigger is scored only if every held leg is covered."""

    return keyed(legs, ["trigger_day"]).groupBy("trigger_day").agg(
        F.count("*").alias("legs"),
        F.count_if("covered").alias("covered_legs"),
        F.bool_and("covered").alias("scored"),
    )


def relative_spread() -> Column:
    return F.try_divide(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2.0)


def daily_quotes(quotes: DataFrame) -> DataFrame:
    """Per symbol and day: mean and largest relative spread, volume sum and maximum."""

    return (
        quotes.withColumn("_spread", relative_spread())
        .groupBy("symbol", F.to_date("quote_ts").alias("day"))
        .agg(
            F.avg("_spread").alias("day_spread"),
            F.max("_spread").alias("day_worst_spread"),
            F.sum("volume").alias("day_volume_sum"),
            F.max("volume").alias("day_volume_max"),
            F.max("open_interest").alias("day_open_interest"),
        )
    )


def spread_ladder(
    trades: DataFrame, exact: DataFrame, proxy: DataFrame, default: float
) -> DataFrame:
    """Exact spread where a quote of the day matches, else the symbol's proxy, else a default."""

    joined = (
        trades.withColumn("day", F.to_date("trade_ts"))
        .join(exact.select("symbol", "day", F.col("day_spread").alias("_exact")), ["symbol", "day"], "left")
        .join(proxy.select("symbol", F.col("proxy_spread").alias("_proxy")), "symbol", "left")
    )
    source = (
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_proxy").isNotNull(), "proxy").otherwise("default")
    )
    return joined.withColumn(
        "relative_spread", F.coalesce("_exact", "_proxy", F.lit(default))
    ).withColumn("source", source).drop("_exact", "_proxy")


def proxy_share(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact and proxy rows, proxy share and median relative spread."""

    exact = F.count_if(F.col("source") == "exact")
    proxied = F.count_if(F.col("source") != "exact")
    counts = keyed(rows, keys).groupBy(*keys).agg(exact.alias("exact_rows"), proxied.alias("proxy_rows"))
    medians = exact_quantiles(rows, keys, "relative_spread", {"median_relative_spread": 0.5})
    share = F.try_divide(
        F.col("proxy_rows"), (F.col("exact_rows") + F.col("proxy_rows")).cast("double")
    )
    return counts.join(medians.drop("size"), list(keys), "left").withColumn("proxy_row_share", share)


# Scenario names and the cost column each subtracts.
SCENARIOS = {
    "modeled": "modeled_cost",
    "midpoint": "midpoint_cost",
    "touch_price": "touch_cost",
    "worst_case": "worst_cost",
}


def cost_scenarios(df: DataFrame, keys: Sequence[str], gross: str = "gross_return") -> DataFrame:
    """Gross return minus each cost estimate, one row per key and scenario."""

    listed = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), (F.col(gross) - F.col(cost)).alias("scenario_return"))
            for name, cost in SCENARIOS.items()
        ]
    )
    return df.select(*keys, F.inline(listed))


def cost_scenario_reject(gross: str = "gross_return") -> Column:
    """Why a cost scenario row is unusable, NULL if it is fine."""

    costs = [F.col(cost) for cost in SCENARIOS.values()]
    negative, broken = F.lit(False), F.lit(False)
    for cost in costs:
        negative = negative | (cost < 0.0)
        broken = broken | finite(F.col(gross) - cost).isNull()
    entry, roundtrip = F.col("entry_coverage"), F.col("roundtrip_coverage")
    outside = ~(entry.between(0.0, 1.0) & roundtrip.between(0.0, 1.0))
    return (
        F.when(negative, "negative_cost")
        .when(broken, "return_not_finite")
        .when(entry.isNull() != roundtrip.isNull(), "coverage_incomplete")
        .when(F.coalesce(outside, F.lit(False)), "coverage_outside")
        .when(F.lower("evidence_label").contains("fill"), "label_claims_fills")
    )


def quote_coverage(legs: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Covered share of absolute weight at entry and round trip, with all rollup levels.

    Uncovered legs stay in the denominator. Rolled-up labels read ``all``; legs with a NULL label belong to no level.
    """

    legs = keyed(legs, levels)
    size = F.abs("weight")
    entry, leave = flag("entry_covered"), flag("exit_covered")
    sums = legs.rollup(*levels).agg(
        *[F.grouping(name).alias(f"_rolled_{name}") for name in levels],
        F.count("*").alias("positions"),
        F.sum(size).alias("absolute_weight"),
        F.coalesce(F.sum(F.when(entry, size)), F.lit(0.0)).alias("entry_covered_weight"),
        F.coalesce(F.sum(F.when(entry & leave, size)), F.lit(0.0)).alias("roundtrip_covered_weight"),
    )
    whole = F.col("absolute_weight")
    return sums.select(
        *[F.when(F.col(f"_rolled_{name}") == 1, "all").otherwise(F.col(name)).alias(name) for name in levels],
        "positions", "absolute_weight", "entry_covered_weight", "roundtrip_covered_weight",
        F.try_divide(F.col("entry_covered_weight"), whole).alias("entry_coverage"),
        F.try_divide(F.col("roundtrip_covered_weight"), whole).alias("roundtrip_coverage"),
    )


def quote_scenario_costs(legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Modeled, mid, touch and worst cost of each book; a missing quote keeps the model.

    ``legs``: weight, ret, modeled_spread, other_cost, entry_spread, exit_spread,
    worst_spread (observed ones may be NULL).
    """

    size = F.abs("weight")
    modeled = F.col("modeled_spread")
    entry, leave = F.coalesce("entry_spread", modeled), F.coalesce("exit_spread", modeled)
    worst = F.coalesce("worst_spread", modeled)
    other = F.sum(size * F.col("other_cost"))
    return keyed(legs, keys).groupBy(*keys).agg(
        F.sum(F.col("weight") * F.col("ret")).alias("gross_return"),
        (F.sum(size * modeled) + other).alias("modeled_cost"),
        other.alias("midpoint_cost"),
        (F.sum(size * (entry + leave) / 2.0) + other).alias("touch_cost"),
        (F.sum(size * (F.greatest(worst, entry) + leave) / 2.0) + other).alias("worst_cost"),
        F.count_if(F.col("entry_spread").isNull()).alias("missing_quotes"),
    )


TERMS = ("spread", "fees", "slippage", "short_call_borrow", "funding")


def cost_reconstruction(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recorded cost against the sum of its terms: gaps and term totals."""

    rebuilt = sum((F.col(name) for name in TERMS[1:]), F.col(TERMS[0]))
    gap = F.abs(F.col("recorded_cost") - rebuilt)
    return keyed(rows, keys).groupBy(*keys).agg(
        F.max(gap).alias("max_absolute_gap"),
        F.avg(gap).alias("mean_absolute_gap"),
        *[F.sum(name).alias(f"total_{name}") for name in TERMS],
        F.when(F.max(gap) <= 1e-12, "exact").otherwise("differs").alias("status"),
    )


PERCENTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def spread_quantiles(rows: DataFrame, keys: Sequence[str], value: str = "relative_spread") -> DataFrame:
    return exact_quantiles(rows, keys, value, PERCENTILES)


def regime(time: str, cut: str) -> Column:
    """Label rows before or from a cut date."""

    name = cut.replace("-", "_")
    return F.when(F.col(time) < F.lit(cut).cast("timestamp"), f"pre_{name}").otherwise(f"post_{name}")


def participation(
    rows: DataFrame, group: str, bounds: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """Order size over volume (sum, maximum) and open interest: medians and breach counts."""

    ratios = {
        "participation_volume_sum": F.try_divide(F.col("contracts"), F.col("day_volume_sum").cast("double")),
        "participation_volume_max": F.try_divide(F.col("contracts"), F.col("day_volume_max").cast("double")),
        "participation_open_interest": F.try_divide(F.col("contracts"), F.col("day_open_interest").cast("double")),
    }
    wide = rows.select(group, *[value.alias(name) for name, value in ratios.items()])
    counts = keyed(wide, [group]).groupBy(group).agg(
        *[F.count_if(F.col(column) > bound).alias(name) for name, (column, bound) in bounds.items()]
    )
    long = wide.unpivot([group], list(ratios), "_measure", "_value")
    medians = exact_quantiles(long, [group, "_measure"], "_value", {"_median": 0.5})
    pivoted = medians.groupBy(group).agg(
        *[F.max(F.when(F.col("_measure") == name, F.col("_median"))).alias(name) for name in ratios]
    )
    return counts.join(pivoted, group)


def symbol_alignment(legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of exact, placeholder and exit-missing position rows."""

    entry, leave, held = flag("entry_covered"), flag("exit_covered"), flag("placeholder")
    exact = ~held
    return keyed(legs, keys).groupBy(*keys).agg(
        F.count("*").alias("active_position_rows"),
        F.count_if(exact).alias("exact_position_rows"),
        F.count_if(exact & entry).alias("exact_entry_covered_rows"),
        F.count_if(exact & ~entry).alias("exact_entry_missing_rows"),
        F.countDistinct(F.when(exact, F.col("symbol"))).alias("exact_unique_symbols"),
        F.count_if(~leave).alias("exit_missing_rows"),
        F.count_if(held).alias("unresolved_placeholder_rows"),
    )
