"""Exact order statistics without sorting a large group in one task.

Values are first counted (ties collapse map-side). They are located by two histogram levels: a
logarithmic cell that is a pure function of the value, and equal-width cells between the exact ends of
a logarithmic cell. Only the distinct values of one fine cell are ordered together. State per group is
bounded by the number of cells, the plan is the same for every size, and nothing runs while it is built.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import finite
from premia.operators.paths import keyed

CELLS_PER_E = 64
CELL_OFFSET = 100_000
FINE_CELLS = 4096


def _log_cell(value: Column) -> Column:
    steps = F.floor(F.ln(F.nullif(F.abs(value), F.lit(0.0))) * CELLS_PER_E) + CELL_OFFSET
    return F.when(value == 0.0, F.lit(0)).otherwise(F.signum(value).cast("bigint") * steps)


def _fine_cell(value: Column) -> Column:
    """Equal-width cell between ``_lo`` and ``_hi``, the ends of the logarithmic cell."""

    share = F.try_divide(value - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return F.least(F.coalesce(F.floor(share * FINE_CELLS), F.lit(0)), F.lit(FINE_CELLS - 1))


def _running(cells: DataFrame, keys: Sequence[str], order: str, suffix: str) -> DataFrame:
    """Count and sum of everything before each row of a group."""

    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(
        f"_n{suffix}", F.coalesce(F.sum("_c").over(before), F.lit(0))
    ).withColumn(f"_s{suffix}", F.coalesce(F.sum("_t").over(before), F.lit(0.0)))


def rank_lookup(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    ranks: Mapping[str, Callable[[Column], Column]],
    weight: str | None = None,
) -> DataFrame:
    """Per group and named ascending 0-based rank: the value there and what lies below.

    ``ranks`` maps a name to a function of the group size. Result columns: keys, ``size``,
    ``sum`` and one struct ``name(value, below, below_sum, at)`` per rank. ``weight`` is a
    whole number of repetitions of a row.
    """

    copies = F.lit(1) if weight is None else F.col(weight)
    counted = (
        keyed(df, keys)
        .select(*keys, finite(value).alias("_v"), copies.cast("bigint").alias("_w"))
        .where(F.col("_v").isNotNull() & (F.col("_w") > 0))
        .groupBy(*keys, "_v")
        .agg(F.sum("_w").alias("_c"))
    )
    counted = counted.withColumn("_t", F.col("_v") * F.col("_c"))
    whole = Window.partitionBy(*keys)
    counted = counted.withColumn("_cell", _log_cell(F.col("_v")))
    coarse = counted.groupBy(*keys, "_cell").agg(
        F.sum("_c").alias("_c"),
        F.sum("_t").alias("_t"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("name"), rank(F.col("size")).cast("bigint").alias("rank"))
                for name, rank in ranks.items()
            ]
        )
    )
    found = (
        _running(coarse, keys, "_cell", "1")
        .withColumn("size", F.sum("_c").over(whole))
        .withColumn("sum", F.sum("_t").over(whole))
        .withColumn("_want", wanted)
        .where(
            (F.col("_n1") <= F.col("_want.rank"))
            & (F.col("_want.rank") < F.col("_n1") + F.col("_c"))
        )
        .select(*keys, "size", "sum", "_want", "_cell", "_n1", "_s1", "_lo", "_hi")
    )
    cell = [*keys, "_cell"]
    fine_rows = counted.join(found.select(*cell, "_lo", "_hi").distinct(), cell).withColumn(
        "_fine", _fine_cell(F.col("_v"))
    )
    fine_cell = [*cell, "_fine"]
    fine = fine_rows.groupBy(*fine_cell).agg(F.sum("_c").alias("_c"), F.sum("_t").alias("_t"))
    narrowed = (
        found.join(_running(fine, cell, "_fine", "2"), cell)
        .withColumn("_n2", F.col("_n1") + F.col("_n2"))
        .withColumn("_s2", F.col("_s1") + F.col("_s2"))
        .where(
            (F.col("_n2") <= F.col("_want.rank"))
            & (F.col("_want.rank") < F.col("_n2") + F.col("_c"))
        )
        .select(*fine_cell, "size", "sum", "_want", "_n2", "_s2")
    )
    last_rows = _running(
        fine_rows.join(narrowed.select(*fine_cell).distinct(), fine_cell), fine_cell, "_v", "3"
    )
    below = F.col("_n2") + F.col("_n3")
    hits = narrowed.join(
        last_rows.select(*fine_cell, "_v", "_c", "_n3", "_s3"), fine_cell
    ).where((below <= F.col("_want.rank")) & (F.col("_want.rank") < below + F.col("_c")))
    entry = F.struct(
        F.col("_v").alias("value"),
        below.alias("below"),
        (F.col("_s2") + F.col("_s3")).alias("below_sum"),
        F.col("_c").alias("at"),
    )
    return hits.groupBy(*keys).agg(
        F.max("size").alias("size"),
        F.max("sum").alias("sum"),
        *[F.max(F.when(F.col("_want.name") == name, entry)).alias(name) for name in ranks],
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probabilities: Mapping[str, float],
    weight: str | None = None,
    tail_means: bool = False,
) -> DataFrame:
    """Linearly interpolated exact quantiles, one column per name, plus ``size``.

    With ``tail_means`` also ``<name>_tail``: the mean of all values not above it.
    """

    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probabilities.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    looked = rank_lookup(df, keys, value, ranks, weight)
    columns = []
    for name, p in probabilities.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        place = (F.col("size") - 1) * F.lit(p)
        part = place - F.floor(place)
        gap = high["value"] - low["value"]
        columns.append((low["value"] + part * gap).alias(name))
        if tail_means:
            upper = F.when((part > 0) & (gap == 0), high).otherwise(low)
            mass = upper["below_sum"] + upper["value"] * upper["at"]
            columns.append((mass / (upper["below"] + upper["at"])).alias(f"{name}_tail"))
    return looked.select(*keys, "size", *columns)


def tail_mass(n: Column, alpha: float) -> Column:
    """How many of ``n`` values the worst (1 - alpha) share holds, in part too."""

    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie between zero and one")
    exact = n.cast("double") * F.lit(1.0 - alpha)
    return F.when(F.abs(exact - F.rint(exact)) <= 1e-12, F.rint(exact)).otherwise(exact)


def fractional_tail_mean(
    df: DataFrame,
    keys: Sequence[str],
    loss: str | Column,
    alpha: float,
    weight: str | None = None,
    name: str = "cvar",
) -> DataFrame:
    """Mean of the worst (1 - alpha) share of losses, the last one counted in part."""

    def edge_rank(n: Column) -> Column:
        return n - F.greatest(F.ceil(tail_mass(n, alpha)), F.lit(1))

    looked = rank_lookup(df, keys, loss, {"_edge": edge_rank}, weight)
    edge, m = F.col("_edge"), tail_mass(F.col("size"), alpha)
    above = F.col("size") - edge["below"] - edge["at"]
    above_sum = F.col("sum") - edge["below_sum"] - edge["value"] * edge["at"]
    return looked.select(
        *keys, "size", ((above_sum + (m - above) * edge["value"]) / m).alias(name)
    )



def _offsets(counts: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], falling: bool) -> DataFrame:
    """Rows before each counted value of a group (``_before``), by two levels of cells.

    ``counts`` has one row per distinct value (and sub-order) with its count ``_n``. Each window is over cells,
    or over the values of one fine cell, so values crowded near one level are still split.
    """

    sign = F.lit(-1 if falling else 1)
    cell, fine = [*keys, "_cell"], [*keys, "_cell", "_fine"]
    celled = counts.withColumn("_cell", sign * _log_cell(F.col(value)))
    ends = celled.groupBy(*cell).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = celled.join(ends, cell).withColumn("_fine", sign * _fine_cell(F.col(value))).drop("_lo", "_hi")

    def before(table: DataFrame, group: Sequence[str], by: Sequence[str | Column], name: str) -> DataFrame:
        window = Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumn(name, F.coalesce(F.sum("_n").over(window), F.lit(0)))

    fines = rows.groupBy(*fine).agg(F.sum("_n").alias("_n"))
    cells = fines.groupBy(*cell).agg(F.sum("_n").alias("_n"))
    placed = (
        before(fines, cell, ["_fine"], "_b")
        .drop("_n")
        .join(before(cells, keys, ["_cell"], "_a").drop("_n"), cell)
        .select(*fine, (F.col("_a") + F.col("_b")).alias("_above"))
    )
    return (
        before(rows, fine, order, "_within")
        .join(placed, fine)
        .withColumn("_before", F.col("_above") + F.col("_within"))
        .drop("_above", "_within", "_fine")
    )


def full_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: Sequence[str],
    name: str = "rank",
    tie_block: Column | None = None,
) -> DataFrame:
    """1-based rank of every row by descending value, ties in the order of ``tie``.

    Distinct values are ordered fine cell by fine cell. Rows of one value are ordered in parts:
    ``tie_block`` must not decrease along ``tie`` (for example the year of a date), so that
    even a value shared by very many rows is never ordered in one task.
    """

    part = F.lit(0) if tie_block is None else tie_block
    rows = (
        keyed(df, keys)
        .where(F.col(value).isNotNull())
        .withColumn("_part", part)
    )
    place = [*keys, value, "_part"]
    counts = rows.groupBy(*place).agg(F.count("*").alias("_n"))
    offsets = _offsets(counts, keys, value, [F.col(value).desc(), F.col("_part")], True).drop("_n", "_cell")
    inside = Window.partitionBy(*place).orderBy(*tie)
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, place)
        .select(*df.columns, (F.col("_before") + F.col("_rn")).alias(name))
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """1-based ascending rank with ties sharing their average; NULL values get NULL.

    Ranks are computed on distinct values and joined back, so ties cost nothing.
    """

    counts = (
        keyed(df, [*keys, value])
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_n"))
    )
    ranked = _offsets(counts, keys, value, [F.col(value)], False)
    place = F.col("_before") + (F.col("_n") + 1) / 2.0
    return df.join(ranked.select(*keys, value, place.alias(name)), [*keys, value], "left").select(
        *df.columns, name
    )
