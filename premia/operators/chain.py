"""Contract chains: checks, pricing under shocks, loadings, exposures, means, returns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import finite, number, ratio
from premia.functions.pricing import with_black_scholes
from premia.operators.paths import keyed

# Underlyings whose vega counts as VIX vega.
VIX_NAMES = ("VX_FRONT", "VIX", "VIX_OPTION")
GREEKS = ("delta", "gamma", "vega", "theta")


def repriced(chain: DataFrame, shocks: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """Each contract under each shock (spot factor, volatility shift, years passed).

    The shocks are a parameter of a few entries, so they ride along as a literal array.
    """

    base = with_black_scholes(chain, "mark", greeks=False)
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("shock"),
                F.lit(float(factor)).alias("factor"),
                F.lit(float(shift)).alias("shift"),
                F.lit(float(years)).alias("years"),
            )
            for name, (factor, shift, years) in shocks.items()
        ]
    )
    shocked = (
        base.withColumn("_shock", F.explode(listed))
        .withColumn("shock", F.col("_shock.shock"))
        .withColumn("base_spot", F.col("spot"))
        .withColumn("base_maturity", F.col("maturity"))
        .withColumn("spot", F.col("spot") * F.col("_shock.factor"))
        .withColumn("volatility", F.col("volatility") + F.col("_shock.shift"))
        .withColumn("maturity", F.greatest(F.col("maturity") - F.col("_shock.years"), F.lit(0.0)))
        .withColumn("volatility_change", F.col("_shock.shift"))
        .drop("_shock")
    )
    return with_black_scholes(shocked, "shocked_mark", greeks=False).withColumn(
        "ret", ratio(F.col("shocked_mark"), F.col("mark")) - 1.0
    )


def contract_reject() -> Column:
    """Why a contract row is unusable (identity checked separately), NULL if it is fine."""

    greeks = F.lit(False)
    for name in GREEKS:
        greeks = greeks | finite(name).isNull()
    return (
        F.when(F.col("contract_id").isNull() | F.col("underlying").isNull(), "missing_label")
        .when(~F.coalesce(finite("mark") > 0.0, F.lit(False)), "mark_not_positive")
        .when(~F.coalesce(finite("spot") > 0.0, F.lit(False)), "spot_not_positive")
        .when(greeks, "greeks_not_finite")
    )


def contract_check(contracts: DataFrame, keys: Sequence[str] = ("contract_id",)) -> DataFrame:
    """Every contract id with its row count, its worst reason and validity."""

    reason = contract_reject()
    return (
        contracts.withColumn("_reason", reason)
        .groupBy(*keys)
        .agg(F.count("*").alias("copies"), F.max("_reason").alias("_reason"))
        .withColumn("reason", F.when(F.col("copies") > 1, "duplicate_id").otherwise(F.col("_reason")))
        .withColumn("valid", F.col("reason").isNull())
        .drop("_reason")
    )


def greek_loadings(contracts: DataFrame, keys: Sequence[str] = ("contract_id",)) -> DataFrame:
    """Long loadings on the three factors of the own underlying; other cells are absent."""

    mark, spot = F.col("mark"), F.col("spot")
    name = F.col("underlying").cast("string")
    cells = F.array(
        F.struct(
            F.concat(F.lit("r_"), name).alias("factor"), (F.col("delta") * spot / mark).alias("loading")
        ),
        F.struct(
            F.concat(F.lit("r2_"), name).alias("factor"),
            (F.col("gamma") * spot * spot * 0.5 / mark).alias("loading"),
        ),
        F.struct(F.concat(F.lit("dv_"), name).alias("factor"), (F.col("vega") / mark).alias("loading")),
    )
    return contracts.select(*keys, F.inline(cells))


def with_risk_exposures(contracts: DataFrame) -> DataFrame:
    """Add the NAV exposures used by limits (the gamma scale is twice the loading's)."""

    mark, spot = F.col("mark"), F.col("spot")
    kind = (
        F.lower(F.coalesce(F.col("asset_class").cast("string"), F.lit("equity_option")))
        if "asset_class" in contracts.columns
        else F.lit("equity_option")
    )
    vix = F.upper(F.col("underlying").cast("string")).isin(*VIX_NAMES) | (kind == "vix_option")
    table = (
        contracts.withColumn("delta_nav", F.col("delta") * spot / mark)
        .withColumn("gamma_nav", F.col("gamma") * spot * spot / mark)
        .withColumn("vega_nav", F.col("vega") / mark)
        .withColumn("vix_vega_nav", F.when(vix, F.col("vega_nav")).otherwise(0.0))
    )
    if "beta_spy_nav" in contracts.columns:
        return table.withColumn("beta_spy_nav", number("beta_spy_nav"))
    if "underlying_beta_spy" in contracts.columns:
        return table.withColumn("beta_spy_nav", F.col("delta_nav") * number("underlying_beta_spy"))
    return table


@dataclass(frozen=True)
class Eligibility:
    """Decision-date thresholds; None switches a rule off."""

    min_mark: float | None = 0.5
    min_maturity: float | None = 0.02
    max_maturity: float | None = None
    min_moneyness: float | None = None
    max_moneyness: float | None = None
    min_volume: float | None = None
    min_open_interest: float | None = None
    max_relative_spread: float | None = None
    assignable: bool | None = None


def is_eligible(rules: Eligibility) -> Column:
    """Whether a contract passes every active rule; a missing value passes none."""

    return reduce(lambda a, b: a & b, [F.coalesce(test, F.lit(False)) for test in _tests(rules)], F.lit(True))


def eligible(contracts: DataFrame, rules: Eligibility) -> DataFrame:
    """Contracts that pass every active rule; all rules are plain column filters."""

    for test in _tests(rules):
        contracts = contracts.where(test)
    return contracts


def _tests(rules: Eligibility) -> list[Column]:
    moneyness = F.col("strike") / F.col("spot")
    tests: list[Column] = []
    for bound, value, low in (
        (rules.min_mark, F.col("mark"), True),
        (rules.min_maturity, F.col("maturity"), True),
        (rules.max_maturity, F.col("maturity"), False),
        (rules.min_moneyness, moneyness, True),
        (rules.max_moneyness, moneyness, False),
    ):
        if bound is not None:
            tests.append(value >= bound if low else value <= bound)
    if rules.min_volume is not None:
        tests.append(F.col("volume") >= rules.min_volume)
    if rules.min_open_interest is not None:
        tests.append(F.col("open_interest") >= rules.min_open_interest)
    if rules.max_relative_spread is not None:
        tests.append(F.col("relative_spread") <= rules.max_relative_spread)
    if rules.assignable is not None:
        tests.append(F.col("short_allowed") == F.lit(rules.assignable))
    return tests


# Weight on the structural mean after both shrinkages, and the clip.
MEAN_WEIGHT = 0.1875
MEAN_CLIP = 0.35
CHANNELS = {
    "Full": (),
    "No carry": ("carry",),
    "No delta": ("delta_premium",),
    "No vol/VRP": ("variance_premium", "volatility_premium"),
    "No skew/tail": ("skew_premium",),
    "No relative value": ("relative_value",),
}
LEDGER = (
    "carry", "delta_premium", "variance_premium", "volatility_premium", "skew_premium",
    "relative_value",
)


def with_mean_channels(contracts: DataFrame) -> DataFrame:
    """The ledger columns of the structural mean, from Greeks and premia on the row."""

    mark, spot = F.col("mark"), F.col("spot")
    return contracts.withColumns(
        {
            "carry": F.col("theta") / mark / 12.0,
            "delta_premium": F.col("delta") * spot / mark * F.col("lambda_spot"),
            "variance_premium": F.col("gamma") * spot * spot * 0.5 / mark * F.col("lambda_var"),
            "volatility_premium": F.col("vega") / mark * F.col("lambda_vol"),
            "skew_premium": F.col("lambda_skew"),
            "relative_value": F.col("lambda_rv"),
        }
    )


def shrunk_mean(raw: Column) -> Column:
    """The raw mean shrunk and clipped; NULL stays NULL (greatest and least would pass over it)."""

    clipped = F.greatest(F.lit(-MEAN_CLIP), F.least(F.lit(MEAN_CLIP), raw * MEAN_WEIGHT))
    return F.when(raw.isNotNull(), clipped)


def structural_mean(contracts: DataFrame) -> DataFrame:
    """Structural mean of each contract with its ledger columns."""

    raw = sum((F.col(name) for name in LEDGER[1:]), F.col(LEDGER[0]))
    return (
        with_mean_channels(contracts)
        .withColumn("structural_mean", raw)
        .withColumn("expected_return", shrunk_mean(F.col("structural_mean")))
    )


def channel_ablation(contracts: DataFrame, keys: Sequence[str] = ("contract_id",)) -> DataFrame:
    """The structural mean with one channel removed, one row per contract and arm."""

    arms = [
        F.struct(
            F.lit(arm).alias("arm"),
            shrunk_mean(sum((F.col(c) for c in LEDGER if c not in out), F.lit(0.0))).alias(
                "expected_return"
            ),
        )
        for arm, out in CHANNELS.items()
    ]
    return with_mean_channels(contracts).select(*keys, F.inline(F.array(*arms)))


def premium_weights(
    positions: DataFrame, contracts: DataFrame, nav: float, multiplier: float = 100.0
) -> DataFrame:
    """Premium weight w = N m C / W of each position, NULL where the contract is unknown or has no mark."""

    marks = contracts.select("contract_id", "mark")
    return positions.join(marks, "contract_id", "left").withColumn(
        "weight", F.col("contracts") * F.col("mark") * multiplier / nav
    )


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    ahead: bool,
    block: Column | None = None,
) -> DataFrame:
    """Add ``next_<c>`` (or ``prev_<c>``) and ``next_<order>`` along each path.

    Rows are ordered inside time blocks; the edge row of the adjacent non-empty block is
    carried over, so a long path is never ordered in one task.
    """

    prefix, step = ("next_", 1) if ahead else ("prev_", -1)
    payload = F.struct(F.col(order), *[F.col(name) for name in columns])
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_block")
    rows = (
        keyed(df, keys)
        .withColumn("_block", F.year(order) if block is None else block)
        .withColumn("_pay", payload)
        .withColumn("_near", F.lead("_pay", step).over(inside))
    )
    edge = F.min_by if ahead else F.max_by
    carry = (
        rows.groupBy(*keys, "_block")
        .agg(edge("_pay", order).alias("_edge"))
        .withColumn("_far", F.lead("_edge", step).over(across))
        .select(*keys, "_block", "_far")
    )
    found = F.coalesce("_near", "_far")
    return rows.join(carry, [*keys, "_block"]).select(
        *df.columns, *[found[name].alias(prefix + name) for name in (order, *columns)]
    )


def option_returns(
    marks: DataFrame, settlements: DataFrame | None, order: str = "period"
) -> DataFrame:
    """Holding-period return; a settlement for the period replaces the later mark."""

    rows = neighbour(marks, ["contract_id"], order, ["mark"], ahead=True)
    if settlements is None:
        later, source = F.col("next_mark"), F.lit("mark")
    else:
        rows = rows.join(settlements.select("contract_id", order, "settlement"), ["contract_id", order], "left")
        later = F.coalesce("settlement", "next_mark")
        source = F.when(F.col("settlement").isNotNull(), "settlement").otherwise("mark")
    return rows.select(
        "contract_id",
        order,
        source.alias("exit_source"),
        (ratio(later, F.col("mark")) - 1.0).alias("ret"),
    ).where(F.col("ret").isNotNull())


def factor_returns(panel: DataFrame, order: str = "period") -> DataFrame:
    """Underlying return, centred squared return and volatility change per period."""

    rows = neighbour(panel, ["underlying"], order, ["spot", "volatility"], ahead=False)
    moves = rows.select(
        "underlying",
        order,
        (ratio(F.col("spot"), F.col("prev_spot")) - 1.0).alias("u"),
        (F.col("volatility") - F.col("prev_volatility")).alias("dv"),
    ).where(F.col("u").isNotNull())
    square = F.col("u") * F.col("u")
    centre = moves.groupBy("underlying").agg(F.avg(square).alias("_mean"))
    return moves.join(centre, "underlying").select(
        "underlying", order, "u", (square - F.col("_mean")).alias("u2_centred"), "dv"
    )


def taylor_attribution(start: DataFrame, end: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Second-order attribution of a price change and what it leaves unexplained.

    ``end`` carries ``end_mark``, ``end_spot``, ``end_volatility`` and ``years``.
    """

    ds = F.col("end_spot") - F.col("spot")
    moved = start.join(end, list(keys)).withColumns(
        {
            "delta_pnl": F.col("delta") * ds,
            "gamma_pnl": F.col("gamma") * ds * ds * 0.5,
            "vega_pnl": F.col("vega") * (F.col("end_volatility") - F.col("volatility")),
            "theta_pnl": F.col("theta") * F.col("years"),
            "pnl": F.col("end_mark") - F.col("mark"),
        }
    )
    explained = F.col("delta_pnl") + F.col("gamma_pnl") + F.col("vega_pnl") + F.col("theta_pnl")
    return moved.select(
        *keys, "delta_pnl", "gamma_pnl", "vega_pnl", "theta_pnl", "pnl",
        (F.col("pnl") - explained).alias("residual"),
    )
