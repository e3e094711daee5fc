"""Policies, limits and whole-contract rounding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.functions.numeric import finite


@dataclass(frozen=True)
class Limits:
    """Book limits; None is inactive."""

    # The published first policy.

    gross_nav: float = 1.0
    net_nav_abs: float | None = 1.0
    short_nav_abs: float | None = 0.25
    per_contract_abs: float | None = 0.18
    long_only: bool = False
    full_gross: bool = False
    delta_abs: float | None = None
    gamma_abs: float | None = None
    vega_abs: float | None = None
    vix_vega_abs: float | None = 8.0
    beta_spy_abs: float | None = 3.0
    stress_loss_abs: float | None = 0.20
    underlying_gross: float | None = 0.35
    vix_future_gross: float | None = 0.20

    def exposures(self) -> dict[str, float]:
        """Active exposure limits by name."""

        bounds = {
            "delta": self.delta_abs,
            "gamma": self.gamma_abs,
            "vega": self.vega_abs,
            "vix_vega": self.vix_vega_abs,
            "beta_spy": self.beta_spy_abs,
        }
        return {name: bound for name, bound in bounds.items() if bound is not None}


@dataclass(frozen=True)
class Policy:
    """Risk policy."""

    # The published first policy.

    annual_volatility_ceiling: float = 0.15
    periods_per_year: float = 12.0
    cvar_alpha: float = 0.95
    cvar_loss_nav: float = 0.10
    stress_loss_nav: float = 0.20
    short_margin_nav: float = 0.75
    collateral_nav: float = 1.0
    lambda_floor: float = 1e-6
    lambda_ceiling: float = 1e6
    bisection_steps: int = 18
    deployment_target: float = 0.50
    deployment_edge_floor: float = 0.0

    def ladder(self) -> list[float]:
        """Geometric risk-aversion ladder from floor to ceiling."""

        steps = self.bisection_steps
        growth = self.lambda_ceiling / self.lambda_floor
        return [self.lambda_floor * growth ** (k / steps) for k in range(steps + 1)]


FIRST_POLICY = Policy()
SECOND_POLICY = Policy(annual_volatility_ceiling=0.25)
FEASIBLE = 1e-5
DUST = 1e-9


def underlying_limit(limits: Limits, underlying: str = "underlying") -> Column:
    """Gross limit of an underlying; the VIX future has its own."""

    return F.when(
        F.col(underlying) == "VX_FRONT", F.lit(limits.vix_future_gross).cast("double")
    ).otherwise(F.lit(limits.underlying_gross).cast("double"))


def exact_cover(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys present on one side only, as ``missing`` (not in right) or ``unexpected``."""

    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return (
        a.join(b, list(on), "left_anti")
        .withColumn("problem", F.lit("missing"))
        .unionByName(b.join(a, list(on), "left_anti").withColumn("problem", F.lit("unexpected")))
    )


def align_spine(spine: DataFrame, values: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """Left join onto the spine: extras vanish, gaps are marked ``missing``."""

    return spine.join(values.select(*on, column), list(on), "left").withColumn(
        "missing", F.col(column).isNull()
    )


def effective_cap(contracts: DataFrame, caps: DataFrame | None, limits: Limits) -> DataFrame:
    """Per-contract cap: the scalar limit and the contract's own cap, whichever is lower."""

    scalar = limits.gross_nav if limits.per_contract_abs is None else limits.per_contract_abs
    if caps is None:
        return contracts.withColumn("effective_cap", F.lit(float(scalar))).withColumn(
            "cap_missing", F.lit(False)
        )
    aligned = align_spine(contracts, caps, ["contract_id"], "cap")
    return (
        aligned.withColumn("effective_cap", F.least(F.lit(float(scalar)), F.col("cap")))
        .withColumnRenamed("missing", "cap_missing")
        .drop("cap")
    )


def policy_limits(contracts: DataFrame, caps: DataFrame, limits: Limits) -> DataFrame:
    """Limits of each contract's universe row, with cap coverage problems marked.

    Caps must cover the contracts exactly; contracts and caps meet in a full outer join.
    """

    joined = contracts.select("contract_id", "underlying").join(
        caps.select("contract_id", "cap"), "contract_id", "full_outer"
    )
    problem = (
        F.when(F.col("underlying").isNull(), "unexpected_cap")
        .when(F.col("cap").isNull(), "missing_cap")
        .when(~F.coalesce(finite("cap") >= 0.0, F.lit(False)), "invalid_cap")
    )
    return joined.select(
        "contract_id",
        "underlying",
        F.least(F.col("cap"), F.lit(limits.per_contract_abs)).alias("contract_limit"),
        F.when(F.col("underlying").isNotNull(), underlying_limit(limits)).alias("underlying_limit"),
        F.lit(limits.short_nav_abs).alias("short_limit"),
        F.lit(limits.beta_spy_abs).alias("beta_limit"),
        F.lit(limits.vix_vega_abs).alias("vix_vega_limit"),
        F.lit(limits.stress_loss_abs).alias("stress_limit"),
        problem.alias("problem"),
    )


def policy_reject() -> Column:
    """Why a policy row is unusable, NULL for a valid one.

    A NULL limit is inactive; the policy's own numbers are required.
    """

    def required(name: str, strict: bool) -> Column:
        value = finite(name)
        return ~F.coalesce(value > 0.0 if strict else value >= 0.0, F.lit(False))

    def bad(name: str, low: float = 0.0) -> Column:
        value = finite(name)
        return F.col(name).isNotNull() & ~F.coalesce(value >= low, F.lit(False))

    return (
        F.when(~F.coalesce(finite("gross_nav") > 0.0, F.lit(False)), "gross_not_positive")
        .when(bad("net_nav_abs"), "net_invalid")
        .when(bad("short_nav_abs"), "short_invalid")
        .when(bad("per_contract_abs"), "cap_invalid")
        .when(bad("stress_loss_abs"), "stress_invalid")
        .when(
            bad("delta_abs") | bad("gamma_abs") | bad("vega_abs") | bad("vix_vega_abs") | bad("beta_spy_abs"),
            "exposure_invalid",
        )
        .when(
            required("annual_volatility_ceiling", True) | required("periods_per_year", True), "scale_not_positive"
        )
        .when(
            required("cvar_loss_nav", False) | required("stress_loss_nav", False)
            | required("short_margin_nav", False) | required("collateral_nav", False),
            "funding_invalid",
        )
        .when(~F.coalesce((F.col("cvar_alpha") > 0) & (F.col("cvar_alpha") < 1), F.lit(False)), "alpha_outside")
        .when(
            ~F.coalesce(
                (finite("lambda_floor") > 0) & (F.col("lambda_floor") <= finite("lambda_ceiling")),
                F.lit(False),
            ),
            "lambda_not_ordered",
        )
        .when(~F.coalesce(F.col("bisection_steps") >= 1, F.lit(False)), "steps_below_one")
        .when(
            ~F.coalesce(F.col("deployment_target").between(0.0, 1.0), F.lit(False)), "target_outside"
        )
        .when(bad("deployment_edge_floor"), "edge_floor_negative")
    )


def whole_contracts(
    rows: DataFrame, nav: float, multiplier: float = 100.0, weight: str = "weight", mark: str = "mark"
) -> DataFrame:
    """Signed truncation to whole contracts and the weight they realize."""

    if nav <= 0.0 or multiplier <= 0.0:
        raise ValueError("a book needs a NAV and a multiplier above zero")
    wanted = F.col(weight) * nav / (F.col(mark) * multiplier)
    return rows.withColumn("contracts", F.signum(wanted) * F.floor(F.abs(wanted))).withColumn(
        "realized_weight", F.col("contracts") * F.col(mark) * multiplier / nav
    )
