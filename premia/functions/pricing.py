"""Black-Scholes-Merton prices and Greeks of a whole chain as column stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.functions.numeric import finite, materialized, normal_pdf, positive, with_normal_cdf

INPUTS = ("spot", "strike", "maturity", "rate", "volatility", "dividend_yield")


def pricing_reject() -> Column:
    """Why a row cannot be priced, NULL for a valid row."""

    missing = F.lit(False)
    for name in INPUTS:
        missing = missing | finite(name).isNull()
    return (
        F.when(missing, "not_finite")
        .when(F.col("spot") <= 0.0, "spot_not_positive")
        .when(F.col("strike") <= 0.0, "strike_not_positive")
        .when(F.col("maturity") < 0.0, "maturity_negative")
        .when(~F.coalesce(F.col("kind").isin("call", "put"), F.lit(False)), "kind_unknown")
        .when(F.col("volatility") < 0.0, "volatility_negative")
        .when((F.col("maturity") > 0.0) & (F.col("volatility") == 0.0), "volatility_not_positive")
    )


def with_black_scholes(df: DataFrame, price: str = "price", greeks: bool = True) -> DataFrame:
    """Add the price and, if asked, delta, gamma, vega and annual theta.

    Rows outside the pricing domain get NULL. At maturity 0 the price is the intrinsic
    value, delta is +1 or -1 strictly in the money and the other Greeks are 0.
    """

    spot, strike, t = F.col("spot"), F.col("strike"), F.col("maturity")
    rate, sigma, carry = F.col("rate"), F.col("volatility"), F.col("dividend_yield")
    ok, call, alive = F.col("_bs_ok"), F.col("kind") == "call", F.col("maturity") > 0.0
    sd, d1 = F.col("_bs_sd"), F.col("_bs_d1")
    staged = (
        df.withColumn("_bs_ok", pricing_reject().isNull())
        .withColumn("_bs_sd", F.when(ok & alive, sigma * F.sqrt(t)))
        .withColumn(
            "_bs_d1",
            F.when(
                sd.isNotNull(),
                (F.ln(spot / strike) + (rate - carry + sigma * sigma * 0.5) * t) / sd,
            ),
        )
        .withColumn("_bs_d2", d1 - sd)
        .withColumn("_bs_s", F.when(ok, spot * F.exp(-carry * t)))
        .withColumn("_bs_k", F.when(ok, strike * F.exp(-rate * t)))
    )
    staged = with_normal_cdf(staged, "_bs_d1", "_bs_n1", "_bs_m1")
    staged = with_normal_cdf(staged, "_bs_d2", "_bs_n2", "_bs_m2")
    s, k = F.col("_bs_s"), F.col("_bs_k")
    n1, m1, n2, m2 = (F.col(f"_bs_{name}") for name in ("n1", "m1", "n2", "m2"))
    value = F.when(
        ok,
        F.when(alive, F.when(call, s * n1 - k * n2).otherwise(k * m2 - s * m1)).otherwise(
            F.when(call, positive(spot - strike)).otherwise(positive(strike - spot))
        ),
    )
    staged = materialized(staged, value.alias(price))
    if greeks:
        at_end = F.when(call & (spot > strike), 1.0).when(~call & (spot < strike), -1.0).otherwise(0.0)
        yield_factor = F.exp(-carry * t)
        density = F.col("_bs_phi")
        decay = -(s * density * sigma) / (F.sqrt(t) * 2.0)
        theta = F.when(call, decay - rate * k * n2 + carry * s * n1).otherwise(
            decay + rate * k * m2 - carry * s * m1
        )
        live = sd.isNotNull()
        staged = staged.withColumn("_bs_phi", normal_pdf("_bs_d1")).withColumns(
            {
                "delta": F.when(
                    ok,
                    F.when(alive, F.when(call, yield_factor * n1).otherwise(-yield_factor * m1)).otherwise(at_end),
                ),
                "gamma": F.when(live, yield_factor * density / (spot * sd)).when(ok, 0.0),
                "vega": F.when(live, s * density * F.sqrt(t)).when(ok, 0.0),
                "theta": F.when(live, theta).when(ok, 0.0),
            }
        )
    return staged.drop(*[name for name in staged.columns if name.startswith("_bs_")])
