"""Decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from premia.functions.numeric import col, finite


def validation_status(
    p05: str | Column = "sharpe_p05",
    p50: str | Column = "sharpe_p50",
    default_share: str | Column = "default_share",
    minimum_wealth: str | Column = "minimum_terminal_wealth",
    feasible: Column | None = None,
) -> Column:
    """fail_infeasible, then fail_default, then pass / mixed / fail_sharpe."""

    share, wealth = finite(col(default_share)), finite(col(minimum_wealth))
    survived = F.coalesce((share <= 0.0) & (wealth > 0.0), F.lit(False))
    allowed = F.lit(True) if feasible is None else F.coalesce(feasible, F.lit(False))
    return (
        F.when(~allowed, "fail_infeasible")
        .when(~survived, "fail_default")
        .when(finite(col(p05)) > 0.0, "pass")
        .when(finite(col(p50)) > 0.0, "mixed")
        .otherwise("fail_sharpe")
    )


# Check names and the rule each follows.
SIGN_CHECKS = ("MC refit", "MC resample", "Repriced")
SCOPE_OF_CHECK = {
    "Liquid CPCV": "liquid_era_2018_plus",
    "Claim CPCV": "claim_window_2020_plus",
}


def robustness_status(check: Column, primary: Column, secondary: Column, looked_up: Column) -> Column:
    """Status of one robustness row; ``looked_up`` is the path summary's status."""

    by_sign = F.when(primary > 0.0, "pass").when(secondary > 0.0, "mixed").otherwise("fail")
    by_rank = F.when(primary <= 0.30, "pass").when(primary <= 0.50, "mixed").otherwise("fail")
    return (
        F.when(check.isin(*SIGN_CHECKS), by_sign)
        .when(check == "Rolling OOS", F.when(primary > 0.0, "pass").otherwise("fail"))
        .when(check == "PBO rank", by_rank)
        .when(
            check.isin(*SCOPE_OF_CHECK),
            F.when(looked_up == "survived", "pass").otherwise(looked_up),
        )
    )
