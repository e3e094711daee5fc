"""Choosing among candidate books supplied by the user.

The convex programs behind the policies are not solved here: the job scores, audits and
ranks any number of given candidates, which approximates the program only as well as the
candidates cover it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import finite
from premia.operators.audit import book_rows, feasible_books, leg_cost
from premia.operators.paths import keyed
from premia.operators.policy import DUST, Limits, Policy
from premia.session import written

EDGE_DUST = 1e-12


def with_edge(rows: DataFrame, floor: float = 0.0) -> DataFrame:
    """Directional mean minus directional cost of each leg and whether it clears the floor."""

    sign = F.signum("weight")
    cost = F.when(sign > 0, F.col("long_cost")).when(sign < 0, F.col("short_cost")).otherwise(0.0)
    return rows.withColumn("edge", sign * F.col("expected_return") - cost).withColumn(
        "eligible", (sign != 0) & (F.col("edge") > floor + EDGE_DUST)
    )


def missing(rows: DataFrame) -> Column:
    return F.col("contract_missing") if "contract_missing" in rows.columns else F.lit(False)


def edge_counts(rows: DataFrame, floor: float = 0.0) -> DataFrame:
    """Eligible legs, their gross weight and total edge per book, and the legs without a contract (never eligible)."""

    w = F.abs("weight")
    return (
        with_edge(rows, floor)
        .groupBy("book_id")
        .agg(
            F.count("*").alias("legs"),
            F.count_if(missing(rows)).alias("missing_contracts"),
            F.count_if("eligible").alias("positive_edge_contracts"),
            F.coalesce(F.sum(F.when(F.col("eligible"), w)), F.lit(0.0)).alias("eligible_gross"),
            F.coalesce(F.sum(F.when(F.col("eligible"), w * F.col("edge"))), F.lit(0.0)).alias(
                "eligible_edge"
            ),
        )
    )


def book_utility_terms(rows: DataFrame) -> DataFrame:
    """Mean, predictable cost and gross of each book, NULL for a book with a leg that no contract stands behind."""

    sound = ~F.bool_or(missing(rows))
    return rows.groupBy("book_id").agg(
        F.when(sound, F.sum(F.col("weight") * F.col("expected_return"))).alias("mean"),
        F.when(sound, F.sum(leg_cost())).alias("cost"),
        F.when(sound, F.sum(F.abs("weight"))).alias("gross"),
    )


def net_utility(books: DataFrame, ladder: Sequence[float]) -> DataFrame:
    """Mean - cost - lambda/2 variance of each book at each risk aversion.

    The ladder is a parameter of a few values carried as a literal array.
    """

    values = F.array(*[F.lit(float(value)) for value in ladder])
    variance = F.col("volatility") * F.col("volatility")
    return books.withColumn("risk_aversion", F.explode(values)).withColumn(
        "net_utility", F.col("mean") - F.col("cost") - F.col("risk_aversion") * variance * 0.5
    )


def select_candidate(candidates: DataFrame, policy: Policy, group: str = "decision_id") -> DataFrame:
    """Per decision the smallest risk aversion whose best feasible book is calm enough.

    ``candidates``: decision, book_id, mean, cost, volatility, feasible. Only maxima of
    structs are aggregated, so a decision with very many candidates needs no sort.
    """

    ceiling = policy.annual_volatility_ceiling / policy.periods_per_year**0.5
    # The least struct: highest utility, then smallest id (of any type that has an order).
    best = F.min(
        F.when(
            F.col("feasible"),
            F.struct(
                (-F.col("net_utility")).alias("minus_utility"),
                F.col("book_id"),
                F.col("volatility"),
                F.col("mean"),
                F.col("cost"),
            ),
        )
    ).alias("_best")
    winners = net_utility(candidates, policy.ladder()).groupBy(group, "risk_aversion").agg(best)
    calm = F.col("_best.volatility") <= ceiling
    chosen = winners.groupBy(group).agg(
        F.min(F.when(calm, F.struct("risk_aversion", "_best"))).alias("_pick"),
        F.bool_or(F.col("_best").isNotNull()).alias("_any"),
    )
    pick = F.col("_pick._best")
    status = (
        F.when(F.col("_pick").isNotNull(), "optimal")
        .when(F.col("_any"), "ceiling_not_reached")
        .otherwise("no_feasible_candidate")
    )
    return chosen.select(
        group,
        status.alias("status"),
        F.col("_pick.risk_aversion").alias("risk_aversion"),
        pick["book_id"].alias("book_id"),
        (-pick["minus_utility"]).alias("net_utility"),
        pick["volatility"].alias("volatility"),
    )


def scaled_to_budget(candidates: DataFrame, budget: float) -> DataFrame:
    """Candidates sized along their own direction to exactly the budget: mean, volatility and gross scale together.

    A candidate without gross, or with a gross that is not finite, has no direction and no numbers.
    """

    size = F.when(F.coalesce(finite("gross") > 0.0, F.lit(False)), F.lit(float(budget)) / F.col("gross"))
    return candidates.withColumns(
        {
            "mean": F.col("mean") * size,
            "volatility": F.col("volatility") * size,
            "gross": F.when(size.isNotNull(), F.lit(float(budget))),
        }
    )


def select_max_sharpe(
    candidates: DataFrame, budget: float, group: str = "decision_id", tolerance: float = 1e-5
) -> DataFrame:
    """Best mean over volatility among candidates whose gross equals the budget."""

    sharpe = F.try_divide(F.col("mean"), F.col("volatility"))
    usable = (F.abs(F.col("gross") - budget) <= tolerance) & (F.col("volatility") > 0.0)
    best = F.min(F.struct((-sharpe).alias("minus_sharpe"), F.col("book_id")))
    return (
        candidates.where(usable)
        .groupBy(group)
        .agg(best.alias("_best"), F.count("*").alias("candidates"))
        .select(
            group,
            F.col("_best.book_id").alias("book_id"),
            (-F.col("_best.minus_sharpe")).alias("sharpe"),
            "candidates",
        )
    )


#: Powers of the edge by which candidate sizes are tilted.
TILTS = (0.0, 0.5, 1.0)


def scale_to_target(
    stage1: DataFrame,
    books: DataFrame,
    contracts: DataFrame,
    scenarios: DataFrame,
    volatility_of: Callable[[DataFrame], DataFrame],
    limits: Limits,
    policy: Policy,
    tilts: Sequence[float] = TILTS,
) -> tuple[DataFrame, DataFrame]:
    """Second stage: raise a first-stage book to the deployment target if that is feasible.

    ``stage1``: book_id, accepted, risk_aversion. Candidates keep the signs, hold only
    positive-edge legs and have exactly the target gross; they differ in how much the
    edge tilts the sizes (``tilts``, powers of the edge). A book with a leg that no contract stands behind is not accepted. Only accepted books below the target have
    candidates. Returns one diagnostics row per book and the legs of the candidates, whose id is the struct (book_id, tilt); ``tilt`` numbers the powers.
    """

    target, floor = policy.deployment_target, policy.deployment_edge_floor
    rows = with_edge(book_rows(books, contracts), floor)
    counts = rows.groupBy("book_id").agg(
        F.sum(F.abs("weight")).alias("stage1_gross_nav"),
        F.count_if(F.col("weight") != 0.0).alias("_nonzero"),
        F.count_if("eligible").alias("_eligible"),
        F.bool_or("contract_missing").alias("_missing"),
    )
    table = stage1.join(counts, "book_id").withColumn("accepted", F.col("accepted") & ~F.col("_missing"))
    table = written(table, "stage1")
    enough = F.col("stage1_gross_nav") >= target - 1e-7
    below = table.where(F.col("accepted") & ~enough).select("book_id", "risk_aversion")
    rows = with_edge(book_rows(books.join(below.select("book_id"), "book_id", "left_semi"), contracts), floor)
    powers = F.array(
        *[F.struct(F.lit(k).alias("tilt"), F.lit(float(power)).alias("power")) for k, power in enumerate(tilts)]
    )
    sized = (
        rows.where("eligible")
        .select("book_id", "contract_id", "weight", "edge", F.inline(powers))
        .withColumn("_raw", F.abs("weight") * F.pow("edge", F.col("power")))
    )
    sums = sized.groupBy("book_id", "tilt").agg(F.sum("_raw").alias("_sum"))
    legs = sized.join(sums, ["book_id", "tilt"]).select(
        F.struct("book_id", "tilt").alias("book_id"),
        "contract_id",
        (F.signum("weight") * F.col("_raw") / F.col("_sum") * target).alias("weight"),
    )
    legs = written(legs, "candidates")
    scored = (
        feasible_books(legs, contracts, scenarios, volatility_of, limits, policy)
        .select("book_id.book_id", "book_id.tilt", "feasible", "mean", "cost", "volatility", "gross")
        .join(below, "book_id")
        .withColumn(
            "_score",
            F.col("mean") - F.col("cost")
            - F.col("risk_aversion") * F.col("volatility") * F.col("volatility") * 0.5,
        )
    )
    best = scored.groupBy("book_id").agg(
        F.max(
            F.when(
                F.col("feasible"),
                F.struct("_score", (-F.col("tilt")).alias("minus_tilt"), "gross"),
            )
        ).alias("_best")
    )
    table = table.join(best, "book_id", "left")
    applied = F.col("accepted") & ~enough & F.col("_best").isNotNull()
    final_gross = F.when(applied, F.col("_best.gross")).otherwise(F.col("stage1_gross_nav"))
    verdict = table.select(
        "book_id",
        "stage1_gross_nav",
        F.lit(target).alias("deployment_target"),
        (F.col("accepted") & (enough | F.col("_best").isNotNull())).alias("deployment_target_feasible"),
        applied.alias("deployment_target_applied"),
        (final_gross >= target - 1e-6).alias("deployment_target_met"),
        F.when(~F.col("accepted"), 0)
        .when(enough, F.col("_nonzero"))
        .otherwise(F.col("_eligible"))
        .alias("positive_edge_contracts"),
        F.when(applied, -F.col("_best.minus_tilt")).alias("tilt"),
    )
    return verdict, legs


def naive_books(
    contracts: DataFrame, group: str, risk: str, budget: float, cap: float
) -> DataFrame:
    """Equal-premium and equal-risk capped weights of every group's contracts."""

    inverse = F.when(F.col(risk) > 0.0, F.try_divide(F.lit(1.0), F.col(risk)))
    totals = keyed(contracts, [group]).groupBy(group).agg(
        F.count("*").alias("_n"), F.sum(inverse).alias("_inverse")
    )
    limit = F.lit(float(cap))
    return contracts.join(totals, group).select(
        group,
        "contract_id",
        F.least(F.lit(budget) / F.col("_n"), limit).alias("equal_premium_capped"),
        F.least(F.coalesce(inverse, F.lit(0.0)) / F.col("_inverse") * budget, limit).alias(
            "equal_risk_capped"
        ),
    )


def weight_summary(books: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contract rows, active legs, gross, net, long, short and largest weight per book."""

    w = F.col("weight")
    return keyed(books, keys).groupBy(*keys).agg(
        F.count("*").alias("contract_rows"),
        F.count_if(F.abs(w) > DUST).alias("active_contracts"),
        F.sum(F.abs(w)).alias("gross_weight"),
        F.sum(w).alias("net_weight"),
        F.sum(F.when(w > 0.0, w).otherwise(0.0)).alias("long_weight"),
        F.sum(F.when(w < 0.0, -w).otherwise(0.0)).alias("short_weight"),
        F.max(F.abs(w)).alias("max_abs_weight"),
    )


def top_share(books: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """Share of gross in the k largest legs.

    The rank filter is applied before the shuffle too (each task keeps its k largest per
    book), so a huge book sends only k rows per task.
    """

    size = keyed(books, keys).select(*keys, "contract_id", F.abs("weight").alias("_size"))
    order = Window.partitionBy(*keys).orderBy(F.col("_size").desc(), "contract_id")
    largest = (
        size.withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= k)
        .groupBy(*keys)
        .agg(F.sum("_size").alias("_top"))
    )
    gross = size.groupBy(*keys).agg(F.sum("_size").alias("_gross"))
    return gross.join(largest, list(keys)).select(
        *keys, F.try_divide(F.col("_top"), F.col("_gross")).alias(f"top{k}_share")
    )


def concentration(books: DataFrame, keys: Sequence[str], cap: str, candidates: Column) -> DataFrame:
    """Candidates, active legs, deployed gross, top-five share, legs at cap, cap budget."""

    size = F.abs("weight")
    active = size > DUST
    sums = keyed(books, keys).groupBy(*keys).agg(
        F.count_if(candidates).alias("n_candidate_contracts"),
        F.count_if(active).alias("n_active_contracts"),
        F.sum(size).alias("deployed_gross"),
        F.count_if(active & (size >= F.col(cap) - DUST)).alias("n_active_at_cap"),
        F.sum(cap).alias("cap_budget"),
    )
    share = F.try_divide(F.col("n_active_at_cap"), F.col("n_active_contracts").cast("double"))
    return sums.withColumn("at_cap_share", share).join(top_share(books, keys), list(keys))
