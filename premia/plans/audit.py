"""Queries on policies, book audits and rounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.operators import audit, chain, covariance, policy
from premia.operators.ranks import fractional_tail_mean, full_rank
from premia.plans.chain import EXPOSURES, SHOCKS, means
from premia.plans.covariance import joint
from premia.plans.inputs import TEXT, load, view
from premia.plans.registry import VIEWS, oracle, query
from premia.session import width, written

# Generous enough that some of the test books pass.
LIMITS = policy.Limits(
    gross_nav=0.50, net_nav_abs=0.30, short_nav_abs=0.22, per_contract_abs=0.07,
    delta_abs=1.5, vix_vega_abs=0.4, beta_spy_abs=1.5, stress_loss_abs=0.4,
    underlying_gross=0.10, vix_future_gross=0.10,
)
POLICY = policy.Policy(
    annual_volatility_ceiling=0.058, cvar_alpha=0.95, cvar_loss_nav=0.095, stress_loss_nav=0.35,
    short_margin_nav=0.14, collateral_nav=0.46,
)
#: A contract's own cap as a multiple of its liquidity cap.
CAP_SHARE = 4.0
NAV = 2e7
#: Legs that one task joins with their contracts.
LEGS_A_TASK = 500_000
STRESS_SQL = ", ".join(
    f"(SELECT any_value(s.ret) FROM shocked s WHERE s.contract_id = u.contract_id AND s.shock = '{n}') AS stress_{n}"
    for n in SHOCKS
)
VIEWS.add(
    "stress_wide",
    "SELECT contract_id, " + ", ".join(f"max(CASE WHEN shock = '{n}' THEN ret END) AS stress_{n}" for n in SHOCKS)
    + " FROM shocked GROUP BY 1",
    "shocked",
)
VIEWS.add(
    "audit_universe",
    f"""SELECT u.*, least({LIMITS.per_contract_abs}::DOUBLE, u.liquidity_cap * {CAP_SHARE}::DOUBLE) AS effective_cap,
              {', '.join('w.stress_' + n for n in SHOCKS)}, m.expected_return
       FROM universe u JOIN stress_wide w ON w.contract_id = u.contract_id JOIN means m ON m.contract_id = u.contract_id
       WHERE u.mark IS NOT NULL""",
    "universe", "stress_wide", "means",
)


def contracts(t):
    """Every contract that has a mark, with expected return, caps and wide stress columns, written once."""

    base = means(t).where("mark IS NOT NULL")
    shocked = (
        chain.repriced(load(t, "fx_chain"), SHOCKS)
        .groupBy("contract_id")
        .agg(*[
            F.max(F.when(F.col("shock") == name, F.col("ret"))).alias(audit.STRESS + name)
            for name in SHOCKS
        ])
    )
    caps = load(t, "fx_chain").select("contract_id", (F.col("liquidity_cap") * CAP_SHARE).alias("cap"))
    table = policy.effective_cap(base, caps, LIMITS).join(shocked, "contract_id")
    return written(table, "contracts")


def tasks_for(table) -> int:
    """Tasks that hold a stored table's rows, ``LEGS_A_TASK`` each; such a count reads its footers only."""

    return -(-table.count() // LEGS_A_TASK)


def legs(t):
    """All legs of all candidate books, also those of contracts without a mark, written once: queries read them several times.

    The view ``fx_quarter_books``; the positions of a large table are summed in as many tasks as its line items ask for.
    """

    tasks = tasks_for(t.lineitem)
    if tasks <= width(t.spark):
        return written(load(t, "fx_quarter_books"), "legs")
    book = F.expr("l_suppkey * 100 + (year(l_shipdate) - 1992) * 4 + quarter(l_shipdate)")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    positions = (
        t.lineitem.select(book.alias("book_id"), F.col("l_partkey").alias("contract_id"), signed.alias("q"))
        .repartition(tasks, "book_id", "contract_id")
        .groupBy("book_id", "contract_id")
        .agg(F.sum("q").alias("q"))
    )
    return written(t.sql(TEXT["fx_quarter_books"][0], fx_quarter_positions=positions), "legs")


VIEWS.add(
    "legs",
    """SELECT b.book_id, b.contract_id, b.weight, u.* EXCLUDE (contract_id), greatest(b.weight, 0.0e0) AS w_long,
              greatest(-b.weight, 0.0e0) AS w_short, CASE WHEN NOT bool_and(u.contract_id IS NOT NULL) OVER (PARTITION BY b.book_id)
                THEN 'contract_missing' END AS problem
       FROM fx_quarter_books b LEFT JOIN audit_universe u ON u.contract_id = b.contract_id""",
    "fx_quarter_books", "audit_universe",
)
VIEWS.add("book_list", "SELECT DISTINCT book_id, problem FROM legs", "legs")
# Books without a problem; the numbers of the others are NULL.
VIEWS.add("sound", "SELECT * EXCLUDE (problem) FROM legs WHERE problem IS NULL", "legs")


def every_book(inner: str) -> str:
    """Oracle text: the rows of ``inner`` for sound books, a row with the problem for each of the others."""

    return f"SELECT k.book_id, k.problem, q.* EXCLUDE (book_id) FROM book_list k LEFT JOIN ({inner}) q ON q.book_id = k.book_id"


def dealt(books):
    """Written legs, dealt by contract over as many tasks as their number asks for, so that a task's memory does not grow with it.

    Tables that the session's own number of tasks holds are left to the engine.
    """

    tasks = tasks_for(books)
    return books if tasks <= width(books.sparkSession) else books.repartition(tasks, "contract_id")


def summing(books) -> int | None:
    """Tasks that sum the scenarios of written legs: as many as their number asks for, None if the session's own number will do."""

    tasks = tasks_for(books)
    return None if tasks <= width(books.sparkSession) else tasks


def sums_of(t):
    """The sums of every book and its ``problem``."""

    sums = audit.book_sums(audit.book_rows(dealt(legs(t)), contracts(t)), LIMITS)
    return sums.withColumnRenamed("leg_problem", "problem")


def measured(value):
    """A number of a sound book only."""

    return F.when(F.col("problem").isNull(), value)


@query(
    "policy_limits",
    oracle(
        "traded",
        """SELECT coalesce(u.contract_id, c.contract_id) AS contract_id, u.underlying,
                  least(c.cap, 0.18e0) AS contract_limit, CASE WHEN u.underlying IS NULL THEN NULL
                    WHEN u.underlying = 'VX_FRONT' THEN 0.20e0 ELSE 0.35e0 END AS underlying_limit,
                  CASE WHEN u.contract_id IS NULL THEN 'unexpected_cap' WHEN c.cap IS NULL THEN 'missing_cap' END AS problem
           FROM traded u FULL JOIN (SELECT contract_id, liquidity_cap AS cap FROM fx_chain WHERE contract_id % 53 <> 0) c
             ON c.contract_id = u.contract_id""",
        "contract_id underlying problem", "contract_limit underlying_limit",
    ),
)
def policy_limits(t):
    chain_rows = load(t, "fx_chain")
    caps = chain_rows.where("contract_id % 53 <> 0").select(
        "contract_id", F.col("liquidity_cap").alias("cap")
    )
    from premia.plans.chain import universe

    return policy.policy_limits(universe(t).where("eligible"), caps, policy.Limits()).select(
        "contract_id", "underlying", "contract_limit", "underlying_limit", "problem"
    )


@query(
    "effective_cap",
    oracle(
        "fx_chain",
        """SELECT contract_id, CASE WHEN contract_id % 53 = 0 THEN 0.15e0 ELSE least(0.15e0, liquidity_cap) END AS effective_cap,
                  contract_id % 53 = 0 AS cap_missing FROM fx_chain""",
        "contract_id cap_missing", "effective_cap",
    ),
)
def effective_cap(t):
    rows = load(t, "fx_chain")
    caps = rows.where("contract_id % 53 <> 0").select("contract_id", F.col("liquidity_cap").alias("cap"))
    return policy.effective_cap(rows, caps, policy.Limits(per_contract_abs=0.15)).select(
        "contract_id", "effective_cap", "cap_missing"
    )


view(
    "fx_policies",
    """
SELECT s_suppkey AS policy_id, s_acctbal / 10000.0e0 AS gross_nav,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (s_suppkey % 11 - 1) / 10.0e0 END AS net_nav_abs,
       0.25e0 AS short_nav_abs, 0.18e0 AS per_contract_abs, 0.2e0 AS stress_loss_abs,
       0.9e0 + 0.01e0 * (s_suppkey % 13) AS cvar_alpha, 0.000001e0 AS lambda_floor,
       CASE WHEN s_suppkey % 17 = 0 THEN 0.0e0 WHEN s_suppkey % 17 = 1 THEN 0.000001e0 ELSE 1000000.0e0 END AS lambda_ceiling,
       CASE WHEN s_suppkey % 37 = 0 THEN 0.0e0 ELSE 0.15e0 END AS annual_volatility_ceiling,
       CASE WHEN s_suppkey % 41 = 0 THEN NULL ELSE 12.0e0 END AS periods_per_year,
       CASE WHEN s_suppkey % 43 = 0 THEN -0.1e0 ELSE 0.1e0 END AS cvar_loss_nav, 0.2e0 AS stress_loss_nav,
       CASE WHEN s_suppkey % 47 = 0 THEN NULL ELSE 0.75e0 END AS short_margin_nav, 1.0e0 AS collateral_nav,
       CASE WHEN s_suppkey % 29 = 0 THEN -1.0e0 WHEN s_suppkey % 2 = 0 THEN NULL ELSE 0.5e0 END AS delta_abs,
       CAST(NULL AS DOUBLE) AS gamma_abs, CAST(NULL AS DOUBLE) AS vega_abs, 8.0e0 AS vix_vega_abs,
       CASE WHEN s_suppkey % 31 = 0 THEN -3.0e0 ELSE 3.0e0 END AS beta_spy_abs,
       s_suppkey % 19 AS bisection_steps, 0.05e0 * (s_suppkey % 23) AS deployment_target,
       0.01e0 * (s_suppkey % 7 - 1) AS deployment_edge_floor
FROM {supplier}
""",
)


@query(
    "policy_check",
    oracle(
        "fx_policies",
        """SELECT policy_id, CASE WHEN gross_nav <= 0 THEN 'gross_not_positive' WHEN net_nav_abs < 0 THEN 'net_invalid'
             WHEN delta_abs < 0 OR beta_spy_abs < 0 THEN 'exposure_invalid'
             WHEN annual_volatility_ceiling <= 0 OR periods_per_year IS NULL THEN 'scale_not_positive'
             WHEN cvar_loss_nav < 0 OR short_margin_nav IS NULL THEN 'funding_invalid'
             WHEN cvar_alpha >= 1 THEN 'alpha_outside' WHEN lambda_ceiling < lambda_floor THEN 'lambda_not_ordered'
             WHEN bisection_steps < 1 THEN 'steps_below_one' WHEN deployment_target > 1 THEN 'target_outside'
             WHEN deployment_edge_floor < 0 THEN 'edge_floor_negative' END AS reason FROM fx_policies""",
        "policy_id reason",
    ),
)
def policy_check(t):
    return load(t, "fx_policies").select("policy_id", policy.policy_reject().alias("reason"))


@query(
    "align_spine",
    oracle(
        "fx_chain fx_marks",
        """SELECT c.contract_id, m.mark, m.mark IS NULL AS missing FROM fx_chain c LEFT JOIN
             (SELECT contract_id, mark FROM fx_marks WHERE period = DATE '1997-03-01') m ON m.contract_id = c.contract_id""",
        "contract_id missing", "mark",
    ),
)
def align_spine(t):
    marks = load(t, "fx_marks").where("period = DATE '1997-03-01'")
    return policy.align_spine(load(t, "fx_chain").select("contract_id"), marks, ["contract_id"], "mark")


@query(
    "exact_cover",
    """SELECT p_partkey AS contract_id, 'missing' AS problem FROM part WHERE p_partkey NOT IN
         (SELECT l_partkey + CASE WHEN l_partkey % 11 = 0 THEN 1000000 ELSE 0 END FROM lineitem)
       UNION ALL SELECT DISTINCT l_partkey + 1000000, 'unexpected' FROM lineitem WHERE l_partkey % 11 = 0
         AND l_partkey + 1000000 NOT IN (SELECT p_partkey FROM part)""",
)
def exact_cover(t):
    spine = t.part.select(F.col("p_partkey").alias("contract_id"))
    # Every eleventh contract is known under another number.
    moved = F.expr("l_partkey + CASE WHEN l_partkey % 11 = 0 THEN 1000000 ELSE 0 END")
    caps = t.lineitem.select(moved.alias("contract_id"))
    return policy.exact_cover(spine, caps, ["contract_id"])


@query(
    "whole_contracts",
    oracle(
        "legs",
        f"""SELECT *, contracts * mark * 100.0e0 / {NAV}::DOUBLE AS realized_weight FROM (SELECT book_id, contract_id, mark,
              sign(weight) * floor(abs(weight * {NAV}::DOUBLE / (mark * 100.0e0))) AS contracts FROM legs) s""",
        "book_id contract_id", "contracts realized_weight",
    ),
)
def whole_contracts(t):
    rows = audit.book_rows(legs(t), contracts(t).select("contract_id", "mark"))
    return policy.whole_contracts(rows, NAV).select("book_id", "contract_id", "contracts", "realized_weight")


@query(
    "predictable_cost",
    oracle(
        "sound book_list",
        every_book("SELECT book_id, sum(long_cost * w_long + short_cost * w_short) AS cost FROM sound GROUP BY 1"),
        "book_id problem", "cost",
    ),
)
def predictable_cost(t):
    return sums_of(t).select("book_id", "problem", "cost")


@query(
    "margin_collateral",
    oracle(
        "sound book_list",
        every_book(
            f"""SELECT *, greatest(margin - {POLICY.short_margin_nav}::DOUBLE, 0) AS margin_breach,
                       greatest(collateral - {POLICY.collateral_nav}::DOUBLE, 0) AS collateral_breach FROM (
                SELECT book_id, sum(short_margin * w_short) AS margin, sum(w_long) + sum(short_margin * w_short) AS collateral
                FROM sound GROUP BY 1) s"""
        ),
        "book_id problem", "margin collateral margin_breach collateral_breach",
    ),
)
def margin_collateral(t):
    from premia.functions.numeric import breach

    collateral = F.col("long") + F.col("margin")
    return sums_of(t).select(
        "book_id", "problem", "margin", collateral.alias("collateral"),
        measured(breach("margin", F.lit(POLICY.short_margin_nav))).alias("margin_breach"),
        measured(breach(collateral, F.lit(POLICY.collateral_nav))).alias("collateral_breach"),
    )


@query(
    "assignment_breach",
    oracle(
        "sound book_list",
        every_book("SELECT book_id, max(CASE WHEN short_allowed THEN 0.0e0 ELSE w_short END) AS assignment FROM sound GROUP BY 1"),
        "book_id problem", "assignment",
    ),
)
def assignment_breach(t):
    return sums_of(t).select("book_id", "problem", "assignment")


@query(
    "exposure_limits",
    oracle(
        "legs",
        f"""SELECT book_id, problem, name, CASE WHEN problem IS NULL THEN exposure END AS exposure, bound,
                   CASE WHEN problem IS NULL THEN greatest(abs(exposure) - bound, 0) END AS breach FROM (
              SELECT book_id, problem, unnest(['delta', 'vix_vega', 'beta_spy']) AS name,
                     unnest([sum(delta_nav * weight), sum(vix_vega_nav * weight), sum(beta_spy_nav * weight)]) AS exposure,
                     unnest([{LIMITS.delta_abs}::DOUBLE, {LIMITS.vix_vega_abs}::DOUBLE, {LIMITS.beta_spy_abs}::DOUBLE]) AS bound
              FROM legs GROUP BY 1, 2) s""",
        "book_id problem name", "exposure bound breach",
    ),
)
def exposure_limits(t):
    from premia.functions.numeric import breach

    listed = F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(f"{name}_exposure").alias("exposure"), F.lit(bound).alias("bound"))
        for name, bound in LIMITS.exposures().items()
    ])
    rows = sums_of(t).select("book_id", "problem", F.inline(listed))
    return rows.withColumn("breach", measured(breach(F.abs("exposure"), "bound")))


WORST = "least(" + ", ".join(f"sum(stress_{n} * weight)" for n in SHOCKS) + ")"


@query(
    "stress_loss",
    oracle(
        "sound book_list",
        every_book(
            f"""SELECT *, greatest(-{POLICY.stress_loss_nav}::DOUBLE - worst_stress, 0) AS breach
                FROM (SELECT book_id, {WORST} AS worst_stress FROM sound GROUP BY 1) s"""
        ),
        "book_id problem", "worst_stress breach",
    ),
)
def stress_loss(t):
    from premia.functions.numeric import breach

    limit = min(POLICY.stress_loss_nav, LIMITS.stress_loss_abs)
    over = breach(-F.col("worst_stress"), F.lit(limit))
    return sums_of(t).select("book_id", "problem", "worst_stress", measured(over).alias("breach"))


VIEWS.add(
    "book_sums",
    f"""SELECT book_id, sum(abs(weight)) AS gross, sum(weight) AS net, sum(w_long) AS long, sum(w_short) AS short,
              max(abs(weight) - effective_cap) AS cap_excess, sum(short_margin * w_short) AS margin,
              sum(long_cost * w_long + short_cost * w_short) AS cost,
              max(CASE WHEN short_allowed THEN 0.0e0 ELSE w_short END) AS assignment,
              sum(delta_nav * weight) AS delta_exposure, sum(vix_vega_nav * weight) AS vix_vega_exposure,
              sum(beta_spy_nav * weight) AS beta_spy_exposure, {WORST} AS worst_stress
       FROM sound GROUP BY 1""",
    "sound",
)
VIEWS.add(
    "book_underlying",
    f"""SELECT book_id, max(greatest(g - CASE WHEN underlying = 'VX_FRONT' THEN {LIMITS.vix_future_gross}::DOUBLE
              ELSE {LIMITS.underlying_gross}::DOUBLE END, 0)) AS underlying
       FROM (SELECT book_id, underlying, sum(abs(weight)) AS g FROM sound GROUP BY 1, 2) s GROUP BY 1""",
    "sound",
)


@query(
    "constraint_violation",
    oracle(
        "book_sums book_underlying sound book_list",
        every_book(
            f"""SELECT book_id, max_violation, greatest(max_violation, max_short) AS long_only_violation FROM (
                  SELECT s.book_id, greatest(gross - {LIMITS.gross_nav}::DOUBLE, cap_excess, abs(net) - {LIMITS.net_nav_abs}::DOUBLE,
                         short - {LIMITS.short_nav_abs}::DOUBLE, u.underlying, -{LIMITS.stress_loss_abs}::DOUBLE - worst_stress,
                         abs(delta_exposure) - {LIMITS.delta_abs}::DOUBLE, abs(vix_vega_exposure) - {LIMITS.vix_vega_abs}::DOUBLE,
                         abs(beta_spy_exposure) - {LIMITS.beta_spy_abs}::DOUBLE, 0) AS max_violation, m.max_short
                  FROM book_sums s JOIN book_underlying u ON u.book_id = s.book_id
                  JOIN (SELECT book_id, max(w_short) AS max_short FROM sound GROUP BY 1) m ON m.book_id = s.book_id) r"""
        ),
        "book_id problem", "max_violation long_only_violation",
    ),
)
def constraint_violation(t):
    return audit.constraint_violation(audit.book_rows(dealt(legs(t)), contracts(t)), LIMITS)


VIEWS.add(
    "cells",
    "SELECT s.* FROM fx_scenarios s JOIN audit_universe u ON u.contract_id = s.contract_id WHERE s.ret IS NOT NULL",
    "fx_scenarios", "audit_universe",
)
VIEWS.add(
    "crossed",
    """SELECT l.book_id, c.scenario_id, sum(c.ret * l.weight) AS scenario_return FROM sound l
       JOIN cells c ON c.contract_id = l.contract_id GROUP BY 1, 2""",
    "sound", "cells",
)
VIEWS.add(
    "losses",
    """SELECT b.book_id, k.scenario_id, b.cost - coalesce(x.scenario_return, 0) AS loss
       FROM book_sums b CROSS JOIN (SELECT DISTINCT scenario_id FROM cells) k
       LEFT JOIN crossed x ON x.book_id = b.book_id AND x.scenario_id = k.scenario_id""",
    "book_sums", "cells", "crossed",
)
VIEWS.add(
    "book_cvar",
    """SELECT book_id, sum(least(1.0e0, greatest(0.0e0, m - (rn - 1))) * loss) / any_value(m) AS cvar FROM (
         SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY loss DESC) AS rn,
                count(*) OVER (PARTITION BY book_id) * (1.0e0 - 0.95e0) AS m FROM losses) s GROUP BY 1""",
    "losses",
)


def cells(t, table):
    """Prepared scenario cells, written once: several branches of a query read them."""

    return written(audit.scenario_prepare(load(t, "fx_scenarios"), table), "cells")


def spoiled_scenarios(t):
    """Scenarios with planted faults: some contracts lose all cells, some have infinite ones late."""

    late = (F.col("contract_id") % 97 == 0) & (F.col("scenario_id") >= F.lit("1996-01-01").cast("date"))
    return (
        load(t, "fx_scenarios")
        .where("contract_id % 89 <> 0")
        .withColumn("ret", F.when(late, F.lit(float("inf"))).otherwise(F.col("ret")))
    )


@query(
    "scenario_cross",
    oracle(
        "legs cells",
        """SELECT l.book_id, l.problem, c.scenario_id, CASE WHEN l.problem IS NULL THEN sum(c.ret * l.weight) END AS scenario_return
           FROM legs l JOIN cells c ON c.contract_id = l.contract_id GROUP BY 1, 2, 3""",
        "book_id scenario_id problem", "scenario_return",
    ),
)
def scenario_cross(t):
    table = contracts(t)
    books = legs(t)
    problems = audit.book_sums(audit.book_rows(dealt(books), table), LIMITS)
    problems = written(problems.select("book_id", F.col("leg_problem").alias("problem")), "problems")
    # The legs of a book with a problem tell its scenarios only.
    rows = books.join(problems, "book_id").withColumn("weight", F.coalesce(measured(F.col("weight")), F.lit(0.0)))
    sums = audit.scenario_sums(rows, cells(t, table), tasks=summing(books)).join(problems, "book_id")
    return sums.withColumn("scenario_return", measured(F.col("scenario_return")))


@query(
    "scenario_prepare",
    oracle(
        "cells",
        """SELECT u.contract_id, count(s.scenario_id) AS observed, (SELECT count(DISTINCT scenario_id) FROM cells) AS scenario_count,
                  CASE WHEN u.contract_id % 89 = 0 OR count(s.scenario_id) = 0 THEN 'scenario_missing'
                       WHEN u.contract_id % 97 = 0 AND count(s.scenario_id) FILTER (WHERE s.scenario_id >= DATE '1996-01-01') > 0
                         THEN 'scenario_not_finite' END AS problem
           FROM audit_universe u LEFT JOIN cells s ON s.contract_id = u.contract_id AND u.contract_id % 89 <> 0 GROUP BY 1""",
        "contract_id problem", "", "observed scenario_count",
    ),
)
def scenario_prepare(t):
    table = contracts(t)
    prepared = audit.scenario_prepare(spoiled_scenarios(t), table)
    observed = prepared.groupBy("contract_id").agg(F.count("*").alias("_n"))
    return (
        audit.scenario_problems(prepared, table.select("contract_id").distinct())
        .join(observed, "contract_id", "left")
        .select(
            "contract_id",
            F.coalesce("_n", F.lit(0)).alias("observed"),
            audit.scenario_count(prepared).scalar().alias("scenario_count"),
            F.col("scenario_problem").alias("problem"),
        )
    )


@query(
    "scenario_cvar",
    oracle(
        "book_cvar book_list",
        every_book(f"SELECT *, greatest(cvar - {POLICY.cvar_loss_nav}::DOUBLE, 0) AS breach FROM book_cvar"),
        "book_id problem", "cvar breach",
    ),
)
def scenario_cvar(t):
    from premia.functions.numeric import breach

    table = contracts(t)
    books = legs(t)
    sums = audit.book_sums(audit.book_rows(dealt(books), table), LIMITS)
    sums = written(sums.select("book_id", "cost", F.col("leg_problem").alias("problem")), "sums")
    costs = sums.where("problem IS NULL").select("book_id", "cost")
    # Only books without a problem have a tail; the legs of the others need not meet their cells.
    rows = books.join(costs, "book_id", "left_semi")
    out = audit.scenario_cvar(rows, cells(t, table), costs, POLICY.cvar_alpha, tasks=summing(books))
    every = sums.select("book_id", "problem").join(out, "book_id", "left")
    return every.withColumn("breach", measured(breach("cvar", F.lit(POLICY.cvar_loss_nav))))


@query(
    "cvar_fractional",
    oracle(
        "fx_returns",
        """SELECT config, strategy, n AS "size", sum(least(1.0e0, greatest(0.0e0, m - (rn - 1))) * loss) / any_value(m) AS cvar FROM (
             SELECT config, strategy, -net_return AS loss, count(*) OVER g AS n, count(*) OVER g * (1.0e0 - 0.95e0) AS m,
                    row_number() OVER (PARTITION BY config, strategy ORDER BY net_return) AS rn
             FROM fx_returns WINDOW g AS (PARTITION BY config, strategy)) s GROUP BY 1, 2, 3""",
        "config strategy", "cvar", '"size"',
    ),
)
def cvar_fractional(t):
    rows = load(t, "fx_returns").withColumn("loss", -F.col("net_return"))
    return fractional_tail_mean(rows, ["config", "strategy"], "loss", 0.95)


@query(
    "tail_rank",
    oracle(
        "fx_returns",
        """SELECT config, strategy, return_date, -net_return AS loss,
                  row_number() OVER (PARTITION BY config, strategy ORDER BY net_return, return_date) AS "rank" FROM fx_returns""",
        "config strategy return_date", "loss", '"rank"',
    ),
)
def tail_rank(t):
    # Written once: the ranks read an average twice, which may differ in its last bit from one evaluation to the next.
    rows = load(t, "fx_returns").select("config", "strategy", "return_date", (-F.col("net_return")).alias("loss"))
    rows = written(rows, "losses")
    return full_rank(
        rows, ["config", "strategy"], "loss", ["return_date"], tie_block=F.year("return_date")
    )


def volatility_function(t, table, owner=None):
    """Books of contracts -> volatility under the shrunk label covariance of their era."""

    rows = joint(t)
    stats = written(covariance.shrinkage_statistics(rows), "shrinkage")
    loadings = written(load(t, "fx_era_loadings"), "loadings")
    names = table.select("contract_id", F.col("underlying").alias("_label"))

    def volatility_of(books):
        home = F.col("book_id") if owner is None else owner
        era = F.when(home % 2 == 0, "early").otherwise("late")
        by_label = (
            books.join(names, "contract_id")
            .groupBy(era.alias("universe_id"), "book_id", F.col("_label").alias("contract_id"))
            .agg(F.sum("weight").alias("weight"))
        )
        return covariance.book_volatility(by_label, rows, stats, loadings).select("book_id", "volatility")

    return volatility_of


def label_volatility_sql(name: str, source: str, *needs: str, home: str = "book_id") -> None:
    """Oracle view (book_id, volatility) of books of contracts, dense form."""

    VIEWS.add(
        f"{name}_labels",
        f"""SELECT CASE WHEN ({home}) % 2 = 0 THEN 'early' ELSE 'late' END AS universe_id, book_id, underlying AS contract_id,
                   sum(weight) AS weight FROM {source} GROUP BY 1, 2, 3""",
        *needs,
    )
    VIEWS.add(
        f"{name}_loads",
        f"""SELECT k.universe_id, k.book_id, 0 AS role, b.factor AS label, sum(k.weight * b.loading) AS e FROM {name}_labels k
            JOIN fx_era_loadings b ON b.universe_id = k.universe_id AND b.contract_id = k.contract_id GROUP BY 1, 2, 3, 4
            UNION ALL SELECT universe_id, book_id, 1, contract_id, weight FROM {name}_labels""",
        f"{name}_labels", "fx_era_loadings",
    )
    VIEWS.add(
        name,
        f"""SELECT a.book_id, sqrt(greatest(sum(CASE WHEN m.block <> 'factor_residual_cov' AND m.row_label = m.col_label
                   THEN 1 ELSE 2 END * a.e * b.e * m.value), 0)) AS volatility
            FROM shrunk_moments m
            JOIN {name}_loads a ON a.universe_id = m.universe_id AND a.label = m.row_label
              AND a.role = CASE WHEN m.block = 'residual_cov' THEN 1 ELSE 0 END
            JOIN {name}_loads b ON b.universe_id = m.universe_id AND b.book_id = a.book_id AND b.label = m.col_label
              AND b.role = CASE WHEN m.block = 'factor_cov' THEN 0 ELSE 1 END
            GROUP BY 1""",
        "shrunk_moments", f"{name}_loads",
    )


label_volatility_sql("audit_vols", "sound", "sound")
BREACHES = (
    "breach_gross breach_caps breach_net breach_short breach_underlying exposure_delta exposure_vix_vega "
    "exposure_beta_spy breach_exposure breach_stress breach_margin breach_collateral breach_assignment "
    "breach_cvar breach_annual_volatility max_violation"
)


def breaches_sql(sums: str, underlying: str, cvar: str, vols: str) -> str:
    return f"""
SELECT *, greatest(breach_gross, breach_caps, breach_net, breach_short, breach_underlying, breach_exposure, breach_stress, breach_margin,
    breach_collateral, breach_assignment, breach_cvar, breach_annual_volatility) AS max_violation,
  greatest(breach_gross, breach_caps, breach_net, breach_short, breach_underlying, breach_exposure, breach_stress, breach_margin,
    breach_collateral, breach_assignment, breach_cvar, breach_annual_volatility) <= 1e-5 AS feasible
FROM (SELECT *, greatest(exposure_delta, exposure_vix_vega, exposure_beta_spy) AS breach_exposure FROM (
  SELECT s.*, greatest(gross - {LIMITS.gross_nav}::DOUBLE, 0) AS breach_gross, greatest(cap_excess, 0) AS breach_caps, greatest(abs(net) - {LIMITS.net_nav_abs}::DOUBLE, 0) AS breach_net,
    greatest(short - {LIMITS.short_nav_abs}::DOUBLE, 0) AS breach_short, u.underlying AS breach_underlying,
    greatest(abs(delta_exposure) - {LIMITS.delta_abs}::DOUBLE, 0) AS exposure_delta, greatest(abs(vix_vega_exposure) - {LIMITS.vix_vega_abs}::DOUBLE, 0) AS exposure_vix_vega,
    greatest(abs(beta_spy_exposure) - {LIMITS.beta_spy_abs}::DOUBLE, 0) AS exposure_beta_spy, greatest(-{POLICY.stress_loss_nav}::DOUBLE - worst_stress, 0) AS breach_stress,
    greatest(margin - {POLICY.short_margin_nav}::DOUBLE, 0) AS breach_margin, greatest(long + margin - {POLICY.collateral_nav}::DOUBLE, 0) AS breach_collateral,
    assignment AS breach_assignment, greatest(c.cvar - {POLICY.cvar_loss_nav}::DOUBLE, 0) AS breach_cvar,
    greatest(v.volatility * sqrt(12.0e0) - {POLICY.annual_volatility_ceiling}::DOUBLE, 0) AS breach_annual_volatility, c.cvar, v.volatility
  FROM {sums} s JOIN {underlying} u ON u.book_id = s.book_id JOIN {cvar} c ON c.book_id = s.book_id
  JOIN {vols} v ON v.book_id = s.book_id) a) b"""


VIEWS.add(
    "audited", breaches_sql("book_sums", "book_underlying", "book_cvar", "audit_vols"),
    "book_sums", "book_underlying", "book_cvar", "audit_vols",
)


# The audit again, over inputs with planted faults of every kind.
VIEWS.add(
    "book_problems",
    """SELECT book_id, coalesce(min(p), CASE WHEN book_id % 10 = 3 THEN 'volatility_missing' END) AS problem FROM (
         SELECT book_id, CASE WHEN problem IS NOT NULL AND mark IS NULL THEN problem ELSE CASE contract_id WHEN 7 THEN 'cap_missing' WHEN 11 THEN 'cost_missing' WHEN 13 THEN 'permission_missing'
             WHEN 17 THEN 'exposure_missing' WHEN 19 THEN 'stress_missing'
             ELSE CASE WHEN contract_id % 997 = 89 THEN 'scenario_missing' WHEN contract_id % 997 = 97 THEN 'scenario_not_finite' END
           END END AS p FROM legs) s GROUP BY 1""",
    "legs",
)


def spoiled(name, ids):
    return F.when(~F.col("contract_id").isin(ids), F.col(name)).alias(name)


@query(
    "portfolio_audit",
    oracle(
        "audited book_problems",
        "SELECT p.book_id, problem, coalesce(feasible AND problem IS NULL, false) AS feasible, "
        + ", ".join(f"CASE WHEN problem IS NULL THEN {name} END AS {name}" for name in BREACHES.split())
        + " FROM book_problems p LEFT JOIN audited a ON a.book_id = p.book_id",
        "book_id feasible problem", BREACHES,
    ),
)
def portfolio_audit(t):
    table = contracts(t)
    faults = {"effective_cap": 7, "short_cost": 11, "short_allowed": 13, "vix_vega_nav": 17, audit.STRESS + next(iter(SHOCKS)): 19}
    faulty = table.withColumns({name: spoiled(name, [i]) for name, i in faults.items()})
    known = (
        load(t, "fx_scenarios")
        .where("contract_id % 997 <> 89")
        .withColumn("ret", F.when(F.col("contract_id") % 997 == 97, F.lit(float("-inf"))).otherwise(F.col("ret")))
    )
    known_volatility = volatility_function(t, table)

    def volatility_of(books):
        return known_volatility(books).withColumn("volatility", F.when(F.col("book_id") % 10 != 3, F.col("volatility")))

    prepared = written(audit.scenario_prepare(known, faulty), "cells")
    out = audit.portfolio_audit(legs(t), faulty, prepared, volatility_of, LIMITS, POLICY)
    return out.select("book_id", *BREACHES.split(), "feasible", "problem")
