"""Queries on candidate selection, second stage, rounding and the monthly decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.operators import audit, policy, selection
from premia.plans.audit import (
    LIMITS,
    NAV,
    POLICY,
    WORST,
    breaches_sql,
    cells,
    contracts,
    label_volatility_sql,
    legs,
    volatility_function,
)
from premia.plans.covariance import book_table
from premia.plans.inputs import TEXT, load
from premia.plans.registry import VIEWS, oracle, query
from premia.session import written

LADDER = POLICY.ladder()
LADDER_SQL = ", ".join(f"({value!r}::DOUBLE)" for value in LADDER)

VIEWS.add(
    "utility_terms",
    """SELECT l.book_id, any_value(n.decision_id) AS decision_id, any_value(l.problem) AS problem, sum(l.weight * l.expected_return) AS mean,
              sum(l.long_cost * l.w_long + l.short_cost * l.w_short) AS cost, any_value(v.volatility) AS volatility
       FROM legs l JOIN fx_owners n ON n.book_id = l.book_id LEFT JOIN audit_vols v ON v.book_id = l.book_id GROUP BY 1""",
    "legs", "audit_vols", "fx_owners",
)
VIEWS.add(
    "scored",
    f"""SELECT u.*, h.lam AS risk_aversion, CASE WHEN problem IS NULL THEN mean - cost - 0.5e0 * h.lam * volatility * volatility END AS net_utility
        FROM utility_terms u, (VALUES {LADDER_SQL}) h(lam)""",
    "utility_terms",
)


def owned(t, books, verdict):
    """A verdict on written ``books`` with each book's decision, without making the books a second time."""

    return verdict.join(t.sql(TEXT["fx_owners"][0], fx_quarter_books=books), "book_id")


def candidates(t):
    """Books with decision and feasibility, and utility terms and volatility of the feasible ones, written once."""

    table = contracts(t)
    books = legs(t)
    verdict = audit.feasible_books(books, table, cells(t, table), volatility_function(t, table), LIMITS, POLICY)
    return written(owned(t, books, verdict), "candidates")


# Utilities at large risk aversion reach 1e1, so six decimals hold full precision.
@query(
    "net_utility_score",
    oracle("scored", "SELECT * FROM scored", "book_id", "risk_aversion net_utility"),
)
def net_utility_score(t):
    table = contracts(t)
    books = legs(t)
    rows = audit.book_rows(books, table)
    terms = selection.book_utility_terms(rows).join(volatility_function(t, table)(books), "book_id", "left")
    return selection.net_utility(terms, LADDER).select("book_id", "risk_aversion", "net_utility")


VIEWS.add(
    "winners",
    """SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.decision_id, s.risk_aversion
              ORDER BY s.net_utility DESC, s.book_id) AS rn
       FROM scored s JOIN audited a ON a.book_id = s.book_id WHERE a.feasible) w WHERE rn = 1""",
    "scored", "audited",
)
VIEWS.add(
    "picks",
    f"""SELECT d.decision_id, CASE WHEN p.book_id IS NOT NULL THEN 'optimal' WHEN d.n_feasible > 0 THEN 'ceiling_not_reached'
               ELSE 'no_feasible_candidate' END AS status, p.risk_aversion, p.book_id, p.net_utility, p.volatility
        FROM (SELECT u.decision_id, count(*) FILTER (WHERE a.feasible) AS n_feasible FROM utility_terms u
              LEFT JOIN audited a ON a.book_id = u.book_id GROUP BY 1) d
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY risk_aversion) AS k FROM winners
                   WHERE volatility <= {POLICY.annual_volatility_ceiling}::DOUBLE / sqrt(12.0e0)) p
          ON p.decision_id = d.decision_id AND p.k = 1""",
    "winners", "utility_terms", "audited",
)


@query(
    "select_candidate",
    oracle("picks", "SELECT * FROM picks", "status", "risk_aversion net_utility volatility", "decision_id book_id"),
)
def select_candidate(t):
    return selection.select_candidate(candidates(t), POLICY)


@query(
    "select_max_sharpe",
    oracle(
        "book_means",
        """SELECT decision_id, book_id, sharpe, candidates FROM (
             SELECT s.s_nationkey AS decision_id, b.book_id, (b.expected_return * (0.27e0 / b.gross_nav)) / (b.volatility * (0.27e0 / b.gross_nav)) AS sharpe,
                    count(*) OVER (PARTITION BY s.s_nationkey) AS candidates,
                    row_number() OVER (PARTITION BY s.s_nationkey ORDER BY b.expected_return / b.volatility DESC, b.book_id) AS rn
             FROM book_means b JOIN supplier s ON s.s_suppkey = b.book_id WHERE b.gross_nav > 0 AND b.volatility > 0) w WHERE rn = 1""",
        "", "sharpe", "decision_id book_id candidates",
    ),
)
def select_max_sharpe(t):
    owners = t.supplier.select(F.col("s_suppkey").alias("book_id"), F.col("s_nationkey").alias("decision_id"))
    table = (
        book_table(t)
        .select("book_id", F.col("expected_return").alias("mean"), "volatility", F.col("gross_nav").alias("gross"))
        .join(owners, "book_id")
    )
    return selection.select_max_sharpe(selection.scaled_to_budget(table, 0.27), 0.27)


VIEWS.add(
    "edges",
    """SELECT *, coalesce(edge > 1e-12 AND weight <> 0, false) AS eligible FROM (SELECT * EXCLUDE (eligible), sign(weight) * expected_return
         - CASE WHEN weight > 0 THEN long_cost WHEN weight < 0 THEN short_cost ELSE 0 END AS edge FROM legs) s""",
    "legs",
)


@query(
    "edge_eligibility",
    oracle(
        "edges",
        """SELECT book_id, count(*) AS legs, count(*) FILTER (WHERE mark IS NULL) AS missing_contracts, count(*) FILTER (WHERE eligible) AS positive_edge_contracts,
                  coalesce(sum(abs(weight)) FILTER (WHERE eligible), 0) AS eligible_gross,
                  coalesce(sum(abs(weight) * edge) FILTER (WHERE eligible), 0) AS eligible_edge FROM edges GROUP BY 1""",
        "book_id", "eligible_gross eligible_edge", "legs missing_contracts positive_edge_contracts",
    ),
)
def edge_eligibility(t):
    return selection.edge_counts(audit.book_rows(legs(t), contracts(t)))


@query(
    "naive_books",
    oracle(
        "universe",
        """SELECT u.underlying, u.contract_id, u.eligible,
                  CASE WHEN u.eligible THEN least(0.5e0 / g.n, 0.008e0) ELSE 0 END AS equal_premium_capped,
                  CASE WHEN u.eligible THEN least(0.5e0 * (1 / u.volatility) / g.inv, 0.008e0) ELSE 0 END AS equal_risk_capped
           FROM universe u LEFT JOIN (SELECT underlying, count(*) AS n, sum(1 / volatility) AS inv FROM universe WHERE eligible
             GROUP BY 1) g ON g.underlying = u.underlying""",
        "underlying contract_id eligible", "equal_premium_capped equal_risk_capped",
    ),
)
def naive_books(t):
    from premia.plans.chain import universe

    chain = universe(t).select("underlying", "contract_id", "volatility", "eligible")
    held = selection.naive_books(chain.where("eligible"), "underlying", "volatility", budget=0.5, cap=0.008)
    idle = chain.where("NOT eligible").select(
        "underlying", "contract_id", F.lit(0.0).alias("equal_premium_capped"), F.lit(0.0).alias("equal_risk_capped")
    )
    return held.withColumn("eligible", F.lit(True)).unionByName(idle.withColumn("eligible", F.lit(False)))


@query(
    "weight_summary",
    oracle(
        "fx_books",
        """SELECT book_id, count(*) AS contract_rows, count(*) FILTER (WHERE abs(weight) > 1e-9) AS active_contracts,
                  sum(abs(weight)) AS gross_weight, sum(weight) AS net_weight, sum(greatest(weight, 0)) AS long_weight,
                  sum(greatest(-weight, 0)) AS short_weight, max(abs(weight)) AS max_abs_weight FROM fx_books GROUP BY 1""",
        "book_id", "gross_weight net_weight long_weight short_weight max_abs_weight", "contract_rows active_contracts",
    ),
)
def weight_summary(t):
    return selection.weight_summary(load(t, "fx_books"), ["book_id"])


TOP5 = """(SELECT book_id, sum(abs(weight)) FILTER (WHERE rn <= 5) / sum(abs(weight)) AS top5_share FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY abs(weight) DESC, contract_id) AS rn FROM legs) s GROUP BY 1)"""


@query("top5_share", oracle("legs", f"SELECT * FROM {TOP5}", "book_id", "top5_share"))
def top5_share(t):
    return selection.top_share(audit.book_rows(legs(t), contracts(t)), ["book_id"])


@query(
    "concentration",
    oracle(
        "legs",
        f"""SELECT s.*, n_active_at_cap / n_active_contracts AS at_cap_share, p.top5_share FROM (
              SELECT book_id, count(*) FILTER (WHERE effective_cap > 0) AS n_candidate_contracts, count(*) FILTER (WHERE abs(weight) > 1e-9) AS n_active_contracts,
                     sum(abs(weight)) AS deployed_gross,
                     count(*) FILTER (WHERE abs(weight) > 1e-9 AND abs(weight) >= effective_cap - 1e-9) AS n_active_at_cap,
                     sum(effective_cap) AS cap_budget FROM legs GROUP BY 1) s JOIN {TOP5} p ON p.book_id = s.book_id""",
        "book_id", "deployed_gross cap_budget at_cap_share top5_share",
        "n_candidate_contracts n_active_contracts n_active_at_cap",
    ),
)
def concentration(t):
    rows = audit.book_rows(legs(t), contracts(t))
    return selection.concentration(rows, ["book_id"], "effective_cap", F.col("effective_cap") > 0.0)


def audit_views(
    prefix: str, rows: str, cell_view: str, *needs: str, own: float = LIMITS.underlying_gross,
    future: float = LIMITS.vix_future_gross, home: str = "book_id",
) -> None:
    """Oracle views of a full audit over another set of legs (named ``<prefix>_audited``).

    ``own`` and ``future`` limit an underlying's gross; ``home`` is the id that decides a book's era.
    """

    VIEWS.add(
        f"{prefix}_legs",
        f"""SELECT b.book_id, b.weight, u.*, greatest(b.weight, 0.0e0) AS w_long, greatest(-b.weight, 0.0e0) AS w_short
            FROM ({rows}) b JOIN audit_universe u ON u.contract_id = b.contract_id""",
        *needs,
    )
    VIEWS.add(
        f"{prefix}_sums",
        f"""SELECT book_id, sum(abs(weight)) AS gross, sum(weight) AS net, sum(w_long) AS long, sum(w_short) AS short,
                   max(abs(weight) - effective_cap) AS cap_excess, sum(short_margin * w_short) AS margin,
                   sum(long_cost * w_long + short_cost * w_short) AS cost, sum(weight * expected_return) AS mean,
                   max(CASE WHEN short_allowed THEN 0.0e0 ELSE w_short END) AS assignment,
                   sum(delta_nav * weight) AS delta_exposure, sum(vix_vega_nav * weight) AS vix_vega_exposure,
                   sum(beta_spy_nav * weight) AS beta_spy_exposure, {WORST} AS worst_stress
            FROM {prefix}_legs GROUP BY 1""",
        f"{prefix}_legs",
    )
    VIEWS.add(
        f"{prefix}_under",
        f"""SELECT book_id, max(greatest(g - CASE WHEN underlying = 'VX_FRONT' THEN {future}::DOUBLE ELSE {own}::DOUBLE END, 0)) AS underlying
            FROM (SELECT book_id, underlying, sum(abs(weight)) AS g FROM {prefix}_legs GROUP BY 1, 2) s GROUP BY 1""",
        f"{prefix}_legs",
    )
    VIEWS.add(
        f"{prefix}_cvar",
        f"""SELECT book_id, sum(least(1.0e0, greatest(0.0e0, m - (rn - 1))) * loss) / any_value(m) AS cvar FROM (
              SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY loss DESC) AS rn,
                     count(*) OVER (PARTITION BY book_id) * (1.0e0 - 0.95e0) AS m FROM (
                SELECT b.book_id, k.scenario_id, b.cost - coalesce(x.r, 0) AS loss
                FROM {prefix}_sums b CROSS JOIN (SELECT DISTINCT scenario_id FROM {cell_view}) k
                LEFT JOIN (SELECT l.book_id, c.scenario_id, sum(c.ret * l.weight) AS r FROM {prefix}_legs l
                           JOIN {cell_view} c ON c.contract_id = l.contract_id GROUP BY 1, 2) x
                  ON x.book_id = b.book_id AND x.scenario_id = k.scenario_id) q) s GROUP BY 1""",
        f"{prefix}_sums", cell_view,
    )
    label_volatility_sql(f"{prefix}_vols", f"{prefix}_legs", f"{prefix}_legs", home=home)
    VIEWS.add(
        f"{prefix}_audited",
        breaches_sql(f"{prefix}_sums", f"{prefix}_under", f"{prefix}_cvar", f"{prefix}_vols"),
        f"{prefix}_sums", f"{prefix}_under", f"{prefix}_cvar", f"{prefix}_vols",
    )


ROUNDED = f"""SELECT book_id, contract_id, sign(weight) * floor(abs(weight * {NAV}::DOUBLE / (mark * 100.0e0))) * mark * 100.0e0
  / {NAV}::DOUBLE AS weight FROM sound"""
audit_views("int", ROUNDED, "cells", "sound", "audit_universe")


def held_gross():
    """Gross weight of what a verdict leaves, as audited: nothing of a book that is all cash."""

    return F.when(F.col("abstained"), 0.0).otherwise(F.col("gross")).alias("held_gross")


@query(
    "integer_or_cash",
    oracle(
        "int_audited book_list",
        """SELECT k.book_id, NOT coalesce(feasible, false) AS abstained,
                  coalesce(k.problem, CASE WHEN feasible THEN 'direct_truncation' ELSE 'infeasible_direct_book' END) AS reason,
                  gross AS rounded_gross, CASE WHEN feasible THEN gross ELSE 0.0e0 END AS held_gross, max_violation
           FROM book_list k LEFT JOIN int_audited a ON a.book_id = k.book_id""",
        "book_id abstained reason", "rounded_gross held_gross max_violation",
    ),
)
def integer_or_cash(t):
    table = contracts(t)
    _, verdict = audit.integer_or_cash(
        legs(t), table, cells(t, table), volatility_function(t, table), LIMITS, POLICY, NAV
    )
    return verdict.select(
        "book_id", "abstained", "reason", F.col("gross").alias("rounded_gross"), held_gross(), "max_violation"
    )


STAGE2 = policy.Policy(**{**POLICY.__dict__, "deployment_target": 0.48, "annual_volatility_ceiling": 0.45, "cvar_loss_nav": 0.25,
                          "stress_loss_nav": 2.0, "short_margin_nav": 0.35, "collateral_nav": 0.5})
WIDE = policy.Limits(gross_nav=1.0, net_nav_abs=0.45, short_nav_abs=0.45, per_contract_abs=None,
                     vix_vega_abs=None, beta_spy_abs=4.0, stress_loss_abs=2.0, underlying_gross=0.35)


# Candidates of the second stage: a book's number times ten plus the tilt, in SQL only.
audit_views(
    "tilted",
    f"""SELECT book_id * 10 + tilt AS book_id, contract_id,
              sign(weight) * raw / sum(raw) OVER (PARTITION BY book_id, tilt) * {STAGE2.deployment_target}::DOUBLE AS weight
       FROM (SELECT book_id, contract_id, weight, tilt, abs(weight) * pow(edge, tilt / 2.0e0) AS raw
             FROM edges, (VALUES (0), (1), (2)) k(tilt) WHERE eligible) r""",
    "cells", "edges", "audit_universe", own=WIDE.underlying_gross, future=WIDE.vix_future_gross, home="book_id // 10",
)
VIEWS.add(
    "tilted_best",
    f"""SELECT * FROM (SELECT s.book_id // 10 AS book_id, s.book_id % 10 AS tilt, s.gross,
              row_number() OVER (PARTITION BY s.book_id // 10
                ORDER BY s.mean - s.cost - v.volatility * v.volatility DESC, s.book_id) AS rn
         FROM tilted_sums s JOIN tilted_under u ON u.book_id = s.book_id JOIN tilted_cvar c ON c.book_id = s.book_id
         JOIN tilted_vols v ON v.book_id = s.book_id
         JOIN (SELECT book_id, max(abs(weight)) AS largest FROM tilted_legs GROUP BY 1) x ON x.book_id = s.book_id
         WHERE greatest(s.gross - {WIDE.gross_nav}::DOUBLE, x.largest - {WIDE.gross_nav}::DOUBLE,
             abs(s.net) - {WIDE.net_nav_abs}::DOUBLE, s.short - {WIDE.short_nav_abs}::DOUBLE, u.underlying,
             abs(s.beta_spy_exposure) - {WIDE.beta_spy_abs}::DOUBLE, -{min(STAGE2.stress_loss_nav, WIDE.stress_loss_abs)}::DOUBLE - s.worst_stress,
             s.margin - {STAGE2.short_margin_nav}::DOUBLE, s.long + s.margin - {STAGE2.collateral_nav}::DOUBLE, s.assignment,
             c.cvar - {STAGE2.cvar_loss_nav}::DOUBLE,
             v.volatility * sqrt(12.0e0) - {STAGE2.annual_volatility_ceiling}::DOUBLE) <= 1e-5) w WHERE rn = 1""",
    "tilted_audited",
)


@query(
    "scale_to_target",
    oracle(
        "tilted_best",
        f"""SELECT book_id, stage1_gross_nav, deployment_target, accepted AND (enough OR best IS NOT NULL) AS deployment_target_feasible,
                  applied AS deployment_target_applied,
                  CASE WHEN applied THEN gross ELSE stage1_gross_nav END >= deployment_target - 1e-6 AS deployment_target_met,
                  CASE WHEN NOT accepted THEN 0 WHEN enough THEN nonzero ELSE eligible END AS positive_edge_contracts,
                  CASE WHEN applied THEN best END AS tilt
           FROM (SELECT e.*, e.book_id % 5 <> 0 AND e.missing = 0 AS accepted, e.stage1_gross_nav >= {STAGE2.deployment_target}::DOUBLE - 1e-7 AS enough, {STAGE2.deployment_target}::DOUBLE AS deployment_target,
                        b.tilt AS best, b.gross,
                        e.book_id % 5 <> 0 AND e.missing = 0 AND NOT e.stage1_gross_nav >= {STAGE2.deployment_target}::DOUBLE - 1e-7 AND b.tilt IS NOT NULL AS applied
                 FROM (SELECT book_id, sum(abs(weight)) AS stage1_gross_nav, count(*) FILTER (WHERE weight <> 0) AS nonzero,
                              count(*) FILTER (WHERE mark IS NULL) AS missing, count(*) FILTER (WHERE eligible) AS eligible FROM edges GROUP BY 1) e
                 LEFT JOIN tilted_best b ON b.book_id = e.book_id) q""",
        "book_id deployment_target_feasible deployment_target_applied deployment_target_met",
        "stage1_gross_nav deployment_target", "positive_edge_contracts tilt",
    ),
)
def scale_to_target(t):
    table = contracts(t)
    books = legs(t)
    stage1 = books.select("book_id").distinct().select(
        "book_id", (F.col("book_id") % 5 != 0).alias("accepted"), F.lit(2.0).alias("risk_aversion")
    )
    wide = policy.effective_cap(table.drop("effective_cap", "cap_missing"), None, WIDE)
    verdict, _ = selection.scale_to_target(
        stage1, books, wide, cells(t, table),
        volatility_function(t, table, owner=F.col("book_id.book_id")), WIDE, STAGE2,
    )
    whole = ("positive_edge_contracts", "tilt")
    return verdict.withColumns({name: F.col(name).cast("bigint") for name in whole})


DECIDED = "2001-09-01"
VIEWS.add("past_cells", f"SELECT * FROM cells WHERE scenario_id < DATE '{DECIDED}'", "cells")
audit_views("past", "SELECT book_id, contract_id, weight FROM sound", "past_cells", "sound", "audit_universe")
VIEWS.add(
    "past_winners",
    f"""SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.decision_id, s.risk_aversion ORDER BY s.net_utility DESC, s.book_id) AS rn
        FROM scored s JOIN past_audited a ON a.book_id = s.book_id WHERE a.feasible) w WHERE rn = 1""",
    "scored", "past_audited",
)
VIEWS.add(
    "past_picks",
    f"""SELECT decision_id, risk_aversion, book_id FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY risk_aversion) AS k
        FROM past_winners WHERE volatility <= {POLICY.annual_volatility_ceiling}::DOUBLE / sqrt(12.0e0)) w WHERE k = 1""",
    "past_winners",
)
audit_views(
    "held", ROUNDED.replace("FROM sound", "FROM sound WHERE book_id IN (SELECT book_id FROM past_picks)"), "past_cells",
    "sound", "audit_universe", "past_picks",
)


@query(
    "monthly_decisions",
    oracle(
        "held_audited past_picks",
        f"""SELECT p.decision_id, p.book_id, p.risk_aversion, NOT a.feasible AS abstained,
                   CASE WHEN a.feasible THEN a.gross ELSE 0.0e0 END AS held_gross,
                   CASE WHEN a.feasible THEN coalesce((SELECT sum(l.weight * c.ret) FROM held_legs l JOIN cells c
                     ON c.contract_id = l.contract_id AND c.scenario_id = DATE '{DECIDED}' WHERE l.book_id = p.book_id), 0)
                     - a.cost ELSE 0.0e0 END AS realized_return
            FROM past_picks p JOIN held_audited a ON a.book_id = p.book_id""",
        "abstained", "risk_aversion held_gross realized_return", "decision_id book_id",
    ),
)
def monthly_decisions(t):
    """Eligibility, means, audit, selection, rounding and realization of all decisions at once."""

    table = contracts(t)
    known = cells(t, table)
    past = known.where(F.col("scenario_id") < F.lit(DECIDED).cast("date"))
    volatility_of = volatility_function(t, table)
    books = legs(t)
    verdict = audit.feasible_books(books, table, past, volatility_of, LIMITS, POLICY)
    pool = owned(t, books, verdict)
    picks = written(selection.select_candidate(pool, POLICY).where("status = 'optimal'"), "picks")
    chosen = books.join(picks.select("book_id"), "book_id", "left_semi")
    held, final = audit.integer_or_cash(chosen, table, past, volatility_of, LIMITS, POLICY, NAV)
    outcome = known.where(F.col("scenario_id") == F.lit(DECIDED).cast("date")).select("contract_id", "ret")
    earned = (
        held.join(outcome, "contract_id", "left")
        .groupBy("book_id")
        .agg(F.coalesce(F.sum(F.col("weight") * F.col("ret")), F.lit(0.0)).alias("_gain"))
    )
    paid = F.when(F.col("abstained"), 0.0).otherwise(F.col("cost"))
    return (
        picks.select("decision_id", "book_id", "risk_aversion")
        .join(final.select("book_id", "abstained", "cost", held_gross()), "book_id")
        .join(earned, "book_id")
        .select(
            "decision_id", "book_id", "risk_aversion", "abstained", "held_gross",
            (F.col("_gain") - paid).alias("realized_return"),
        )
    )
