"""The monthly decision sequence over all configs and dates."""

from __future__ import annotations

from premia.operators import decisions
from premia.plans.inputs import load, view
from premia.plans.registry import VIEWS, oracle, query

RULES = decisions.Rules()

# Signed quantity shipped by a nation's suppliers, by region, month and brand.
view(
    "fx_shipments",
    """
SELECT r.r_name AS config, n.n_nationkey AS book_id, p.p_brand AS label,
       CAST(date_trunc('month', l.l_shipdate) AS DATE) AS period,
       sum(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END) AS q
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
JOIN {nation} n ON n.n_nationkey = s.s_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
GROUP BY 1, 2, 3, 4
""",
)

VIEWS.add("decision_dates", "SELECT DISTINCT period AS d FROM fx_panel", "fx_panel")
VIEWS.add(
    "past_moments",
    """SELECT d, a.label AS row_label, b.label AS col_label, count(*) AS n, avg(a.ret) AS mean, covar_samp(a.ret, b.ret) AS cov
       FROM decision_dates JOIN fx_panel a ON a.period < d JOIN fx_panel b ON b.period = a.period AND a.label <= b.label
       GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    "decision_dates", "fx_panel",
)
VIEWS.add(
    "past_books",
    f"""SELECT d, config, book_id, label, {RULES.gross}::DOUBLE * q / sum(abs(q)) OVER (PARTITION BY d, config, book_id) AS weight
        FROM (SELECT d, config, book_id, label, CAST(sum(q) AS DOUBLE) AS q FROM decision_dates JOIN fx_shipments ON period < d
              GROUP BY 1, 2, 3, 4) s WHERE q <> 0""",
    "decision_dates", "fx_shipments",
)


def _audited(name: str, books: str) -> None:
    VIEWS.add(
        name,
        f"""SELECT *, coalesce(months >= {RULES.least_months} AND gross <= {RULES.gross}::DOUBLE + 1e-9 AND largest <= {RULES.cap}::DOUBLE + 1e-9
                 AND abs(net) <= {RULES.net_abs}::DOUBLE + 1e-9
                 AND volatility * sqrt(12.0e0) <= {RULES.volatility_ceiling}::DOUBLE + 1e-9, false) AS feasible
            FROM (SELECT s.*, gross * {RULES.cost_rate}::DOUBLE AS cost,
                    CASE WHEN pairs = legs * (legs + 1) // 2 THEN sqrt(greatest(variance, 0)) END AS volatility FROM (
                  SELECT b.d, b.config, b.book_id, sum(weight * mean) AS mean, sum(abs(weight)) AS gross, sum(weight) AS net,
                         max(abs(weight)) AS largest, min(coalesce(n, 0)) AS months, count(*) AS legs
                  FROM {books} b LEFT JOIN past_moments m ON m.d = b.d AND m.row_label = b.label AND m.col_label = b.label GROUP BY 1, 2, 3) s
                LEFT JOIN (SELECT x.d, x.config, x.book_id, count(*) AS pairs,
                         sum(CASE WHEN x.label = y.label THEN 1 ELSE 2 END * x.weight * y.weight * m.cov) AS variance
                  FROM {books} x JOIN {books} y ON y.d = x.d AND y.config = x.config AND y.book_id = x.book_id
                  JOIN past_moments m ON m.d = x.d AND m.row_label = x.label AND m.col_label = y.label GROUP BY 1, 2, 3) v
                  ON v.d = s.d AND v.config = s.config AND v.book_id = s.book_id) q""",
        books, "past_moments",
    )


_audited("past_pool", "past_books")
VIEWS.add(
    "past_choice",
    f"""SELECT d, config, count(*) AS candidates, arg_max(book_id, (mean - cost - {RULES.risk_aversion}::DOUBLE * volatility * volatility, -book_id))
          FILTER (WHERE feasible) AS book_id FROM past_pool GROUP BY 1, 2""",
    "past_pool",
)
VIEWS.add(
    "lot_books",
    f"""SELECT d, config, book_id, label, lots, lots * ({RULES.lot}::DOUBLE / {RULES.capital}::DOUBLE) AS weight FROM (
          SELECT b.*, sign(weight) * floor(abs(weight) * ({RULES.capital}::DOUBLE / {RULES.lot}::DOUBLE) + 1e-9) AS lots
          FROM past_books b JOIN past_choice c ON c.d = b.d AND c.config = b.config AND c.book_id = b.book_id) s WHERE lots <> 0""",
    "past_books", "past_choice",
)
_audited("lot_pool", "lot_books")


@query(
    "decision_pipeline",
    oracle(
        "past_choice lot_pool lot_books fx_panel",
        """SELECT c.config, c.d AS decision_date, c.candidates, c.book_id,
                  CASE WHEN c.book_id IS NULL THEN 'no_feasible_candidate' WHEN f.feasible THEN 'held' ELSE 'abstained' END AS status,
                  CASE WHEN f.feasible THEN g.lots ELSE 0 END AS lots, CASE WHEN f.feasible THEN f.gross ELSE 0 END AS held_gross,
                  CASE WHEN f.feasible THEN f.volatility END AS volatility,
                  CASE WHEN f.feasible THEN g.gain - f.cost ELSE 0 END AS realized_return
           FROM past_choice c LEFT JOIN lot_pool f ON f.d = c.d AND f.config = c.config
           LEFT JOIN (SELECT b.d, b.config, sum(abs(lots)) AS lots, coalesce(sum(weight * p.ret), 0) AS gain
                      FROM lot_books b LEFT JOIN fx_panel p ON p.period = b.d AND p.label = b.label GROUP BY 1, 2) g
             ON g.d = c.d AND g.config = c.config""",
        "config decision_date status", "held_gross volatility realized_return", "candidates book_id lots",
    ),
)
def decision_pipeline(t):
    table = decisions.decide(load(t, "fx_panel"), load(t, "fx_shipments"), RULES)
    return table.withColumns({name: table[name].cast("bigint") for name in ("candidates", "book_id", "lots")})
