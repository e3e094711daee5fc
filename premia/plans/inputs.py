"""Input views over the given tables, the same SQL text for Spark and the oracle.

Literals carry ``e0`` so that both dialects compute in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from premia.plans.registry import TABLES, VIEWS, Tables

TEXT: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name: str, text: str, *needs: str) -> None:
    TEXT[name] = (text, needs)
    plain = text
    for table in (*TABLES, *needs):
        plain = plain.replace("{" + table + "}", table)
    VIEWS.add(name, plain, *needs)


def load(t: Tables, name: str) -> DataFrame:
    """A view as a DataFrame."""

    text, needs = TEXT[name]
    return t.sql(text, **{need: load(t, need) for need in needs})


# Monthly return paths of 25 (config, strategy) groups; some default.
view(
    "fx_returns",
    """
SELECT c.c_mktsegment AS config, o.o_orderpriority AS strategy,
       CAST(date_trunc('month', o.o_orderdate) AS DATE) AS return_date,
       1.5e0 * (avg(o.o_totalprice) / 250000.0e0 - 1.0e0) AS net_return,
       avg(o.o_totalprice) / 500000.0e0 AS gross_nav,
       max(o.o_totalprice) > 490000.0e0 AS integer_repair_failed,
       CASE WHEN count(*) % 3 = 0 THEN NULL ELSE count(*) % 3 = 1 END AS integer_execution_abstained,
       CASE WHEN count(*) % 5 = 0 THEN NULL ELSE count(*) % 2 = 0 END AS integer_conversion_feasible,
       CASE WHEN min(o.o_orderkey) % 4 = 0 THEN 'unscored_missing_or_incomplete_executable_quotes'
            ELSE 'retrospective_development_sample' END AS evidence_status
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
GROUP BY 1, 2, 3
""",
)

# One benchmark return per month.
view(
    "fx_benchmark",
    """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS return_date,
       avg(l_extendedprice) / 38000.0e0 - 1.0e0 AS benchmark_return
FROM {lineitem} GROUP BY 1
""",
)

# One option contract per part.
view(
    "fx_chain",
    """
SELECT p_partkey AS contract_id, p_brand AS underlying,
       CASE WHEN p_size % 10 = 0 THEN 'vix_option' ELSE 'equity_option' END AS asset_class,
       CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind,
       p_retailprice / 10.0e0 AS spot,
       p_retailprice / 10.0e0 * (0.8e0 + 0.4e0 * (p_partkey % 41) / 40.0e0) AS strike,
       (p_size - 1) / 49.0e0 AS maturity,
       0.02e0 AS rate, 0.01e0 AS dividend_yield,
       0.15e0 + 0.01e0 * (p_partkey % 20) AS volatility,
       0.001e0 * (1 + p_partkey % 5) AS long_cost, 0.002e0 * (1 + p_partkey % 3) AS short_cost,
       0.5e0 + 0.1e0 * (p_partkey % 4) AS short_margin, p_partkey % 7 <> 0 AS short_allowed,
       0.5e0 + (p_partkey % 11) / 10.0e0 AS underlying_beta_spy,
       0.02e0 + 0.01e0 * (p_partkey % 19) AS liquidity_cap
FROM {part}
""",
)

# Complete label x month panel (25 labels).
view(
    "fx_panel",
    """
SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS period, p.p_brand AS label,
       avg(l.l_extendedprice) / 50000.0e0 - 1.0e0 AS ret
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY 1, 2
""",
)

# Factor panel: five labels by month.
view(
    "fx_factors",
    """
SELECT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS period, 'f_' || c.c_mktsegment AS label,
       avg(o.o_totalprice) / 250000.0e0 - 1.0e0 AS ret
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY 1, 2
""",
)

# Loadings of the 25 panel labels on the five factors.
view(
    "fx_loadings",
    """
SELECT p.p_brand AS contract_id, f.label AS factor,
       avg(((p.p_partkey + 7 * length(f.label)) % 11) / 10.0e0 - 0.4e0) AS loading
FROM {part} p CROSS JOIN (SELECT DISTINCT 'f_' || c_mktsegment AS label FROM {customer}) f
GROUP BY 1, 2
""",
)

# Sparse contract scenarios.
view(
    "fx_scenarios",
    """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS scenario_id, l_partkey AS contract_id,
       avg(l_extendedprice) / 50000.0e0 - 1.0e0 AS ret
FROM {lineitem} GROUP BY 1, 2
""",
)

# Signed quantity of each book and contract.
view(
    "fx_positions",
    """
SELECT l_suppkey AS book_id, l_partkey AS contract_id,
       sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS q
FROM {lineitem} GROUP BY 1, 2
""",
)

# Signed premium weights, gross 0.5 per book.
view(
    "fx_books",
    """
SELECT s.book_id, s.contract_id, 0.5e0 * s.q / t.gross AS weight
FROM {fx_positions} s
JOIN (SELECT book_id, sum(abs(q)) AS gross FROM {fx_positions} GROUP BY 1) t
  ON s.book_id = t.book_id
WHERE t.gross > 0
""",
    "fx_positions",
)

# What each supplier ships in each quarter: every line item is in exactly one of these positions.
view(
    "fx_quarter_positions",
    """
SELECT l_suppkey * 100 + (year(l_shipdate) - 1992) * 4 + quarter(l_shipdate) AS book_id, l_partkey AS contract_id,
       sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS q
FROM {lineitem} GROUP BY 1, 2
""",
)

# Whole candidate books of the audit, of seven different gross weights.
view(
    "fx_quarter_books",
    """
SELECT s.book_id, s.contract_id, (0.4e0 + 0.02e0 * (s.book_id % 7)) * s.q / t.gross AS weight
FROM {fx_quarter_positions} s
JOIN (SELECT book_id, sum(abs(q)) AS gross FROM {fx_quarter_positions} GROUP BY 1) t ON s.book_id = t.book_id
WHERE t.gross > 0
""",
    "fx_quarter_positions",
)

# The decision that a book is a candidate of: its supplier's nation.
view(
    "fx_owners",
    """
SELECT b.book_id, CAST(s.s_nationkey AS BIGINT) AS decision_id
FROM (SELECT DISTINCT book_id FROM {fx_quarter_books}) b JOIN {supplier} s ON s.s_suppkey = CAST(floor(b.book_id / 100.0e0) AS BIGINT)
""",
    "fx_quarter_books",
)

# Books over the panel labels.
view(
    "fx_label_books",
    """
SELECT b.book_id, p.p_brand AS contract_id, sum(b.weight) AS weight
FROM {fx_books} b JOIN {part} p ON b.contract_id = p.p_partkey GROUP BY 1, 2
""",
    "fx_books",
)

# Quotes and trades.
view(
    "fx_quotes",
    """
SELECT user_id AS symbol, ts AS quote_ts, event_id AS quote_id,
       value * (1e0 - 0.005e0 * (1 + event_id % 5)) AS bid,
       value * (1e0 + 0.005e0 * (1 + event_id % 5)) AS ask,
       1 + event_id % 97 AS volume, 10 + event_id % 211 AS open_interest
FROM {events} WHERE event_type IN ('view', 'click')
""",
)
view(
    "fx_trades",
    """
SELECT event_id AS trade_id, user_id AS symbol, ts AS trade_ts, value AS mark,
       CASE WHEN user_id % 3 = 0 THEN 'vix_option' ELSE 'equity_option' END AS asset_class,
       CASE WHEN event_id % 2 = 0 THEN 'orig' ELSE 'larger' END AS arm,
       CASE WHEN event_id % 3 = 0 THEN -0.001e0 ELSE 0.001e0 END * (1 + event_id % 9) AS weight,
       1 + event_id % 13 AS contracts
FROM {events} WHERE event_type = 'purchase'
""",
)
