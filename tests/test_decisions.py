import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from premia.operators import decisions

RULES = decisions.Rules(least_months=6, cap=0.3, net_abs=0.45, volatility_ceiling=0.06, capital=1e6, lot=20_000.0)
PANEL = "period date, label string, ret double"
POSITIONS = "config string, book_id long, label string, period date, q double"
LABELS = "abcd"


def month(i):
    return dt.date(2001 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def inputs():
    rng = random.Random(4)
    panel = [(month(i), label, rng.gauss(0.01, 0.03)) for i in range(30) for label in LABELS if rng.random() > 0.05]
    positions = [
        (config, book, label, month(i), float(rng.randint(-4, 9)))
        for config, first in (("x", 1), ("y", 4)) for book in range(first, first + 3) for label in LABELS for i in range(30) if rng.random() > 0.4
    ]
    return panel, positions


def plain(panel, positions, rules):
    """The sequence, one date after another."""

    out = {}
    for date in sorted({period for period, _, _ in panel}):
        past = {}
        for period, label, ret in panel:
            if period < date:
                past.setdefault(label, {})[period] = ret
        weights = {}
        for config, book, label, period, q in positions:
            if period < date:
                weights.setdefault((config, book), {}).setdefault(label, 0.0)
                weights[config, book][label] += q
        weights = {key: {k: q for k, q in held.items() if q} for key, held in weights.items()}
        weights = {key: {k: rules.gross * q / sum(map(abs, held.values())) for k, q in held.items()} for key, held in weights.items() if held}

        def cov(a, b):
            both = [p for p in past.get(a, {}) if p in past.get(b, {})]
            if len(both) < 2:
                return None
            ma, mb = (sum(past[k][p] for p in both) / len(both) for k in (a, b))
            return sum((past[a][p] - ma) * (past[b][p] - mb) for p in both) / (len(both) - 1)

        def audit(held):
            months = min(len(past.get(k, {})) for k in held)
            cells = [cov(a, b) and held[a] * held[b] * cov(a, b) for a in held for b in held]
            vol = None if None in cells else math.sqrt(max(sum(cells), 0))
            gross, net = sum(map(abs, held.values())), sum(held.values())
            fine = months >= rules.least_months and vol is not None and gross <= rules.gross + 1e-9 and abs(net) <= rules.net_abs + 1e-9
            fine = fine and max(map(abs, held.values())) <= rules.cap + 1e-9 and vol * math.sqrt(12) <= rules.volatility_ceiling + 1e-9
            mean = sum(w * sum(past[k].values()) / len(past[k]) for k, w in held.items() if past.get(k))
            return fine, gross, vol, mean

        for config in {config for config, _ in weights}:
            pool = []
            for (owner, book), held in weights.items():
                if owner == config:
                    fine, gross, vol, mean = audit(held)
                    if fine:
                        pool.append((-(mean - gross * rules.cost_rate - rules.risk_aversion * vol * vol), book))
            if not pool:
                out[config, date] = ("no_feasible_candidate", None, 0, 0.0, 0.0)
                continue
            book = min(pool)[1]
            lots = {k: math.copysign(math.floor(abs(w) * rules.capital / rules.lot + 1e-9), w) for k, w in weights[config, book].items()}
            lots = {k: n for k, n in lots.items() if n}
            held = {k: n * rules.lot / rules.capital for k, n in lots.items()}
            fine, gross, vol, _ = audit(held)
            now = {label: ret for period, label, ret in panel if period == date}
            gain = sum(w * now.get(k, 0.0) for k, w in held.items()) - gross * rules.cost_rate
            out[config, date] = ("held", book, sum(map(abs, lots.values())), gross, gain) if fine else ("abstained", book, 0, 0.0, 0.0)
    return out


def decided(spark, panel, positions):
    table = decisions.decide(spark.createDataFrame(panel, PANEL), spark.createDataFrame(positions, POSITIONS), RULES)
    return {(row.config, row.decision_date): row for row in table.collect()}


def test_all_dates_at_once_are_the_dates_one_by_one(spark, inputs):
    want, got = plain(*inputs, RULES), decided(spark, *inputs)
    assert set(got) == set(want) and {row.status for row in got.values()} >= {"held", "no_feasible_candidate"}
    for key, (status, book, lots, gross, gain) in want.items():
        row = got[key]
        assert (row.status, row.book_id, row.lots) == (status, book, lots), key
        assert (row.held_gross, row.realized_return) == (pytest.approx(gross), pytest.approx(gain))


def test_later_rows_change_no_decision(spark, inputs):
    panel, positions = inputs
    cut = month(20)
    other = [(p, k, -5 * r if p >= cut else r) for p, k, r in panel]
    moved = [(c, b, k, p, 3 * q + 1 if p >= cut else q) for c, b, k, p, q in positions] + [("x", 99, "a", cut, 5.0)]
    before, after = decided(spark, panel, positions), decided(spark, other, moved)
    for (config, date), row in before.items():
        if date < cut:
            assert after[config, date] == row
        elif date == cut:  # decided from the months before; only what is earned is new
            assert after[config, date].asDict() | {"realized_return": 0} == row.asDict() | {"realized_return": 0}


def test_empty_inputs_and_missing_returns(spark, inputs):
    panel, positions = inputs
    assert decided(spark, [], positions) == {} and decided(spark, panel, []) == {}
    holes = [(p, k, None if k == "a" else r) for p, k, r in panel]
    rows = decided(spark, holes, [row for row in positions if row[2] == "a"])
    assert rows and {row.status for row in rows.values()} == {"no_feasible_candidate"}
    assert decisions.months(spark.createDataFrame(holes, PANEL)).select(F.size("dates")).first()[0] == 30
