import datetime as dt
import math
import random
from statistics import NormalDist

import pytest

from premia.functions.numeric import expected_maximum, with_expected_maximum, with_normal_cdf, with_normal_quantile
from premia.operators import inference

SCHEMA = "k string, return_date date, net_return double"


def rows(key, values):
    return [(key, dt.date(2019, 1, 1) + dt.timedelta(days=30 * i), v) for i, v in enumerate(values)]


def test_normal_functions(table):
    xs = [-40.0, -9.0, -7.2, -3.0, -0.5, 0.0, 0.7, 3.3, 7.3, 39.0]
    for r in with_normal_cdf(table([(x,) for x in xs], "x double"), "x", "p", "q").collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=1e-15)
        assert r["q"] == pytest.approx(0.5 * math.erfc(r["x"] / math.sqrt(2)), abs=1e-15)
    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    for r in with_normal_quantile(table([(p,) for p in ps], "p double"), "p", "x").collect():
        assert r["x"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-8)
    for r in with_expected_maximum(table([(n,) for n in (1, 2, 22, 598)], "n int"), "n", "m").collect():
        assert r["m"] == pytest.approx(expected_maximum(r["n"]), abs=1e-10)


def probability(values, bench):
    n = len(values)
    mean = sum(values) / n
    m2, m3, m4 = (sum((v - mean) ** k for v in values) / n for k in (2, 3, 4))
    s = mean / math.sqrt(m2 * n / (n - 1))
    skew = m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6) + 3
    var = (1 - skew * s + 0.25 * (kurt - 1) * s * s) / (n - 1)
    return NormalDist().cdf((s - bench) / math.sqrt(var)), s


def test_psr_and_dsr_follow_the_formula(table):
    values = [0.02, -0.01, 0.03, 0.015, -0.02, 0.04, 0.01]
    df = table(rows("a", values) + rows("ruin", [0.1, -1.0, 0.2]) + rows("flat", [0.01] * 4), SCHEMA)
    got = {r["k"]: r for r in inference.probabilistic_sharpe(df, ["k"], benchmark_sharpe=0.25).collect()}
    want, s = probability(values, 0.25 / math.sqrt(12))
    assert got["a"]["psr"] == pytest.approx(want, abs=1e-12)
    assert got["ruin"]["psr"] is None
    trials = table([("a", 10), ("flat", 1)], "k string, trials int")
    dsr = {r["k"]: r["dsr"] for r in inference.deflated_sharpe(df, trials, ["k"]).collect()}
    bench = max(0.0, math.sqrt((1 + 0.5 * s * s) / 6) * expected_maximum(10))
    assert dsr["a"] == pytest.approx(probability(values, bench)[0], abs=1e-10)
    assert dsr["a"] < got["a"]["psr"]


def test_bootstrap_is_seeded_circular_and_keeps_the_length(table):
    rng = random.Random(1)
    df = table(rows("a", [rng.random() for _ in range(23)]), SCHEMA)
    panel = inference.bootstrap_panel(df, ["k"], 3, 5, 7).orderBy("replicate", "pos").collect()
    again = inference.bootstrap_panel(df.repartition(5), ["k"], 3, 5, 7).orderBy("replicate", "pos").collect()
    assert panel == again and len(panel) == 69
    values = [r["net_return"] for r in df.orderBy("return_date").collect()]
    for r in panel:
        assert r["net_return"] == values[r["source_pos"]]
        if r["pos"] % 5:
            before = next(p for p in panel if p["replicate"] == r["replicate"] and p["pos"] == r["pos"] - 1)
            assert r["source_pos"] == (before["source_pos"] + 1) % 23
    other = inference.bootstrap_panel(df, ["k"], 3, 5, 8).orderBy("replicate", "pos").collect()
    assert [r["source_pos"] for r in other] != [r["source_pos"] for r in panel]
    with pytest.raises(ValueError):
        inference.bootstrap_panel(df, ["k"], 3, 0, 7)


@pytest.mark.parametrize("length,block", [(23, 5), (20, 5), (3, 8), (9, 1)])
def test_intervals_are_those_of_the_panel(table, length, block):
    rows = [("a", dt.date(2019 + i // 12, i % 12 + 1, 1), 5.0 + 0.01 * ((i * 7) % 11 - 5)) for i in range(length)]
    df = table(rows, "k string, return_date date, net_return double")
    panel = inference.bootstrap_panel(df, ["k"], 40, block, 7).toPandas()
    means = panel.groupby("replicate")["net_return"].agg(["mean", "std"])
    sharpes = (means["mean"] / means["std"] * math.sqrt(12)).replace([math.inf], math.nan).dropna()
    got = inference.bootstrap_intervals(df, ["k"], 40, block, 7).first()
    assert got["usable_draws"] == 40
    assert got["sharpe_lo"] == pytest.approx(sharpes.quantile(0.05), rel=1e-6)
    assert got["sharpe_hi"] == pytest.approx(sharpes.quantile(0.95), rel=1e-6)


@pytest.mark.parametrize("length,block", [(23, 5), (20, 5), (3, 8), (9, 1), (31, 7)])
def test_path_risk_is_that_of_the_panel(table, length, block):
    rng = random.Random(length)
    steps = {"a": [rng.uniform(-0.3, 0.4) for _ in range(length)], "b": [rng.uniform(-0.3, 0.4) for _ in range(length - 1)] + [-1.0]}
    df = table([(k, dt.date(2001 + i // 12, i % 12 + 1, 1), r) for k, values in steps.items() for i, r in enumerate(values)], "k string, return_date date, net_return double")
    panel = inference.bootstrap_panel(df, ["k"], 30, block, 7).orderBy("k", "replicate", "pos").toPandas()
    got = {row["k"]: row for row in inference.resampled_paths(df, ["k"], 30, block, 7).collect()}
    for k in steps:
        dips, wealths, lost = [], [], 0
        for _, path in panel[panel["k"] == k].groupby("replicate"):
            wealth, peak, dip = 1.0, 1.0, 0.0
            for r in path["net_return"]:
                wealth = wealth * (1 + r) if wealth > 0 and r > -1 else 0.0
                peak = max(peak, wealth)
                dip = min(dip, wealth / peak - 1)
            dips.append(dip)
            wealths.append(wealth)
            lost += wealth <= 0
        row = got[k]
        assert row["paths"] == 30 and row["default_share"] == pytest.approx(lost / 30)
        assert row["minimum_terminal_wealth"] == pytest.approx(min(wealths), abs=1e-12)
        ordered = sorted(dips)
        assert row["drawdown_p50"] == pytest.approx((ordered[14] + ordered[15]) / 2, abs=1e-12)
