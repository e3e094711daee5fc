import datetime as dt
import math
import random

import pytest

from premia.operators import metrics, paths

SCHEMA = "config string, return_date date, net_return double, gross_nav double, integer_repair_failed boolean"


def path(config, values, start=dt.date(2020, 1, 31)):
    return [
        (config, start + dt.timedelta(days=31 * i), v, 0.5, None if i % 2 else True)
        for i, v in enumerate(values)
    ]


def brute(values, periods=12.0):
    clean = [v for v in values if v is not None and math.isfinite(v)]
    wealth, peak, dip, ruined = 1.0, 1.0, 0.0, False
    for v in clean:
        wealth = 0.0 if ruined else wealth * (1 + v)
        if wealth <= 0:
            wealth, ruined = 0.0, True
        peak = max(peak, wealth)
        dip = min(dip, wealth / peak - 1)
    return wealth, (-1.0 if ruined else dip), ruined


def summary(df, **kw):
    return {r["config"]: r for r in paths.performance_summary(df, ["config"], **kw).collect()}


def test_drawdown_counts_the_initial_wealth(table):
    row = summary(table(path("a", [-0.10, 0.0]), SCHEMA))["a"]
    assert row["max_drawdown"] == pytest.approx(-0.10)


def test_default_is_absorbing(table):
    df = table(path("a", [0.20, -1.0, 0.50]), SCHEMA)
    row = summary(df)["a"]
    assert row["defaulted"] and row["terminal_wealth"] == 0.0
    assert row["cagr"] == -1.0 and row["max_drawdown"] == -1.0
    assert row["sharpe"] is None and row["sortino"] is None
    wealth = [r["wealth"] for r in paths.wealth_path(df, ["config"]).orderBy("return_date").collect()]
    assert wealth == pytest.approx([1.2, 0.0, 0.0])


def test_mean_is_not_cagr(table):
    row = summary(table(path("a", [0.5, -0.4] * 6), SCHEMA))["a"]
    assert row["annualized_mean_return"] > 0 > row["cagr"]


def test_null_keys_vanish_and_empty_groups_stay(table):
    rows = path("a", [0.1, 0.2]) + path(None, [0.3]) + path("empty", [None, float("nan")])
    got = summary(table(rows, SCHEMA))
    assert set(got) == {"a", "empty"}
    assert got["empty"]["observations"] == 0 and got["empty"]["cagr"] is None
    assert got["empty"]["defaulted"] is False and got["empty"]["mean_gross_nav"] == 0.5
    assert got["empty"]["integer_failures"] == 1


def test_infinite_returns_are_dropped_but_surface_as_worst(table):
    row = summary(table(path("a", [0.1, float("-inf"), 0.1]), SCHEMA))["a"]
    assert row["observations"] == 2 and row["worst_month"] == float("-inf")
    assert not row["defaulted"]


def test_long_paths_match_the_sequential_recursion_for_any_block_and_partitioning(table):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    data = {f"p{k}": [rng.gauss(0.01, 0.08) for _ in range(60 + 7 * k)] for k in range(4)}
    data["ruin"] = [0.1, 0.2, -1.5, 3.0, 0.1]
    rows = [row for name, values in data.items() for row in path(name, values)]
    rng.shuffle(rows)
    df = table(rows, SCHEMA).repartition(7)
    for block in (None, F.lit(0), F.col("return_date")):
        got = summary(df, block=block)
        for name, values in data.items():
            wealth, dip, ruined = brute(values)
            assert got[name]["terminal_wealth"] == pytest.approx(wealth, abs=1e-12)
            assert got[name]["max_drawdown"] == pytest.approx(dip, abs=1e-12)
            assert got[name]["defaulted"] == ruined


def test_full_metrics_and_benchmark(table):
    rows = path("a", [0.02, -0.01, 0.03, 0.01])
    bench = table([(r[1], 0.01) for r in rows[:3]] + [(rows[3][1], float("nan"))], "return_date date, benchmark_return double")
    row = metrics.performance_metrics(table(rows, SCHEMA), ["config"], benchmark=bench).first()
    active = [0.01, -0.02, 0.02]
    mean = sum(active) / 3
    std = math.sqrt(sum((x - mean) ** 2 for x in active) / 2)
    assert row["information_ratio"] == pytest.approx(mean * 12 / (std * math.sqrt(12)))
    assert row["var_95"] == pytest.approx(0.01 - 0.15 * 0.02)
    assert row["cvar_95"] == pytest.approx(0.01)
    assert row["omega"] == pytest.approx(0.06 / 0.01)


def test_invalid_scale_is_refused(table):
    with pytest.raises(ValueError):
        summary(table(path("a", [0.1]), SCHEMA), periods=0.0)


def test_trailing_window_sees_only_earlier_rows(table):
    df = table(path("a", [float(i) for i in range(40)]), SCHEMA).drop("gross_nav", "integer_repair_failed")
    got = metrics.trailing_statistics(df, ["config"], "return_date", "net_return", 93).orderBy("return_date").collect()
    assert len(got) == 40 and got[0]["trailing_n"] == 0
    assert [r["trailing_n"] for r in got[3:]] == [3] * 37
    assert got[10]["trailing_mean"] == pytest.approx(8.0)
