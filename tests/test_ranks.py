import random

import numpy as np
import pytest

from premia.operators.ranks import average_rank, exact_quantiles, fractional_tail_mean, full_rank


def data():
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)]
    rows += [("tail", rng.paretovariate(0.3) * rng.choice([-1, 1])) for _ in range(400)]
    rows += [("ties", float(rng.choice([-1, 0, 0, 2]))) for _ in range(300)]
    rows += [("close", 100 + rng.random() * 1e-9) for _ in range(300)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0)]
    return rows


def test_quantiles_and_tail_means_are_exact(table):
    rows = data()
    df = table(rows + [("hot", None), (None, 1.0), ("hot", float("nan"))], "k string, v double")
    probs = {"a": 0.05, "b": 0.5, "c": 0.9}
    got = exact_quantiles(df, ["k"], "v", probs, tail_means=True).collect()
    assert {r["k"] for r in got} == {"hot", "tail", "ties", "close", "one", "two"}
    for r in got:
        values = np.array([v for k, v in rows if k == r["k"]])
        assert r["size"] == len(values)
        for name, p in probs.items():
            q = np.quantile(values, p)
            assert r[name] == pytest.approx(q, rel=1e-12, abs=1e-12)
            assert r[f"{name}_tail"] == pytest.approx(values[values <= q + 1e-15].mean(), rel=1e-9)


def test_fractional_tail(table):
    df = table([("a", 1.0), ("a", 2.0), ("a", 3.0)], "k string, v double")
    assert fractional_tail_mean(df, ["k"], "v", 0.5).first()["cvar"] == pytest.approx(8 / 3)
    weighted = table([("a", 1.0, 3), ("a", 5.0, 1)], "k string, v double, n int")
    got = fractional_tail_mean(weighted, ["k"], "v", 0.5, weight="n").first()
    assert got["cvar"] == pytest.approx(3.0)


def test_ranks_of_whole_groups(table):
    rows = [(k, v, i) for i, (k, v) in enumerate(data())]
    df = table(rows, "k string, v double, i int")
    got = full_rank(df, ["k"], "v", ["i"]).collect()
    for key in {"hot", "ties", "tail"}:
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: r["rank"])
        assert [r["i"] for r in mine] == [r[2] for r in want]
    small = table([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("a", None)], "k string, v double")
    ranks = {(r["v"], r["rank"]) for r in average_rank(small, ["k"], "v", "rank").collect()}
    assert ranks == {(1.0, 1.0), (2.0, 2.5), (5.0, 4.0), (None, None)}


def test_values_crowded_near_one_level(table):
    rng = random.Random(5)
    values = [100.0 + rng.random() * 1e-6 for _ in range(2000)] + [100.0] * 50 + [-3.0, 0.0, 0.0]
    rows = [("k", v, i) for i, v in enumerate(values)]
    df = table(rows, "k string, v double, i int")
    got = {r["i"]: r["rank"] for r in full_rank(df, ["k"], "v", ["i"]).collect()}
    want = {r[2]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    assert got == want
    ordered = sorted(values)
    for r in average_rank(df, ["k"], "v", "rank").collect():
        low = ordered.index(r["v"])
        assert r["rank"] == low + (ordered.count(r["v"]) + 1) / 2


def test_no_job_runs_while_a_plan_is_built(table, spark):
    spark.sparkContext.setJobGroup("planning", "planning")
    exact_quantiles(table([("a", 1.0)], "k string, v double"), ["k"], "v", {"m": 0.5})
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
