import datetime as dt
import random

import pytest

from premia.functions.status import validation_status
from premia.operators import validation as ops

SCHEMA = "config string, strategy string, return_date date, label_end date, net_return double"


def rows(strategy, n, seed=0):
    rng = random.Random(seed)
    start = dt.date(2015, 1, 1)
    out = []
    for i in range(n):
        day = start + dt.timedelta(days=30 * i)
        out.append(("c", strategy, day, day + dt.timedelta(days=45), rng.gauss(0.01, 0.05)))
    return out


def test_splits_purge_embargo_and_paths(table):
    df = table(rows("s", 50), SCHEMA)
    keys = ["config", "strategy"]
    splits = ops.cpcv_splits(df, keys, count=12, embargo=3)
    got = splits.collect()
    assert len(got) == 50 * 66
    sizes = {}
    for r in got:
        if r["split_id"] == 0:
            sizes[r["block"]] = sizes.get(r["block"], 0) + 1
    assert [sizes[b] for b in range(12)] == [5, 5] + [4] * 10
    by_split = {}
    for r in got:
        by_split.setdefault(r["split_id"], []).append(r)
    for members in by_split.values():
        test = [r for r in members if r["role"] == "test"]
        for r in members:
            if r["role"] == "train":
                assert all(r["return_date"] > x["label_end"] or r["label_end"] < x["return_date"] for x in test)
                assert all(abs(r["pos"] - x["pos"]) > 3 for x in test)
    paths = ops.cpcv_paths(splits, keys, 12).collect()
    assert {r["path_id"] for r in paths} == set(range(11))
    for p in range(11):
        dates = [r["return_date"] for r in paths if r["path_id"] == p]
        assert len(dates) == 50 == len(set(dates))


def test_overfitting_probability(table):
    ranks = table(
        [("c", 0, "a", 3.0, 1.0), ("c", 0, "b", 2.0, 2.0), ("c", 0, "d", 1.0, 3.0),
         ("c", 1, "a", 3.0, 3.0), ("c", 1, "b", 2.0, 2.0), ("c", 1, "d", 1.0, 1.0),
         ("c", 2, "a", 1.0, 1.0), ("c", 2, "b", 3.0, 2.0), ("c", 2, "d", 2.0, 3.0)],
        "config string, split_id int, strategy string, in_rank double, out_rank double",
    )
    row = ops.overfitting_probability(ranks, "config", "strategy").first()
    # The winner in the middle has logit 0, which does not count as overfitted.
    assert row["pbo"] == pytest.approx(1 / 3) and row["median_logit"] == pytest.approx(0.0)
    assert row["splits"] == 3 and row["strategies"] == 3


def test_status_precedence(table):
    df = table(
        [(1, 0.1, 0.2, 0.0, 1.0, False), (2, 0.1, 0.2, 0.1, 1.0, True), (3, 0.1, 0.2, 0.0, 0.0, True),
         (4, 0.1, 0.2, 0.0, 1.0, True), (5, -0.1, 0.2, 0.0, 1.0, True), (6, -0.1, -0.2, 0.0, 1.0, True),
         (7, None, None, None, 1.0, True)],
        "id int, sharpe_p05 double, sharpe_p50 double, default_share double, minimum_terminal_wealth double, ok boolean",
    )
    from pyspark.sql import functions as F

    got = {r["id"]: r["s"] for r in df.select("id", validation_status(feasible=F.col("ok")).alias("s")).collect()}
    assert got == {1: "fail_infeasible", 2: "fail_default", 3: "fail_default", 4: "pass", 5: "mixed", 6: "fail_sharpe",
                   7: "fail_default"}
