import datetime as dt

import numpy as np
import pytest

from premia.operators import covariance as ops

RNG = np.random.default_rng(4)
T, FACTORS, CONTRACTS = 9, ["f1", "f2"], ["A", "B", "C"]


@pytest.fixture
def panels(table):
    f = RNG.normal(size=(T, 2))
    load = RNG.normal(size=(3, 2))
    r = f @ load.T + 0.3 * RNG.normal(size=(T, 3))
    dates = [dt.date(2019 + i // 4, 1 + 3 * (i % 4), 1) for i in range(T)]
    schema = "universe_id string, period date, label string, ret double"
    gap = dt.date(2030, 1, 1)
    factors = [("u", d, n, float(f[i, j])) for i, d in enumerate(dates) for j, n in enumerate(FACTORS)]
    options = [("u", d, n, float(r[i, j])) for i, d in enumerate(dates) for j, n in enumerate(CONTRACTS)]
    options += [("u", gap, "A", 1.0), ("u", dates[0], "extra", 5.0)]
    factors += [("u", gap, n, 1.0) for n in FACTORS]
    loadings = [("u", c, n, float(load[i, j])) for i, c in enumerate(CONTRACTS) for j, n in enumerate(FACTORS)]
    return (
        table(options, schema), table(factors, schema),
        table(loadings, "universe_id string, contract_id string, factor string, loading double"), f, r, load,
    )


def dense(f, r, load):
    f, r = f - f.mean(0), r - r.mean(0)
    z = np.column_stack([f, r - f @ load.T])
    s = z.std(0, ddof=1)
    y = z / s
    t, q = y.shape
    c = y.T @ y / t
    mu = np.trace(c) / q
    beta = (((y**2).sum(1) ** 2).sum() / t - (c**2).sum()) / (q * t)
    delta = ((c**2).sum() - 2 * mu * np.trace(c) + q * mu**2) / q
    rho = min(max(beta, 0), delta) / delta
    return ((1 - rho) * c + rho * mu * np.eye(q)) * np.outer(s, s), rho


def matrix(rows, names):
    out = np.zeros((len(names), len(names)))
    for r in rows:
        i, j = names.index(r["row_label"]), names.index(r["col_label"])
        out[i, j] = out[j, i] = r["value"]
    return out


@pytest.mark.parametrize("tiles", [1, 3])
def test_joint_moments_equal_the_dense_estimator(panels, tiles):
    options, factors, loadings, f, r, load = panels
    rows = ops.joint_moments(options, factors, loadings, tiles=tiles).collect()
    want, _ = dense(f, r, load)
    assert len(rows) == 15 and {row["n_obs"] for row in rows} == {T}
    assert np.allclose(matrix(rows, FACTORS + CONTRACTS), want, atol=1e-12)


def test_sample_moments_rebuild_the_sample_covariance(panels):
    options, factors, loadings, f, r, load = panels
    moments = ops.joint_moments(options, factors, loadings, regularize=False)
    rows = ops.option_covariance(moments, loadings).collect()
    assert np.allclose(matrix(rows, CONTRACTS), np.cov(r.T), atol=1e-12)


def test_volatility_without_a_matrix(panels, table):
    options, factors, loadings, f, r, load = panels
    joint = ops.standardized(ops.joint_observations(options, factors, loadings))
    stats = ops.shrinkage_statistics(joint)
    want, rho = dense(f, r, load)
    assert stats.first()["shrinkage"] == pytest.approx(rho)
    w = {1: [0.2, -0.1, 0.4], 2: [0.0, 0.5, 0.0]}
    books = table(
        [("u", b, c, x) for b, ws in w.items() for c, x in zip(CONTRACTS, ws) if x],
        "universe_id string, book_id int, contract_id string, weight double",
    )
    for row in ops.book_volatility(books, joint, stats, loadings).collect():
        ws = np.array(w[row["book_id"]])
        v = np.concatenate([load.T @ ws, ws])
        assert row["volatility"] == pytest.approx(np.sqrt(v @ want @ v), rel=1e-12)


def test_default_factor_blocks_and_matrix_problems(table):
    schema = "universe_id string, row_label string, col_label string, value double"
    cov = table([("u", "A", "A", 0.02), ("u", "A", "B", 0.004), ("u", "B", "A", 0.004), ("u", "B", "B", 1e-9)], schema)
    cells = {(r["row_label"], r["col_label"]): r["value"] for r in ops.factor_covariance_default(cov).collect()}
    assert cells[("r2_A", "r2_B")] == pytest.approx(2 * 0.004**2)
    assert cells[("dv_A", "dv_A")] == 0.005 and cells[("dv_B", "dv_B")] == 1e-8
    assert ("dv_A", "dv_B") not in cells
    bad = table(
        [("u", "A", "A", 1.0), ("u", "A", "B", 0.1), ("u", "B", "A", 0.2), ("u", "B", "B", float("nan")), ("u", "A", "C", 1.0)],
        schema,
    )
    found = {(r["low_label"], r["high_label"], r["reason"]) for r in ops.moment_check(bad, ["universe_id"]).collect()}
    assert found == {("A", "B", "not_symmetric"), ("B", "B", "not_finite"), ("A", "C", "missing_cell")}
    with pytest.raises(ValueError):
        ops.diagonal_shrink(cov, 1.5)
