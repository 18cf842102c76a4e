import numpy as np
import pytest

from chronofact.llm import feast, whitening


def with_values(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    m = (q * values) @ q.T
    return (m + m.T) / 2


CASES = {
    "spread": np.random.default_rng(2).gamma(2, 40, 64), "repeated": np.repeat(np.arange(1.0, 9), 8), "one": np.ones(1), "equal": np.full(40, 3.0),
    "flat": np.r_[np.arange(1.0, 11), np.zeros(60)], "falling": 10.0 ** -np.arange(11), "close": 1 + 1e-9 * np.arange(20)}


@pytest.mark.parametrize("name", CASES)
def test_eigenpairs_equal_a_full_solver(name):
    values, wanted = np.sort(CASES[name])[::-1], min(32, int((CASES[name] > 0).sum()))
    matrix = with_values(values)
    intervals = feast.plan(matrix, wanted)
    assert sum(i.count for i in intervals) >= wanted
    found, vectors = feast.largest([feast.solved(matrix, i) for i in intervals], wanted)
    assert found == pytest.approx(values[:wanted], rel=1e-9, abs=1e-13 * values[0])
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12


def test_signs_of_pivots_count_eigenvalues():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 30):
        a = rng.normal(size=(n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (-2.0, 0.0, 0.7, 3.0):
            assert feast.eigenvalues_above(a, shift) == (values > shift).sum()
    assert feast.eigenvalues_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert feast.eigenvalues_above(np.zeros((3, 3)), 0.0) == 0


def test_a_wrong_count_is_noticed():
    matrix = with_values(np.arange(1.0, 21))
    with pytest.raises(ArithmeticError):
        feast.solve(matrix, feast.Interval(4.5, 9.5, 7, 11))


def check(rows, keys, found, components=32):
    """The whole query against numpy's solver on exact integers."""
    x = np.floor(64 * np.asarray(rows, np.float64)).astype(np.int64) + 1_000_000
    n, d = x.shape
    sums = x.sum(0)
    centred = (x - sums / n)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    width = min(components, d)
    assert len(found) == n * width
    by = {}
    for r in found:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    deviation = ((n * x - sums) ** 2).sum(1)
    for c in range(1, width + 1):
        live = values[c - 1] > 1e-11 * values[0]
        want = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1]) if live else None
        got = np.array([by[c][k][0]["whitened"] for k in keys], float)
        if live:
            assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
        else:
            assert np.isnan(got).all()
        for k, dev in zip(keys, deviation, strict=True):
            r = by[c][k][0]
            assert r["n"] == n and r["deviation"] == dev and r["identity_error"] < 1e-8
            assert r["explained"] == pytest.approx(values[c - 1] / values.sum() if live else 0.0, rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("d", [1, 3, 40])
def test_query_equals_brute_force(spark, d):
    rng = np.random.default_rng(d)
    rows = (rng.normal(size=(300, d)) * np.linspace(1, 3, d)).tolist()
    frame = spark.createDataFrame([(i, r, "x", 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, n string, component int")
    check(rows, range(300), whitening.whiten(frame.repartition(5)).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(50, 3)).tolist()
    rows = [[*r, r[0]] for r in rows]  # one direction has no variance
    rows[7] = rows[6]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan"), 1.0, 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0, 1.0]),
           (104, [1.0, 2.0]), (105, []), (106, [1e300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([*enumerate(rows), *odd], "vec_id long, embedding array<double>")
    check(rows, range(50), whitening.whiten(frame).collect())
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 1.0]), (1, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert len(whitening.whiten(nulls).collect()) == 6
    assert whitening.whiten(frame.limit(0)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(i, [2.0, 3.0]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 8 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in same)


def test_deviations_are_exact_beyond_longs():
    fit = whitening.Fit(2, 3, np.array([10, 10]), np.array([1, 2]), np.empty(0), np.empty((2, 0)), 0.0)
    x = np.array([[2**33, 10], [2**30, 11], [2**29, 2]])
    want = [sum((3 * int(v) - 30 - r) ** 2 for v, r in zip(row, (1, 2), strict=True)) for row in x]
    assert fit.deviations(x) == [w if w < 2**63 else None for w in want] and None in fit.deviations(x)
    assert fit.deviations(x[2:] * 0 + 12) == [(3 * 2 - 1) ** 2 + (3 * 2 - 2) ** 2]
