import numpy as np
import pytest

from siemloom.llm import queries
from siemloom.llm import whitening as W

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", range(6))
def test_contour_against_dense_eigenpairs(kind):
    for seed in range(8):
        r = np.random.default_rng(seed)
        n = int(r.integers(1, 70))
        q = np.linalg.qr(r.standard_normal((n, n)))[0]
        e = [r.random(n), 10.0 ** r.uniform(-8, 3, n), np.repeat(r.random(3), n)[:n], np.r_[np.ones(n // 2 + 1), np.zeros(n)][:n],
             np.sort(r.random(n)) ** 8 + 1e-3, 1 + 1e-9 * r.random(n)][kind]
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        want = np.linalg.eigvalsh(a)[::-1]
        want = want[want > W.RANK * want[0]][:32]
        values, x = W.principal(a, 32)
        assert len(values) == len(want)
        assert np.abs(values - want).max() < 1e-13 * want[0]
        assert np.abs(a @ x - x * values).max() < 1e-12 * want[0] and np.abs(x.T @ x - np.eye(len(want))).max() < 1e-13


def test_inertia_counts():
    r = np.random.default_rng(3)
    a = r.standard_normal((40, 40))
    a = a + a.T
    e, count = np.linalg.eigvalsh(a), W.Inertia(a)
    for shift in np.linspace(e[0] - 1, e[-1] + 1, 60):
        assert count.below(shift) == (e < shift).sum()


def plain(rows, most=32):
    """The contract by numpy over all rows: {(vec_id, component): (deviation, whitened up to its sign, explained)}."""
    rows = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    y = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:most]
    z = y @ u[:, order] / np.sqrt(e[order])
    return {(rows[i][0], k + 1): (int(((n * x[i] - s) ** 2).sum()), z[i, k], e[order[k]] / e.sum()) for i in range(n) for k in range(len(order))}, n


def agree(got, rows):
    want, n = plain(rows)
    assert len(got) == len(want)
    ours = np.array([r["whitened"] for r in got])
    theirs = np.array([want[r["vec_id"], r["component"]][1] for r in got])
    for k in {r["component"] for r in got}:
        at = [i for i, r in enumerate(got) if r["component"] == k]
        sign = np.sign((ours[at] * theirs[at]).sum())
        assert np.abs(ours[at] - sign * theirs[at]).max() < 1e-7
    for r in got:
        deviation, _, explained = want[r["vec_id"], r["component"]]
        assert r["n"] == n and r["deviation"] == deviation and abs(r["explained"] / explained - 1) < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_query_against_numpy(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    agree(queries.op12_whitening(spark, SF).collect(), rows)


def test_odd_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(c) for c in r.standard_normal(5) * [9, 5, 3, 2, 1]]) for i in range(80)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, key string, vector int, whitened double"
    make = lambda rows: spark.createDataFrame([(i, v, "k", 1, 0.5) for i, v in rows], schema)
    out = W.whiten(make(rows + odd))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agree(out.collect(), rows)
    twice = W.whiten(make(rows + rows)).collect()
    assert len(twice) == 800 and {x["n"] for x in twice} == {160}
    # Another length than most, an entry beyond 62 bits, a null id.
    more = W.whiten(make([*rows, (200, [1.0, 2.0]), (201, [1e300] * 5), (None, [0.0] * 5)])).collect()
    assert len(more) == 81 * 5 and sum(x["vec_id"] is None for x in more) == 5
    # A deviation beyond 64 bits is null, the rest holds.
    far = W.whiten(make([*rows, (300, [1e9, 0.0, 0.0, 0.0, 0.0])])).collect()
    assert {x["deviation"] for x in far if x["vec_id"] == 300} == {None} and far[0]["identity_error"] < 1e-4
    assert W.whiten(make(rows[:1] * 4)).count() == 0 and W.whiten(make([])).count() == 0 and W.whiten(make(odd)).count() == 0


def test_vectors_in_few_directions(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(a), float(b), float(a), 0.0]) for i, (a, b) in enumerate(r.integers(-9, 9, (50, 2)))]
    out = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x["component"] for x in out} == {1, 2} and out[0]["identity_error"] < 1e-9
