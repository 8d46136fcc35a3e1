"""Whitening against whole numbers in plain Python, and against what the definitions promise."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from mediacat.llm import whitening
from mediacat.llm.whitening import Whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component string, whitened int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "n", "c", 1) for i, v in rows], SCHEMA).repartition(3)


def fitted(rows, how):
    """Usable rows with their integers, sums and the exact covariance."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    good = [(i, [math.floor(Fraction(c) * how.scale) + how.offset for c in v]) for i, v in good if len(v) == d]
    n, sums = len(good), [sum(x[k] for _, x in good) for k in range(d)]
    y = [[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in good]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    return good, n, sums, y, cov


def check(spark, rows, how, tolerance=1e-9):
    good, n, sums, y, cov = fitted(rows, how)
    d = len(sums)
    out = whitening.whiten(frame(spark, rows), how).collect()
    shown = min(how.components, d)
    assert len(out) == len(good) * shown
    v = np.array([[float(c) for c in r] for r in cov])
    model = whitening.fit(frame(spark, rows), how)
    assert model.n == n and model.sums == sums
    assert np.array_equal(model.covariance, v)
    values = np.linalg.eigvalsh(v)[::-1]
    deviation = {i: sum(a * a for a in r) for (i, _), r in zip(good, y, strict=True)}
    vectors = {i: np.array([a / n for a in r]) for (i, _), r in zip(good, y, strict=True)}
    for r in out:
        assert r.n == n and r.deviation == deviation[r.vec_id]
        e, w = model.values[r.component - 1], model.vectors[:, r.component - 1]
        if r.component <= model.rank:
            assert abs(np.linalg.norm(w) - 1) < 1e-12 and np.abs(v @ w - e * w).max() <= 1e-11 * values[0]
            assert r.whitened == pytest.approx(vectors[r.vec_id] @ w / math.sqrt(e), rel=tolerance, abs=tolerance)
            assert r.explained == pytest.approx(values[r.component - 1] / sum(values), rel=1e-6)
        else:
            assert r.whitened is None
        assert (r.identity_error is None) == (min(model.rank, shown) == 0) and (r.identity_error or 0) < 1e-4
    return out, model


def test_against_whole_numbers(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(k, 0.2 + k / 7) for k in range(7)]) for i in range(200)]
    odd = [(900, None), (901, []), (902, [1.0] * 6 + [None]), (903, [math.nan] * 7), (904, [math.inf] + [0.0] * 6), (905, [1.0, 2.0]), rows[3], (906, [-0.0] * 7), (907, [0.5, -0.5, 1 / 64, -1 / 64, 1e-300, -1e-300, 3.0])]
    check(spark, rows + odd, Whitening(components=4))
    check(spark, rows + odd, Whitening(components=32, offset=10**12))
    out, _ = check(spark, rows + [(None, [1.0] * 7)], Whitening())
    assert sum(r.vec_id is None for r in out) == 7


def test_dependent_and_constant_dimensions(spark):
    rnd = random.Random(4)
    rows = [(i, [float(a := rnd.randint(-9, 9)), 2.0 * a, 5.0, float(rnd.randint(0, 3))]) for i in range(50)]
    _, model = check(spark, rows, Whitening())
    assert model.rank == 2
    out, model = check(spark, [(1, [2.0, 3.0])], Whitening())
    assert model.rank == 0 and {r.explained for r in out} == {None}
    assert whitening.whiten(frame(spark, [(1, None), (2, [None])])).count() == 0
    assert whitening.whiten(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_are_exact(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) * 2.0 ** rnd.randint(40, 62), rnd.uniform(-1, 1) * 2.0**50]) for i in range(40)]
    good, n, sums, y, cov = fitted(rows, Whitening())
    model = whitening.fit(frame(spark, rows))
    assert model.sums == sums and model.covariance.tolist() == [[float(c) for c in r] for r in cov]
    whole = {i: sum(a * a for a in r) for (i, _), r in zip(good, y, strict=True)}
    for r in whitening.project(frame(spark, rows), model).collect():
        assert r.deviation == (whole[r.vec_id] if whole[r.vec_id] < 10**38 else None)


def test_query(spark):
    from mediacat.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    good, n, sums, y, _ = fitted(rows, Whitening())
    out = QUERIES["op11_whitening"](spark, sf)
    assert dict(out.dtypes)["deviation"] == "bigint"
    got = out.toPandas()
    assert len(got) == 32 * n and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == {i: sum(a * a for a in r) for (i, _), r in zip(good, y, strict=True)}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(wide.T @ wide / n - np.eye(32)).max() < 1e-9
