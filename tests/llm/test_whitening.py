"""Whitening against plain exact sums and a dense eigensolver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linescope.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>"


def brute_integers(rows):
    """(vec_id, integers) of the sound rows of the usual length."""
    sound = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in sound]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    return [(k, tuple(math.floor(256 * c) for c in v)) for k, v in sound if len(v) == usual]


def brute(rows, count=4):
    """n, {(vec_id, x): deviation}, eigenvalues, vectors, covariance of the fit list."""
    kept = brute_integers(rows)
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[a] for x in fit) for a in range(d)]
    centred = {x: [n * x[a] - sums[a] for a in range(d)] for x in fit}
    scatter = [[sum(centred[x][a] * centred[x][b] for x in fit) for b in range(d)] for a in range(d)]
    covariance = np.array([[v / n**3 for v in row] for row in scatter])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:count]
    return kept, n, {x: sum(c * c for c in centred[x]) for x in fit}, values[order], vectors[:, order], np.trace(covariance), centred


def vectors(seed, n, d=12, shift=0.0, stretch=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(1, 3, d) * stretch + shift
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    return rows + [(n + k, rows[0][1]) for k in range(n // 3)]  # copies of one vector


def check(spark, rows, close=1e-9):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    kept, n, deviations, values, basis, trace, centred = brute(rows)
    m = min(4, basis.shape[0])
    assert len(got) == len(kept) * m
    assert {r.n for r in got} == {n}
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, []).append(r)
    signs = {}
    for vec_id, x in kept:
        own = sorted(by_row[vec_id], key=lambda r: r.component)[:m]
        assert [r.component for r in own] == list(range(1, m + 1))
        for r in own:
            exact = deviations[x]
            assert r.deviation_exact == str(exact) and r.deviation == (exact if exact < 2**63 else None)
            want = sum(c / n * b for c, b in zip(centred[x], basis[:, r.component - 1])) / math.sqrt(values[r.component - 1])
            if abs(want) > 1e-3:
                signs.setdefault(r.component, round(r.whitened / want))
            assert r.whitened * signs.get(r.component, 1) == pytest.approx(want, abs=close)
            assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
    assert set(signs.values()) <= {-1, 1}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("shift", [0.0, 1e5, -3e9])
def test_whiten(spark, shift):
    """A shift that would swallow the variance in floating point changes nothing."""
    check(spark, vectors(1, 300, shift=shift))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 60, d=5) + [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [nan, 0.0, 0.0, 0.0, 0.0])]
    rows += [(904, [0.0, -inf, 0.0, 0.0, 0.0]), (905, [1.0, 2.0]), (906, [-0.0, 0.0, -0.001, 1e-300, 0.5])]
    check(spark, rows)
    docs = spark.createDataFrame([*rows, (None, rows[3][1])], SCHEMA)
    assert whitening.whiten(docs).filter("vec_id is null").count() == 4


def test_narrow_vectors(spark):
    check(spark, vectors(4, 40, d=2))


def test_outlier(spark):
    """One far vector holds nearly all variance; the rest keeps its components."""
    rows = vectors(5, 200, d=6) + [(999, [1e12, -2e12, 5e11, 0.0, 1.0, 3e11])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got[0].identity_error < 1e-6
    assert {r.deviation is None for r in got} == {True}
    kept, n, deviations, *_ = brute(rows)
    assert {r.vec_id: r.deviation_exact for r in got} == {vec_id: str(deviations[x]) for vec_id, x in kept}
    plain = sorted({r.component: r.explained for r in got}.items())
    # The far direction is out of the rest's way: the others come from the projected rows.
    fit = np.array([list(x) for x in sorted({x for _, x in kept})], np.longdouble)
    fit -= fit.mean(0)
    far = np.array([1e12, -2e12, 5e11, 0, 1, 3e11], np.longdouble)
    far /= np.sqrt(far @ far)
    rest = fit - np.outer(fit @ far, far)
    values = np.sort(np.linalg.eigvalsh((rest.T @ rest / n).astype(float)))[::-1]
    for component, explained in plain[1:]:
        assert explained == pytest.approx(float(values[component - 2]) / (plain[0][1] * 0 + np.trace((fit.T @ fit / n).astype(float))), rel=0.05)


def test_one_vector_and_no_variance(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [
        (k, c, 1, 0, None, None, None) for k in (1, 2, 3) for c in (1, 2)
    ]
    flat = [(k, [float(k), 1.0, 2.0 * k]) for k in range(9)]  # one direction only
    got = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.component: r.explained for r in got} == {1: pytest.approx(1.0), 2: 0.0, 3: 0.0}
    assert all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-12


def test_equal_eigenvalues(spark):
    """Any orthogonal pair of the shared space is right."""
    rows = [(4 * k + s, [float(v) * (1 if s % 2 else -1) if j == k else 0.0 for j in range(3)]) for k, v in enumerate((2, 2, 1)) for s in range(2)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got[0].identity_error < 1e-12
    assert sorted({(r.component, round(r.explained, 6)) for r in got}) == [(1, round(4 / 9, 6)), (2, round(4 / 9, 6)), (3, round(1 / 9, 6))]


def test_wide_entries(spark):
    """Sums beyond 64 bits stay exact, and entries beyond them stop at the end."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(c) for c in rng.normal(size=3) * 1e16]) for k in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    kept, n, deviations, *_ = brute(rows)
    if all(abs(v) < 2**63 for _, x in kept for v in x):
        assert {r.vec_id: r.deviation_exact for r in got} == {vec_id: str(deviations[x]) for vec_id, x in kept}
    assert got[0].identity_error < 1e-9
    far = whitening.integer_rows(spark.createDataFrame([(1, [1e300, -1e300])], SCHEMA)).first()
    assert far.x == [2**63 - 1, -(2**63)]


def test_empty_and_extra_columns(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    rows = vectors(9, 20, d=3)
    names = ["x", "entries", "n", "parts", "place", "part", "deviation", "component", "whitened", "length", "dim", "low"]
    odd = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("clash").alias(name) for name in names))
    got = whitening.whiten(odd)
    assert got.columns == empty.columns
    plain = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("seed", range(4))
def test_scatter_by_planes(seed):
    rng = np.random.default_rng(seed)
    widths = rng.integers(0, 12, 7)
    rows = (rng.integers(0, 1 << 12, (rng.integers(1, 200), 7)) & ((1 << widths) - 1)).astype(np.uint64)
    limbs = 2 * int(widths.max()) // whitening.LIMB + 1
    products, sums = np.zeros((limbs, 7, 7), np.int64), np.zeros((limbs, 7), np.int64)
    whitening.add_products(products, sums, *whitening.planes(rows, widths))
    weight = 1 << (whitening.LIMB * np.arange(limbs))
    total = np.tensordot(weight, products, 1)
    both = total + total.T - np.diag(np.diag(total))
    assert (both == rows.astype(np.int64).T @ rows.astype(np.int64)).all()
    assert (weight @ sums == rows.sum(0).astype(np.int64)).all()
