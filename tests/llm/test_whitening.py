import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm.whitening import LARGEST, Centre, polar, principal, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, vector string, n string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "y", "y", "y") for i, v in rows], schema).repartition(3)


def plain(rows, wanted=16):
    """{vec_id: deviation}, eigenvalues, trace, n, and whitened vectors by id up to the sign."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for i, v in good}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for i, v in x.items()}
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    white = {i: (v - s / n) @ u / np.sqrt(np.where(e > 0, e, 1)) for i, v in x.items()}
    return deviation, e, float(np.trace(centred.T @ centred / n)), n, white


@pytest.mark.parametrize("d,n", [(3, 40), (24, 300)])
def test_whitening(spark, d, n):
    rng = np.random.default_rng(d)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((n, d)) * rng.uniform(0.2, 3, d))]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 3)]  # copies count once
    rows += [(2000, None), (2001, [None] * d), (2002, [float("nan")] * d), (2003, [float("inf")] + [0.0] * (d - 1))]
    deviation, e, trace, fitted, white = plain(rows)
    got = whiten(frame(spark, rows)).collect()
    k = min(16, d)
    assert len(got) == len(deviation) * k
    assert {r.vec_id: r.deviation for r in got} == deviation
    assert {r.n for r in got} == {fitted}
    by_component = {c: {r.vec_id: r.whitened for r in got if r.component == c} for c in range(1, k + 1)}
    for c, column in by_component.items():
        want = {i: w[c - 1] for i, w in white.items()}
        sign = np.sign(sum(column[i] * want[i] for i in want))
        assert max(abs(column[i] - sign * want[i]) for i in want) < 1e-8
    assert all(abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9 for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_odd_tables(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector
    flat = [(i, [float(i), 5.0, 2.0 * i]) for i in range(9)] + [(None, [1.0, 5.0, 2.0]), (5, [1.0, 5.0, 2.0])]
    got = whiten(frame(spark, flat)).collect()  # they vary in one direction only
    assert len(got) == 11 and {r.component for r in got} == {1}
    mixed = [(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [3.0, 1.0]), (5, []), (6, [0.0, 5.0])]
    assert {r.vec_id for r in whiten(frame(spark, mixed)).collect()} == {3, 4, 6}


def test_huge_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [1.0, 2.0]), (3, [-1e30, 7.0])]
    got = {r.vec_id: r for r in whiten(frame(spark, rows)).collect()}
    assert len(got) == 3 and got[1].deviation is None  # it is beyond a long
    centre = Centre(2, [int(LARGEST), 3])
    assert centre.deviation(np.array([[0, 1], [int(LARGEST), 1]])) == [None, None]
    assert Centre(3, [10, 5]).deviation(np.array([[4, 1]])) == [(12 - 10) ** 2 + (3 - 5) ** 2]


def test_every_dimension_type(spark):
    rows = [(i, [float(i % 3), float(i % 5)]) for i in range(15)]
    df = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert whiten(df, components=1).count() == 15


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_spectral_divide_and_conquer(d):
    rng = np.random.default_rng(d)
    for values in (rng.uniform(50, 51, d), np.exp(rng.uniform(-12, 5, d)), np.arange(d) + 1.0, np.ones(d),
                   np.repeat([3.0, 2.0], d)[:d]):
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        a = (q * values) @ q.T
        e, v = principal((a + a.T) / 2, 16)
        assert np.allclose(e, np.sort(values)[::-1][:16], rtol=1e-11)
        assert np.abs(a @ v.T - v.T * e).max() < 1e-13 * values.max() * d
        assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-13 * d


def test_polar():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 30))
    u = polar(a + a.T)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-12 and np.linalg.eigvalsh(u @ (a + a.T)).min() > 0
    assert polar(np.zeros((3, 3))) is None and polar(np.diag([1.0, 0.0])) is None
