"""Whitening against a version in fractions and one dense product."""
import math
import random
from fractions import Fraction

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, x string, weight double, h long, key long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 0.5, 1, 2, 3) for k, v in rows], SCHEMA).repartition(3)


def vectors(dim=6):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + d) for d in range(dim)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a third of all rows hold one vector
    rows += [rows[7], rows[7], (None, rows[8][1]), (None, [0.25] * dim)]  # repeated rows, null ids
    rows += [(2000, None), (2001, [1.0] * (dim - 1) + [None]), (2002, [math.nan] * dim), (2003, [math.inf] + [0.0] * (dim - 1)), (2004, [1e38] * dim)]
    rows += [(2005, [0.5, 0.25]), (2006, [])]  # short ones
    return rows


def dense(rows, dim, weights="one"):
    xs = []
    for k, v in rows:
        if v is None or any(c is None or not math.isfinite(c) or abs(c) > 1e30 for c in v):
            continue
        v = [float(np.float32(c)) for c in v] + [0.0] * (dim - len(v))
        xs.append((k, tuple(math.floor(64 * c) + 1_000_000 for c in v)))
    fit = sorted({x for _, x in xs}) if weights == "one" else sorted(x for _, x in xs)
    n, s = len(fit), [sum(x[d] for x in fit) for d in range(dim)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s)] for x in fit])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for k, x in xs:
        d = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s)])
        out.append((k, sum((n * c - t) ** 2 for c, t in zip(x, s)), d @ v / np.sqrt(e)))
    return n, e / e.sum(), out


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitened_equals_dense(spark, weights):
    from logloom.llm.op12_whitening import whitened
    rows = vectors()
    n, explained, want = dense(rows, 6, weights)
    found = whitened(frame(spark, rows), components=16, weights=weights).collect()
    assert len(found) == len(want) and {r.n for r in found} == {n}
    assert max(r.identity_error for r in found) < 1e-9
    order = lambda k, dev, y: (k is None, k or 0, dev, tuple(np.round(np.abs(y), 6)))
    found.sort(key=lambda r: order(r.key, r.deviation, r.whitened))
    want.sort(key=lambda r: order(*r))
    sign = np.sign(np.array(found[0].whitened) * want[0][2])
    for r, (k, dev, y) in zip(found, want):
        assert (r.key, r.deviation) == (k, dev)
        assert np.allclose(np.array(r.whitened) * sign, y, atol=1e-8) and np.allclose(r.explained, explained, rtol=1e-9)


def test_query(spark, tmp_path):
    from logloom.llm.op12_whitening import op12_whitening
    frame(spark, vectors(20)).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = op12_whitening(spark, str(tmp_path)).collect()
    n, explained, want = dense(vectors(20), 20)
    assert len(rows) == 16 * len(want) and {r.component for r in rows} == set(range(1, 17))
    assert {r.n for r in rows} == {n} and all(abs(r.explained / explained[r.component - 1] - 1) < 1e-6 for r in rows)


def test_no_variance_and_empty(spark):
    from logloom.llm.op12_whitening import whitened
    assert whitened(frame(spark, [])).count() == 0
    assert whitened(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitened(frame(spark, [(i, [float(i), float(2 * i)]) for i in range(5)])).collect()  # one direction only
    assert len(line) == 5 and all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-9 for r in line)


def test_large_numbers():
    from logloom.llm.op12_whitening import centred, deviations
    rng = random.Random(3)
    x = np.array([[rng.randrange(1 << 61, 1 << 62) for _ in range(3)] for _ in range(9)], dtype=np.int64)
    sums = [sum(int(v) for v in x[:, d]) for d in range(3)]
    want = np.array([[float(Fraction(9 * int(v) - s, 9)) for v, s in zip(row, sums)] for row in x])
    assert np.allclose(centred(x, 9, sums), want, rtol=1e-12)
    assert deviations(x, 9, sums) == [None] * 9  # beyond 64 bits
    y = np.array([[10**9, 5], [10**9 + 3, 9]], dtype=np.int64)
    assert deviations(y, 2, [2 * 10**9 + 3, 14]) == [9 + 16, 9 + 16]
