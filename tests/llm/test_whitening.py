"""Whitening against Fractions and big integers, and its defined cases."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from marketlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, at int, total string"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in vectors], SCHEMA).repartition(parts)


def integers(vector):
    return [math.floor(Fraction(float(np.float32(c))) * 64) + 1_000_000 for c in vector]


def plain(vectors):
    """n, integer vectors, sums and the covariance as Fractions."""
    rows = [(i, integers(v)) for i, v in vectors]
    n, sums = len(rows), [sum(c) for c in zip(*(x for _, x in rows))]
    off = [[n * a - s for a, s in zip(x, sums)] for _, x in rows]
    size = len(sums)
    return n, rows, off, [[Fraction(sum(y[i] * y[j] for y in off), n**3) for j in range(size)] for i in range(size)]


def some(seed, rows, size, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread * (1 + k)) for k in range(size)]) for i in range(rows)]


def test_whitening_is_exact(spark):
    vectors = some(1, 120, 5)
    vectors += [(7, vectors[3][1]), (None, vectors[4][1])]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [1.0, float("nan"), 2.0, 3.0, 4.0]), (203, [1.0, float("inf"), 2.0, 3.0, 4.0]), (204, []), (205, [1.0] * 4)]
    found = whitening.digest(table(spark, vectors + bad)).collect()
    n, rows, off, covariance = plain(vectors)
    assert len(found) == 5 * n and {r.n for r in found} == {n}
    wanted = sorted((str(i), sum(a * a for a in y)) for (i, _), y in zip(rows, off))
    assert sorted((str(r.vec_id), r.deviation) for r in found if r.component == 1) == wanted
    assert all(str(r.deviation) == r.deviation_exact for r in found)
    exact = np.array([[float(c) for c in line] for line in covariance])
    values, vectors_of = np.linalg.eigh(exact)
    shares = {r.component: r.explained for r in found}
    assert [shares[k + 1] for k in range(5)] == pytest.approx((values[::-1] / np.trace(exact)).tolist(), rel=1e-9)
    w = {(str(r.vec_id), r.deviation, r.component): r.whitened for r in found}
    for (i, _), y in zip(rows, off):
        for k in range(5):
            projected = float(np.array([a / n for a in y]) @ vectors_of[:, 4 - k]) / math.sqrt(values[4 - k])
            assert abs(w[str(i), sum(a * a for a in y), k + 1]) == pytest.approx(abs(projected), rel=1e-8, abs=1e-10)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_whitening_does_not_depend_on_parts(spark):
    vectors = some(2, 200, 40, 1e-4)
    one, many = (whitening.fit(table(spark, vectors, p)) for p in (1, 7))
    assert one.centre == many.centre and np.array_equal(one.values, many.values) and len(one.values) == 32 and np.array_equal(one.vectors, many.vectors)


def test_products_of_large_integers():
    rng = random.Random(3)
    for bits in (5, 17, 18, 40, 61, 90):
        rows = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)]
        y = np.array(rows, np.int64 if bits < 62 else object)
        product = whitening.Product(3)
        product.add(y)
        product.add(y)
        assert product.fold().tolist() == [[2 * sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    x = np.array([[(1 << 62) - 1], [-(1 << 62)], [5]] * 9, np.int64)
    assert whitening.column_sums(x).tolist() == [sum(int(v) for v in x[:, 0])]
    big = whitening.Centre(1 << 40, [3, -5], [1, 2])
    assert big.centred(np.array([[1 << 40, -(1 << 50)]], np.int64)).tolist() == [[(1 << 80) - 3 * (1 << 40) - 1, -(1 << 90) + 5 * (1 << 40) - 2]]


def test_whitening_of_far_and_flat_vectors(spark):
    far = [(1, [1e30, 0.5]), (2, [-1e30, 1.5]), (3, [0.0, 99.0])]
    found = whitening.digest(table(spark, far)).collect()
    assert any(r.deviation is None and int(r.deviation_exact) >= 1 << 63 for r in found)
    assert whitening.digest(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.digest(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    line = whitening.digest(table(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)
    tied = whitening.fit(table(spark, [(i, [float(i)]) for i in range(3)] + [(i, [float(i), float(i * i)]) for i in range(3)]))
    assert tied.centre.n == 3 and len(tied.centre.quotients) == 2
