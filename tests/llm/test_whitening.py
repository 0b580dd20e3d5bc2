"""Whitening against exact fractions and NumPy's own eigenvectors; the polynomial, roots and null spaces on their own."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from ledgerlake.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<double>, x string, component int, n string"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, "x", 1, "n") for k, v in enumerate(vectors)], SCHEMA)


def whole(v):
    return [math.floor(64 * c) for c in v]


def polynomial_of_roots(roots):
    out = [1]
    for r in roots:
        out = [(out[k - 1] if k else 0) - r * (out[k] if k < len(out) else 0) for k in range(len(out) + 1)]
    return out


def gram(rng, d, rank, size):
    a = np.array([[rng.randrange(-size, size) for _ in range(d)] for _ in range(rank)], object)
    return a.T @ a


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (5, 3), (9, 9), (12, 4)])
def test_the_polynomial_has_the_matrix_as_root(spark, d, rank):
    """Cayley and Hamilton: the polynomial of a matrix, at the matrix, is zero; its second coefficient is the trace."""
    matrix = gram(random.Random(d), d, rank, 10**6)
    found = whitening.characteristic_polynomial(spark, matrix)
    total = np.zeros((d, d), object)
    for c in reversed(found):
        total = total @ matrix + c * np.eye(d, dtype=int).astype(object)
    assert not total.any() and found[-1] == 1 and found[-2] == -sum(matrix[k, k] for k in range(d))
    assert next(k for k, c in enumerate(found) if c) == d - rank


def test_primes():
    found = whitening.primes_below(1 << 31, 200)
    assert found[0] == 2**31 - 1 and math.prod(found) > 1 << 200
    assert all(all(p % q for q in range(2, 46342)) for p in found[:2])


def test_roots_with_multiplicities():
    roots = [1, 1, 5, 7, 7, 7, 10**12, 10**12 + 1]
    p = polynomial_of_roots(roots)
    assert whitening.roots_above(p, 6, 0) == 5 and whitening.roots_above(p, 7, 0) == 2 and whitening.roots_above(p, 13, 1) == 5
    falling = sorted(roots, reverse=True)
    for k in range(1, 9):
        root = whitening.isolated_root(p, k, 64)
        assert abs(Fraction(root.value, 1 << 64) - falling[k - 1]) <= Fraction(1, 1 << 64)
        assert root.times == roots.count(falling[k - 1]) and root.above == sum(r > falling[k - 1] for r in roots)


def test_null_space_of_a_multiple_root():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    matrix = np.array([[9 if i == j else 0 for j in range(6)] for i in range(6)], object)
    matrix[0, 0], matrix[1, 0], matrix[0, 1] = 11, 2, 2
    values = np.linalg.eigvalsh(matrix.astype(float))
    assert np.isclose(values[:5].max(), 9)
    basis = whitening.null_space(matrix, whitening.Root(9 << 256, 4, 1))
    assert np.abs(basis @ basis.T - np.eye(4)).max() < 1e-15
    assert np.abs(matrix.astype(float) @ basis.T - 9 * basis.T).max() < 1e-13


def check(found, vectors, components=32):
    x = [whole(v) for v in vectors]
    n, width = len(x), max(map(len, x))
    x = np.array([v + [0] * (width - len(v)) for v in x], object)
    sums = x.sum(0)
    centred = n * x - sums
    deviations = [int(v) for v in (centred**2).sum(1)]
    c = (centred / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > values[0] * 1e-9).sum())
    count = min(components, rank)
    assert len(found) == n * count and {r.component for r in found} == set(range(1, count + 1))
    by_component = {}
    for r in found:
        by_component.setdefault(r.component, []).append(r)
    w = np.zeros((n, count))
    for k, rows in by_component.items():
        assert sorted(r.deviation for r in rows) == sorted(deviations)
        assert len({r.explained for r in rows}) == 1 and math.isclose(rows[0].explained, values[k - 1] / values.sum(), rel_tol=1e-9)
        for r in rows:
            w[r.vec_id, k - 1] = r.whitened
    assert np.abs(w.T @ w / n - np.eye(count)).max() <= found[0].identity_error + 1e-12 and found[0].identity_error < 1e-9
    wanted = c @ vectors[:, :count] / np.sqrt(values[:count])
    apart = [k for k in range(count) if all(abs(values[k] - v) > 1e-6 * values[0] for j, v in enumerate(values) if j != k)]
    signs = np.sign((wanted * w).sum(0))
    assert np.abs(wanted * signs - w)[:, apart].max(initial=0) < 1e-7


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(60, 7)) * [5, 3, 3, 1, 1, 0.5, 0.2]).tolist()
    check(whitening.op13_whitening(table(spark, vectors)).collect(), vectors)


def test_more_than_32_dimensions_and_ties(spark):
    vectors = np.concatenate([np.eye(40) * 4, -np.eye(40) * 4, np.eye(40) * 4]).tolist()
    check(whitening.op13_whitening(table(spark, vectors)).collect(), vectors)


def test_ranks_below_the_width(spark):
    vectors = [[float(k), 2.0 * k, 0.0, 5.0] for k in range(10)] * 3
    check(whitening.op13_whitening(table(spark, vectors)).collect(), vectors)


def test_odd_rows(spark):
    good = [[1.0, 2.5], [3.0, -1.0], [0.25], [1.0, 2.5], [7.0, 0.0]]
    odd = [None, [None, 1.0], [float("nan"), 0.0], [float("inf"), 0.0], [1e300, 1.0]]
    found = whitening.op13_whitening(table(spark, good + odd)).collect()
    check(found, good)
    again = spark.createDataFrame([(None, v, "x", 1, "n") for v in good], SCHEMA)
    assert sorted(round(r.whitened, 9) for r in whitening.op13_whitening(again).collect()) == sorted(round(r.whitened, 9) for r in found)
    for none in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None], [[]]):
        assert whitening.op13_whitening(table(spark, none)).count() == 0


def test_large_entries_stay_exact(spark):
    """Entries beyond 2^26 give products beyond 2^53; deviations beyond a bigint are null."""
    vectors = [[2.0**40 + k, 3.0 * k] for k in range(6)]
    rows = whitening.whole_vectors(table(spark, vectors))
    sums = whitening.sums_of(rows)
    x = np.array([whole(v) for v in vectors], object)
    assert (sums.second == x.T @ x).all() and (sums.first == x.sum(0)).all()
    check(whitening.op13_whitening(table(spark, vectors)).collect(), vectors)
    far = [[2.0**50], [0.0], [1.0]]
    assert {r.deviation for r in whitening.op13_whitening(table(spark, far)).collect()} == {None}


def test_the_given_embeddings(spark):
    folder = "/root/testdata/sf0.001"
    found = queries.QUERIES["op13_whitening"](spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    check(found, [[float(c) for c in r.embedding] for r in rows])
