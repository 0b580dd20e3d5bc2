"""Whitening of embeddings by an exact characteristic polynomial.

Vectors become integers, so their scatter n * sum(x x') - S S', n squared times the covariance, is an integer matrix and
is summed exactly. Its characteristic polynomial is worked out modulo many primes, each by reduction to Hessenberg form,
one prime a row of a Spark job, and put together by Chinese remainders. All its roots are real, so the signs of the
polynomial shifted to a point count the roots above that point, with their multiplicities: bisection isolates the k-th
largest root and goes on to 2^-PRECISION. Its components are the null space of the scatter less the root, by inverse
iteration with as many bits; each component is a row of a second Spark job. The driver holds a matrix and the
polynomial: their sizes depend on the width of the vectors, not on their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import comb, isqrt, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlake.llm.common import stored

SCALE, COMPONENTS = 64, 32
#: Bits after the point of roots and components; roots that agree in all of them count as one multiple root.
PRECISION = 256
#: Entries from here on do not fit a bigint when scaled.
LARGEST = 2.0**56
ROWS_AT_ONCE = 4096
_LIMB = 60
_EXACT, _LONG = 1 << 53, 1 << 63
#: Primes are below this, so that a product of two residues and one more fit a signed 64-bit number.
_PRIMES_BELOW = 1 << 31
RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): floor(64 c) of the rows whose vector is there and has no null, NaN, infinite or too large an entry."""
    vector = F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    rows = embeddings.where("embedding IS NOT NULL").where(~odd)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(vector, lambda c: F.floor(c * SCALE)).alias("x"))


def matrix_of(vectors: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows of a matrix; missing entries at the end count as zero."""
    out = np.zeros((len(vectors), width), np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    out[np.arange(width)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


@dataclass
class Sums:
    """What the fit list is known by: number of vectors, their width, largest entry, sums, and sums of products."""

    n: int
    width: int
    largest: int
    first: np.ndarray
    second: np.ndarray

    def scatter(self) -> np.ndarray:
        return self.n * self.second - np.outer(self.first, self.first)


def sums_of(rows: DataFrame) -> Sums:
    """Exact sums of rows(x). A task adds its rows up; what leaves it has at most (width + 1) squared numbers, in limbs of 60 bits."""
    entry = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(entry).alias("largest")).first()
    n, width, largest = size.n, size.width or 0, size.largest or 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), object)
        exact = largest * largest < _EXACT
        step = max(1, min(ROWS_AT_ONCE, _EXACT // max(1, largest * largest)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                x = matrix_of(batch.column(0).slice(begin, step), width)
                x = np.column_stack([np.ones(len(x), np.int64), x])
                if exact:
                    x = x.astype(float)
                    total += (x.T @ x).astype(np.int64).astype(object)
                else:
                    x = x.astype(object)
                    total += x.T @ x
        i, j = np.triu_indices(width + 1)
        found = []
        for row, column in zip(i.tolist(), j.tolist()):
            value, sign, limb = abs(total[row, column]), 1 if total[row, column] > 0 else -1, 0
            while value:
                found.append((row, column, limb, sign * (value & (1 << _LIMB) - 1)))
                value, limb = value >> _LIMB, limb + 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    kind = "i int, j int, limb int, value bigint"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    parts = rows.select("x").mapInArrow(add, kind)
    total = np.zeros((width + 1, width + 1), object)
    for r in parts.groupBy("i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        total[r.i, r.j] += int(r.value) << _LIMB * r.limb
    second = total[1:, 1:]
    return Sums(n, width, largest, total[0, 1:], second + np.triu(second, 1).T)


def primes_below(limit: int, bits: float) -> list[int]:
    """The largest primes below limit whose product has more than so many bits."""

    def is_prime(p: int) -> bool:
        """Miller and Rabin's test, exact below 2^64 with these bases."""
        if any(p % q == 0 for q in (3, 5, 7, 11, 13)):
            return False
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
            x = pow(base, odd, p)
            if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
                return False
        return True

    found, candidate = [], limit | 1
    while bits >= 0:
        candidate -= 2
        if is_prime(candidate):
            found.append(candidate)
            bits -= log2(candidate)
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(t - matrix) modulo the prime p < 2^31."""
    a = (matrix % p).astype(np.int64)
    d = len(a)
    for k in range(1, d - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        if below[0]:
            swap = [k, k + int(below[0])]
            a[swap] = a[swap[::-1]]
            a[:, swap] = a[:, swap[::-1]]
        factors = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - factors[:, None] * a[k][None, :]) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * factors[None, :] % p).sum(1)) % p
    steps = [np.ones(1, np.int64)]
    for k in range(d):
        new = np.zeros(k + 2, np.int64)
        new[1:] = steps[k]
        new[:-1] = (new[:-1] - a[k, k] * steps[k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(a[i + 1, i]) % p
            if not chain:
                break
            factor = int(a[i, k]) * chain % p
            new[: i + 1] = (new[: i + 1] - factor * steps[i]) % p
        steps.append(new)
    return steps[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients, constant first, of det(t - matrix) of a positive semidefinite integer matrix; one prime a row of a job.

    No coefficient is larger than the power of d of (1 + trace / d), d being the width.
    """
    d = len(matrix)
    trace = sum(int(matrix[k, k]) for k in range(d))
    bits = d * (log2(d + trace) - log2(d)) * (1 + 1e-9) + 2
    primes = primes_below(_PRIMES_BELOW, bits)
    shared = spark.sparkContext.broadcast((matrix, primes))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, primes = shared.value
        for batch in batches:
            for k in batch["id"]:
                yield pd.DataFrame({"prime": [primes[k]], "residues": [polynomial_modulo(matrix, primes[k])]})

    jobs = spark.range(0, len(primes), 1, min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    found = jobs.mapInPandas(reduce, "prime bigint, residues array<bigint>").collect()
    product = 1
    for r in found:
        product *= r.prime
    out = [0] * (d + 1)
    for r in found:
        rest = product // r.prime
        weight = rest * pow(rest, -1, r.prime)
        for k, residue in enumerate(r.residues):
            out[k] += weight * residue
    out = [c % product for c in out]
    return [c - product if 2 * c > product else c for c in out]


def roots_above(polynomial: list[int], point: int, bits: int) -> int:
    """How many roots of a polynomial without complex ones lie above point / 2^bits > 0, counted as often as they come.

    These are the changes of sign (Descartes) of the polynomial in point / 2^bits * (t + 1).
    """
    d = len(polynomial) - 1
    row = [c * point**k << bits * (d - k) for k, c in enumerate(polynomial)]
    shifted = []
    for _ in range(d + 1):
        *row, last = accumulate(reversed(row))
        row.reverse()
        shifted.append(last)
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(polynomial: list[int], point: int, bits: int) -> int:
    value, scale = 0, 0
    for c in reversed(polynomial):
        value = value * point + (c << scale)
        scale += bits
    return (value > 0) - (value < 0)


@dataclass(frozen=True)
class Root:
    """A root times 2^PRECISION, rounded up; how often it comes, and the number of roots above it."""

    value: int
    times: int
    above: int


def isolated_root(polynomial: list[int], k: int, precision: int = PRECISION) -> Root:
    """The k-th largest root, from 1, of a polynomial whose roots are all real and not negative; it must not be zero."""
    low, high, bits = 0, 1 << abs(polynomial[-2]).bit_length(), 0
    at_low, at_high = len(polynomial) - 1 - next(n for n, c in enumerate(polynomial) if c), 0
    side = 0
    while high - low > 1 or bits < precision:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        if at_low - at_high == 1:
            side = side or _sign(polynomial, high, bits)
            here = _sign(polynomial, middle, bits)
            if not side or not here:
                exact = high if not side else middle
                return Root(exact << precision - bits, 1, at_high)
            low, high = (low, middle) if here == side else (middle, high)
        elif (above := roots_above(polynomial, middle, bits)) >= k:
            low, at_low = middle, above
        else:
            high, at_high = middle, above
    return Root(high, at_low - at_high, at_high)


def null_space(matrix: np.ndarray, root: Root, precision: int = PRECISION) -> np.ndarray:
    """Orthonormal rows, as doubles, that span the null space of matrix less root, by inverse iteration in whole numbers."""
    d, one = len(matrix), 1 << precision
    a = matrix * one
    a[np.diag_indices(d)] -= root.value
    order = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1
        a[k + 1 :, k] = a[k + 1 :, k] * one // a[k, k]
        a[k + 1 :, k + 1 :] -= a[k + 1 :, k][:, None] * a[k, k + 1 :][None, :] >> precision

    def solved(x: np.ndarray) -> np.ndarray:
        x = x[order]
        for k in range(d):
            x[k + 1 :] -= a[k + 1 :, k] * x[k] >> precision
        for k in range(d - 1, -1, -1):
            x[k] = x[k] * one // a[k, k]
            x[:k] -= a[:k, k] * x[k] >> precision
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        return x * one // max(1, isqrt(int((x * x).sum())))

    rng = np.random.default_rng(0)
    found = [np.array([int(v) for v in rng.integers(-(2**40), 2**40, d)], object) * one for _ in range(root.times)]
    for _ in range(3):
        basis: list[np.ndarray] = []
        for x in found:
            x = unit(solved(x))
            for _ in range(2):
                for q in basis:
                    x = x - (q * (int((x * q).sum()) >> precision) >> precision)
                x = unit(x)
            basis.append(x)
        found = basis
    return np.array([[float(v) / float(one) for v in x] for x in found])


@dataclass
class Whitening:
    """Sums of the fit list, and its components: unit vectors as rows, and eigenvalues of the covariance."""

    sums: Sums
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S of integer rows, exact: as int64 where all fits, else as Python integers."""
        if 2 * self.sums.n * self.sums.largest < _LONG:
            return self.sums.n * x - self.sums.first.astype(np.int64)[None, :]
        return self.sums.n * x.astype(object) - self.sums.first[None, :]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Divided as doubles: a quotient of Python integers is rounded once."""
        return (centred / self.sums.n).astype(float) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, centred: np.ndarray) -> pa.Array:
        """Null where the sum of squares does not fit a bigint."""
        most = 2 * self.sums.n * self.sums.largest
        if self.sums.width * most * most < _LONG:
            return pa.array((centred * centred).sum(1))
        exact = (centred.astype(object) ** 2).sum(1)
        return pa.array([int(v) if v < _LONG else None for v in exact], pa.int64())


def fit(spark: SparkSession, sums: Sums, components: int = COMPONENTS) -> Whitening:
    """The components of largest eigenvalue, at most so many; eigenvalues that are exactly zero have none."""
    matrix = sums.scatter()
    trace = sum(int(matrix[k, k]) for k in range(sums.width))
    if not trace:
        return Whitening(sums, np.zeros((0, sums.width)), np.zeros(0), np.zeros(0))
    polynomial = characteristic_polynomial(spark, matrix)
    zeros = next(k for k, c in enumerate(polynomial) if c)
    count = min(components, sums.width - zeros)
    shared = spark.sparkContext.broadcast((matrix, polynomial))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, polynomial = shared.value
        for batch in batches:
            for k in batch["id"].tolist():
                root = isolated_root(polynomial, k)
                vector = null_space(matrix, root)[k - root.above - 1]
                vector = vector * np.sign(vector[np.abs(vector).argmax()])
                yield pd.DataFrame({"component": [k], "root": [str(root.value)], "vector": [vector]})

    jobs = spark.range(1, count + 1, 1, count).mapInPandas(solve, "component int, root string, vector array<double>")
    found = sorted(jobs.collect(), key=lambda r: r.component)
    one = 1 << PRECISION
    values = np.array([int(r.root) / (one * sums.n * sums.n) for r in found])
    return Whitening(sums, np.array([r.vector for r in found]), values, np.array([int(r.root) / (one * trace) for r in found]))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, taken positive, of the covariance of the whitened rows less the identity."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, np.zeros((k + 1, k + 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = matrix_of(batch.column(0).slice(begin, ROWS_AT_ONCE), model.sums.width)
                w = np.column_stack([np.ones(len(x)), model.whitened(model.centred(x))])
                total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.reshape(-1))], names=["i", "j", "value"])

    parts = rows.select("x").mapInArrow(add, "i int, j int, value double")
    total = np.zeros((k + 1, k + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        total[r.i, r.j] = r.value
    mean = total[0, 1:] / model.sums.n
    return float(np.abs(total[1:, 1:] / model.sums.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and each component.

    Rows whose vector is null or holds null, non-finite or too large (2^56) entries are left out. A null vec_id takes part; repeated rows
    count and come as often as they are there. Missing entries of shorter vectors count as zero. A direction without any
    variance (one vector, or all alike) is no component; without components there are no rows. Equal eigenvalues share
    their null space, of which any orthonormal basis will do. A deviation that does not fit a bigint is null. Extra
    columns are not read.
    """
    spark = embeddings.sparkSession
    rows = stored(whole_vectors(embeddings), "whole-vectors")
    model = fit(spark, sums_of(rows), components)
    count = len(model.values)
    if not count:
        return spark.createDataFrame([], RESULT)
    error = identity_error(rows, model)
    shared = spark.sparkContext.broadcast(model)
    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                ids, vectors = (c.slice(begin, ROWS_AT_ONCE) for c in batch.columns)
                centred = model.centred(matrix_of(vectors, model.sums.width))
                which = np.repeat(np.arange(len(ids)), count)
                size = len(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(which)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(ids))),
                        pa.array(np.full(size, model.sums.n)),
                        model.deviation(centred).take(pa.array(which)),
                        pa.array(model.whitened(centred).reshape(-1)),
                        pa.array(np.tile(model.explained, len(ids))),
                        pa.array(np.full(size, error)),
                    ],
                    schema=schema,
                )

    return rows.mapInArrow(run, RESULT)


def op13_whitening(embeddings: DataFrame) -> DataFrame:
    """The contract's columns. Its x is ours plus 1000000, which changes neither deviations nor covariances."""
    return whiten(embeddings)
