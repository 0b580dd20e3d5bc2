"""Exact top-k inner products by pivot-table elimination.

Vectors get one more coordinate that gives all the same length, so that the largest inner product is the smallest
distance. The index stores each vector with its distances to PIVOTS vectors. For a query, the largest difference
of the two distances to any pivot is a lower bound of the distance, hence an upper bound of the score; candidates
are scored in the order of their bounds until no bound reaches the k-th best score. The pivots' own scores give
the first threshold. Queries come in blocks of a fixed size against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.common import stored

K, EVERY, PIVOTS, SCALE = 5, 50, 32, 256
#: Queries of one block at most about this many; they are sent to all tasks.
BLOCK = 4096
#: Candidates scored at once, in the order of their bounds.
STEP = 256
_AT_ONCE = 1 << 21
_EXACT = 1 << 53


def whole(vectors: pd.Series, width: int) -> np.ndarray:
    """floor(256 x) of vectors as doubles, missing components zero."""
    rows = np.zeros((len(vectors), width))
    for row, vector in zip(rows, vectors):
        row[: len(vector)] = vector
    return np.floor(SCALE * rows)


def usable(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, embedding) as doubles: rows with an id and a vector without null, NaN or infinity; row numbers them."""
    vector = F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~odd)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("embedding"))


def _square() -> Column:
    def add(total: Column, x: Column) -> Column:
        return total + F.pow(F.floor(x * SCALE).cast("double"), 2)

    return F.aggregate("embedding", F.lit(0.0), add)


def _dot(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows of integers: as doubles where every sum fits, else as Python integers."""
    if exact:
        return a @ b.T
    return np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T


class _Space:
    """The common sphere: its squared radius, and the pivots on it."""

    def __init__(self, square: float, width: int, pivots: np.ndarray):
        self.square, self.width, self.pivots = square, width, pivots
        self.exact = square < _EXACT
        self.lift = self._lift(pivots)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        gap = 2 * self.square - 2 * (x @ self.pivots.T) - 2 * np.outer(self._lift(x), self.lift)
        return np.sqrt(np.maximum(gap, 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        gap = (q * q).sum(1)[:, None] + self.square - 2 * (q @ self.pivots.T)
        return np.sqrt(np.maximum(gap, 0))

    def most(self, q: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Largest scores possible at distances of at least low, with room for rounding."""
        low = np.maximum(low - 1e-6 * np.sqrt(self.square + 1), 0)
        return ((q * q).sum(1)[:, None] + self.square - low * low) / 2 * (1 + 1e-9) + 1


def _block(index: DataFrame, space: _Space, query_rows: np.ndarray, queries: np.ndarray, pivot_rows: np.ndarray, k: int) -> DataFrame:
    """(query, row, vec_id, score): the k best of each task for each query of a block; query and row are row numbers."""
    at_pivots = space.of_queries(queries)
    first = np.full(len(queries), -np.inf)
    known = _dot(queries, space.pivots, space.exact)
    for n, own in enumerate(query_rows):
        others = sorted((s for s, p in zip(known[n], pivot_rows) if p != own), reverse=True)
        if len(others) >= k:
            first[n] = others[k - 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple]] = [[] for _ in query_rows]
        for batch in batches:
            ids, numbers = batch["vec_id"].to_numpy(np.int64), batch["row"].to_numpy(np.int64)
            rows = np.array(batch["vector"].tolist(), float).reshape(len(ids), space.width)
            away = np.array(batch["away"].tolist(), float).reshape(len(ids), -1)
            part = max(1, _AT_ONCE // max(1, len(ids)))
            for begin in range(0, len(queries), part):
                mine = slice(begin, begin + part)
                low = np.zeros((len(queries[mine]), len(ids)))
                for p in range(away.shape[1]):
                    np.maximum(low, np.abs(at_pivots[mine, p][:, None] - away[:, p][None, :]), out=low)
                most = space.most(queries[mine], low)
                for n in range(begin, begin + len(low)):
                    bound = most[n - begin]
                    floor = max(first[n], -best[n][k - 1][0] if len(best[n]) >= k else -np.inf)
                    order = np.flatnonzero((bound >= floor) & (numbers != query_rows[n]))
                    order = order[np.argsort(-bound[order], kind="stable")]
                    for at in range(0, len(order), STEP):
                        some = order[at : at + STEP]
                        floor = max(first[n], -best[n][k - 1][0] if len(best[n]) >= k else -np.inf)
                        if bound[some[0]] < floor:
                            break
                        scores = _dot(queries[n : n + 1], rows[some], space.exact)[0]
                        near = [m for m in range(len(some)) if scores[m] >= floor] if floor > -np.inf else range(len(some))
                        found = [(-int(scores[m]), int(ids[some[m]]), int(numbers[some[m]])) for m in near]
                        best[n] = sorted(best[n] + found)[:k]
        out = [(int(q), row, vec, -score) for q, list_ in zip(query_rows, best) for score, vec, row in list_]
        yield pd.DataFrame(out, columns=["query", "row", "vec_id", "score"]).astype("int64")

    return index.mapInPandas(run, "query bigint, row bigint, vec_id bigint, score bigint")


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every` its k best other rows, ties to smaller ids.

    Rows that repeat an id are rows of their own, as queries and as candidates. Rows left out: see usable. Vectors of different widths are compared as if the missing components were zero.
    Scores must fit a bigint. No rows give no rows; a query without other rows has none.
    """
    rows = stored(usable(embeddings), "vectors")
    size = rows.agg(F.max(_square()).alias("square"), F.max(F.size("embedding")).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not size.queries:
        return embeddings.sparkSession.createDataFrame([], result)
    width = max(size.width, 1)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toPandas()
    space = _Space(size.square * (1 + 1e-12), width, whole(chosen["embedding"], width))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = whole(batch["embedding"], width)
            yield pd.DataFrame({"row": batch["row"], "vec_id": batch["vec_id"], "vector": list(x), "away": list(space.of_rows(x))})

    index = stored(rows.mapInPandas(measure, "row bigint, vec_id bigint, vector array<double>, away array<double>"), "pivot-index")
    blocks = -(-size.queries // block)
    found = []
    for n in range(blocks):
        mine = index.where((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == n)).toPandas()
        if len(mine):
            queries = np.array(mine["vector"].tolist(), float).reshape(len(mine), width)
            found.append(stored(_block(index, space, mine["row"].to_numpy(), queries, chosen["row"].to_numpy(), k), "block-best"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    names = index.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")


def op7_pivots(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings)


ORACLE = """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row AND c.vec_id IS NOT NULL
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
