"""Hot keys take another way to the same result."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.ordered import Previous, Rank, RowNumber, RunningSum, measured

MEASURES = [RowNumber("n"), RunningSum("running", "v"), Previous("before", "v")]


@pytest.fixture
def rows(spark):
    # Key 0 holds a third of all rows, half of them equal copies; key 1 has nulls.
    return spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"),
        F.when(F.col("id") % 2 == 0, 5).when(F.col("id") % 1001 == 0, None).otherwise(F.col("id") % 500).alias("v"),
        (F.col("id") % 40).alias("w"),
    )


def ordered(df):
    return sorted(map(tuple, df.select("k", "n", "v", "w", "running", "before").collect()), key=repr)


@pytest.mark.parametrize("hot_rows", [5_000, 200])
def test_hot_keys_give_the_plain_result(rows, hot_rows):
    # Copies are equal in every column, so any order among them is the same result.
    order = [F.desc("v"), F.col("w")]
    plain = measured(rows, ["k"], order, MEASURES, hot_rows=10**9)
    spread = measured(rows, ["k"], order, MEASURES, hot_rows=hot_rows)
    assert spread.dtypes == plain.dtypes
    assert ordered(spread) == ordered(plain)


def test_hot_rows_are_spread_over_ranges(rows, spark, monkeypatch):
    from ledgerlake.operators import ordered as module

    folders = []

    def remember(spark_, purpose):
        folders.append(real(spark_, purpose))
        return folders[-1]

    real = module.new_folder
    monkeypatch.setattr(module, "new_folder", remember)
    measured(rows, ["k"], [F.desc("v"), F.col("w")], MEASURES, hot_rows=5_000).count()
    placed = spark.read.parquet(next(f for f in folders if "ordered" in f))
    per_range = [r["count"] for r in placed.groupBy("k", "_range").count().collect()]
    assert sum(per_range) >= 10_000 and max(per_range) < sum(per_range) / 3


def test_several_keys_and_a_null_key(spark):
    rows = spark.range(4_000).select(
        F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id") % 3).alias("k"),
        (F.col("id") % 2).alias("w"),
        F.col("id").alias("v"),
    )
    order = [F.col("v")]
    plain = measured(rows, ["k", "w"], order, MEASURES, hot_rows=10**9)
    spread = measured(rows, ["k", "w"], order, MEASURES, hot_rows=500)
    assert ordered(spread) == ordered(plain)


def test_types_do_not_depend_on_hot_keys(spark):
    rows = spark.range(900).selectExpr("id % 2 AS k", "id AS v", "CAST(18446744073709551615 AS DECIMAL(20,0)) AS d")
    measures = [RowNumber("n"), RunningSum("total", "d"), Previous("before", "d")]
    plain = measured(rows, ["k"], [F.col("v")], measures, hot_rows=10**9)
    spread = measured(rows, ["k"], [F.col("v")], measures, hot_rows=100)
    assert plain.dtypes == spread.dtypes
    assert sorted(plain.collect()) == sorted(spread.collect())


@pytest.mark.parametrize("hot_rows", [5_000, 400])
@pytest.mark.parametrize("by", [("v",), ("v", "w")])
def test_rank_over_runs_that_cross_ranges(rows, hot_rows, by):
    """Half of the hot key's rows are one run of equal values, longer than several ranges; nulls are a run too."""
    order = [F.desc("v"), F.col("w")]
    measures = [RowNumber("n"), Rank("rank", by)]
    plain = measured(rows, ["k"], order, measures, hot_rows=10**9)
    spread = measured(rows, ["k"], order, measures, hot_rows=hot_rows)
    assert spread.dtypes == plain.dtypes

    def found(table):
        return sorted(map(tuple, table.select("k", "v", "w", "n", "rank").collect()), key=repr)

    assert found(spread) == found(plain)
    assert all(r[4] <= r[3] for r in found(spread))
