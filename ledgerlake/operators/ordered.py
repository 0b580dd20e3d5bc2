"""Row number, rank, running sum and previous value per key, also when one key holds very many rows.

A plain window sorts all rows of a key in one task. Here keys with more than
`hot_rows` rows are found first; their rows are range-partitioned by key and
order over many tasks, numbered inside each range, and moved on by what the
earlier ranges of the same key hold. All other keys take the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.plans.scratch import new_folder

HOT_ROWS = 4_000_000
RANGES_PER_HOT_ROWS = 4
#: So many hot keys are broadcast at most; more are joined as the optimiser decides.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class RowNumber:
    name: str


@dataclass(frozen=True)
class RunningSum:
    name: str
    of: str


@dataclass(frozen=True)
class Previous:
    name: str
    of: str


@dataclass(frozen=True)
class Rank:
    """Place of the first row with the same values in `by`, the first columns of the order."""

    name: str
    by: tuple[str, ...]


Measure = RowNumber | RunningSum | Previous | Rank


def _plain(measure: Measure, keys: Sequence[str], order: Sequence[Column]) -> Column:
    window = W.partitionBy(*keys).orderBy(*order)
    match measure:
        case RowNumber():
            return F.row_number().over(window).cast("bigint")
        case Rank(_, by):
            return F.rank().over(W.partitionBy(*keys).orderBy(*order[: len(by)])).cast("bigint")
        case RunningSum(_, of):
            return F.sum(of).over(window.rowsBetween(W.unboundedPreceding, W.currentRow))
        case Previous(_, of):
            return F.lag(of).over(window)


def _with_plain(rows: DataFrame, measures: Sequence[Measure], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.select("*", *[_plain(m, keys, order).alias(m.name) for m in measures])


def _apart(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with their keys renamed, to be joined on them."""
    return rows.withColumnsRenamed({k: f"_of_{k}" for k in keys})


def _same(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])


def _carried(measure: Measure, ranges: WindowSpec) -> Column:
    """What the earlier ranges of a key hand to a range."""
    before = ranges.rowsBetween(W.unboundedPreceding, -1)
    match measure:
        case RowNumber():
            return F.sum("_rows").over(before)
        case RunningSum(name, _):
            return F.sum(f"_{name}").over(before)
        case Previous(name, _):
            return F.lag(f"_{name}").over(ranges)
        case Rank(name, _):
            # Where the last run of the range before begins, if this range goes on with that run.
            goes_on = F.lag(f"_last_{name}").over(ranges).eqNullSafe(F.col(f"_first_{name}"))
            return F.when(goes_on, F.last(f"_begins_{name}", ignorenulls=True).over(before))


def _summed(measure: Measure) -> list[Column]:
    """What a range tells of a key besides its number of rows."""
    match measure:
        case RowNumber():
            return []
        case RunningSum(name, of):
            return [F.sum(of).alias(f"_{name}")]
        case Previous(name, of):
            return [F.max_by(of, "_place").alias(f"_{name}")]
        case Rank(name, by):
            values = F.struct(*by)
            return [
                F.min_by(values, "_place").alias(f"_first_{name}"),
                F.max_by(values, "_place").alias(f"_last_{name}"),
                F.max_by(name, "_place").alias(f"_begins_{name}"),
            ]


def _begun(ranges: DataFrame, measure: Rank, in_turn: WindowSpec) -> DataFrame:
    """The place in its key, not in its range, where a range's last run begins; null if that is in an earlier range."""
    name = measure.name
    first, last = F.col(f"_first_{name}"), F.col(f"_last_{name}")
    one_run_from_before = F.lag(last).over(in_turn).eqNullSafe(first) & first.eqNullSafe(last)
    earlier = F.coalesce(F.sum("_rows").over(in_turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    has_before = F.row_number().over(in_turn) > 1
    begins = F.when(~(has_before & one_run_from_before), earlier + F.col(f"_begins_{name}"))
    return ranges.withColumn(f"_begins_{name}", begins)


def _moved(measure: Measure) -> Column:
    """A measure of one range, moved on by what was carried to it."""
    own, carried = F.col(measure.name), F.col(f"_carried_{measure.name}")
    match measure:
        case RowNumber():
            return own + F.coalesce(carried, F.lit(0))
        case Rank():
            earlier = F.coalesce(F.col("_carried_rows"), F.lit(0))
            return F.when((own == 1) & carried.isNotNull(), carried).otherwise(own + earlier)
        case RunningSum():
            return F.when(carried.isNull(), own).when(own.isNull(), carried).otherwise(own + carried)
        case Previous():
            return F.when(F.col("_first"), carried).otherwise(own)


def _hot(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], measures: Sequence[Measure], ranges: int
) -> DataFrame:
    spark = rows.sparkSession
    folder = new_folder(spark, "ordered")
    # The row id parts equal rows, so that copies can fall into several ranges.
    (
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *keys, *order, "_tie")
        .sortWithinPartitions(*keys, *order, "_tie")
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_tie")
        .write.parquet(folder)
    )
    # Read from the table: the ranges are fixed there.
    placed = spark.read.parquet(folder)
    in_turn = W.partitionBy(*keys).orderBy("_range")
    inside = ["_range", *keys]
    places = [F.col("_place")]
    ranks = [m for m in measures if isinstance(m, Rank)]
    others = [m for m in measures if not isinstance(m, Rank)]
    numbered = _with_plain(_with_plain(placed, others, inside, places), ranks, inside, order)
    numbered = numbered.withColumn("_first", F.row_number().over(W.partitionBy(*inside).orderBy(*places)) == 1)
    told = (numbered if ranks else placed).groupBy(*inside).agg(F.count("*").alias("_rows"), *[c for m in measures for c in _summed(m)])
    for rank in ranks:
        told = _begun(told, rank, in_turn)
    earlier = F.sum("_rows").over(in_turn.rowsBetween(W.unboundedPreceding, -1)).alias("_carried_rows")
    carried = told.select(*inside, earlier, *[_carried(m, in_turn).alias(f"_carried_{m.name}") for m in measures])
    # One row per range and hot key in it. Their number grows with the rows, so
    # nothing is said about a broadcast; a range holds few rows for one task.
    joined = numbered.join(_apart(carried, inside), _same(inside), "left")
    return joined.select(*rows.columns, *[_moved(m).alias(m.name) for m in measures])


def measured(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    measures: Sequence[Measure],
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows with each measure over (partition by keys order by order), in the types of a plain window."""
    folder = new_folder(rows.sparkSession, "hot-keys")
    rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows).write.parquet(folder)
    found = rows.sparkSession.read.parquet(folder)
    hot_total, hot_count = found.agg(F.sum("_rows"), F.count("*")).first()
    plain = _with_plain(rows, measures, keys, order)
    if not hot_total:
        return plain
    ranges = -(-hot_total * RANGES_PER_HOT_ROWS // hot_rows)
    hot_keys = _apart(found.drop("_rows"), keys)
    if hot_count <= BROADCAST_KEYS:
        hot_keys = F.broadcast(hot_keys)
    cold = rows.join(hot_keys, _same(keys), "left_anti")
    hot = rows.join(hot_keys, _same(keys), "left_semi")
    split = _hot(hot, keys, order, measures, ranges)
    kinds = {f.name: f.dataType for f in plain.schema}
    split = split.select(*rows.columns, *[F.col(m.name).cast(kinds[m.name]).alias(m.name) for m in measures])
    return _with_plain(cold, measures, keys, order).unionByName(split)
