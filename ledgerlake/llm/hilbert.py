"""Shards along a Hilbert curve through several metadata dimensions.

Dimensions are quantised to equal shares of the rows, order kept, so that each run of the curve covers a small box:
files cut from it can be skipped by the least and greatest values of any of the dimensions. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.common import in_parts, stored

SHARDS = 8
DEPTH = 5
#: Rows of one curve cell are ordered in so many parts at least, more where the cell has many rows: no task orders a cell.
SALTS = 256
#: Tasks that order the distinct values of a text dimension, and values that are sent to all tasks.
RANGES, BROADCAST_VALUES = 64, 100_000


def hilbert_index(axes: list[Column], depth: int = DEPTH) -> Column:
    """Place on the Hilbert curve of integer coordinates from 0 to 2^depth - 1, by bit transposition."""
    n = len(axes)

    def turned(x: Column, q: Column) -> Column:
        low = q - 1
        at = [x[k] for k in range(n)]
        for k in range(n):
            swap = at[0].bitwiseXOR(at[k]).bitwiseAND(low)
            is_set = at[k].bitwiseAND(q) != 0
            first = F.when(is_set, at[0].bitwiseXOR(low)).otherwise(at[0].bitwiseXOR(swap))
            if k:
                at[k] = F.when(is_set, at[k]).otherwise(at[k].bitwiseXOR(swap))
            at[0] = first
        return F.array(*at)

    def gray(x: Column) -> Column:
        at = [x[0]]
        for k in range(1, n):
            at.append(x[k].bitwiseXOR(at[-1]))
        flips = [F.when(at[-1].bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)) for b in range(1, depth)]
        flip = F.lit(0)
        for part in flips:
            flip = flip.bitwiseXOR(part)
        at.append(flip)
        return F.array(*at)

    def woven(x: Column) -> Column:
        index = F.lit(0).cast("bigint")
        for b in range(depth - 1, -1, -1):
            for k in range(n):
                bit = F.shiftright(x[k].bitwiseXOR(x[n]), b).bitwiseAND(1)
                index = index.bitwiseOR(F.shiftleft(bit.cast("bigint"), b * n + n - 1 - k))
        return index

    powers = F.array(*(F.lit(1 << b) for b in range(depth - 1, 0, -1)))
    start = F.array(*(a.cast("int") for a in axes))
    coded = F.transform(F.array(F.aggregate(powers, start, turned)), gray)
    return F.transform(coded, woven)[0]


def text_axis(rows: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """(value, axis) for each value of a text column: 2^depth times the share of rows with lesser values, rounded down.

    Values are compared whole. They are counted, and the counts summed up along the values range by range.
    """
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange(RANGES, "value").withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "text-values")
    along = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("range").agg(F.sum("n").alias("all")).select("range", F.coalesce(F.sum("all").over(along), F.lit(0)).alias("start"))
    inside = W.partitionBy("range").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    before = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), "range")
    total = max(ranged.agg(F.sum("n")).first()[0] or 0, 1)
    axis = F.floor((F.col("start") + F.col("inside")) * (1 << depth) / total).cast("int")
    return stored(before.select("value", axis.alias("axis")), "text-axis")


def on_axes(rows: DataFrame, texts: list[str], numbers: list[str], depth: int = DEPTH) -> DataFrame:
    """Stored rows with columns _a0, _a1, ...: coordinates by text columns without nulls, then by number columns."""
    out = rows
    for k, column in enumerate(texts):
        axis = text_axis(rows, column, depth).toDF("_value", f"_a{k}")
        if axis.count() <= BROADCAST_VALUES:
            axis = F.broadcast(axis)
        out = out.join(axis, F.col(column) == F.col("_value")).drop("_value")
    return out.select("*", *(a.alias(f"_a{len(texts) + k}") for k, a in enumerate(shares(rows, numbers, depth))))


def shares(found: DataFrame, codes: list[str], depth: int = DEPTH) -> list[Column]:
    """For each code column its share, 0 to 2^depth - 1, between quantiles of all rows."""
    points = [k / (1 << depth) for k in range(1, 1 << depth)]
    bounds = found.agg(*(F.percentile_approx(c, points, 10_000).alias(c) for c in codes)).first()
    columns = []
    for c in codes:
        distinct = sorted(set(bounds[c] or []))
        edges = F.array(*(F.lit(b).cast("bigint") for b in distinct)) if distinct else F.array().cast("array<bigint>")
        columns.append(_edges_below(edges, F.col(c)))
    return columns


def _edges_below(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda edge: edge < value))


def curve_order(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, size, text_crc32, curve, place): the gapless place of every row along the curve.

    Dimensions: source, lang and size. Places come from counts by cell and part, so no task orders more than one
    part of one cell. Rows that agree in all three output columns take neighbouring places in any order. Null text
    has no bytes; a null in a dimension counts as the empty text. No rows give no rows. Other columns are not read.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    known = set(documents.columns)
    of_text = [F.coalesce(F.col(c).cast("string") if c in known else F.lit(None).cast("string"), F.lit("")) for c in ("source", "lang")]
    size = (F.octet_length(text) + 1).cast("bigint")
    found = documents.select(
        F.col("doc_id").cast("bigint"), size.alias("size"), F.crc32(text).alias("text_crc32"),
        of_text[0].alias("_source"), of_text[1].alias("_lang"),
    )
    found = stored(found, "shard-rows")
    cells = on_axes(found, ["_source", "_lang"], ["size"], depth).select("doc_id", "size", "text_crc32", "_a0", "_a1", "_a2")
    curve = hilbert_index([F.col(f"_a{k}") for k in range(3)], depth)
    cells = cells.select("doc_id", "size", "text_crc32", curve.alias("curve"))
    sizes = stored(cells.groupBy("curve").agg(F.count("*").alias("_rows")), "cell-sizes")  # at most 2^(3 depth) rows
    cells = in_parts(cells, "curve", sizes, ["doc_id", "size", "text_crc32"], SALTS)
    counted = stored(cells.groupBy("curve", "_part").agg(F.count("*").alias("_n")), "cell-counts")
    inside = W.partitionBy("curve").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    along = W.orderBy("curve").rowsBetween(W.unboundedPreceding, -1)  # at most 2^(3 depth) rows
    starts = counted.groupBy("curve").agg(F.sum("_n").alias("_all")).select("curve", F.coalesce(F.sum("_all").over(along), F.lit(0)).alias("_start"))
    offsets = counted.select("curve", "_part", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_before")).join(starts, "curve")
    offsets = offsets.select("curve", "_part", (F.col("_start") + F.col("_before")).alias("_offset"))
    number = F.row_number().over(W.partitionBy("curve", "_part").orderBy("doc_id", "size", "text_crc32")) - 1
    ranked = cells.withColumn("_number", number).join(stored(offsets, "cell-offsets"), ["curve", "_part"])
    return ranked.select("doc_id", "size", "text_crc32", "curve", (F.col("_offset") + F.col("_number")).alias("place"))


def shard_runs(documents: DataFrame, shards: int = SHARDS, depth: int = DEPTH) -> DataFrame:
    """curve_order with (shard, slot): the curve cut in runs whose row counts differ by one at most. No rows: no shards."""
    placed = stored(curve_order(documents, depth), "curve-places")
    n = max(placed.count(), 1)
    shard = F.expr(f"(place * {shards}) div {n}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("place") - start).withColumn("shard", F.col("shard").cast("int"))


def write_runs(documents: DataFrame, folder: str, files: int = SHARDS, depth: int = DEPTH) -> None:
    """Write documents as about `files` Parquet files along the curve, each sorted by it."""
    names = [f"_d{k}" for k in range(len(documents.columns))]
    named = documents.toDF(*names)
    place = {c: F.col(names[documents.columns.index(c)]) for c in ("source", "lang", "text", "doc_id")}
    rows = stored(
        named.select(
            *names, F.coalesce(place["source"], F.lit("")).alias("_source"), F.coalesce(place["lang"], F.lit("")).alias("_lang"),
            F.coalesce(F.octet_length(place["text"]), F.lit(0)).cast("bigint").alias("_size"),
        ),
        "run-rows",
    )
    rows = on_axes(rows, ["_source", "_lang"], ["_size"], depth)
    rows = rows.select(*names, hilbert_index([F.col(f"_a{k}") for k in range(3)], depth).alias("_curve"))
    ordered = rows.repartitionByRange(files, "_curve", place["doc_id"]).sortWithinPartitions("_curve", place["doc_id"])
    ordered.drop("_curve").toDF(*documents.columns).write.parquet(folder)


def op9_hilbert(documents: DataFrame) -> DataFrame:
    """The contract's columns under the law `rows`."""
    found = shard_runs(documents)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
