"""Known mints: reading the list, and keeping only rows that refer to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.base58 import try_from_base58
from ledgerlake.plans.scratch import new_folder

# A key is 32 bytes: this many make a broadcast of well under 100 MB.
BROADCAST_KEYS = 500_000


def known_mints(lines: DataFrame) -> DataFrame:
    """Distinct keys of a list with one base58 text per line; blank and bad lines are skipped."""
    text = F.regexp_replace("value", r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "").alias("text")
    return (
        lines.select(text)
        .where(F.col("text") != "")
        .select(try_from_base58("text").alias("pubkey"))
        .where(F.col("pubkey").isNotNull())
        .distinct()
    )


def read_known_mints(spark: SparkSession, path: str) -> DataFrame:
    return known_mints(spark.read.text(path))


def keep_known(known: DataFrame, folder: str | None = None) -> DataFrame:
    """The list as a written table: decoded once, cheap to count, and a plain scan whose joins can be split."""
    spark = known.sparkSession
    folder = folder or new_folder(spark, "known-mints")
    known.write.parquet(folder)
    return spark.read.schema(known.schema).parquet(folder)


def only_known(rows: DataFrame, tested: Column, known: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Rows whose `tested` key is in `known` (distinct keys): a left semi-join.

    The list is counted first. A small one is broadcast, so the rows are not
    shuffled. A larger one is left to a shuffled join, where adaptive execution
    splits the rows of a hot key, if the list is a written table (`keep_known`)
    and not still to be made distinct under the join; it has each key once.
    """
    keys = known.select(F.col("pubkey").alias("_known"))
    if known.count() <= broadcast_keys:
        keys = F.broadcast(keys)
    joined = rows.withColumn("_tested", tested).join(keys, F.col("_tested") == F.col("_known"), "left_semi")
    return joined.drop("_tested")
