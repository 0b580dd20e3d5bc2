"""Counters of a run, taken while its rows pass by."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.binary import align
from ledgerlake.schemas import RECORD_HEADER_BYTES


def record_size() -> Column:
    """Bytes a version takes in its member, padding included."""
    return align(F.col("data_len").cast("bigint") + RECORD_HEADER_BYTES, 8)


class RunClock:
    """Times a run from here on and counts the accounts it writes."""

    def __init__(self):
        self.observation = Observation()
        self.begin = time.monotonic()

    def watch(self, accounts: DataFrame) -> DataFrame:
        """The same rows, counted on the way through with their record bytes."""
        return accounts.observe(
            self.observation,
            F.count(F.lit(1)).alias("rows_parsed"),
            F.coalesce(F.sum(record_size()), F.lit(0)).alias("record_bytes"),
        )

    def summary(self, spark: SparkSession, compressed_bytes: int, counts=None) -> DataFrame:
        """One row of figures, after the watched rows were written, or of the counts of a run that took its own.

        `rows_parsed` counts rows that passed the filters; `mb_per_s` divides
        compressed bytes by 10^6 and by the seconds taken. `rejected_*` tell
        how much of members was left out behind records that overrun them.
        """
        seconds = time.monotonic() - self.begin
        rate = compressed_bytes / 1e6 / max(seconds, 1e-9)
        if counts is None:
            seen = self.observation.get
            figures = (seen["rows_parsed"], seen["record_bytes"], 0, 0)
        else:
            figures = (counts.rows["accounts"], counts.record_bytes, counts.rejected_members, counts.rejected_bytes)
        return spark.createDataFrame(
            [(*figures[:2], compressed_bytes, seconds, rate, *figures[2:])],
            "rows_parsed bigint, record_bytes bigint, compressed_bytes bigint, seconds double, mb_per_s double, "
            "rejected_members bigint, rejected_bytes bigint",
        )
