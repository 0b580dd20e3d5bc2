"""One call from archives to tables and a summary of the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.operators.filters import SnapshotFilters
from ledgerlake.operators.known import read_known_mints
from ledgerlake.operators.metrics import RunClock
from ledgerlake.plans.ingest import publish_archives
from ledgerlake.sources.files import list_files
from ledgerlake.sources.snapshot import ARCHIVE_PATTERNS


def process_snapshot(
    spark: SparkSession,
    path: str,
    folder: str,
    *,
    known_mints: str | None = None,
    filters: SnapshotFilters = SnapshotFilters(),
    incremental: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Publish the tables of the archives under `path` into `folder`.

    `known_mints` is a text with one base58 key per line; it is needed unless
    the filters include spam. Full archives are read, or incremental ones when
    asked. Returns one row: accounts written, their record bytes, compressed
    bytes read, seconds, and MB/s of compressed bytes; then how many members
    were cut off at a record that overruns them and the bytes lost, which the
    table `rejected` lists, if `mode` is DROPMALFORMED and not FAILFAST.
    """
    kind = "incremental" if incremental else "full"
    known = None if known_mints is None else read_known_mints(spark, known_mints)
    compressed = sum(size for _, size in list_files(path, ARCHIVE_PATTERNS[kind]))
    clock = RunClock()
    counts = publish_archives(
        spark, path, lambda name: f"{folder}/{name}", known=known, filters=filters, kind=kind, mode=mode
    )
    return clock.summary(spark, compressed, counts)
