"""Snapshots that keep arriving: archives or unpacked account members in a landing folder.

Spark's file stream keeps the list of files already taken. Each micro-batch
writes its own folder of every table, so a batch that is run again after a
failure replaces its output and adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators.decoders import DEFAULT_DECODERS, TOKEN_ACCOUNTS, Decoder
from ledgerlake.operators.filters import SnapshotFilters
from ledgerlake.operators.membership import ready_keys
from ledgerlake.operators.records import unfold
from ledgerlake.operators.sketches import holder_sketches
from ledgerlake.plans.ingest import publish, publish_archives, read_versions, write_versions
from ledgerlake.schemas import STORED_VERSIONS
from ledgerlake.sources.snapshot import ARCHIVE_PATTERNS
from ledgerlake.sources.tables import register_tables

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
FILES_PER_BATCH = 1_000
#: Spark's own default leaves out files a week older than the newest; late archives must not be lost.
MAX_FILE_AGE = "36500d"


def _landed(spark: SparkSession, folder: str, pattern: str, files_per_batch: int) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", MAX_FILE_AGE)
        .load(folder)
    )


def _start(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, now: bool) -> StreamingQuery:
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if now else query).start()


def _batch_place(folder: str, number: int) -> Callable[[str], str]:
    return lambda name: f"{folder}/{name}/batch={number}"


def publish_arriving_archives(
    spark: SparkSession,
    landing: str,
    folder: str,
    checkpoint: str,
    *,
    known: DataFrame | None = None,
    filters: SnapshotFilters = SnapshotFilters(),
    decoders: Sequence[Decoder] = DEFAULT_DECODERS,
    kind: str = "all",
    files_per_batch: int = FILES_PER_BATCH,
    mode: str = "FAILFAST",
    with_sketches: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """Publish all tables of archives as they land, each archive read once.

    With sketches a batch also leaves its holders a mint in `holder_sketches`,
    which `operators.sketches.estimates` puts together.

    The stream carries file names only: at most `files_per_batch` of them reach
    the driver, and their archives are then read like any others.
    """
    register_tables(spark)
    known = None if known is None else ready_keys(known)
    paths = _landed(spark, landing, ARCHIVE_PATTERNS[kind], files_per_batch).select("path")

    def write(batch: DataFrame, number: int) -> None:
        arrived = [row.path for row in batch.collect()]
        if arrived:
            place = _batch_place(folder, number)
            session = batch.sparkSession
            publish_archives(session, arrived, place, known=known, filters=filters, decoders=decoders, mode=mode)
            if with_sketches:
                found = session.read.parquet(place(TOKEN_ACCOUNTS.name))
                holder_sketches(found).write.mode("overwrite").parquet(place("holder_sketches"))

    return _start(paths, write, checkpoint, available_now)


def stream_members(
    spark: SparkSession,
    landing: str,
    *,
    decoders: Sequence[Decoder] = DEFAULT_DECODERS,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Account versions (stored form) of unpacked account members as they land, each below 2 GiB."""
    entries = _landed(spark, landing, "*", files_per_batch).select(
        F.lit("").alias("archive"),
        "path",
        F.lit(True).alias("is_accounts"),
        F.lit(0).cast("bigint").alias("base_offset"),
        "content",
    )
    return unfold(entries, STORED_VERSIONS, decoders=decoders)


def publish_versions(
    versions: DataFrame,
    folder: str,
    checkpoint: str,
    *,
    known: DataFrame | None = None,
    filters: SnapshotFilters = SnapshotFilters(),
    decoders: Sequence[Decoder] = DEFAULT_DECODERS,
    available_now: bool = True,
) -> StreamingQuery:
    """Publish all tables of a stream of account versions, which are stored with them."""

    def write(batch: DataFrame, number: int) -> None:
        place = _batch_place(folder, number)
        write_versions(batch, place("versions"), decoders)
        stored = read_versions(batch.sparkSession, place("versions"))
        publish(stored, place, known=known, filters=filters, decoders=decoders)

    return _start(versions, write, checkpoint, available_now)
