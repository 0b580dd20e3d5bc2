"""Snapshot archives or chunks of members as account versions."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlake.operators.decoders import DEFAULT_DECODERS, Decoder, kept_data
from ledgerlake.operators.filters import SnapshotFilters
from ledgerlake.operators.walk import record_batches, record_words
from ledgerlake.schemas import ACCOUNT_VERSIONS, pick
from ledgerlake.sources.files import list_files, locate
from ledgerlake.sources.snapshot import ARCHIVE_PATTERNS, AccountReader, register

# Compressed bytes of large archives per task once their chunks are spread.
SPREAD_BYTES = 64 << 20

_CHUNK_COLUMNS = ("archive", "path", "base_offset", "content")


def unfold(
    entries: DataFrame,
    schema: StructType = ACCOUNT_VERSIONS,
    *,
    decoders: Sequence[Decoder] = DEFAULT_DECODERS,
    drop_malformed: bool = False,
) -> DataFrame:
    """Account versions held by chunks of account members (1 chunk to N rows)."""
    arrow_schema = to_arrow_schema(schema)
    wanted = [d.rule for d in decoders]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                archive, path, base, content = (column[row] for column in batch.columns)
                yield from record_batches(
                    content.as_buffer(),
                    arrow_schema,
                    archive=archive.as_py(),
                    path=path.as_py(),
                    base_offset=base.as_py(),
                    wanted=wanted,
                    drop_malformed=drop_malformed,
                )

    return entries.where("is_accounts").select(*_CHUNK_COLUMNS).mapInArrow(walk, schema)


def corrupt_records(entries: DataFrame) -> DataFrame:
    """(archive, path, rec_offset) of each record that overruns its member."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                bad = record_words(row["content"])[1]
                if bad is not None:
                    found.append((row["archive"], row["path"], row["base_offset"] + bad * 8))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column) for column in zip(*found)], ["archive", "path", "rec_offset"]
                )

    return (
        entries.where("is_accounts")
        .select(*_CHUNK_COLUMNS)
        .mapInArrow(find, "archive string, path string, rec_offset bigint")
    )


def spread_chunks(entries: DataFrame, tasks: int) -> DataFrame:
    """Chunks spread evenly over tasks. The hash of a chunk's place is stable if a task is run again."""
    return entries.repartition(tasks, "archive", "entry_no", "chunk_no")


def too_large_for_one_task(archives: Sequence[tuple[str, int]], cores: int) -> list[tuple[str, int]]:
    """Archives of more than three cores' fair share of all bytes: below that, spreading costs more than it gains."""
    total = sum(size for _, size in archives)
    return [(uri, size) for uri, size in archives if size * cores > 3 * total]


def read_accounts(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    columns: Sequence[str] = tuple(ACCOUNT_VERSIONS.names),
    decoders: Sequence[Decoder] = DEFAULT_DECODERS,
    filters: SnapshotFilters = SnapshotFilters(include_dead=True),
    kind: str = "all",
    mode: str = "FAILFAST",
    schema: StructType = ACCOUNT_VERSIONS,
    decoded_only: bool = False,
) -> DataFrame:
    """Account versions in the archives under `path`.

    An archive is unfolded where it is decompressed: no shuffle, and only the
    asked columns and rows leave the task. An archive too large for that, or
    all when they are few, is only decompressed and cut in one task; its chunks
    are spread over all cores before they are unfolded.

    With `schema=STORED_VERSIONS` u64 columns come as bits; with `decoded_only`
    only records come that one of the decoders takes.
    """
    register(spark)
    cores = spark.sparkContext.defaultParallelism
    paths = [path] if isinstance(path, str) else list(path)
    archives = [found for p in paths for found in list_files(p, ARCHIVE_PATTERNS[kind])]
    large = too_large_for_one_task(archives, cores)
    parts = []
    if len(large) < len(archives) or not archives:
        apart = {uri for uri, _ in large}
        small = paths if not large else [uri for uri, _ in archives if uri not in apart]
        reader = spark.read.format("ledger_accounts").schema(pick(schema, *columns)).options(kind=kind, mode=mode)
        reader = reader.option("minPartitions", cores).options(**_wanted(decoders, filters, decoded_only))
        parts.append(reader.load(small))
    if large:
        tasks = max(cores, sum(size for _, size in large) // SPREAD_BYTES)
        uris = [uri for uri, _ in large]
        tested = ["lamports", *filters.keys(), *(("owner", "data_len", "data") if decoded_only else ())]
        needed = [*columns, *(n for n in dict.fromkeys(tested) if n not in columns)]
        rows = _unfold_spread(spark, uris, tasks, pick(schema, *needed), decoders, kind, mode)
        if decoded_only:
            rows = rows.where(reduce(or_, [d.matches() for d in decoders]))
        parts.append(rows.where(filters.predicate()).select(*columns))
    return reduce(DataFrame.unionByName, parts)


def read_as_packed(
    rows: DataFrame,
    pack: Callable[[str], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]],
    *,
    columns: Sequence[str] = tuple(ACCOUNT_VERSIONS.names),
    decoders: Sequence[Decoder] = DEFAULT_DECODERS,
    filters: SnapshotFilters = SnapshotFilters(include_dead=True),
    schema: StructType = ACCOUNT_VERSIONS,
    decoded_only: bool = False,
) -> DataFrame:
    """Account versions of archives that are packed from rows, as `read_accounts` gives them.

    `pack(folder)` turns a task's batches into archives of that folder and gives
    the name of each, in a column `archive`, when it is whole. The task then
    reads it as the source `ledger_accounts` does, and removes it: no task has
    more than one archive on disk, however many there are.
    """
    schema = pick(schema, *columns)
    reader = AccountReader(schema, {"path": ""} | _wanted(decoders, filters, decoded_only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="ledgerlake-archive-") as folder:
            fs, _ = locate(folder)
            for packed in pack(folder)(batches):
                for name in packed.column("archive").to_pylist():
                    yield from reader.read_archive(f"{folder}/{name}")
                    fs.delete_file(f"{folder}/{name}")

    return rows.mapInArrow(run, schema)


def _wanted(decoders: Sequence[Decoder], filters: SnapshotFilters, decoded_only: bool) -> dict[str, str]:
    """What is read of an archive, as options of the source."""
    kept = {"keepData": json.dumps(kept_data(decoders)), "onlyKeptData": str(decoded_only).lower()}
    return kept | filters.reader_options()


def _unfold_spread(spark, paths, tasks, schema, decoders, kind, mode) -> DataFrame:
    entries = spark.read.format("ledger_snapshot").options(kind=kind, accountsOnly="true").load(paths)
    return unfold(
        spread_chunks(entries, tasks),
        schema,
        decoders=decoders,
        drop_malformed=mode.upper() == "DROPMALFORMED",
    )
