"""From archives to tables, straight or by way of stored account versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators.decoders import DEFAULT_DECODERS, Decoder, dispatch, first_matches
from ledgerlake.operators.filters import SnapshotFilters, accounts
from ledgerlake.operators.known import BROADCAST_KEYS, only_known
from ledgerlake.operators.membership import KnownKeys, ready_keys
from ledgerlake.operators.records import SPREAD_BYTES, spread_chunks, too_large_for_one_task
from ledgerlake.plans.scratch import new_folder
from ledgerlake.sources.files import list_files
from ledgerlake.sources.snapshot import ARCHIVE_PATTERNS
from ledgerlake.sources.tables import Counts, as_archives, as_chunks, plan_of, register_tables, written_counts

# How the tables are written.
PARQUET_OPTIONS = {
    "compression": "snappy",
    "parquet.enable.dictionary": "false",
    "parquet.block.row.count.limit": "1000000",
}

# Stored versions are mostly keys and hashes: zstd leaves about a third less of them than snappy, in no more time.
VERSIONS_CODEC = {"compression": "zstd"}

# A reader that looks for one key skips row groups whose Bloom filter lacks it.
BLOOM_OPTIONS = {f"parquet.bloom.filter.enabled#{name}": "true" for name in ("pubkey", "hash")} | {
    "parquet.bloom.filter.adaptive.enabled": "true"
}


def write_versions(
    versions: DataFrame, path: str, decoders: Sequence[Decoder] = DEFAULT_DECODERS, clustered_by: Sequence[str] = ()
) -> None:
    """Store account versions by the decoder that takes them.

    A decoder then reads only its own folder, and the others never see the
    record data. Row groups carry Bloom filters of pubkeys and hashes. With
    `clustered_by` the versions are range-partitioned and sorted by those
    columns (one shuffle), so that files also differ in their least and
    greatest keys; equal rows fall into several ranges.
    """
    stored = versions.withColumn("decoder", dispatch(decoders))
    if clustered_by:
        order = ["decoder", *clustered_by]
        tied = stored.withColumn("_tie", F.monotonically_increasing_id())
        stored = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order).drop("_tie")
    stored.write.mode("overwrite").options(**VERSIONS_CODEC, **BLOOM_OPTIONS).partitionBy("decoder").parquet(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _write_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").options(**PARQUET_OPTIONS).parquet(path)


def write_accounts(versions: DataFrame, path: str, filters: SnapshotFilters = SnapshotFilters()) -> None:
    """The `accounts` table; it is there even when no account passes."""
    _write_table(accounts(versions, filters), path)


def _needed_known(filters: SnapshotFilters, known):
    if filters.include_spam:
        return None
    if known is None:
        raise ValueError("a list of known mints is needed unless spam is included")
    return known


def publish(
    versions: DataFrame,
    place: Callable[[str], str],
    *,
    known: DataFrame | None = None,
    filters: SnapshotFilters = SnapshotFilters(),
    decoders: Sequence[Decoder] = DEFAULT_DECODERS,
) -> None:
    """All tables of stored account versions, each at `place(name)`.

    Filters on accounts do not touch the decoded tables.
    """
    known = _needed_known(filters, known)
    write_accounts(versions, place("accounts"), filters)
    for decoder in decoders:
        _write_table(decoder.table(versions, known), place(decoder.name))


def publish_archives(
    spark: SparkSession,
    path: str | Sequence[str] | DataFrame,
    place: Callable[[str], str],
    *,
    known: DataFrame | KnownKeys | None = None,
    filters: SnapshotFilters = SnapshotFilters(),
    decoders: Sequence[Decoder] = DEFAULT_DECODERS,
    kind: str = "all",
    mode: str = "FAILFAST",
    exact_keys: int = BROADCAST_KEYS,
) -> Counts:
    """All tables straight from archives, when the versions are not wanted for anything else.

    Each archive is decompressed and walked once, by the sink `ledger_tables`,
    which writes all tables; an archive too large for one task is only cut into
    chunks there, and the sink gets those. Known mints are tested in the same
    pass: exactly while the list has up to `exact_keys` keys, beyond that by a
    Bloom filter, after which the few rows that are left go through the exact
    semi-join. With `mode="DROPMALFORMED"` the table `rejected` lists what was
    left out.

    `path` may be a table of names (`uri`) whose tasks write each archive before
    they give its name. The same task then walks and removes it, so that all of
    them are never on disk together.
    """
    register_tables(spark)
    known = _needed_known(filters, known)
    decoders = first_matches(decoders)
    work = new_folder(spark, "ingest")
    tested = [d.name for d in decoders if d.known_by is not None] if known is not None else []
    ready, landed = None, {}
    if tested:
        ready = known if isinstance(known, KnownKeys) else ready_keys(known, exact_keys)
        landed = {} if ready.exact else {name: f"{work}/{name}" for name in tested}
    names = ["accounts", *(d.name for d in decoders), *(["rejected"] if mode.upper() == "DROPMALFORMED" else [])]
    places = {name: landed.get(name, place(name)) for name in names}
    test = None if ready is None else ready.test()
    passing = isinstance(path, DataFrame)
    plan = plan_of(places, decoders, filters.conditions(), test, "rejected" in names, f"{work}/summary.json", passing)
    rows = as_archives(path) if passing else _sink_rows(spark, path, kind)
    rows.write.format("ledger_tables").option("plan", plan).mode("overwrite").save()
    for decoder in decoders:
        if decoder.name in landed:
            rows = spark.read.parquet(landed[decoder.name])
            _write_table(only_known(rows, F.col(decoder.known_by), ready.keys).select(rows.columns), place(decoder.name))
    return written_counts(f"{work}/summary.json")


def _sink_rows(spark: SparkSession, path: str | Sequence[str], kind: str) -> DataFrame:
    """What the sink takes: names of archives in tasks of equal bytes, and spread chunks of those too large for that."""
    cores = spark.sparkContext.defaultParallelism
    paths = [path] if isinstance(path, str) else list(path)
    archives = [found for p in paths for found in list_files(p, ARCHIVE_PATTERNS[kind])]
    large = too_large_for_one_task(archives, cores)
    parts = []
    if len(large) < len(archives) or not archives:
        apart = {uri for uri, _ in large}
        small = [uri for uri, _ in archives if uri not in apart] if large else paths
        listed = spark.read.format("ledger_archives").option("kind", kind).option("minPartitions", cores)
        parts.append(as_archives(listed.load(small)))
    if large:
        entries = spark.read.format("ledger_snapshot").options(kind=kind, accountsOnly="true").load([uri for uri, _ in large])
        tasks = max(cores, sum(size for _, size in large) // SPREAD_BYTES)
        parts.append(as_chunks(spread_chunks(entries, tasks)))
    return reduce(DataFrame.unionByName, parts)
