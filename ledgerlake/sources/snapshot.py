"""Batch data sources over snapshot archives.

``ledger_archives`` lists archives. ``ledger_snapshot`` lists tar members and
hands out their bodies in chunks; ``ledger_accounts`` goes one step further and
unfolds the chunks into account versions in the task that decompresses them, so
raw bytes never cross into the JVM. All read the columns of the schema they are
given and no others, and ``ledger_accounts`` no rows that a filter drops.

An archive is one compressed stream and is read by one task, largest first.
With ``minPartitions`` set, small archives are packed together into tasks.
"""

from __future__ import annotations

import heapq
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DecimalType, LongType, StructType

from ledgerlake.operators.decoders import rule_of
from ledgerlake.operators.walk import KEY_WORDS, U64_WORDS, Condition, record_batches
from ledgerlake.schemas import ACCOUNT_VERSIONS, ARCHIVES, ENTRIES
from ledgerlake.sources.archive import DEFAULT_CHUNK, Chunk, read_archive
from ledgerlake.sources.arriving import ArrivingArchives
from ledgerlake.sources.files import list_files

# File names of the two kinds of archive.
ARCHIVE_PATTERNS = {
    "all": "*.tar.zst",
    "full": "snapshot*.tar.zst",
    "incremental": "incremental-snapshot*.tar.zst",
}

LISTING_ROWS = 10_000


@dataclass
class ArchivePartition(InputPartition):
    uris: list[str]

    def __post_init__(self):
        super().__init__(self.uris)


def packed(archives: list[tuple[str, int]], groups: int) -> list[list[str]]:
    """Archives in at most that many groups of about equal bytes, largest first."""
    loads = [(0, number, []) for number in range(min(groups, len(archives)))]
    for uri, size in sorted(archives, key=lambda a: -a[1]):
        held, number, uris = heapq.heappop(loads)
        heapq.heappush(loads, (held + size, number, [*uris, uri]))
    return [uris for _, _, uris in sorted(loads, key=lambda load: -load[0])]


def _flag(options, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


class _ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema = schema
        self.arrow_schema = to_arrow_schema(schema)
        self.names = schema.names
        self.kind = options.get("kind", "all")
        if self.kind not in ARCHIVE_PATTERNS:
            raise ValueError(f"kind must be one of {sorted(ARCHIVE_PATTERNS)}, not {self.kind!r}")
        if "paths" in options:
            self.paths = json.loads(options["paths"])
        elif "path" in options:
            self.paths = [options["path"]]
        else:
            raise ValueError("a path to archives is needed: load(path)")
        self.chunk_bytes = int(options.get("chunkBytes", DEFAULT_CHUNK))
        self.min_partitions = int(options.get("minPartitions", 0))
        self.max_partition_bytes = int(options.get("maxPartitionBytes", 128 << 20))
        self.drop_malformed = options.get("mode", "FAILFAST").upper() == "DROPMALFORMED"

    def found(self) -> list[tuple[str, int]]:
        return [f for path in self.paths for f in list_files(path, ARCHIVE_PATTERNS[self.kind])]

    def partitions(self):
        return self.packed_partitions(self.found())

    def packed_partitions(self, found: list[tuple[str, int]]) -> list[ArchivePartition]:
        groups = len(found)
        if self.min_partitions:
            total = sum(size for _, size in found)
            groups = max(self.min_partitions, -(-total // self.max_partition_bytes))
        return [ArchivePartition(uris) for uris in packed(found, groups)]

    def read(self, partition: ArchivePartition | None) -> Iterator[pa.RecordBatch]:
        # Spark asks for one read without a partition when there are none.
        for uri in partition.uris if partition else ():
            yield from self.read_archive(uri)


class ListReader(_ArchiveReader):
    """Archives as rows, without opening them; a task's archives are a partition."""

    def read(self, partition: ArchivePartition | None) -> Iterator[pa.RecordBatch]:
        if partition:
            yield pa.RecordBatch.from_arrays([pa.array(partition.uris, pa.string())], schema=self.arrow_schema)


class EntryReader(_ArchiveReader):
    """Tar members as rows; bodies of account members only."""

    def __init__(self, schema: StructType, options):
        super().__init__(schema, options)
        self.accounts_only = _flag(options, "accountsOnly", False)
        self.with_content = _flag(options, "includeContent", True) and "content" in self.names
        self.end_on_empty_name = options.get("endOfArchive", "nul") == "emptyName"

    def _row(self, archive: str, chunk: Chunk) -> dict:
        member = chunk.member
        return {
            "archive": archive,
            "entry_no": member.entry_no,
            "path": member.path,
            "typeflag": member.typeflag,
            "size": member.size,
            "is_accounts": member.is_accounts,
            "chunk_no": chunk.chunk_no,
            "base_offset": chunk.base_offset,
            "content": chunk.content,
        }

    def _rows_batch(self, rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([row[f.name] for row in rows], type=f.type) for f in self.arrow_schema]
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow_schema)

    def read_archive(self, uri: str) -> Iterator[pa.RecordBatch]:
        archive = posixpath.basename(uri)
        rows: list[dict] = []
        held = 0
        for chunk in read_archive(
            uri,
            accounts_only=self.accounts_only,
            with_content=self.with_content,
            chunk_bytes=self.chunk_bytes,
            end_on_empty_name=self.end_on_empty_name,
        ):
            rows.append(self._row(archive, chunk))
            held += len(chunk.content or b"")
            if held >= self.chunk_bytes or len(rows) >= LISTING_ROWS:
                yield self._rows_batch(rows)
                rows, held = [], 0
        if rows:
            yield self._rows_batch(rows)


_COMPARISONS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _stated(name: str, value: object, schema: StructType) -> object | None:
    """A literal as the walk compares it; None where it cannot."""
    kind = schema[name].dataType
    if name in KEY_WORDS:
        return bytes(value) if isinstance(value, (bytes, bytearray)) else None
    if name == "executable":
        return int(value) if 0 <= value < 256 else None
    if isinstance(kind, LongType):
        return value % 2**64
    whole = Decimal(value)
    return int(whole) if whole == whole.to_integral_value() and 0 <= whole < 2**64 else None


def pushed(given: Filter, schema: StructType) -> Condition | tuple | None:
    """The condition that says the same as a filter, an empty tuple if it always holds, None if the walk has none.

    Numbers stored as bits have no order, keys are only equal or not.
    """
    inner, negated = (given.child, True) if isinstance(given, Not) else (given, False)
    name = inner.attribute[0] if len(getattr(inner, "attribute", ())) == 1 else None
    if name not in (*KEY_WORDS, *U64_WORDS, "executable"):
        return None
    if isinstance(inner, IsNotNull):
        return None if negated else ()
    ordered = name == "executable" or isinstance(schema[name].dataType, DecimalType)
    if isinstance(inner, In):
        values = [_stated(name, v, schema) for v in inner.value if v is not None]
        if negated or None in values:
            return None
        return Condition(name, "in", tuple(values))
    if isinstance(inner, (EqualTo, EqualNullSafe)):
        op = "!=" if negated else "=="
    elif type(inner) in _COMPARISONS and not negated and ordered and name not in KEY_WORDS:
        op = _COMPARISONS[type(inner)]
    else:
        return None
    value = None if inner.value is None else _stated(name, inner.value, schema)
    return None if value is None else Condition(name, op, value)


class AccountReader(_ArchiveReader):
    """Account versions as rows, in the columns of the schema asked for."""

    def __init__(self, schema: StructType, options):
        super().__init__(schema, options)
        self.where = [] if _flag(options, "includeDead", True) else [Condition("lamports", "!=", 0)]
        for name in KEY_WORDS:
            if options.get(name + "Hex"):
                self.where.append(Condition(name, "==", bytes.fromhex(options[name + "Hex"])))
        self.wanted = [rule_of(kept) for kept in json.loads(options.get("keepData", "[]"))]
        self.wanted_only = _flag(options, "onlyKeptData", False)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the record's own fields are answered by the walk; all others go back to Spark."""
        for given in filters:
            condition = pushed(given, self.schema)
            if condition is None:
                yield given
            elif condition:
                self.where.append(condition)

    def read_archive(self, uri: str) -> Iterator[pa.RecordBatch]:
        archive = posixpath.basename(uri)
        for chunk in read_archive(uri, accounts_only=True, chunk_bytes=self.chunk_bytes):
            yield from record_batches(
                chunk.content,
                self.arrow_schema,
                archive=archive,
                path=chunk.member.path,
                base_offset=chunk.base_offset,
                wanted=self.wanted,
                drop_malformed=self.drop_malformed,
                where=self.where,
                wanted_only=self.wanted_only,
            )


class _ArchiveSource(DataSource):
    """Read at once, or as a stream of archives that arrive (options ``progress``, ``maxBytesPerTrigger``)."""

    def streamReader(self, schema: StructType) -> ArrivingArchives:
        return ArrivingArchives(self.reader(schema), self.options.get("progress"), int(self.options.get("maxBytesPerTrigger", 0)))


class LedgerSnapshot(_ArchiveSource):
    """``spark.read.format("ledger_snapshot")``: members of archives.

    Options: ``kind`` (all, full, incremental), ``accountsOnly``,
    ``includeContent``, ``chunkBytes``, ``endOfArchive`` (nul, emptyName),
    ``minPartitions``, ``maxPartitionBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "ledger_snapshot"

    def schema(self) -> StructType:
        return ENTRIES

    def reader(self, schema: StructType) -> EntryReader:
        return EntryReader(schema, self.options)


class LedgerArchives(_ArchiveSource):
    """``spark.read.format("ledger_archives")``: archives, unread, in tasks of about equal bytes.

    Options: ``kind``, ``minPartitions``, ``maxPartitionBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "ledger_archives"

    def schema(self) -> StructType:
        return ARCHIVES

    def reader(self, schema: StructType) -> ListReader:
        return ListReader(schema, self.options)


class LedgerAccounts(_ArchiveSource):
    """``spark.read.format("ledger_accounts")``: account versions in archives.

    A u64 column asked for as bigint holds the bits of the number.

    Options: ``kind``, ``chunkBytes``, ``minPartitions``,
    ``maxPartitionBytes``, ``mode`` (FAILFAST, DROPMALFORMED), ``includeDead``,
    ``ownerHex``, ``pubkeyHex``, ``hashHex``, ``keepData``, a JSON list of
    [owner hex, data length] or [owner hex, least, most length, prefix hex,
    its place] whose record data is kept, and ``onlyKeptData`` to read no other
    records.
    """

    @classmethod
    def name(cls) -> str:
        return "ledger_accounts"

    def schema(self) -> StructType:
        return ACCOUNT_VERSIONS

    def reader(self, schema: StructType) -> AccountReader:
        return AccountReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, and let Spark push filters into them: it refuses sources that take filters otherwise."""
    for source in (LedgerArchives, LedgerSnapshot, LedgerAccounts):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
