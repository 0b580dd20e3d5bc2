"""A sink that takes archives and gives tables: every archive is decompressed and walked once.

``ledger_tables`` is written to with rows of two kinds: the name of an archive, or a chunk of a member of one that is
spread over many tasks. The task that gets a row walks its records once, hands each record to the tables that want it,
and writes their Parquet files under hidden names. Only when all tasks are done does the driver move the files of the
attempts that Spark accepted to where readers see them; files of failed, repeated or given up attempts are never seen.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerlake.operators.decoders import Decoder, Field, first_matches
from ledgerlake.operators.membership import bloom_keys, exact_keys
from ledgerlake.operators.walk import BATCH_ROWS, EXECUTABLE_BYTE, Condition, CorruptRecord, RecordView, binary_array, record_words, u64_array
from ledgerlake.schemas import RECORD_HEADER_BYTES
from ledgerlake.sources.archive import read_archive
from ledgerlake.sources.files import locate, remove_folder
from ledgerlake.sources.snapshot import register

# How the tables are written.
COMPRESSION, GROUP_ROWS = "snappy", 1_000_000
#: Bytes of a table that a task gathers before it writes them as a row group.
GROUP_BYTES = 32 << 20
ACCOUNTS, REJECTED = "accounts", "rejected"
#: What the sink is written: `uri` of an archive, or all other columns.
SINK = "uri string, archive string, path string, size bigint, base_offset bigint, content binary"

_U64 = pa.decimal128(20, 0)


def _required(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(name, kind, nullable=False) for name, kind in fields])


ACCOUNTS_ARROW = _required(
    ("pubkey", pa.binary()), ("lamports", _U64), ("owner", pa.binary()), ("data_len", _U64), ("executable", pa.bool_()), ("rent_epoch", _U64)
)
REJECTED_ARROW = _required(("archive", pa.string()), ("path", pa.string()), ("rec_offset", pa.int64()), ("bytes", pa.int64()))


def accounts_batch(view: RecordView, at: np.ndarray) -> pa.RecordBatch:
    """Rows of the `accounts` table."""

    def key(name: str) -> pa.Array:
        return binary_array(view.key(at, name).view(np.uint8))

    def number(name: str) -> pa.Array:
        return u64_array(view.u64(at, name), _U64)

    executable = pa.array(view.raw[at * 8 + EXECUTABLE_BYTE] == 1)
    columns = [key("pubkey"), number("lamports"), key("owner"), number("data_len"), executable, number("rent_epoch")]
    return pa.RecordBatch.from_arrays(columns, schema=ACCOUNTS_ARROW)


class _TableFile:
    """One task's rows of one table: a file, begun with the first row."""

    def __init__(self, folder: str, schema: pa.Schema):
        self.folder, self.schema = folder, schema
        self.name, self.file = None, None
        self.held, self.bytes, self.held_rows, self.rows = [], 0, 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        if self.held_rows + batch.num_rows > GROUP_ROWS or self.bytes + batch.nbytes > GROUP_BYTES:
            self._flush()
        self.held.append(batch)
        self.bytes += batch.nbytes
        self.held_rows += batch.num_rows
        self.rows += batch.num_rows

    def _flush(self) -> None:
        if not self.held:
            return
        if self.file is None:
            fs, path = locate(self.folder)
            self.name = f"part-{uuid.uuid4().hex}.snappy.parquet"
            fs.create_dir(path, recursive=True)
            self.file = _parquet(fs, posixpath.join(path, self.name), self.schema)
        self.file.write_table(pa.Table.from_batches(self.held), row_group_size=GROUP_ROWS)
        self.held, self.bytes, self.held_rows = [], 0, 0

    def close(self) -> None:
        self._flush()
        if self.file is not None:
            self.file.close()


def _parquet(fs: pafs.FileSystem, path: str, schema: pa.Schema) -> pq.ParquetWriter:
    return pq.ParquetWriter(path, schema, filesystem=fs, compression=COMPRESSION, use_dictionary=False, store_schema=False)


@dataclass
class Counts:
    """What was read and written; those of many tasks add up."""

    archives: int = 0
    chunks: int = 0
    records: int = 0
    record_bytes: int = 0
    rejected_members: int = 0
    rejected_bytes: int = 0
    rows: dict[str, int] = field(default_factory=dict)

    def add(self, other: Counts) -> None:
        for name in ("archives", "chunks", "records", "record_bytes", "rejected_members", "rejected_bytes"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        for name, rows in other.rows.items():
            self.rows[name] = self.rows.get(name, 0) + rows


@dataclass
class Written(WriterCommitMessage):
    """One task's files by table, and its counts."""

    files: dict[str, str]
    counts: Counts


def plan_of(places: dict[str, str], decoders: list[Decoder], where: list[Condition], known: dict | None, drop_malformed: bool, summary: str, consume: bool = False) -> str:
    """All that the sink is told, as one option; with `consume` it removes each archive that it has read."""

    def told(decoder: Decoder) -> dict:
        fields = [[f.name, f.kind, f.offset, f.optional] for f in decoder.fields]
        rule = decoder.rule
        return {
            "name": decoder.name, "owner": rule.owner.hex(), "data_len": rule.least, "most_len": rule.most, "prefix": rule.prefix.hex(),
            "prefix_at": rule.prefix_at, "known_by": decoder.known_by, "fields": fields,
        }

    conditions = [[c.name, c.op, c.value.hex() if isinstance(c.value, bytes) else c.value] for c in where]
    return json.dumps(
        {
            "places": places, "decoders": [told(d) for d in first_matches(decoders)], "where": conditions, "known": known,
            "drop_malformed": drop_malformed, "summary": summary, "run": uuid.uuid4().hex, "consume": consume,
        }
    )


def _decoder(told: dict) -> Decoder:
    fields = tuple(Field(name, kind, offset, optional) for name, kind, offset, optional in told["fields"])
    return Decoder(
        told["name"], bytes.fromhex(told["owner"]), told["data_len"], fields, told["known_by"], told["most_len"], bytes.fromhex(told["prefix"]), told["prefix_at"]
    )


class TablesWriter(DataSourceArrowWriter):
    """Walks what it is given and writes all tables; see the module."""

    def __init__(self, schema: StructType, plan: str, overwrite: bool):
        told = json.loads(plan)
        self.names = schema.names
        self.places, self.overwrite = told["places"], overwrite
        self.decoders = [_decoder(d) for d in told["decoders"]]
        self.where = [Condition(n, op, bytes.fromhex(v) if isinstance(v, str) else v) for n, op, v in told["where"]]
        self.known, self.drop_malformed = told["known"], told["drop_malformed"]
        self.summary, self.run, self.consume = told["summary"], told["run"], told["consume"]

    def _staged(self, name: str) -> str:
        return f"{self.places[name]}/_staged-{self.run}"

    def _schemas(self) -> dict[str, pa.Schema]:
        schemas = {ACCOUNTS: ACCOUNTS_ARROW} | {d.name: d.arrow_schema() for d in self.decoders}
        return schemas | ({REJECTED: REJECTED_ARROW} if self.drop_malformed else {})

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        tables = {name: _TableFile(self._staged(name), schema) for name, schema in self._schemas().items()}
        counts, known = Counts(), None
        if self.known:
            known = bloom_keys(self.known["folder"], self.known["blocks"]) if self.known["blocks"] else exact_keys(self.known["folder"])
        for batch in iterator:
            for row in range(batch.num_rows):
                cells = dict(zip(batch.schema.names, (column[row] for column in batch.columns)))
                if cells["uri"].is_valid:
                    counts.archives += 1
                    uri = cells["uri"].as_py()
                    for chunk in read_archive(uri, accounts_only=True):
                        self._take(chunk.content, posixpath.basename(uri), chunk.member.path, chunk.member.size, chunk.base_offset, tables, counts, known)
                    if self.consume:
                        fs, path = locate(uri)
                        fs.delete_file(path)
                else:
                    archive, path, size, base = (cells[n].as_py() for n in ("archive", "path", "size", "base_offset"))
                    self._take(cells["content"].as_buffer(), archive, path, size, base, tables, counts, known)
        for table in tables.values():
            table.close()
        counts.rows = {name: table.rows for name, table in tables.items()}
        return Written({name: table.name for name, table in tables.items() if table.name}, counts)

    def _take(self, body, archive: str, path: str, size: int, base: int, tables: dict[str, _TableFile], counts: Counts, known) -> None:
        """The records of one chunk, each to the tables that want it."""
        every, bad = record_words(body)
        if bad is not None:
            if not self.drop_malformed:
                raise CorruptRecord(f"{archive}: {path}: record at offset {base + bad * 8} overruns the member")
            lost = size - base - bad * 8
            counts.rejected_members += 1
            counts.rejected_bytes += lost
            tables[REJECTED].add(pa.RecordBatch.from_arrays([pa.array([v]) for v in (archive, path, base + bad * 8, lost)], schema=REJECTED_ARROW))
        counts.chunks += 1
        counts.records += len(every)
        view = RecordView(body)
        rules = [d.rule for d in self.decoders]
        for begin in range(0, len(every), BATCH_ROWS):
            at = every[begin : begin + BATCH_ROWS]
            passing = view.passing(at, self.where)
            lengths = view.u64(passing, "data_len").astype(np.int64)
            counts.record_bytes += int(((lengths + RECORD_HEADER_BYTES + 7) & ~7).sum())
            tables[ACCOUNTS].add(accounts_batch(view, passing))
            chosen = view.matched(at, rules)
            for number, decoder in enumerate(self.decoders):
                mine = at[chosen == number]
                if known is not None and decoder.known_by is not None and len(mine):
                    mine = mine[known.holds(decoder.key_of(view, mine))]
                if len(mine):
                    tables[decoder.name].add(decoder.batch(view, mine))

    def commit(self, messages: list[Written | None]) -> None:
        """Let readers see the files of the accepted attempts; a table without any gets a file without rows."""
        total = Counts()
        for message in messages:
            if message is not None:
                total.add(message.counts)
        for name, schema in self._schemas().items():
            fs, path = locate(self.places[name])
            fs.create_dir(path, recursive=True)
            if self.overwrite:
                for old in fs.get_file_info(pafs.FileSelector(path)):
                    if old.base_name != f"_staged-{self.run}":
                        fs.delete_dir(old.path) if old.type == pafs.FileType.Directory else fs.delete_file(old.path)
            files = [m.files[name] for m in messages if m is not None and name in m.files]
            for file in files:
                fs.move(posixpath.join(path, f"_staged-{self.run}", file), posixpath.join(path, file))
            if not files:
                _parquet(fs, posixpath.join(path, f"part-none-{self.run}.snappy.parquet"), schema).close()
        self._drop_staged()
        fs, path = locate(self.summary)
        fs.create_dir(posixpath.dirname(path), recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(json.dumps(vars(total)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_staged()

    def _drop_staged(self) -> None:
        for name in self._schemas():
            remove_folder(self._staged(name))


class LedgerTables(DataSource):
    """``rows.write.format("ledger_tables").option("plan", plan_of(...)).mode("overwrite").save()``."""

    @classmethod
    def name(cls) -> str:
        return "ledger_tables"

    def writer(self, schema: StructType, overwrite: bool) -> TablesWriter:
        return TablesWriter(schema, self.options["plan"], overwrite)


def register_tables(spark: SparkSession) -> None:
    """Make the sink known to the session, and the sources it is fed from."""
    register(spark)
    spark.dataSource.register(LedgerTables)


def written_counts(summary: str) -> Counts:
    """The counts that a commit left."""
    fs, path = locate(summary)
    with fs.open_input_stream(path) as file:
        return Counts(**json.loads(file.read()))


def as_archives(archives: DataFrame) -> DataFrame:
    """Rows of `ledger_archives` as the sink takes them."""
    return archives.select("uri", *(F.lit(None).cast(kind).alias(name) for name, kind in _columns()[1:]))


def as_chunks(entries: DataFrame) -> DataFrame:
    """Chunks of account members from `ledger_snapshot` as the sink takes them."""
    return entries.where("is_accounts").select(F.lit(None).cast("string").alias("uri"), *(name for name, _ in _columns()[1:]))


def _columns() -> list[list[str]]:
    return [column.split(" ") for column in SINK.split(", ")]
