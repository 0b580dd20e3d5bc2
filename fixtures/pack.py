"""Encoded records into `.tar.zst` archives, one Spark task per archive."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures.ledger import archive_count, dealt_rows, encoded, first_incremental, table
from ledgerlake.functions.base58 import to_base58
from ledgerlake.operators.records import read_as_packed
from ledgerlake.sources.files import locate

BLOCK = 512
ZERO_TAIL = bytes(448)
MEMBER_BYTES = 64 << 20
TWO_FRAME_ARCHIVE = 1
PACKED_SCHEMA = "archive string, members int, account_bytes bigint"


def tar_header(name: str, size: int, typeflag: bytes = b"0", size_field: bytes | None = None) -> bytes:
    header = bytearray(BLOCK)
    header[: len(name)] = name.encode()
    header[124:136] = size_field or b"%011o\0" % size
    header[156:157] = typeflag
    return bytes(header)


def tar_member(name: str, body: bytes, typeflag: bytes = b"0", size_field: bytes | None = None) -> bytes:
    return tar_header(name, len(body), typeflag, size_field) + body + bytes(-len(body) % BLOCK)


def archive_name(number: int, archives: int) -> str:
    kind = "incremental-snapshot" if number >= first_incremental(archives) else "snapshot"
    return f"{kind}-{number}.tar.zst"


class ArchiveFile:
    """One archive being written; it gets its name only once it is whole."""

    def __init__(self, folder: str, name: str, two_frames: bool):
        self.fs, path = locate(folder)
        self.fs.create_dir(path, recursive=True)
        self.final = posixpath.join(path, name)
        self.draft = posixpath.join(path, f"_draft-{uuid.uuid4().hex}")
        self.out = self.fs.open_output_stream(self.draft)
        self.codec = zstandard.ZstdCompressor(level=1)
        self.frame = self.codec.stream_writer(self.out, closefd=False)
        self.two_frames = two_frames

    def write(self, data: bytes) -> None:
        if self.two_frames and len(data) > 1:
            self.frame.write(data[: len(data) // 2])
            self.frame.close()
            self.frame = self.codec.stream_writer(self.out, closefd=False)
            data, self.two_frames = data[len(data) // 2 :], False
        self.frame.write(data)

    def close(self) -> None:
        self.frame.write(bytes(2 * BLOCK))
        self.frame.close()
        self.out.close()
        self.fs.move(self.draft, self.final)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, memoryview]]:
    """(archive_no, member_no, joined records) for each run of equal numbers."""
    for batch in batches:
        archive, member, rec = (batch.column(i) for i in range(3))
        numbers = np.asarray(member)
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        offsets = np.frombuffer(rec.buffers()[1], np.int32)[rec.offset : rec.offset + len(rec) + 1]
        data = memoryview(rec.buffers()[2]) if rec.buffers()[2] else memoryview(b"")
        for start, stop in zip([0, *cuts], [*cuts, len(numbers)]):
            yield archive[int(start)].as_py(), int(numbers[start]), data[offsets[start] : offsets[stop]]


def _writer(folder: str, archives: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, member, part = None, None, None, 0
        body = bytearray()
        members = account_bytes = 0

        def end_member() -> None:
            nonlocal body, members, account_bytes, part
            data = bytes(body) + (ZERO_TAIL if part == 0 else b"")
            out.write(tar_member(f"accounts/{1000 + member}.{member + part * 2 * archives}", data))
            members, account_bytes, part, body = members + 1, account_bytes + len(data), part + 1, bytearray()

        def end_archive() -> pa.RecordBatch:
            end_member()
            out.write(tar_member("snapshots/1000/1000", b"\x07" * 700))
            out.write(tar_member("snapshots/status_cache", b"\x08" * 10))
            out.close()
            return pa.RecordBatch.from_pydict(
                {
                    "archive": [archive_name(now, archives)],
                    "members": pa.array([members], pa.int32()),
                    "account_bytes": [account_bytes],
                }
            )

        for number, of_member, data in _runs(encoded(batches)):
            if number != now:
                if out:
                    yield end_archive()
                out = ArchiveFile(folder, archive_name(number, archives), number == TWO_FRAME_ARCHIVE)
                out.write(tar_member("version", b"1.2.0"))
                out.write(tar_member("accounts/", b"", b"5"))
                now, member, part, members, account_bytes = number, of_member, 0, 0, 0
            elif of_member != member:
                end_member()
                member, part = of_member, 0
            body += data
            if len(body) >= MEMBER_BYTES:
                end_member()
        if out:
            yield end_archive()

    return write


def archives_of(spark: SparkSession, sf_dir: str) -> int:
    """How many archives the synthetic ledger of `sf_dir` has."""
    return archive_count(table(spark, sf_dir, "lineitem").count())


def write_archives(spark: SparkSession, sf_dir: str, folder: str, archives: int | None = None, wanted: range | None = None) -> DataFrame:
    """Pack the synthetic ledger of `sf_dir`, or those wanted of its archives; one output row per archive."""
    archives = archives or archives_of(spark, sf_dir)
    return dealt_rows(spark, sf_dir, archives, wanted).mapInArrow(_writer(folder, archives), PACKED_SCHEMA)


def archives_to_read(spark: SparkSession, sf_dir: str, folder: str, archives: int) -> DataFrame:
    """(uri) of every archive, written to the folder by the task that gives its name; a task run again writes its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = posixpath.join(folder, uuid.uuid4().hex)
        for packed in _writer(mine, archives)(batches):
            yield pa.RecordBatch.from_pydict({"uri": [posixpath.join(mine, name) for name in packed.column("archive").to_pylist()]})

    return dealt_rows(spark, sf_dir, archives).mapInArrow(run, "uri string")


def read_packed(spark: SparkSession, sf_dir: str, archives: int, **options) -> DataFrame:
    """Account versions of the synthetic ledger, as `read_accounts` gives them; an archive is there only while its task reads it."""
    return read_as_packed(dealt_rows(spark, sf_dir, archives), lambda folder: _writer(folder, archives), **options)


def known_mint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known-mints text: keys of every third part, some spaced or repeated, with blank and bad lines."""
    key = F.col("p_partkey")
    mint = F.unhex(F.sha2(F.concat(F.lit("mint:"), key.cast("string")), 256))
    text = F.col("text")
    keys = (
        table(spark, sf_dir, "part")
        .where(key % 3 == 0)
        .select(key, to_base58(mint).alias("text"))
        .withColumn("text", F.when(key % 9 == 0, F.concat(F.lit("  "), text, F.lit(" "))).otherwise(text))
        .select(F.explode(F.when(key % 15 == 0, F.array(text, text)).otherwise(F.array(text))).alias("value"))
    )
    odd = spark.range(1).select(F.explode(F.array(F.lit(""), F.lit("   "), F.lit("not-base58-0OIl"))).alias("value"))
    return keys.unionByName(odd)
