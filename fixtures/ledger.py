"""Driver tables as account records (see FIXTURES.md).

Spark deals narrow rows to archives and members; the task that packs an archive encodes its rows there, a batch at a
time. (As one native expression over all kinds the encoding was a method too large for the JVM to compile.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.schemas import (
    KEY_BYTES,
    MINT_BYTES,
    RECORD_HEADER_BYTES,
    TOKEN_ACCOUNT_BYTES,
    TOKEN_PROGRAM,
    ZERO_KEY,
)

MAX_U64 = -1  # the bits of 2^64 - 1 in a bigint
ROWS_PER_ARCHIVE = 75_000
ROWS_PER_LARGE_ARCHIVE = 8_000_000
SMALL_ARCHIVES = 4_096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive_count(rows: int) -> int:
    """Archives for this many lineitem rows: small ones first, then ever more of full size."""
    small = -(-rows // ROWS_PER_ARCHIVE)
    large = -(-rows // ROWS_PER_LARGE_ARCHIVE)
    return max(4, min(small, max(SMALL_ARCHIVES, large)))


def first_incremental(archives: int) -> int:
    return archives * 3 // 4


# One narrow row per record is what gets shuffled; the bytes are made after it.
NARROW = {
    "k": "bigint",
    "line": "int",
    "part": "bigint",
    "supplier": "bigint",
    "quantity": "bigint",
    "size": "int",
    "nation": "int",
    "flag": "string",
    "status": "string",
}


def _narrow(rows: DataFrame, kind: str, spread: Column, **values: Column) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("kind"),
        spread.cast("bigint").alias("spread"),
        *[values.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in NARROW.items()],
    )


def narrow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's rows that become records, as narrow rows of one shape."""
    col = F.col
    order, part, supplier, line = (
        col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    )
    quantity = col("l_quantity").cast("bigint")
    simple = [
        ("customer", "wallet", "c_custkey", {"nation": col("c_nationkey")}),
        ("part", "mint", "p_partkey", {"size": col("p_size")}),
        ("supplier", "program", "s_suppkey", {}),
        ("nation", "decoy_len", "n_nationkey", {}),
        ("region", "decoy_owner", "r_regionkey", {}),
    ]
    kinds = [
        _narrow(table(spark, sf_dir, name), kind, col(key), k=col(key), **more)
        for name, kind, key, more in simple
    ]
    # Many columns take part in spreading lineitems over members, so that one
    # hot order, part or supplier does not fill one member.
    kinds.append(
        _narrow(
            table(spark, sf_dir, "lineitem"),
            "token",
            order + part + supplier * 3 + line + quantity,
            k=order,
            line=line,
            part=part,
            supplier=supplier,
            quantity=quantity,
            flag=col("l_returnflag"),
            status=col("l_linestatus"),
        )
    )
    return reduce(DataFrame.unionByName, kinds)


def dealt_rows(spark: SparkSession, sf_dir: str, archives: int, wanted: range | None = None) -> DataFrame:
    """(archive_no, member_no, narrow row) by archive and member, plus one row without a record per member; of all archives or those wanted."""
    wanted = range(archives) if wanted is None else wanted
    marker = F.col("id")
    rows = narrow_rows(spark, sf_dir).unionByName(_narrow(spark.range(archives * 2), "", marker))
    member = F.pmod("spread", F.lit(archives * 2)).cast("int")
    return (
        rows.withColumn("member_no", member)
        .withColumn("archive_no", F.floor(member / 2).cast("int"))
        .where(F.col("archive_no").isNull() | F.col("archive_no").between(wanted.start, wanted.stop - 1))  # one without a member fails below
        .repartitionById(len(wanted), F.col("archive_no") - wanted.start)
        .sortWithinPartitions("archive_no", "member_no")
        .select("archive_no", "member_no", "kind", *NARROW)
    )


def keys_of(texts: Iterable[bytes]) -> np.ndarray:
    """K(text) of each text, as rows of bytes."""
    return np.frombuffer(b"".join([sha256(text).digest() for text in texts]), np.uint8).reshape(-1, KEY_BYTES)


def _id_keys(prefix: bytes, ids: np.ndarray) -> np.ndarray:
    """K(prefix, id) of each id; one that repeats is worked out once."""
    kinds, place = np.unique(ids, return_inverse=True)
    return keys_of([prefix + b"%d" % i for i in kinds.tolist()])[place]


class _Cells(NamedTuple):
    """A column of whole numbers: its values, 0 where there is none, and where there is one."""

    value: np.ndarray
    there: np.ndarray


def _cells(column: pa.Array) -> _Cells:
    return _Cells(column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False))


def _texts(column: pa.Array, text: str) -> np.ndarray:
    """Where a column of text is this one."""
    return pc.equal(column, text).fill_null(False).to_numpy(zero_copy_only=False)


def _mod(value: np.ndarray, by: int) -> np.ndarray:
    return np.fmod(value, by)  # the sign of the value, as in SQL


def _low_byte(value: np.ndarray) -> np.ndarray:
    return np.where(value < 0, 0xFF, value).astype(np.uint8)


class _Records:
    """Records of one kind and data length as rows of bytes; `there` is off for those that lack a value."""

    def __init__(self, count: int, length: int, there: np.ndarray):
        self.rows = np.zeros((count, RECORD_HEADER_BYTES + -(-length // 8) * 8), np.uint8)
        self.there = there
        self.number(8, length)

    def number(self, at: int, value: np.ndarray | int, width: int = 8) -> None:
        column = np.broadcast_to(np.asarray(value, dtype="<i8"), len(self.rows))
        self.rows[:, at : at + width] = np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8)[:, :width]

    def put(self, at: int, value: bytes | np.ndarray) -> None:
        value = np.frombuffer(value, np.uint8) if isinstance(value, bytes) else value
        self.rows[:, at : at + value.shape[-1]] = value

    def header(self, names: list[bytes], *, version, lamports, rent, owner: bytes, executable=None) -> None:
        self.number(0, version)
        self.put(16, keys_of(names))
        self.number(48, lamports)
        self.number(56, rent)
        self.put(64, owner)
        if executable is not None:
            self.rows[:, 96] = executable
        self.put(104, keys_of([b"hash:" + name for name in names]))


DATA = RECORD_HEADER_BYTES  # where the data of a record begins


def _names(kind: bytes, ids: np.ndarray) -> list[bytes]:
    return [kind + b":%d" % i for i in ids.tolist()]


def _wallets(rows: dict) -> _Records:
    (k, there), nation = rows["k"], rows["nation"]
    dead, full = _mod(k, 10) == 0, _mod(k, 100) == 3
    found = _Records(len(k), 0, there & (nation.there | dead | full))
    lamports = np.where(dead, 0, np.where(full, MAX_U64, k * 1000 + nation.value))
    rent = np.where(_mod(k, 2) == 0, MAX_U64, 361)
    found.header(_names(b"wallet", k), version=k, lamports=lamports, rent=rent, owner=ZERO_KEY)
    return found


def _mints(rows: dict) -> _Records:
    (k, there), size = rows["k"], rows["size"]
    nft, of = _mod(k, 50) == 1, size.value
    found = _Records(len(k), MINT_BYTES, there & size.there)
    lamports = np.where(_mod(k, 20) == 0, 0, 1461600)
    found.header(_names(b"mint", k), version=k, lamports=lamports, rent=MAX_U64, owner=TOKEN_PROGRAM)
    found.number(DATA, np.where(_mod(k, 30) == 0, 2, np.where(_mod(k, 3) == 1, 0, 1)), 4)
    found.put(DATA + 4, _id_keys(b"authority:", of))
    found.number(DATA + 36, np.where(k == 9, MAX_U64, np.where(nft, 1, k * 1000 + of)))
    found.rows[:, DATA + 44] = _low_byte(np.where(nft, 0, _mod(of, 10)))
    fourth = _mod(k, 4)
    found.rows[:, DATA + 45] = np.where(fourth == 0, 0, np.where(fourth == 2, 2, 1))
    found.number(DATA + 46, of > 25, 4)
    found.put(DATA + 50, _id_keys(b"freeze:", of))
    return found


def _tokens(rows: dict) -> _Records:
    order, line, part, supplier, quantity = (rows[n] for n in ("k", "line", "part", "supplier", "quantity"))
    returned, closed = _texts(rows["flag"], "R"), _texts(rows["flag"], "A")
    full = _mod(part.value, 300) == 9
    there = part.there & supplier.there & (full | (quantity.there & line.there)) & (line.there | ~returned)
    found = _Records(len(part.value), TOKEN_ACCOUNT_BYTES, there)
    names = _names(b"token", order.value)
    numbered = line.there.tolist()
    names = [name + b":%d" % n if has else name for name, n, has in zip(names, line.value.tolist(), numbered)]
    for row in np.flatnonzero(~order.there).tolist():  # a name leaves out what is null
        names[row] = b"token:%d" % line.value[row] if numbered[row] else b"token"
    lamports = np.where(line.there & (line.value == 7), 0, 2039280)
    found.header(names, version=part.value, lamports=lamports, rent=MAX_U64, owner=TOKEN_PROGRAM)
    found.put(DATA, _id_keys(b"mint:", part.value + 3 * (_mod(part.value, 30) == 6)))
    found.put(DATA + 32, _id_keys(b"wallet:", supplier.value))
    found.number(DATA + 64, np.where(full, MAX_U64, quantity.value * 1000 + line.value))
    found.number(DATA + 72, returned, 4)
    found.put(DATA + 76, _id_keys(b"wallet:", supplier.value + 1))
    found.rows[:, DATA + 108] = np.where(_texts(rows["status"], "O"), 1, 2)
    found.number(DATA + 109, _mod(part.value, 100) == 0, 4)
    found.number(DATA + 113, 2039280)
    found.number(DATA + 121, np.where(returned, line.value, 0))
    found.number(DATA + 129, closed, 4)
    found.put(DATA + 133, _id_keys(b"close:", supplier.value))
    return found


def _programs(rows: dict) -> _Records:
    k, there = rows["k"]
    found = _Records(len(k), 36, there)
    executable = _low_byte(_mod(k, 3))
    owner = sha256(b"loader").digest()
    found.header(_names(b"program", k), version=k, lamports=k + 1000000, rent=0, owner=owner, executable=executable)
    found.number(DATA, 2, 4)
    found.put(DATA + 4, _id_keys(b"programdata:", k))
    return found


def _decoys(kind: bytes, owner: bytes, lamports: int, length: int):
    def encode(rows: dict) -> _Records:
        k, there = rows["k"]
        found = _Records(len(k), length, there)
        found.header(_names(kind, k), version=k, lamports=k + lamports, rent=0, owner=owner)
        found.put(DATA, b"\x01" * length)
        return found

    return encode


_KINDS = {
    "token": _tokens,
    "wallet": _wallets,
    "mint": _mints,
    "program": _programs,
    "decoy_len": _decoys(b"decoy_len", TOKEN_PROGRAM, 5000, 170),
    "decoy_owner": _decoys(b"decoy_owner", sha256(b"other").digest(), 6000, 82),
}


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(archive_no, member_no, rec) of narrow rows, in their order; no bytes for a kind without records or a row that lacks a value."""
    for batch in batches:
        kinds = batch.column("kind").dictionary_encode()
        kind_of = kinds.indices.to_numpy(zero_copy_only=False)
        made = []
        lengths = np.zeros(batch.num_rows, np.int64)
        for number, kind in enumerate(kinds.dictionary.to_pylist()):
            if kind not in _KINDS:
                continue
            at = np.flatnonzero(kind_of == number)
            mine = batch.take(pa.array(at))
            rows = {name: mine.column(name) if type_ == "string" else _cells(mine.column(name)) for name, type_ in NARROW.items()}
            found = _KINDS[kind](rows)
            at, records = at[found.there], found.rows[found.there]
            lengths[at] = records.shape[1]
            made.append((at, records))
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        out = np.zeros(offsets[-1], np.uint8)
        window = np.lib.stride_tricks.sliding_window_view
        for at, records in made:
            if len(at):
                window(out, records.shape[1], writeable=True)[offsets[at]] = records
        rec = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([batch.column("archive_no"), batch.column("member_no"), rec], ["archive_no", "member_no", "rec"])
