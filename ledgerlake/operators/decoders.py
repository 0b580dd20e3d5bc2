"""Decoders: a record layout as data, compiled to native column expressions and to NumPy.

A decoder names an owner and what the data must look like, and lists the fields of the data.
More decoders need no Python functions, only another `Decoder` value. The two forms give the
same rows: `Column`s over stored versions, and Arrow arrays where an archive is walked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import binary
from ledgerlake.operators.walk import RecordView, Rule, binary_array, u64_array
from ledgerlake.schemas import KEY_BYTES, MINT_BYTES, TOKEN_ACCOUNT_BYTES, TOKEN_PROGRAM

OTHER = "other"
_READERS = {
    "key": lambda data, at: binary.field(data, at, KEY_BYTES),
    "u64": binary.u64,
    "u32": lambda data, at: binary.u64(F.concat(binary.field(data, at, 4), F.lit(bytearray(4))), 0),
    "u8": binary.u8,
    "flag": lambda data, at: binary.field(data, at, 1) != F.lit(bytearray(1)),
}
_WIDTHS = {"key": KEY_BYTES, "u64": 8, "u32": 4, "u8": 1, "flag": 1}
_U64 = pa.decimal128(20, 0)
_ARROW = {"key": pa.binary(), "u64": _U64, "u32": _U64, "u8": pa.int16(), "flag": pa.bool_()}


@dataclass(frozen=True)
class Field:
    """A field at a byte offset; an optional one has a u32 tag there and its value after it."""

    name: str
    kind: str
    offset: int
    optional: bool = False

    def read(self, data: Column) -> Column:
        reader = _READERS[self.kind]
        if self.optional:
            return binary.optional(data, self.offset, reader(data, self.offset + 4))
        return reader(data, self.offset)

    @property
    def end(self) -> int:
        """Bytes of data that the field needs."""
        return self.offset + 4 * self.optional + _WIDTHS[self.kind]

    def arrow(self) -> pa.Field:
        return pa.field(self.name, _ARROW[self.kind], nullable=self.optional)

    def bytes_of(self, front: np.ndarray) -> np.ndarray:
        """The bytes of the value, from data as rows of bytes."""
        return np.ascontiguousarray(front[:, self.end - _WIDTHS[self.kind] : self.end])

    def array(self, front: np.ndarray) -> pa.Array:
        """The field of data as rows of bytes: what `read` gives."""
        there = None
        if self.optional:
            tag = np.ascontiguousarray(front[:, self.offset : self.offset + 4])
            there = tag.view("<u4")[:, 0] == 1
        value = self.bytes_of(front)
        if self.kind == "key":
            return binary_array(value, there)
        if self.kind in ("u64", "u32"):
            return u64_array(value.view("<u8" if self.kind == "u64" else "<u4")[:, 0].astype("<u8"), _U64, there)
        plain = value[:, 0].astype(np.int16) if self.kind == "u8" else value[:, 0] != 0
        return pa.array(plain, mask=None if there is None else ~there)


@dataclass(frozen=True)
class Decoder:
    """Decodes accounts of one owner into the table `name`.

    An account matches if its data has `data_len` bytes, or up to `most_len` if
    that is given, and `prefix` stands at `prefix_at` of it. All fields must lie
    within the first `data_len` bytes.
    `known_by` is the column (`pubkey` or a key field) that must be a known
    mint unless spam is included.
    """

    name: str
    owner: bytes
    data_len: int
    fields: Sequence[Field]
    known_by: str | None = None
    most_len: int | None = None
    prefix: bytes = b""
    prefix_at: int = 0

    def __post_init__(self):
        needed = max([field.end for field in self.fields] + [self.prefix_at + len(self.prefix)])
        if needed > self.data_len or self.rule.most < self.data_len:
            raise ValueError(f"{self.name}: {needed} bytes are read of data of {self.data_len} to {self.rule.most}")

    @property
    def rule(self) -> Rule:
        most = self.data_len if self.most_len is None else self.most_len
        return Rule(self.owner, self.data_len, most, self.prefix, self.prefix_at)

    def matches(self) -> Column:
        """Where the decoder takes an account version; with a prefix, its data must be there."""
        same = (F.col("owner") == binary.key(self.owner)) & F.col("data_len").between(self.data_len, self.rule.most)
        if not self.prefix:
            return same
        found = binary.field(F.col("data"), self.prefix_at, len(self.prefix)) == binary.key(self.prefix)
        return same & F.coalesce(found, F.lit(False))

    def arrow_schema(self) -> pa.Schema:
        return pa.schema([pa.field("pubkey", pa.binary(), nullable=False), *(field.arrow() for field in self.fields)])

    def key_of(self, view: RecordView, at: np.ndarray) -> np.ndarray:
        """Bytes of the column that must be known, for records that match."""
        field = next((f for f in self.fields if f.name == self.known_by), None)
        if field is None:
            return view.key(at, "pubkey").view(np.uint8)
        return field.bytes_of(view.front(at, 0, self.data_len))

    def batch(self, view: RecordView, at: np.ndarray) -> pa.RecordBatch:
        """Decoded rows of records that match."""
        front = view.front(at, 0, self.data_len)
        columns = [binary_array(view.key(at, "pubkey").view(np.uint8)), *(field.array(front) for field in self.fields)]
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow_schema())

    def columns(self) -> list[Column]:
        return [field.read(F.col("data")).alias(field.name) for field in self.fields]

    def table(self, versions: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Decoded rows of all versions that match; of known mints only when `known` is given.

        The semi-join comes before decoding: only its key is read first.
        """
        rows = versions.where(self._chosen(versions)).select("pubkey", "data")
        if known is not None and self.known_by is not None:
            from ledgerlake.operators.membership import only_listed  # reads files as the sources do, which import this module

            key_field = next((f for f in self.fields if f.name == self.known_by), None)
            tested = F.col("pubkey") if key_field is None else key_field.read(F.col("data"))
            rows = only_listed(rows, tested, known)
        return rows.select("pubkey", *self.columns())

    def _chosen(self, versions: DataFrame) -> Column:
        if "decoder" in versions.columns:
            return F.col("decoder") == self.name
        return self.matches()


MINTS = Decoder(
    "mints",
    TOKEN_PROGRAM,
    MINT_BYTES,
    (
        Field("mint_authority", "key", 0, optional=True),
        Field("freeze_authority", "key", 46, optional=True),
        Field("supply", "u64", 36),
        Field("decimals", "u8", 44),
        Field("is_initialized", "flag", 45),
    ),
    known_by="pubkey",
)

TOKEN_ACCOUNTS = Decoder(
    "token_accounts",
    TOKEN_PROGRAM,
    TOKEN_ACCOUNT_BYTES,
    (
        Field("mint", "key", 0),
        Field("owner", "key", 32),
        Field("amount", "u64", 64),
        Field("delegate", "key", 72, optional=True),
        Field("state", "u8", 108),
        Field("is_native", "u64", 109, optional=True),
        Field("delegated_amount", "u64", 121),
        Field("close_authority", "key", 129, optional=True),
    ),
    known_by="mint",
)

DEFAULT_DECODERS = (MINTS, TOKEN_ACCOUNTS)


def dispatch(decoders: Sequence[Decoder] = DEFAULT_DECODERS) -> Column:
    """Name of the first decoder that matches a version, else `other`."""
    chosen = F.lit(OTHER)
    for decoder in reversed(decoders):
        chosen = F.when(decoder.matches(), decoder.name).otherwise(chosen)
    return chosen


def first_matches(decoders: Sequence[Decoder]) -> list[Decoder]:
    """The decoders that can be first to match: none that repeats an earlier one's rule."""
    first: dict[Rule, Decoder] = {}
    for decoder in decoders:
        first.setdefault(decoder.rule, decoder)
    return list(first.values())


def kept_data(decoders: Sequence[Decoder]) -> list[list]:
    """The rules of the records whose data must be kept, as JSON can hold them."""
    return [[d.rule.owner.hex(), d.rule.least, d.rule.most, d.rule.prefix.hex(), d.rule.prefix_at] for d in decoders]


def rule_of(kept: Sequence) -> Rule:
    """A rule from what `kept_data` gives; a single length may stand alone."""
    owner, least, *rest = kept
    most, prefix, at = [*rest, *(least, "", 0)[len(rest):]]
    return Rule(bytes.fromhex(owner), least, most, bytes.fromhex(prefix), at)


def is_nft(supply: Column, decimals: Column) -> Column:
    return (supply == 1) & (decimals == 0)
