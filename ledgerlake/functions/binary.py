"""Little-endian integers, optional values and keys inside binary columns, as native expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.schemas import KEY_BYTES, U64

LOW_NIBBLES = 0x0F0F0F0F0F0F0F0F
TWO_TO_64 = Decimal(2**64)


def key(value: bytes) -> Column:
    """A literal key."""
    return F.lit(bytearray(value))


def is_zero(column: Column) -> Column:
    return column == key(bytes(KEY_BYTES))


def field(data: Column, offset: int, length: int) -> Column:
    return F.substring(data, offset + 1, length)


def u8(data: Column, offset: int) -> Column:
    return F.conv(F.hex(field(data, offset, 1)), 16, 10).cast("smallint")


def _swap_nibbles(value: Column) -> Column:
    mask = F.lit(LOW_NIBBLES)
    return F.shiftleft(value.bitwiseAND(mask), 4).bitwiseOR(
        F.shiftrightunsigned(value, 4).bitwiseAND(mask)
    )


def i64_le(data: Column, offset: int) -> Column:
    """Eight bytes as a signed bigint.

    Reversing the hex text puts the bytes in order with the two nibbles of
    each byte exchanged; one mask-and-shift exchanges them back. (`reverse` on
    the binary itself would treat it as UTF-8 text.)
    """
    text = F.reverse(F.hex(field(data, offset, 8)))
    return _swap_nibbles(F.conv(text, 16, -10).cast("bigint"))


def unsigned(value: Column) -> Column:
    """The u64 with the bits of a bigint, as decimal(20,0)."""
    exact = value.cast(U64)
    return F.when(value >= 0, exact).otherwise((exact + F.lit(TWO_TO_64)).cast(U64))


def u64_of(rows: DataFrame, name: str) -> Column:
    """A u64 column as decimal(20,0), whether it is stored as that or as bits."""
    return unsigned(F.col(name)) if dict(rows.dtypes)[name] == "bigint" else F.col(name)


def u64(data: Column, offset: int) -> Column:
    return unsigned(i64_le(data, offset))


def has_value(data: Column, offset: int) -> Column:
    """An optional value is there only where its u32 tag is 1."""
    return field(data, offset, 4) == F.lit(bytearray(b"\x01\x00\x00\x00"))


def optional(data: Column, offset: int, value: Column) -> Column:
    return F.when(has_value(data, offset), value)


def le64(value: Column) -> Column:
    """A bigint's bits as eight little-endian bytes: the inverse of `i64_le`."""
    return F.unhex(F.reverse(F.lpad(F.hex(_swap_nibbles(value.cast("bigint"))), 16, "0")))


def align(value: Column, step: int) -> Column:
    """Rounded up to a power-of-two step."""
    return (value + F.lit(step - 1)).bitwiseAND(F.lit(-step))
