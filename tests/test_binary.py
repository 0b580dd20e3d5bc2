from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import binary

EDGES = [0, 1, 2**31, 2**32 - 1, 2**63 - 1, 2**63, 2**64 - 1, 0x0123456789ABCDEF, 4303299]


def test_u64_edges(spark):
    rows = spark.createDataFrame([(bytearray(b"\xff" + n.to_bytes(8, "little")),) for n in EDGES], "data binary")
    found = rows.select(binary.u64(F.col("data"), 1).alias("n"), binary.i64_le(F.col("data"), 1).alias("bits")).collect()
    assert [r.n for r in found] == [Decimal(n) for n in EDGES]
    assert [r.bits for r in found] == [n - 2**64 if n >= 2**63 else n for n in EDGES]


def test_bytes_that_look_like_utf8_text(spark):
    rows = spark.createDataFrame([(bytearray.fromhex("C3A9410000000000"),)], "data binary")
    assert rows.select(binary.u64(F.col("data"), 0)).first()[0] == 4303299


def test_le64_is_the_inverse(spark):
    bits = [n - 2**64 if n >= 2**63 else n for n in EDGES]
    rows = spark.createDataFrame([(n,) for n in bits], "n bigint")
    found = [bytes(r[0]) for r in rows.select(binary.le64(F.col("n"))).collect()]
    assert found == [n.to_bytes(8, "little") for n in EDGES]


@pytest.mark.parametrize("tag, present", [(0, False), (1, True), (2, False), (256, False), (257, False)])
def test_optional(spark, tag, present):
    data = tag.to_bytes(4, "little") + (77).to_bytes(8, "little")
    rows = spark.createDataFrame([(bytearray(data),)], "data binary")
    value = rows.select(binary.optional(F.col("data"), 0, binary.u64(F.col("data"), 4))).first()[0]
    assert value == (77 if present else None)


def test_u8_key_and_align(spark):
    rows = spark.createDataFrame([(bytearray(b"\x00\xff"), bytearray(32))], "data binary, k binary")
    row = rows.select(
        binary.u8(F.col("data"), 0), binary.u8(F.col("data"), 1), binary.is_zero(F.col("k")),
        F.col("k") == binary.key(b"\x01" * 32), *[binary.align(F.lit(n), 8) for n in (0, 1, 8, 9)],
    ).first()
    assert tuple(row) == (0, 255, True, False, 0, 8, 8, 16)
