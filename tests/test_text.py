from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlake.functions import base58
from ledgerlake.functions.text import describe_account, format_rows
from ledgerlake.operators.records import read_accounts
from ledgerlake.schemas import STORED_VERSIONS
from tests.conftest import account_member, key, record, write_archive


def test_values_as_text(spark):
    rows = spark.createDataFrame(
        [
            (True, 1, 2**40, Decimal(2**64 - 1), 0.5, 1.00005, "x", bytearray(b"\0a"), date(2024, 1, 2)),
            (None,) * 9,
        ],
        "b boolean, i int, l bigint, u decimal(20,0), f float, d double, s string, k binary, o date",
    )
    first, second = format_rows(rows).collect()
    assert tuple(first) == (
        "true", "1", str(2**40), "18446744073709551615", "0.5000", "1.0001", "x", base58.encode(b"\0a"), "2024-01-02",
    )
    assert set(second) == {"NULL"}


def test_halves_round_to_even(spark):
    rows = spark.createDataFrame([(0.03125,), (0.09375,), (0.00015,), (float("nan"),), (float("inf"),), (-0.0,)], "d double")
    assert [r.d for r in format_rows(rows).collect()] == ["0.0312", "0.0938", "0.0001", "NaN", "inf", "-0.0000"]


def test_one_line_per_account(spark, tmp_path):
    write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", record(executable=2, rent_epoch=2**64 - 1)))
    decimals = read_accounts(spark, str(tmp_path))
    bits = read_accounts(spark, str(tmp_path), schema=STORED_VERSIONS)
    line, same = (rows.select(describe_account(rows)).first()[0] for rows in (decimals, bits))
    assert line == same
    a, o, h = (base58.encode(key(n)) for n in "aoh")
    assert line == (
        f"version: 7, data_len: 0, pubkey: {a}, lamports: 1, rent_epoch: 18446744073709551615,"
        f" owner: {o}, executable: 2, hash: {h}"
    )


def test_repeated_names_and_backticks(spark):
    rows = spark.sql("SELECT 1 AS a, 2.5D AS a, CAST(NULL AS DOUBLE) AS `b``c`")
    found = format_rows(rows)
    assert found.columns == ["a", "a", "b`c"]
    assert tuple(found.first()) == ("1", "2.5000", "NULL")


def test_four_decimals_of_many_values(spark):
    import random

    draw = random.Random(3)
    values = [draw.choice([1, -1]) * draw.random() * 10.0 ** draw.randint(-6, 20) for _ in range(3000)]
    values += [n / 32 for n in range(-64, 64)] + [0.99995, 0.99999, -0.00001, 2.0**53, 1e300, float("-inf")]
    rows = spark.createDataFrame([(v,) for v in values], "d double").coalesce(1)
    assert [r.d for r in format_rows(rows).collect()] == [f"{v:.4f}" for v in values]
