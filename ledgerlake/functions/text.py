"""Values and accounts as display text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.base58 import to_base58
from ledgerlake.functions.binary import u64_of


@F.arrow_udf(T.StringType())
def four_decimals(values: pa.Array) -> pa.Array:
    """Four decimals, rounded from the exact binary value, halves to even.

    (`format_string` rounds the shortest decimal text instead, halves up.) Whole
    columns are formatted at once; only values whose rounding the scaled double
    cannot tell, at halves and beyond 2^53 ten-thousandths, are taken one by one.
    """
    numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.abs(numbers)
    with np.errstate(invalid="ignore"):
        whole = np.floor(size)
        scaled = (size - whole) * 1e4
        sure = (size < 2**53 / 1e4) & (np.abs(scaled - np.floor(scaled) - 0.5) > 1e-6)
    digits = np.where(sure, np.rint(scaled), 0).astype(np.int64)
    whole = np.where(sure, whole, 0).astype(np.int64) + digits // 10_000
    sign = pc.if_else(pa.array(np.signbit(numbers)), "-", "")
    fraction = pc.utf8_lpad(pc.cast(pa.array(digits % 10_000), pa.string()), 4, "0")
    text = pc.binary_join_element_wise(sign, pc.cast(pa.array(whole), pa.string()), ".", fraction, "")
    hard = ["NaN" if v != v else f"{v:.4f}" for v in numbers[~sure].tolist()]
    text = pc.replace_with_mask(text, pa.array(~sure), pa.array(hard, pa.string()))
    return pc.if_else(pc.is_valid(values), text, pa.scalar(None, pa.string()))


def as_text(column: Column, kind: T.DataType) -> Column:
    """One value as text: NULL as `NULL`, floats with four decimals, binary as base58."""
    if isinstance(kind, T.BinaryType):
        text = to_base58(column)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = four_decimals(column.cast("double"))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def format_rows(rows: DataFrame) -> DataFrame:
    """Every column of a result as text, by position, so that names may repeat; nothing is collected here."""
    names = [f"c{n}" for n in range(len(rows.columns))]
    texts = [as_text(F.col(name), f.dataType).alias(name) for name, f in zip(names, rows.schema)]
    return rows.toDF(*names).select(*texts).toDF(*rows.columns)


def describe_account(versions: DataFrame) -> Column:
    """One line of text about each account version."""
    shown = [
        ("version", u64_of(versions, "write_version")),
        ("data_len", u64_of(versions, "data_len")),
        ("pubkey", to_base58("pubkey")),
        ("lamports", u64_of(versions, "lamports")),
        ("rent_epoch", u64_of(versions, "rent_epoch")),
        ("owner", to_base58("owner")),
        ("executable", F.col("executable")),
        ("hash", to_base58("hash")),
    ]
    return F.concat_ws(", ", *[F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in shown])
