"""Published schemas and the fixed byte layouts behind them."""

from pyspark.sql import types as T

# u64 values need 20 digits; a bigint would overflow at 2^63.
U64 = T.DecimalType(20, 0)

# The record layout and the token program's id.
RECORD_HEADER_BYTES = 136
MINT_BYTES = 82
TOKEN_ACCOUNT_BYTES = 165
KEY_BYTES = 32
TOKEN_PROGRAM = bytes.fromhex("06ddf6e1d765a193d9cbe146ceeb79ac1cb485ed5f5b37913a8cf5857eff00a9")
ZERO_KEY = bytes(KEY_BYTES)


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


ACCOUNTS = _table(
    ("pubkey", T.BinaryType(), False),
    ("lamports", U64, False),
    ("owner", T.BinaryType(), False),
    ("data_len", U64, False),
    ("executable", T.BooleanType(), False),
    ("rent_epoch", U64, False),
)

MINTS = _table(
    ("pubkey", T.BinaryType(), False),
    ("mint_authority", T.BinaryType(), True),
    ("freeze_authority", T.BinaryType(), True),
    ("supply", U64, False),
    ("decimals", T.ShortType(), False),
    ("is_initialized", T.BooleanType(), False),
)

TOKEN_ACCOUNTS = _table(
    ("pubkey", T.BinaryType(), False),
    ("mint", T.BinaryType(), False),
    ("owner", T.BinaryType(), False),
    ("amount", U64, False),
    ("delegate", T.BinaryType(), True),
    ("state", T.ShortType(), False),
    ("is_native", U64, True),
    ("delegated_amount", U64, False),
    ("close_authority", T.BinaryType(), True),
)

# One row per archive.
ARCHIVES = _table(("uri", T.StringType(), False))

# One row per chunk of a tar member. A chunk always holds whole records.
ENTRIES = _table(
    ("archive", T.StringType(), False),
    ("entry_no", T.LongType(), False),
    ("path", T.StringType(), False),
    ("typeflag", T.StringType(), False),
    ("size", T.LongType(), False),
    ("is_accounts", T.BooleanType(), False),
    ("chunk_no", T.IntegerType(), False),
    ("base_offset", T.LongType(), False),
    ("content", T.BinaryType(), True),
)

# One row per stored account version, `data` only where a decoder wants it.
ACCOUNT_VERSIONS = _table(
    ("archive", T.StringType(), False),
    ("path", T.StringType(), False),
    ("rec_offset", T.LongType(), False),
    ("write_version", U64, False),
    ("data_len", U64, False),
    ("pubkey", T.BinaryType(), False),
    ("lamports", U64, False),
    ("rent_epoch", U64, False),
    ("owner", T.BinaryType(), False),
    ("executable", T.ShortType(), False),
    ("hash", T.BinaryType(), False),
    ("data", T.BinaryType(), True),
)

# The same rows as they are stored between steps: each u64 is a bigint with the
# same bits, which Arrow, Parquet and codegen move much faster than a decimal.
# Equality is unchanged; `functions.binary.u64_of` gives the number.
STORED_VERSIONS = T.StructType(
    [T.StructField(f.name, T.LongType() if f.dataType == U64 else f.dataType, f.nullable) for f in ACCOUNT_VERSIONS]
)


def pick(schema: T.StructType, *names: str) -> T.StructType:
    """The named fields of a schema, in the order given."""
    return T.StructType([schema[name] for name in names])
