import os

import pyarrow as pa
import pyarrow.parquet as pq

from fixtures.ledger import NARROW, encoded
from ledgerlake.operators.decoders import MINTS
from ledgerlake.operators.membership import key_matrix
from ledgerlake.schemas import TOKEN_PROGRAM, ZERO_KEY
from tests.conftest import key, record, token_data

MAX_U64 = 2**64 - 1
TOKEN = {"k": 5, "line": 3, "part": 9, "supplier": 4, "quantity": 2, "flag": "R", "status": "O"}


def records(*rows: dict) -> list[bytes]:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema(
        [("archive_no", pa.int32()), ("member_no", pa.int32()), ("kind", pa.string())]
        + [(name, types[kind]) for name, kind in NARROW.items()]
    )
    batch = pa.RecordBatch.from_pylist([{"archive_no": 0, "member_no": 1} | row for row in rows], schema=schema)
    (found,) = encoded(iter([batch]))
    assert found.column("archive_no").to_pylist() == [0] * len(rows)
    return found.column("rec").to_pylist()


def token_record(name: str, **changes) -> bytes:
    data = token_data(
        mint=key("mint:9"), owner=key("wallet:4"), amount=MAX_U64, delegate=(1, key("wallet:5")), state=1,
        is_native=(0, 2039280), delegated=3, close=(0, key("close:4")),
    )
    fields = {"pubkey": key(name), "owner": TOKEN_PROGRAM, "lamports": 2039280, "write_version": 9, "rent_epoch": MAX_U64}
    return record(**(fields | {"hash_": key("hash:" + name), "data": data} | changes))


def test_records_are_those_of_the_layout_and_keep_their_order():
    wallet = record(
        pubkey=key("wallet:103"), owner=ZERO_KEY, lamports=MAX_U64, write_version=103, rent_epoch=361, hash_=key("hash:wallet:103")
    )
    rows = [{"kind": "token"} | TOKEN, {"kind": ""}, {"kind": "wallet", "k": 103}, {"kind": "token"} | TOKEN]
    token = token_record("token:5:3")
    assert records(*rows) == [token, b"", wallet, token]


def test_a_name_leaves_out_a_null_and_other_nulls_leave_no_record():
    nulls = [TOKEN | {name: None} for name in ("k", "part", "supplier", "line")]
    found = records(*[{"kind": "token"} | row for row in nulls], {"kind": "wallet", "k": 5}, {"kind": "mint", "k": 5})
    assert found == [token_record("token:3"), b"", b"", b"", b"", b""]


def test_keys_of_a_cut_column_and_of_other_widths():
    keys = pa.array([key("a"), None, b"short", key("b"), key("c")], pa.binary())
    assert [k.tobytes() for k in key_matrix(keys)] == [key("a"), key("b"), key("c")]
    assert [k.tobytes() for k in key_matrix(keys.slice(1, 3))] == [key("b")]
    assert key_matrix(keys.slice(1, 2)).shape == (0, 32)


def test_each_store_has_the_columns_its_queries_read(lake):
    assert "data" not in lake.headers.columns and "hash" in lake.headers.columns
    mints = lake.decoded(MINTS)
    assert set(mints.columns) == {"pubkey", "owner", "data_len", "data", "decoder"}
    assert (lake.headers.count(), mints.count()) == (6414, 200)
    for folder, _, files in os.walk(f"{lake.root}/headers"):
        for file in files:
            if file.endswith(".parquet"):
                assert pq.ParquetFile(f"{folder}/{file}").metadata.row_group(0).column(0).compression == "ZSTD"
