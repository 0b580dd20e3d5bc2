import hashlib
import io
import os
import sys

import pytest
import zstandard
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fixtures.lake import lake_of  # noqa: E402
from fixtures.pack import tar_member  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lake(spark):
    return lake_of(spark, SF_DIR)


def key(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def record(
    *,
    pubkey: bytes = key("a"),
    owner: bytes = key("o"),
    lamports: int = 1,
    data: bytes = b"",
    data_len: int | None = None,
    write_version: int = 7,
    rent_epoch: int = 0,
    executable: int = 0,
    hash_: bytes = key("h"),
) -> bytes:
    """One encoded record with its padding, made without the library."""

    def u64(value: int) -> bytes:
        return value.to_bytes(8, "little")

    head = u64(write_version) + u64(len(data) if data_len is None else data_len) + pubkey
    head += u64(lamports) + u64(rent_epoch) + owner + bytes([executable]) + bytes(7) + hash_
    return head + data + bytes(-len(data) % 8)


def mint_data(*, authority=(1, key("auth")), supply=5, decimals=2, initialized=1, freeze=(0, bytes(32))) -> bytes:
    def option(pair):
        return pair[0].to_bytes(4, "little") + pair[1]

    return option(authority) + supply.to_bytes(8, "little") + bytes([decimals, initialized]) + option(freeze)


def token_data(
    *,
    mint=key("m"),
    owner=key("w"),
    amount=9,
    delegate=(0, bytes(32)),
    state=1,
    is_native=(0, 0),
    delegated=0,
    close=(0, bytes(32)),
) -> bytes:
    def u32(value):
        return value.to_bytes(4, "little")

    def u64(value):
        return value.to_bytes(8, "little")

    return (
        mint + owner + u64(amount) + u32(delegate[0]) + delegate[1] + bytes([state])
        + u32(is_native[0]) + u64(is_native[1]) + u64(delegated) + u32(close[0]) + close[1]
    )


def tar_zst(*members: bytes, ending: bytes = bytes(1024)) -> bytes:
    return zstandard.ZstdCompressor().compress(b"".join(members) + ending)


def write_archive(folder, name: str, *members: bytes) -> str:
    (folder / name).write_bytes(tar_zst(*members))
    return str(folder)


def account_member(name: str, *records: bytes) -> bytes:
    return tar_member(name, b"".join(records))


def stream(data: bytes) -> io.BytesIO:
    return io.BytesIO(data)
