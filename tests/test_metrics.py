import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import base58
from ledgerlake.operators.filters import SnapshotFilters
from ledgerlake.plans.run import process_snapshot
from ledgerlake.schemas import TOKEN_PROGRAM
from tests.conftest import account_member, key, mint_data, record, write_archive


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    mint = record(pubkey=key("m"), owner=TOKEN_PROGRAM, data=mint_data())
    records = [record(data=b"1"), record(lamports=0), record(), mint]
    write_archive(folder, "snapshot-1.tar.zst", account_member("accounts/1.1", *records))
    write_archive(folder, "incremental-snapshot-2.tar.zst", account_member("accounts/1.1", record()))
    (tmp_path / "known.txt").write_text(base58.encode(key("m")) + "\n\nbad0\n")
    return tmp_path


def test_one_call_publishes_and_sums_up(spark, landing):
    row = process_snapshot(
        spark, f"{landing}/in", f"{landing}/out", known_mints=f"{landing}/known.txt"
    ).first()
    size = (landing / "in" / "snapshot-1.tar.zst").stat().st_size
    assert (row.rows_parsed, row.record_bytes, row.compressed_bytes) == (3, 144 + 136 + 224, size)
    assert row.seconds > 0 and abs(row.mb_per_s - size / 1e6 / row.seconds) < 1e-9
    assert spark.read.parquet(f"{landing}/out/accounts").agg(F.count("*")).first()[0] == 3
    assert [bytes(r.pubkey) for r in spark.read.parquet(f"{landing}/out/mints").collect()] == [key("m")]


def test_incremental_and_nothing_passing(spark, landing):
    spam = SnapshotFilters(include_spam=True)
    row = process_snapshot(spark, f"{landing}/in", f"{landing}/out", filters=spam, incremental=True).first()
    assert row.rows_parsed == 1
    none = SnapshotFilters(owner=base58.encode(key("nobody")), include_spam=True)
    row = process_snapshot(spark, f"{landing}/in", f"{landing}/none", filters=none).first()
    assert (row.rows_parsed, row.record_bytes) == (0, 0)
    assert spark.read.parquet(f"{landing}/none/accounts").count() == 0
