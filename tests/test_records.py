"""Reading archives: kinds, chunking, spreading and corrupt records."""

import pytest
from pyspark.errors import PythonException

from ledgerlake.operators import listing, records
from ledgerlake.operators.records import corrupt_records, read_accounts, too_large_for_one_task, unfold
from ledgerlake.schemas import ENTRIES
from ledgerlake.sources import register
from ledgerlake.sources.snapshot import packed
from tests.conftest import account_member, key, record, write_archive
from fixtures.pack import tar_member


def keys(rows):
    return sorted(bytes(r.pubkey) for r in rows.select("pubkey").collect())


@pytest.fixture
def archives(tmp_path):
    for n in range(3):
        body = [record(pubkey=key(f"{n}:{i}"), data=bytes(i)) for i in range(50)]
        write_archive(tmp_path, f"snapshot-{n}.tar.zst", account_member(f"accounts/{n}.{n}", *body))
    write_archive(tmp_path, "incremental-snapshot-9.tar.zst", account_member("accounts/9.9", record(pubkey=key("i"))))
    (tmp_path / "snapshot-4.tar.bz2").write_bytes(b"not read")
    (tmp_path / "notes.txt").write_text("not read")
    return str(tmp_path)


def test_small_archives_are_packed_into_tasks():
    archives = [("a", 10), ("b", 100), ("c", 20), ("d", 30)]
    assert packed(archives, 9) == [["b"], ["d"], ["c"], ["a"]]
    assert packed(archives, 3) == [["b"], ["d"], ["c", "a"]]
    assert packed(archives, 2) == [["b"], ["d", "c", "a"]]
    assert packed([], 10) == []


def test_packing_changes_no_row(spark, archives):
    register(spark)
    for least in (1, 2, 3, 100):
        rows = spark.read.format("ledger_accounts").option("minPartitions", least).load(archives)
        assert rows.count() == 151 and rows.rdd.getNumPartitions() <= max(least, 4)


def test_kinds(spark, archives):
    assert read_accounts(spark, archives).count() == 151
    assert read_accounts(spark, archives, kind="full").count() == 150
    assert keys(read_accounts(spark, archives, kind="incremental")) == [key("i")]
    assert read_accounts(spark, archives + "/snapshot-1.tar.zst").count() == 50
    assert read_accounts(spark, archives + "/snapshot-[01]*").count() == 100
    with pytest.raises(FileNotFoundError):
        read_accounts(spark, archives + "/missing")


def test_no_archives_of_a_kind(spark, tmp_path):
    write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", record()))
    assert read_accounts(spark, str(tmp_path), kind="incremental").count() == 0


def test_large_archives_are_told_by_their_share():
    assert too_large_for_one_task([("a", 10)] * 8, 8) == []
    assert too_large_for_one_task([("a", 10)] * 4, 8) == []
    assert too_large_for_one_task([("a", 100)] + [("b", 10)] * 20, 8) == []
    assert too_large_for_one_task([("a", 100)] + [("b", 10)] * 20, 80) == [("a", 100)]
    assert too_large_for_one_task([("a", 10)], 1) == []
    assert too_large_for_one_task([("a", 10)], 8) == [("a", 10)]
    assert too_large_for_one_task([], 8) == []


@pytest.mark.parametrize("large", [[], [0], [0, 2], [0, 1, 2, 3]])
def test_spreading_changes_no_row(spark, archives, monkeypatch, large):
    monkeypatch.setattr(records, "too_large_for_one_task", lambda found, cores: [found[n] for n in large])
    rows = read_accounts(spark, archives)
    assert rows.count() == 151
    expected = sorted([key(f"{n}:{i}") for n in range(3) for i in range(50)] + [key("i")])
    assert keys(rows) == expected
    assert ("Exchange" in rows._jdf.queryExecution().toString()) == bool(large)


@pytest.mark.parametrize("chunk_bytes", [1, 1024, 4096, 32 << 20])
def test_chunk_size_changes_no_row(spark, archives, chunk_bytes):
    register(spark)
    entries = spark.read.format("ledger_snapshot").option("chunkBytes", chunk_bytes).load(archives)
    rows = unfold(records.spread_chunks(entries, 5))
    places = sorted((r.archive, r.rec_offset) for r in rows.select("archive", "rec_offset").collect())
    whole = sorted((r.archive, r.rec_offset) for r in read_accounts(spark, archives).select("archive", "rec_offset").collect())
    assert places == whole and keys(rows) == keys(read_accounts(spark, archives))
    direct = spark.read.format("ledger_accounts").option("chunkBytes", chunk_bytes).load(archives)
    assert keys(direct) == keys(rows)


def test_corrupt_record_fails_with_its_place(spark, tmp_path):
    broken = account_member("accounts/1.1", record(), record(data_len=10**6), record())
    write_archive(tmp_path, "snapshot-1.tar.zst", broken, account_member("accounts/2.2", record()))
    with pytest.raises(Exception, match="snapshot-1.tar.zst: accounts/1.1: record at offset 136"):
        read_accounts(spark, str(tmp_path)).collect()
    assert read_accounts(spark, str(tmp_path), mode="DROPMALFORMED").count() == 2
    entries = spark.read.format("ledger_snapshot").load(str(tmp_path))
    assert [tuple(r) for r in corrupt_records(entries).collect()] == [("snapshot-1.tar.zst", "accounts/1.1", 136)]
    assert unfold(entries, drop_malformed=True).count() == 2
    with pytest.raises(PythonException, match="overruns"):
        unfold(entries).collect()


def test_listing(spark, tmp_path):
    write_archive(
        tmp_path,
        "snapshot-1.tar.zst",
        tar_member("version", b"1.2.0"),
        tar_member("accounts/", b"", b"5"),
        account_member("accounts/1.1", record(), record(data=b"1")),
        tar_member("account/2.2", record()),
    )
    entries = listing.list_entries(spark, str(tmp_path))
    assert [r.path for r in listing.accounts_members(entries).collect()] == ["accounts/1.1"]
    (row,) = listing.manifest(entries).collect()
    assert tuple(row) == ("snapshot-1.tar.zst", 4, 1, 280, 512)
    (totals,) = listing.counts(entries, read_accounts(spark, str(tmp_path))).collect()
    assert tuple(totals) == (4, 1, 280, 2)
    assert entries.schema.names == list(listing.LISTED)
    assert spark.read.format("ledger_snapshot").load(str(tmp_path)).schema == ENTRIES


def test_unknown_kind(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="kind must be one of"):
        spark.read.format("ledger_snapshot").option("kind", "daily").load(str(tmp_path)).collect()
