"""From archives to published tables, against the figures of FIXTURES.md at sf0.001."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fixtures.lake import key_of
from ledgerlake.functions import base58
from ledgerlake.operators.decoders import MINTS, TOKEN_ACCOUNTS
from ledgerlake.operators.filters import SnapshotFilters, accounts
from ledgerlake.operators.records import read_accounts
from ledgerlake.plans import ingest
from ledgerlake.plans.ingest import publish, publish_archives, write_versions
from ledgerlake.plans.sql import query, query_text
from ledgerlake.sources.views import open_table, register_views, view_counts
from tests.conftest import account_member, key, mint_data, record, write_archive
from ledgerlake.schemas import TOKEN_PROGRAM


def test_goldens(lake):
    versions = lake.versions
    assert versions.count() == 6414
    alive = accounts(versions).agg(F.count("*"), F.sum("lamports"), F.count_if("executable")).first()
    assert tuple(alive) == (5447, 36893488158080604179, 3)
    assert MINTS.table(versions).count() == 200
    assert TOKEN_ACCOUNTS.table(versions).count() == 6000
    assert TOKEN_ACCOUNTS.table(versions).select("pubkey").distinct().count() == 4599
    verified = TOKEN_ACCOUNTS.table(versions, lake.known).agg(F.count("*"), F.sum("amount")).first()
    assert tuple(verified) == (2014, 590295810358755756635)
    assert MINTS.table(versions, lake.known).count() == 67


def test_decoded_tables_ignore_account_filters(spark, lake, tmp_path):
    filters = SnapshotFilters(owner=base58.encode(key_of("loader")), include_spam=True)
    publish(lake.versions, lambda name: f"{tmp_path}/{name}", filters=filters)
    assert open_table(spark, str(tmp_path), "accounts").count() == 10
    mints = open_table(spark, str(tmp_path), "mints")
    assert mints.count() == 200
    assert mints.where(F.col("pubkey") == F.lit(bytearray(key_of("mint:20")))).count() == 1
    assert accounts(lake.versions).where(F.col("pubkey") == F.lit(bytearray(key_of("mint:20")))).count() == 0


def test_spam_does_not_touch_accounts(lake, tmp_path, spark):
    publish(lake.versions, lambda name: f"{tmp_path}/{name}", filters=SnapshotFilters(include_spam=True))
    assert open_table(spark, str(tmp_path), "accounts").count() == lake.table("accounts").count()
    assert open_table(spark, str(tmp_path), "mints").count() == 200


@pytest.mark.parametrize("large", [[], [0, 2]])
def test_straight_from_archives_gives_the_same_tables(spark, lake, tmp_path, monkeypatch, large):
    monkeypatch.setattr(ingest, "too_large_for_one_task", lambda found, cores: [found[n] for n in large])

    def place(name):
        return f"{tmp_path}/{name}"

    publish_archives(spark, lake.archives, place, known=lake.known)
    publish(lake.versions, lambda name: f"{tmp_path}/by-versions/{name}", known=lake.known)
    for name in ("accounts", "mints", "token_accounts"):
        straight, stored = spark.read.parquet(place(name)), spark.read.parquet(f"{tmp_path}/by-versions/{name}")
        assert straight.schema == stored.schema
        assert straight.exceptAll(stored).isEmpty() and stored.exceptAll(straight).isEmpty()
    some = SnapshotFilters(owner=base58.encode(key_of("loader")), include_spam=True)
    publish_archives(spark, lake.archives, place, filters=some, kind="full")
    assert spark.read.parquet(place("accounts")).count() == 8
    assert spark.read.parquet(place("mints")).count() == 150


def test_known_list_is_needed(lake, tmp_path):
    with pytest.raises(ValueError, match="known mints"):
        publish(lake.versions, lambda name: f"{tmp_path}/{name}")


def test_file_format(lake):
    for name in ("accounts", "mints", "token_accounts"):
        for file in glob.glob(f"{lake.published}/{name}/*.parquet"):
            group = pq.ParquetFile(file).metadata.row_group(0)
            for n in range(group.num_columns):
                assert group.column(n).compression == "SNAPPY"
                assert not any("DICTIONARY" in e for e in group.column(n).encodings)


def test_row_groups_hold_at_most_a_million_rows(spark, tmp_path):
    from ledgerlake.plans.ingest import PARQUET_OPTIONS

    spark.range(0, 1_200_000, 1, 1).write.options(**PARQUET_OPTIONS).parquet(str(tmp_path / "t"))
    (file,) = glob.glob(f"{tmp_path}/t/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert max(meta.row_group(n).num_rows for n in range(meta.num_row_groups)) <= 1_000_000


def test_tables_without_rows(spark, tmp_path):
    write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", record(lamports=0)))
    write_versions(read_accounts(spark, str(tmp_path)), f"{tmp_path}/versions")
    versions = spark.read.parquet(f"{tmp_path}/versions")
    publish(versions, lambda name: f"{tmp_path}/out/{name}", filters=SnapshotFilters(include_spam=True))
    assert [tuple(r) for r in view_counts(spark, f"{tmp_path}/out").collect()] == [("accounts", 0)]
    assert set(register_views(spark, f"{tmp_path}/out")) == {"accounts"}


def test_no_tables_at_all(spark, tmp_path):
    assert view_counts(spark, str(tmp_path)).collect() == []


def test_sql_text(spark, tmp_path):
    data = mint_data(supply=2**64 - 1, authority=(0, bytes(32)))
    write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", record(owner=TOKEN_PROGRAM, data=data)))
    write_versions(read_accounts(spark, str(tmp_path)), f"{tmp_path}/versions")
    publish(spark.read.parquet(f"{tmp_path}/versions"), lambda name: f"{tmp_path}/out/{name}", filters=SnapshotFilters(include_spam=True))
    sql = "SELECT a.owner, m.supply, m.mint_authority FROM accounts a JOIN mints m ON a.pubkey = m.pubkey"
    assert query(spark, f"{tmp_path}/out", sql).first().supply == 2**64 - 1
    text = query_text(spark, f"{tmp_path}/out", sql).first()
    assert tuple(text) == (base58.encode(TOKEN_PROGRAM), "18446744073709551615", "NULL")


def scanned(table):
    """Rows that the Parquet scans of a plan handed out, and the result's rows."""
    found = len(table.collect())

    def scans(node):
        if "Scan" in node.nodeName():
            yield node.metrics().apply("numOutputRows").value()
        if "AdaptiveSparkPlan" in node.nodeName():
            yield from scans(node.executedPlan())
        children = node.children()
        for n in range(children.size()):
            yield from scans(children.apply(n))

    return sum(scans(table._jdf.queryExecution().executedPlan())), found


@pytest.mark.parametrize("clustered_by", [(), ("pubkey",)])
def test_one_key_skips_row_groups(spark, tmp_path, clustered_by):
    archives = tmp_path / "in"
    archives.mkdir()
    for n in range(6):
        body = [record(pubkey=key(f"{n}:{i}"), hash_=key(f"h{n}:{i}")) for i in range(200)]
        write_archive(archives, f"snapshot-{n}.tar.zst", account_member(f"accounts/{n}.{n}", *body))
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_versions(read_accounts(spark, str(archives)), f"{tmp_path}/versions", clustered_by=clustered_by)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    versions = spark.read.parquet(f"{tmp_path}/versions")
    groups = [pq.ParquetFile(f).metadata.row_group(0).num_rows for f in glob.glob(f"{tmp_path}/versions/*/*.parquet")]
    assert versions.count() == 1200 and len(groups) >= 5
    for name, text in (("pubkey", "3:77"), ("hash", "h3:77")):
        read, found = scanned(versions.where(F.col(name) == F.lit(bytearray(key(text)))).select("lamports"))
        assert found == 1 and read <= max(groups)
    for name in ("pubkey", "hash"):
        read, found = scanned(versions.where(F.col(name) == F.lit(bytearray(key("nobody")))).select("lamports"))
        assert found == 0 and read <= max(groups)
    every = {bytes(r.pubkey) for r in versions.select("pubkey").collect()}
    assert every == {key(f"{n}:{i}") for n in range(6) for i in range(200)}
