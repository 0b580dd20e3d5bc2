"""What a stream publishes equals what a batch gives."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.filters import SnapshotFilters, accounts
from ledgerlake.operators.decoders import DEFAULT_DECODERS, MINTS, TOKEN_ACCOUNTS, kept_data
from ledgerlake.operators.records import read_accounts
from ledgerlake.operators.sketches import ERROR, estimates, holder_sketches
from ledgerlake.sources import register
from ledgerlake.streaming.landing import publish_arriving_archives, publish_versions, stream_members
from ledgerlake.schemas import TOKEN_PROGRAM
from tests.conftest import account_member, key, mint_data, record, token_data, write_archive


def snapshot(n):
    return [
        record(pubkey=key(f"a{n}")),
        record(pubkey=key(f"dead{n}"), lamports=0),
        record(pubkey=key(f"m{n}"), owner=TOKEN_PROGRAM, data=mint_data()),
        record(pubkey=key(f"t{n}"), owner=TOKEN_PROGRAM, data=token_data(mint=key("m0"))),
    ]


def rows(table):
    return sorted(map(tuple, table.collect()), key=repr)


@pytest.mark.parametrize("files_per_batch", [1000, 1])
def test_archives_that_arrive_over_time(spark, tmp_path, files_per_batch):
    landing = tmp_path / "landing"
    landing.mkdir()
    out, progress = f"{tmp_path}/out", f"{tmp_path}/progress"
    known = spark.createDataFrame([(bytearray(key("m0")),)], "pubkey binary")

    def run():
        publish_arriving_archives(
            spark, str(landing), out, progress, known=known, files_per_batch=files_per_batch
        ).awaitTermination()

    for n in range(2):
        write_archive(landing, f"snapshot-{n}.tar.zst", account_member(f"accounts/{n}.{n}", *snapshot(n)))
    run()
    write_archive(landing, "incremental-snapshot-2.tar.zst", account_member("accounts/2.2", *snapshot(2)))
    run()
    run()
    batch = read_accounts(spark, str(landing))
    for name, expected in (
        ("accounts", accounts(batch)),
        ("mints", MINTS.table(batch, known)),
        ("token_accounts", TOKEN_ACCOUNTS.table(batch, known)),
    ):
        assert rows(spark.read.parquet(f"{out}/{name}").drop("batch")) == rows(expected)
    assert spark.read.parquet(f"{out}/accounts").count() == 9


def test_unpacked_members(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for n in range(3):
        (landing / f"{n}.{n}").write_bytes(b"".join(snapshot(n)) + bytes(40))
    out = f"{tmp_path}/out"
    filters = SnapshotFilters(include_dead=True, include_spam=True)
    publish_versions(stream_members(spark, str(landing)), out, f"{tmp_path}/progress", filters=filters).awaitTermination()
    assert spark.read.parquet(f"{out}/accounts").count() == 12
    assert spark.read.parquet(f"{out}/mints").count() == 3
    assert spark.read.parquet(f"{out}/token_accounts").count() == 3


def test_only_paths_come_from_the_file_stream(spark, tmp_path):
    write_archive(tmp_path, "snapshot-0.tar.zst", account_member("accounts/0.0", record()))
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_batches_give_those_of_the_whole(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for n in range(4):
        body = [record(pubkey=key(f"t{n}:{i}"), owner=TOKEN_PROGRAM, data=token_data(mint=key(f"m{i % 3}"), owner=key(f"w{i % (300 * (n + 1))}"))) for i in range(2500)]
        write_archive(landing, f"snapshot-{n}.tar.zst", account_member(f"accounts/{n}.{n}", *body))
    filters = SnapshotFilters(include_spam=True)
    out = f"{tmp_path}/out"
    publish_arriving_archives(spark, str(landing), out, f"{tmp_path}/progress", filters=filters, files_per_batch=1, with_sketches=True).awaitTermination()
    parts = spark.read.parquet(f"{out}/holder_sketches").drop("batch")
    assert parts.count() == 12
    tokens = spark.read.parquet(f"{out}/token_accounts")
    assert rows(estimates(parts)) == rows(estimates(holder_sketches(tokens)))
    exact = {bytes(r.mint): r.n for r in tokens.groupBy("mint").agg(F.count_distinct("owner").alias("n")).collect()}
    for r in estimates(parts).collect():
        assert abs(r.estimate - exact[bytes(r.mint)]) <= ERROR * exact[bytes(r.mint)]


# The source of its own


def stream(spark, landing, progress, name="ledger_accounts", **options):
    register(spark)
    kept = json.dumps(kept_data(DEFAULT_DECODERS))
    return spark.readStream.format(name).options(progress=progress, minPartitions=2, keepData=kept, **options).load(str(landing))


def run(rows_, out, checkpoint, write=None):
    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows_.writeStream.foreachBatch(write or keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def steps(progress):
    return [[os.path.basename(uri) for uri, _ in json.load(open(f))] for f in sorted(glob.glob(f"{progress}/step-*.json"))]


def test_archives_arrive_at_the_source(spark, tmp_path):
    landing, progress, out, checkpoint = (f"{tmp_path}/{n}" for n in ("landing", "steps", "out", "checkpoint"))
    os.mkdir(landing)
    for n in range(3):
        write_archive(tmp_path / "landing", f"snapshot-{n}.tar.zst", account_member(f"accounts/{n}.{n}", *snapshot(n)))
    one = os.path.getsize(f"{landing}/snapshot-0.tar.zst")
    for times in range(4):
        run(stream(spark, landing, progress, maxBytesPerTrigger=one + 1), out, checkpoint)
        if times == 1:
            write_archive(tmp_path / "landing", "incremental-snapshot-0.tar.zst", account_member("accounts/9.9", *snapshot(9)))
    assert steps(progress) == [["snapshot-0.tar.zst"], ["snapshot-1.tar.zst"], ["incremental-snapshot-0.tar.zst"], ["snapshot-2.tar.zst"]]
    run(stream(spark, landing, progress), out, checkpoint)
    found = spark.read.parquet(out).drop("batch")
    assert rows(found) == rows(read_accounts(spark, landing)) and len(steps(progress)) == 4


def test_a_batch_that_failed_takes_the_same_archives(spark, tmp_path):
    """The first run dies while its batch writes; another archive has arrived when it starts anew."""
    landing, progress, out, checkpoint = (f"{tmp_path}/{n}" for n in ("landing", "steps", "out", "checkpoint"))
    os.mkdir(landing)
    write_archive(tmp_path / "landing", "snapshot-1.tar.zst", account_member("accounts/1.1", *snapshot(1)))

    def dies(batch, number):
        batch.limit(2).write.mode("overwrite").parquet(f"{out}/batch={number}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(stream(spark, landing, progress), out, checkpoint, dies)
    write_archive(tmp_path / "landing", "snapshot-0.tar.zst", account_member("accounts/0.0", *snapshot(0)))
    run(stream(spark, landing, progress), out, checkpoint)
    run(stream(spark, landing, progress), out, checkpoint)
    assert steps(progress) == [["snapshot-1.tar.zst"], ["snapshot-0.tar.zst"]]
    assert rows(spark.read.parquet(f"{out}/batch=0")) == rows(read_accounts(spark, f"{landing}/snapshot-1.tar.zst"))
    assert rows(spark.read.parquet(out).drop("batch")) == rows(read_accounts(spark, landing))


def test_a_stream_needs_a_place_for_its_progress(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="progress"):
        run(spark.readStream.format("ledger_archives").load(str(tmp_path)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")


def test_names_and_members_as_streams(spark, tmp_path):
    write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", *snapshot(1)))
    for name, column, wanted in (("ledger_archives", "uri", f"{tmp_path}/snapshot-1.tar.zst"), ("ledger_snapshot", "path", "accounts/1.1")):
        out = f"{tmp_path}/{name}"
        run(stream(spark, tmp_path, f"{out}-steps", name).select(column), out, f"{out}-checkpoint")
        assert [r[column] for r in spark.read.parquet(out).collect()] == [wanted]
