"""The sink that makes all tables in one pass: equal to the tables of stored versions, exactly once, and all or nothing."""

import dataclasses
import glob
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fixtures.lake import DECODERS, key_of
from ledgerlake.functions import base58
from ledgerlake.operators import membership
from ledgerlake.operators.decoders import DEFAULT_DECODERS, Decoder, Field, first_matches, kept_data, rule_of
from ledgerlake.operators.filters import SnapshotFilters, accounts
from ledgerlake.operators.records import read_accounts
from ledgerlake.plans import ingest
from ledgerlake.plans.ingest import publish, publish_archives, read_versions, write_versions
from ledgerlake.plans.run import process_snapshot
from ledgerlake.plans.sql import query
from ledgerlake.schemas import TOKEN_PROGRAM
from ledgerlake.sources.views import register_views
from tests.conftest import account_member, key, mint_data, record, token_data, write_archive

SPAM = SnapshotFilters(include_spam=True)


def rows(table):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in table.collect()), key=repr)


def visible(folder):
    return [f for f in glob.glob(f"{folder}/**/*", recursive=True) if os.path.isfile(f) and "/_" not in f[len(str(folder)):]]


@pytest.fixture
def archives(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(4):
        body = [record(pubkey=key(f"{n}:{i}"), data=bytes(i), lamports=i) for i in range(50)]
        body += [record(pubkey=key(f"m{n}"), owner=TOKEN_PROGRAM, data=mint_data())]
        body += [record(pubkey=key(f"t{n}:{i}"), owner=TOKEN_PROGRAM, data=token_data(mint=key(f"m{i % 4}"))) for i in range(8)]
        write_archive(folder, f"snapshot-{n}.tar.zst", account_member(f"accounts/{n}.{n}", *body), account_member(f"accounts/{n}.9", record()))
    return str(folder)


@pytest.mark.parametrize("large", [[], [1], [0, 1, 2, 3]])
def test_every_archive_is_read_once(spark, archives, tmp_path, monkeypatch, large):
    monkeypatch.setattr(ingest, "too_large_for_one_task", lambda found, cores: [found[n] for n in large if n < len(found)])
    counts = publish_archives(spark, archives, lambda name: f"{tmp_path}/out/{name}", filters=SPAM)
    assert (counts.archives, counts.chunks, counts.records) == (4 - len(large), 8, 4 * 60)
    assert counts.rows == {"accounts": 4 * 59, "mints": 4, "token_accounts": 32}
    for name, number in counts.rows.items():
        assert spark.read.parquet(f"{tmp_path}/out/{name}").count() == number
    again = publish_archives(spark, archives + "/snapshot-0*", lambda name: f"{tmp_path}/out/{name}", filters=SPAM)
    assert spark.read.parquet(f"{tmp_path}/out/token_accounts").count() == again.rows["token_accounts"] == 8
    assert not glob.glob(f"{tmp_path}/out/*/_staged*")


def test_tables_of_the_fixture(spark, lake, tmp_path):
    publish_archives(spark, lake.archives, lambda name: f"{tmp_path}/a/{name}", known=lake.known, decoders=DECODERS)
    publish(lake.versions, lambda name: f"{tmp_path}/b/{name}", known=lake.known, decoders=DECODERS)
    for name in ("accounts", "mints", "token_accounts", "programs"):
        one, other = (spark.read.parquet(f"{tmp_path}/{side}/{name}") for side in "ab")
        assert one.schema == other.schema
        assert rows(one) == rows(other)
    for file in glob.glob(f"{tmp_path}/a/*/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        assert all(group.column(n).compression == "SNAPPY" and "DICTIONARY" not in str(group.column(n).encodings) for n in range(group.num_columns))
    assert query(spark, f"{tmp_path}/a", "SELECT count(*) FROM programs").first()[0] == 10


def test_a_failed_run_shows_nothing(spark, archives, tmp_path):
    broken = account_member("accounts/1.1", record(), record(data_len=10**6))
    write_archive(tmp_path / "in", "snapshot-9.tar.zst", broken)
    with pytest.raises(Exception, match="record at offset 136 overruns"):
        publish_archives(spark, archives, lambda name: f"{tmp_path}/out/{name}", filters=SPAM)
    assert visible(tmp_path / "out") == []


def test_what_is_left_out_is_told(spark, tmp_path):
    broken = account_member("accounts/1.1", record(), record(data_len=10**6), record(), record())
    write_archive(tmp_path, "snapshot-1.tar.zst", broken, account_member("accounts/2.2", record()))
    row = process_snapshot(spark, str(tmp_path), f"{tmp_path}/out", filters=SPAM, mode="DROPMALFORMED").first()
    assert (row.rows_parsed, row.record_bytes, row.rejected_members, row.rejected_bytes) == (2, 272, 1, 3 * 136)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect()] == [("snapshot-1.tar.zst", "accounts/1.1", 136, 408)]
    assert "rejected" in register_views(spark, f"{tmp_path}/out")


def test_no_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    counts = publish_archives(spark, f"{tmp_path}/in", lambda name: f"{tmp_path}/out/{name}", filters=SPAM)
    assert not any(counts.rows.values()) and counts.archives == 0
    for name in ("accounts", "mints", "token_accounts"):
        assert spark.read.parquet(f"{tmp_path}/out/{name}").count() == 0


def test_rows_are_cut_into_groups(spark, archives, tmp_path, monkeypatch):
    from ledgerlake.sources import tables

    monkeypatch.setattr(tables, "GROUP_BYTES", 2000)
    file = tables._TableFile(f"{tmp_path}/t", tables.REJECTED_ARROW)
    import pyarrow as pa

    for n in range(10):
        columns = [pa.array([text] * 20) for text in ("archive", "path")] + [pa.array([n] * 20), pa.array([1] * 20)]
        file.add(pa.RecordBatch.from_arrays(columns, schema=tables.REJECTED_ARROW))
    file.close()
    (found,) = glob.glob(f"{tmp_path}/t/*.parquet")
    meta = pq.ParquetFile(found).metadata
    assert meta.num_row_groups > 3 and meta.num_rows == file.rows == 200


RANGED = Decoder("ranged", key("own"), 6, (Field("kind", "u8", 0), Field("n", "u32", 2)), most_len=9, prefix=b"\x07\x01")
PLAIN = Decoder("plain", key("own"), 2, (Field("kind", "u8", 0), Field("on", "flag", 1)), most_len=40)


def test_general_match_both_ways(spark, tmp_path):
    data = [b"\x07\x01" + bytes([n] * (n + 2)) for n in range(10)] + [b"\x07\x02" + bytes(6), b"\x01", b"", bytes(41), bytes(40)]
    body = [record(pubkey=key(str(n)), owner=key("own"), data=d) for n, d in enumerate(data)] + [record(data=data[5])]
    write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", *body))
    decoders = [RANGED, PLAIN]
    publish_archives(spark, str(tmp_path), lambda name: f"{tmp_path}/a/{name}", filters=SPAM, decoders=decoders)
    write_versions(read_accounts(spark, str(tmp_path), decoders=decoders), f"{tmp_path}/versions", decoders)
    publish(read_versions(spark, f"{tmp_path}/versions"), lambda name: f"{tmp_path}/b/{name}", filters=SPAM, decoders=decoders)
    for name in ("ranged", "plain"):
        assert rows(spark.read.parquet(f"{tmp_path}/a/{name}")) == rows(spark.read.parquet(f"{tmp_path}/b/{name}"))
    ranged = spark.read.parquet(f"{tmp_path}/a/ranged")
    assert sorted((r.kind, int(r.n)) for r in ranged.collect()) == [(7, n * 0x01010101) for n in range(2, 6)]
    assert spark.read.parquet(f"{tmp_path}/a/plain").count() == 10 + 1 - 4 + 1
    assert query(spark, f"{tmp_path}/a", "SELECT sum(n) FROM ranged").first()[0] == 14 * 0x01010101
    straight = read_accounts(spark, str(tmp_path), decoders=[RANGED], decoded_only=True)
    assert straight.count() == 4


def test_rules_as_options():
    assert [rule_of(k) for k in kept_data([RANGED, *DEFAULT_DECODERS])] == [d.rule for d in (RANGED, *DEFAULT_DECODERS)]
    assert rule_of([key("o").hex(), 5]) == dataclasses.replace(PLAIN, owner=key("o"), data_len=5, most_len=None).rule
    assert first_matches([RANGED, dataclasses.replace(RANGED, name="twin"), PLAIN]) == [RANGED, PLAIN]


def test_fields_must_lie_inside_the_shortest_data():
    with pytest.raises(ValueError, match="bytes are read"):
        Decoder("bad", key("o"), 3, (Field("n", "u64", 0),))
    with pytest.raises(ValueError, match="bytes are read"):
        Decoder("bad", key("o"), 9, (Field("n", "u64", 0),), most_len=8)


def test_optional_fields_as_arrays(spark, tmp_path):
    """Tags other than one give NULL both ways, for keys, numbers, bytes and flags."""
    fields = (Field("k", "key", 0, True), Field("n", "u64", 36, True), Field("b", "u8", 48, True), Field("f", "flag", 53, True))
    decoder = Decoder("options", key("own"), 58, fields)

    def data(tag):
        return tag.to_bytes(4, "little") + key("v") + tag.to_bytes(4, "little") + bytes([255] * 8) + tag.to_bytes(4, "little") + b"\xff" + tag.to_bytes(4, "little") + b"\x02"

    write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", *[record(pubkey=key(str(t)), owner=key("own"), data=data(t)) for t in (0, 1, 2, 257)]))
    publish_archives(spark, str(tmp_path), lambda name: f"{tmp_path}/a/{name}", filters=SPAM, decoders=[decoder])
    found, versions = spark.read.parquet(f"{tmp_path}/a/options"), read_accounts(spark, str(tmp_path), decoders=[decoder])
    assert rows(found) == rows(decoder.table(versions))
    (one,) = found.where("n IS NOT NULL").collect()
    assert (bytes(one.k), int(one.n), one.b, one.f) == (key("v"), 2**64 - 1, 255, True)


# Known keys in the tasks


def matrix(names):
    return np.frombuffer(b"".join(names), dtype=np.uint8).reshape(len(names), 32)


def test_exact_keys_with_equal_first_words():
    base = [key(str(n)) for n in range(300)]
    twins = [b"A" * 8 + key(str(n))[8:] for n in range(50)]
    held = membership.ExactKeys(matrix(base + twins))
    asked = base[:20] + twins + [b"A" * 8 + key("x")[8:], key("other"), bytes(32), bytes([255] * 32)]
    assert held.holds(matrix(asked)).tolist() == [True] * 70 + [False] * 4
    assert not membership.ExactKeys(matrix([])).holds(matrix(asked)).any()


def test_bloom_filter_misses_no_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(membership, "SEGMENT_BLOCKS", 32)
    keys = [key(f"k{n}") for n in range(5000)]
    known = spark.createDataFrame([(bytearray(k),) for k in keys], "pubkey binary")
    blocks = membership.bloom_blocks(len(keys))
    membership.bloom_table(known, blocks).write.parquet(f"{tmp_path}/bloom")
    held = membership.bloom_keys(f"{tmp_path}/bloom", blocks)
    assert held.holds(matrix(keys)).all()
    assert held.holds(matrix([key(f"x{n}") for n in range(20_000)])).mean() < 0.01


@pytest.mark.parametrize("exact, most_bytes", [(500_000, 1 << 26), (1, 1 << 26), (1, 0)])
def test_known_mints_however_they_are_tested(spark, lake, tmp_path, exact, most_bytes):
    known = membership.ready_keys(lake.known, exact, most_bytes)
    assert known.exact == (exact > 1) and (known.test() is None) == (most_bytes == 0)
    counts = publish_archives(spark, lake.archives, lambda name: f"{tmp_path}/{name}", known=known)
    for name in ("mints", "token_accounts"):
        assert rows(spark.read.parquet(f"{tmp_path}/{name}")) == rows(lake.table(name))
    all_of_them, right = 6000, lake.table("token_accounts").count()
    landed = counts.rows["token_accounts"]
    assert landed == (right if exact > 1 else all_of_them) if most_bytes == 0 or exact > 1 else right <= landed < right + 200


def test_one_call_with_a_long_list(spark, archives, tmp_path, monkeypatch):
    monkeypatch.setattr(membership, "BROADCAST_KEYS", 0)
    (tmp_path / "known.txt").write_text("\n".join(base58.encode(key(f"m{n}")) for n in range(2)))
    process_snapshot(spark, archives, f"{tmp_path}/out", known_mints=f"{tmp_path}/known.txt")
    assert spark.read.parquet(f"{tmp_path}/out/token_accounts").agg(F.count("*"), F.count_distinct("mint")).first() == (16, 2)


# Filters pushed into the source


def scan(spark, archives):
    from ledgerlake.sources import register

    register(spark)
    return spark.read.format("ledger_accounts").load(archives)


def plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "condition, left",
    [
        ("lamports <> 0", False),
        ("lamports > 40 AND lamports <= 45", False),
        ("lamports IN (3, 5, 99)", False),
        ("lamports = 7.0", False),
        ("executable = 0 AND data_len >= 20", False),
        ("length(owner) = 32 AND lamports = 3", True),
        ("lamports = 3 OR lamports = 4", None),
        ("NOT lamports IN (1, 2)", None),
        ("path = 'accounts/1.1' AND lamports < 5", True),
        ("lamports IS NOT NULL", False),
    ],
)
def test_filters_reach_the_walk(spark, archives, condition, left):
    found = scan(spark, archives).where(condition).select("pubkey", "lamports", "data_len")
    every = spark.createDataFrame(scan(spark, archives).collect(), scan(spark, archives).schema)
    assert rows(found) == rows(every.where(condition).select("pubkey", "lamports", "data_len"))
    if left is not None:
        assert ("Filter " in plan(found)) == left, plan(found)


@pytest.mark.parametrize("column, name", [("pubkey", "1:7"), ("owner", "o"), ("hash", "h"), ("pubkey", "nobody")])
def test_keys_reach_the_walk(spark, archives, column, name):
    rows_ = scan(spark, archives).where(F.col(column) == F.lit(bytearray(key(name))))
    expected = {"1:7": 1, "o": 4 * 51, "h": 240, "nobody": 0}[name]
    assert rows_.count() == expected and "Filter " not in plan(rows_)
    assert scan(spark, archives).where(F.col(column) == F.lit(bytearray(b"short"))).count() == 0


@pytest.mark.parametrize(
    "asked",
    [{"owner": "loader"}, {"hash": "hash:mint:4"}, {"pubkey": "wallet:3"}, {"pubkey": "mint:9", "include_dead": True}, {}],
)
def test_filters_from_archives_and_from_versions(spark, lake, asked):
    filters = SnapshotFilters(**{k: v if k == "include_dead" else base58.encode(key_of(v)) for k, v in asked.items()})
    pushed = scan(spark, lake.archives).where(filters.predicate())
    assert "Filter " not in plan(pushed)
    assert rows(accounts(pushed, SnapshotFilters(include_dead=True))) == rows(accounts(lake.versions, filters))


def test_bits_are_compared_as_bits(spark, tmp_path):
    from ledgerlake.schemas import STORED_VERSIONS
    from ledgerlake.sources import register

    register(spark)
    write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", record(lamports=2**64 - 1), record(lamports=5)))
    stored = spark.read.format("ledger_accounts").schema(STORED_VERSIONS).load(str(tmp_path))
    assert stored.where("lamports = -1").count() == 1 and stored.where("lamports > 0").count() == 1
    assert stored.where("lamports IN (-1, 5)").count() == 2 and stored.where("lamports <> -1").count() == 1
    plain = scan(spark, str(tmp_path))
    assert plain.where("lamports > 9223372036854775807").count() == 1 and plain.where("lamports = -1").count() == 0
    assert plain.where("lamports < 5.5").count() == 1 and plain.where("lamports <> 18446744073709551616").count() == 2


# Two-phase commit, attempt by attempt


def writer_of(tmp_path, archives, **more):
    from pyspark.sql.types import StructType

    from ledgerlake.sources import tables

    names = ("accounts", "mints", "token_accounts", *(("rejected",) if more.get("drop_malformed") else ()))
    plan = tables.plan_of({n: f"{tmp_path}/out/{n}" for n in names}, list(DEFAULT_DECODERS), [], None, more.get("drop_malformed", False), f"{tmp_path}/summary.json")
    return tables.TablesWriter(StructType.fromDDL(tables.SINK), plan, True)


def names_batch(*uris):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from ledgerlake.sources.tables import SINK

    schema = to_arrow_schema(StructType.fromDDL(SINK))
    return pa.RecordBatch.from_pylist([{"uri": u} for u in uris], schema=schema)


def test_only_accepted_attempts_are_seen(spark, archives, tmp_path):
    """A task tried twice, as by speculation: nothing is visible before the commit, and then one attempt's rows."""
    from ledgerlake.sources.tables import written_counts

    writer = writer_of(tmp_path, archives)
    lost = writer.write(iter([names_batch(f"{archives}/snapshot-0.tar.zst")]))
    kept = writer.write(iter([names_batch(f"{archives}/snapshot-0.tar.zst")]))
    other = writer.write(iter([names_batch(f"{archives}/snapshot-1.tar.zst", f"{archives}/snapshot-2.tar.zst")]))
    empty = writer.write(iter([]))
    assert visible(tmp_path / "out") == [] and lost.files["accounts"] != kept.files["accounts"] and empty.files == {}
    writer.commit([kept, other, empty, None])
    assert pq.read_table(f"{tmp_path}/out/token_accounts").num_rows == 3 * 8
    assert written_counts(f"{tmp_path}/summary.json").archives == 3
    assert len(visible(tmp_path / "out")) == 6 and not glob.glob(f"{tmp_path}/out/*/_*")
    writer_of(tmp_path, archives).commit([])
    assert pq.read_table(f"{tmp_path}/out/token_accounts").num_rows == 0


def test_an_aborted_write_leaves_what_was_there(spark, archives, tmp_path):
    first = writer_of(tmp_path, archives)
    first.commit([first.write(iter([names_batch(f"{archives}/snapshot-0.tar.zst")]))])
    before = sorted(visible(tmp_path / "out"))
    second = writer_of(tmp_path, archives)
    message = second.write(iter([names_batch(f"{archives}/snapshot-1.tar.zst")]))
    second.abort([message, None])
    assert sorted(visible(tmp_path / "out")) == before and not glob.glob(f"{tmp_path}/out/*/_*")
