import dataclasses

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import base58
from ledgerlake.operators.decoders import DEFAULT_DECODERS, MINTS, OTHER, TOKEN_ACCOUNTS, Decoder, Field, dispatch, first_matches, is_nft
from ledgerlake.operators.filters import SnapshotFilters, accounts
from ledgerlake.operators.known import known_mints, only_known
from ledgerlake.operators.records import read_accounts, unfold
from ledgerlake.schemas import ACCOUNTS, MINTS as MINTS_SCHEMA, TOKEN_ACCOUNTS as TOKENS_SCHEMA, TOKEN_PROGRAM
from ledgerlake.sources import register
from tests.conftest import account_member, key, mint_data, record, token_data, write_archive


@pytest.fixture
def versions(spark, tmp_path):
    def build(*records, decoders=DEFAULT_DECODERS):
        write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", *records))
        return read_accounts(spark, str(tmp_path), decoders=decoders)

    return build


def token_program(data, **more):
    return record(owner=TOKEN_PROGRAM, data=data, **more)


def test_mint(versions):
    rows = versions(
        token_program(mint_data(supply=2**64 - 1, freeze=(1, key("f"))), pubkey=key("m1")),
        token_program(mint_data(authority=(2, key("x")), initialized=2, decimals=255), pubkey=key("m2")),
        token_program(mint_data(authority=(0, key("x")), initialized=0, freeze=(2, key("x"))), pubkey=key("m3")),
    )
    found = {bytes(r.pubkey): r for r in MINTS.table(rows).collect()}
    one, two, three = (found[key(k)] for k in ("m1", "m2", "m3"))
    assert (one.mint_authority, one.freeze_authority, one.supply) == (key("auth"), key("f"), 2**64 - 1)
    assert (two.mint_authority, two.is_initialized, two.decimals) == (None, True, 255)
    assert (three.mint_authority, three.freeze_authority, three.is_initialized) == (None, None, False)


def test_token_account(versions):
    rows = versions(
        token_program(token_data(delegate=(1, key("d")), is_native=(1, 2**63), delegated=4, close=(1, key("c")), state=2)),
        token_program(token_data(delegate=(3, key("d")), is_native=(2, 9), close=(0, key("c")))),
    )
    full, empty = sorted(TOKEN_ACCOUNTS.table(rows).collect(), key=lambda r: r.delegate is None)
    assert (full.mint, full.owner, full.amount, full.state) == (key("m"), key("w"), 9, 2)
    assert (full.delegate, full.is_native, full.delegated_amount, full.close_authority) == (key("d"), 2**63, 4, key("c"))
    assert (empty.delegate, empty.is_native, empty.close_authority) == (None, None, None)


def test_schemas(versions):
    rows = versions(token_program(mint_data()))

    def shape(schema):
        return [(f.name, f.dataType) for f in schema]

    assert shape(accounts(rows).schema) == shape(ACCOUNTS)
    assert shape(MINTS.table(rows).schema) == shape(MINTS_SCHEMA)
    assert shape(TOKEN_ACCOUNTS.table(rows).schema) == shape(TOKENS_SCHEMA)


def test_exact_length_and_owner_decide(versions):
    rows = versions(*[token_program(bytes(n)) for n in (81, 82, 83, 164, 165, 166)], record(data=bytes(82)))
    chosen = {(int(r.data_len), r.chosen) for r in rows.select("data_len", dispatch().alias("chosen")).collect()}
    assert chosen == {(81, OTHER), (82, "mints"), (82, OTHER), (83, OTHER), (164, OTHER), (165, "token_accounts"), (166, OTHER)}
    assert MINTS.table(rows).count() == 1 and TOKEN_ACCOUNTS.table(rows).count() == 1


def test_first_decoder_that_matches_wins(versions):
    twin = dataclasses.replace(MINTS, name="twin")
    rows = versions(token_program(mint_data()))
    assert rows.select(dispatch([MINTS, twin])).first()[0] == "mints"
    assert rows.select(dispatch([twin, MINTS])).first()[0] == "twin"
    assert first_matches([twin, MINTS, TOKEN_ACCOUNTS]) == [twin, TOKEN_ACCOUNTS]


def test_decoder_without_code(versions):
    vault = Decoder("vaults", key("v"), 13, (Field("kind", "u32", 0), Field("n", "u64", 4), Field("on", "flag", 12)))
    rows = versions(record(owner=key("v"), data=b"\xff\xff\xff\xff" + bytes(8) + b"\x03"), decoders=[vault])
    row = vault.table(rows).first()
    assert (row.kind, row.n, row.on) == (2**32 - 1, 0, True)


def test_spam_is_told_by_own_key_or_by_mint(spark, versions):
    rows = versions(
        token_program(mint_data(), pubkey=key("good")),
        token_program(mint_data(), pubkey=key("spam")),
        token_program(token_data(mint=key("good")), pubkey=key("t1")),
        token_program(token_data(mint=key("spam")), pubkey=key("good")),
    )
    known = spark.createDataFrame([(bytearray(key("good")),)], "pubkey binary")
    assert [bytes(r.pubkey) for r in MINTS.table(rows, known).collect()] == [key("good")]
    assert [bytes(r.pubkey) for r in TOKEN_ACCOUNTS.table(rows, known).collect()] == [key("t1")]
    assert MINTS.table(rows).count() == 2 and TOKEN_ACCOUNTS.table(rows).count() == 2
    assert accounts(rows).count() == 4


def test_large_known_list_is_not_broadcast_by_hand(spark):
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("k"))
    known = spark.range(0, 3000, 3).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("pubkey"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = only_known(rows, F.col("k"), known, broadcast_keys=10)
        small = only_known(rows, F.col("k"), known)
        assert large.count() == small.count() == 1000
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (large, small)]
        assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" in plans[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_known_list_lines(spark):
    text = base58.encode(key("a"))
    lines = [text, f"  {text}\t", "", "   ", "0OIl", "1" * 32, "2", "1" * 33]
    found = known_mints(spark.createDataFrame([(line,) for line in lines], "value string")).collect()
    assert {bytes(r.pubkey) for r in found} == {key("a"), bytes(32), b"\x01" + bytes(31)}
    assert len(found) == 3


def test_account_filters(versions):
    rows = versions(
        record(pubkey=key("p1"), lamports=0, executable=1),
        record(pubkey=key("p2"), owner=key("o2"), executable=2),
        record(pubkey=key("p3"), owner=key("o2"), hash_=key("h3"), executable=1),
        record(pubkey=key("p3"), owner=key("o2")),
    )

    def found(**asked):
        asked = {n: base58.encode(v) if isinstance(v, bytes) else v for n, v in asked.items()}
        return sorted((bytes(r.pubkey), r.executable) for r in accounts(rows, SnapshotFilters(**asked)).collect())

    p = {n: key(n) for n in ("p1", "p2", "p3")}
    assert found() == sorted([(p["p2"], False), (p["p3"], True), (p["p3"], False)])
    assert (p["p1"], True) in found(include_dead=True)
    assert len(found(owner=key("o2"))) == 3
    assert found(hash=key("h3")) == [(p["p3"], True)]
    assert len(found(pubkey=p["p3"])) == 2
    assert found(owner=key("o2"), pubkey=p["p3"], hash=key("h3")) == [(p["p3"], True)]
    assert found(owner=key("o"), pubkey=p["p3"]) == []


def test_bad_filter_text_fails_before_any_job():
    with pytest.raises(base58.Base58Error):
        SnapshotFilters(owner="0OIl").predicate()


def test_filters_inside_the_reader_agree(spark, tmp_path):
    records = [record(pubkey=key(str(n % 7)), owner=key(str(n % 3)), lamports=n % 4) for n in range(200)]
    write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", *records))
    everything = read_accounts(spark, str(tmp_path))
    filters = SnapshotFilters(owner=base58.encode(key("1")), pubkey=base58.encode(key("4")))
    inside = read_accounts(spark, str(tmp_path), filters=filters, columns=("pubkey", "owner", "lamports"))
    expected = everything.where(filters.predicate()).select("pubkey", "owner", "lamports")
    assert sorted(inside.collect()) == sorted(expected.collect())
    assert inside.count() > 0


def test_is_nft(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 0), (1, 1), (2, 0) AS t(supply, decimals)")
    assert [r[0] for r in rows.select(is_nft(F.col("supply"), F.col("decimals"))).collect()] == [True, False, False]


def test_unfold_chunks(spark, tmp_path):
    register(spark)
    write_archive(tmp_path, "snapshot-1.tar.zst", account_member("accounts/1.1", record(), record()))
    entries = spark.read.format("ledger_snapshot").load(str(tmp_path))
    assert unfold(entries).count() == 2
