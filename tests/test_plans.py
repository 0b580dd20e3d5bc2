"""The plans are the ones meant."""

from ledgerlake.functions import base58
from ledgerlake.operators.decoders import MINTS, TOKEN_ACCOUNTS
from ledgerlake.operators.filters import SnapshotFilters, accounts
from ledgerlake.operators.records import read_accounts
from catalog.queries import QUERIES
from tests.conftest import SF_DIR, key


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_parquet_scan(lake):
    text = plan(accounts(lake.versions, SnapshotFilters(owner=base58.encode(key("loader")))))
    assert "EqualTo(owner" in text and "Not(EqualTo(lamports,0))" in text
    schema = text.split("ReadSchema: ")[1]
    assert "data:binary" not in schema and "hash" not in schema


def test_a_decoder_reads_its_own_folder_and_two_columns(lake):
    text = plan(MINTS.table(lake.versions))
    assert "decoder" in text.split("PartitionFilters: ")[1].split("]")[0]
    assert "ReadSchema: struct<pubkey:binary,data:binary>" in text
    assert "Exchange" not in text and "Python" not in text


def test_known_mints_are_broadcast_before_decoding(lake):
    text = plan(TOKEN_ACCOUNTS.table(lake.versions, lake.known))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text
    lines = text.splitlines()
    join = next(n for n, line in enumerate(lines) if "BroadcastHashJoin" in line)
    assert any("conv(" in line for line in lines[:join])
    assert not any("conv(" in line for line in lines[join:])


def test_reading_many_archives_needs_no_shuffle(spark, lake):
    assert "Exchange" not in plan(read_accounts(spark, lake.archives, columns=("pubkey",)))


def test_no_cross_joins(spark):
    for name in ("sql_theta_range", "sql_wallet_balances", "sql_scalar_subquery", "sql_supply_vs_held", "sql_left_unheld_mints"):
        text = plan(QUERIES[name](spark, SF_DIR))
        assert "Cartesian" not in text and "NestedLoop" not in text, name


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["sql_top_holders"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan(QUERIES["rank_sources_rough"](spark, SF_DIR))
