"""Ledgers of more archives than are kept: each archive is there only while its task reads it."""

import os
from collections import Counter

import pytest

from catalog.queries import QUERIES
from conftest import SF_DIR, key
from fixtures import lake as lakes
from ledgerlake.operators.known import only_known
from ledgerlake.operators.membership import only_listed
from ledgerlake.plans.scratch import new_folder, scratch_root, shuffles_removed


@pytest.fixture(scope="module")
def passing(spark):
    return lakes.Lake(spark, SF_DIR, new_folder(spark, "passing-ledger"), kept=2)


@pytest.fixture
def rows_of(spark, lake, passing, monkeypatch):
    """A query's rows, of the ledger that is kept and of the one that passes."""

    def run(name: str) -> tuple[Counter, Counter]:
        found = []
        for one in (lake, passing):
            monkeypatch.setitem(lakes._lakes, (spark, SF_DIR), one)
            found.append(Counter(map(repr, QUERIES[name](spark, SF_DIR).collect())))
        return tuple(found)

    return run


def archives_under(folder: str) -> list[str]:
    return [file for _, _, files in os.walk(folder) for file in files if file.endswith(".tar.zst")]


@pytest.mark.parametrize("name", ["accounts_all_versions", "describe_accounts", "token_accounts_all", "option_fields", "token_accounts_verified"])
def test_versions_are_read_without_keeping_archives_or_versions(passing, rows_of, name):
    kept, passed = rows_of(name)
    assert kept == passed and kept
    left = os.listdir(passing.root) if os.path.isdir(passing.root) else []
    assert not {x for x in left if x.startswith(("archives", "headers", "decoded"))}


@pytest.mark.parametrize("name", ["sql_cube_accounts", "sql_scalar_subquery", "sql_approx_holders", "sql_owner_setops"])
def test_tables_are_published_without_keeping_archives(passing, rows_of, name):
    kept, passed = rows_of(name)
    assert kept == passed and kept
    assert not os.path.exists(f"{passing.root}/archives") and not archives_under(passing.root)


def left_in(root: str) -> set[str]:
    return {f for f in os.listdir(root) if f.startswith(("landing-", "passing-")) and archives_under(f"{root}/{f}")}


def test_archives_land_by_and_by(spark, passing, rows_of):
    before = left_in(scratch_root(spark))
    shares = [len(archives_under(folder)) for folder in passing.landings()]
    assert shares == [1] * passing.count
    kept, passed = rows_of("stream_accounts")
    assert kept == passed and kept
    assert left_in(scratch_root(spark)) == before


def test_what_passes_is_removed_when_a_query_fails(spark, monkeypatch):
    def failing(_, archives, *others, **options):
        places = [r.uri for r in archives.collect()]
        assert len(places) == one.count and all(map(os.path.exists, places))
        raise RuntimeError("no tables")

    monkeypatch.setattr(lakes, "publish_archives", failing)
    before = left_in(scratch_root(spark))
    one = lakes.Lake(spark, SF_DIR, new_folder(spark, "failing-ledger"), kept=2)
    with pytest.raises(RuntimeError, match="no tables"):
        _ = one.published
    for folder in one.landings():
        assert archives_under(folder)
        break
    assert left_in(scratch_root(spark)) == before


def test_archives_that_are_kept_are_read(spark):
    one = lakes.Lake(spark, SF_DIR, new_folder(spark, "kept-ledger"), kept=2)
    assert len(archives_under(one.archives)) == one.count > one.kept
    assert list(one.landings()) == [one.archives] and len(archives_under(one.archives)) == one.count


def test_a_long_list_is_a_filter_before_the_join(spark):
    known = spark.createDataFrame([(bytearray(key(f"k{n}")),) for n in range(40)] + [(bytearray(b"short"),)], "pubkey binary")
    cells = [key(f"k{n}") for n in range(0, 80, 3)] * 2 + [None, b"short", b"other"]
    rows = spark.createDataFrame([(None if c is None else bytearray(c), n) for n, c in enumerate(cells)], "mint binary, n int")
    found = only_listed(rows, rows["mint"], known, broadcast_keys=3)
    assert "may" not in found.columns and "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    expected = [r.n for r in only_known(rows, rows["mint"], known).collect()]
    assert sorted(r.n for r in found.collect()) == sorted(expected) and len(expected) == 2 * 14 + 1


def test_shuffle_files_go_with_their_query(spark):
    def files() -> int:
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return sum(f.startswith("shuffle_") for folder in folders for _, _, names in os.walk(folder.getPath()) for f in names)

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(setting, None)
    with shuffles_removed(spark):
        spark.range(1000).groupBy("id").count().write.parquet(new_folder(spark, "shuffled"))
        assert files() <= before
    assert spark.conf.get(setting, None) == was
