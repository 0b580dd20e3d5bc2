"""The digest index: what stays, increments, replays, the buckets, odd rows, and hot texts."""

import hashlib

import duckdb
import pytest

from ledgerlake.llm import digests, queries
from ledgerlake.plans.scratch import new_folder

SCHEMA = "doc_id bigint, text string, digest string, row int, keep_id string, notes map<string,string>"


def table(spark, pairs):
    return spark.createDataFrame([(k, t, "d", 1, "k", {"a": "b"}) for k, t in pairs], SCHEMA)


def lowered(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def test_every_row_is_told_what_stays(spark):
    pairs = [(1, "Same"), (7, "same"), (3, "SAME"), (4, "É"), (5, "é"), (6, None), (2, ""), (None, "same"), (None, "alone"), (9, "twice"), (9, "twice"), (8, "x" * 200_000)]
    found = digests.op12_exact(table(spark, pairs)).collect()
    assert len(found) == len(pairs)
    groups = {}
    for k, t in pairs:
        groups.setdefault(lowered(t), []).append(k)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_digest[r.text_sha256]
        assert r.keep_id == max((k for k in ids if k is not None), default=None) and r.group_size == len(ids)
        assert r.doc_id in ids
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_no_rows(spark):
    assert digests.op12_exact(table(spark, [(1, "a")]).where("false")).count() == 0


def test_increments_and_replays(spark):
    folder = new_folder(spark, "test-index")
    index = digests.DigestIndex.create(spark, folder, 1000)
    first = table(spark, [(1, "a"), (2, "A"), (3, "b")])
    kept = digests.ingest(first, index)
    assert kept.columns == first.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    again = digests.DigestIndex.open(spark, folder)
    assert again.buckets == index.buckets and again.rows().count() == 2
    assert digests.ingest(first, again).count() == 0 and again.rows().count() == 2
    more = table(spark, [(10, "a"), (11, "c"), (12, "C"), (13, "d")])
    assert sorted(r.doc_id for r in digests.ingest(more, again).collect()) == [12, 13]
    assert {bytes(r.digest): r.doc_id for r in digests.DigestIndex.open(spark, folder).rows().collect()} == {
        hashlib.sha256(t.encode()).digest(): k for t, k in [("a", 2), ("b", 3), ("c", 12), ("d", 13)]
    }


def test_the_index_is_not_shuffled(spark):
    index = digests.DigestIndex.create(spark, new_folder(spark, "test-index"), 1000)
    index.append(digests.members_of(table(spark, [(k, str(k)) for k in range(50)])))
    plan = index.unseen(digests.members_of(table(spark, [(1, "1"), (99, "99")])))._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :]
    assert "LeftAnti" in plan and plan.count("Exchange") == 2, plan
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan, side


@pytest.mark.parametrize("hot", [2, 1000])
def test_hot_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(digests, "HOT", hot)
    pairs = [(k, "hot" if k % 3 else f"t{k % 30}") for k in range(300)]
    found = digests.op12_exact(table(spark, pairs)).collect()
    sizes = {}
    for k, t in pairs:
        sizes.setdefault(t, []).append(k)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == sorted((k, max(sizes[t]), len(sizes[t]), k == max(sizes[t])) for k, t in pairs)


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    found = queries.QUERIES["op12_exact"](spark, folder)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
        wanted = db.sql(queries.ORACLES["op12_exact"]).fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
