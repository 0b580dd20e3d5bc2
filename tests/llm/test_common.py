"""Helpers of the operators: parts of hot keys, stored tables that replace others."""

from pyspark.sql import functions as F

from ledgerlake.llm import common


def test_no_part_of_a_hot_key_is_large(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    sizes = rows.groupBy("k").agg(F.count("*").alias("_rows"))
    parted = common.in_parts(rows, "k", sizes, ["id"], least=2, part_rows=100)
    counted = parted.groupBy("k", "_part").count().collect()
    assert sum(r["count"] for r in counted) == 9000 and max(r["count"] for r in counted) < 200
    by_key = {}
    for r in counted:
        by_key.setdefault(r.k, []).append(r["_part"])
    assert len(by_key[0]) >= 60 and all(sorted(p) == list(range(len(p))) for p in by_key.values())


def test_a_table_is_removed_once_another_replaces_it(spark):
    first = common.stored(spark.range(10), "test-first")
    place = common._folders[first]
    second = common.stored(first.groupBy().count(), "test-second", instead_of=[first])
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert second.first()["count"] == 10
    assert spark.conf.get(common._CLEAN_UP) == "false"
