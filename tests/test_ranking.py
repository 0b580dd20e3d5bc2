import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.ranking import final_ranking, parses, resolve_url, shortlist, source_candidates, throughput

BASE = "http://n1:8899/a/snapshot.tar.zst"


@pytest.mark.parametrize(
    "location, url",
    [
        ("/snap-1.tar.zst", "http://n1:8899/snap-1.tar.zst"),
        ("snap-1.tar.zst", "http://n1:8899/a/snap-1.tar.zst"),
        ("../snap-1.tar.zst", "http://n1:8899/snap-1.tar.zst"),
        ("../../../snap", "http://n1:8899/snap"),
        ("./b/./c/../snap", "http://n1:8899/a/b/snap"),
        ("b/..", "http://n1:8899/a/"),
        ("https://h2/x", "https://h2/x"),
        ("https://h2", "https://h2/"),
        ("//h3/x", "http://h3/x"),
        ("?v=2", "http://n1:8899/a/snapshot.tar.zst?v=2"),
        ("/x?p=../y", "http://n1:8899/x?p=../y"),
    ],
)
def test_resolve_url(spark, location, url):
    assert spark.range(1).select(resolve_url(F.lit(BASE), F.lit(location))).first()[0] == url


def probes(spark, rows):
    return spark.createDataFrame(
        rows,
        "rpc string, path_no int, probe_no bigint, probe_url string, status int, location string, content_length string",
    )


def test_first_redirect_per_node(spark):
    found = source_candidates(
        probes(
            spark,
            [
                ("n1", 1, 1, BASE, 302, "/late", "1"),
                ("n1", 0, 2, BASE, 302, "/first", "18446744073709551615"),
                ("n1", 0, 3, BASE, 302, "/again", "2"),
                ("n2", 0, 4, BASE, 404, "/missing", "3"),
                ("n2", 1, 5, BASE, 399, "/second", "bad"),
                ("n3", 0, 6, BASE, 302, None, "4"),
                ("n4", 0, 7, BASE, 400, "/x", "4"),
                (None, 0, 8, BASE, 302, "/x", "5"),
            ],
        )
    ).collect()
    assert {(r.rpc, r.url[-6:], None if r.size is None else int(r.size)) for r in found} == {
        ("n1", "/first", 2**64 - 1),
        ("n2", "second", None),
    }


def test_speeds_and_ranks(spark):
    rows = spark.createDataFrame(
        [("a", 100, 1.0), ("b", 100, 0.0), ("c", 0, 1.0), ("d", 300, 1.0), ("e", 300, 1.0), ("f", 5, 1.0), ("g", 6, 1.0), ("h", 7, 1.0)],
        "url string, bytes bigint, secs double",
    )
    done, secs = F.col("bytes"), F.col("secs")
    assert [r[0] for r in rows.select(throughput(done, secs)).take(3)] == [100.0, 0.0, 0.0]
    listed = shortlist(rows, done, secs)
    assert [r.url for r in listed.collect()] == ["d", "e", "a", "h", "g"]
    ranked = final_ranking(listed, -done * F.when(F.col("url") == "d", 0).otherwise(-1048576), secs)
    assert [(r.rank, r.url, r.mbps) for r in ranked.collect()] == [(1, "e", 300.0), (2, "a", 100.0), (3, "h", 7.0), (4, "g", 6.0)]


def test_nothing_found(spark):
    assert shortlist(source_candidates(probes(spark, [])), F.lit(1), F.lit(1.0)).collect() == []


def test_sizes_are_strict_u64(spark):
    from ledgerlake.operators.ranking import _u64

    texts = ["12", "+12", "12.5", "-5", " 12 ", "1e3", "18446744073709551615", "18446744073709551616", "", None, "12\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: None if r.n is None else int(r.n) for r in rows.withColumn("n", _u64(rows.t)).collect()}
    assert {t: n for t, n in found.items() if n is not None} == {"12": 12, "+12": 12, "18446744073709551615": 2**64 - 1}


@pytest.mark.parametrize(
    "location, url",
    [("", "http://n/a/b?q"), ("#f", "http://n/a/b?q#f"), ("?r", "http://n/a/b?r"), ("c", "http://n/a/c")],
)
def test_references_without_a_path_keep_the_asked_one(spark, location, url):
    found = spark.range(1).select(resolve_url(F.lit("http://n/a/b?q#old"), F.lit(location)))
    assert found.first()[0] == url


@pytest.mark.parametrize(
    "location, right",
    [("", True), ("/x:y", True), ("http://h:80/x", True), ("//h", True), ("http://[::1]:8/x", True), ("http://u@h/x", True),
     ("http://:80/x", False), ("http://", False), ("//", False), ("http://h:99999/", False), ("http://h:8a/", False),
     ("http://a b/", False), (None, None)],
)
def test_locations_that_parse(spark, location, right):
    assert spark.range(1).select(parses(F.lit(location).cast("string"))).first()[0] is right
