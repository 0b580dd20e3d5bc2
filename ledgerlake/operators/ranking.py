"""Download sources ranked from a log of probes and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How many sources go to the final round, and bytes per MiB.
SHORTLIST = 5
MIB = 1_048_576

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _without_dots(path: Column) -> Column:
    """A path with its `.` and `..` steps followed."""
    steps = F.split(path, "/")

    def follow(done: Column, step: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    walked = F.aggregate(steps, F.array().cast("array<string>"), follow)
    ends_open = F.element_at(steps, -1).isin(".", "..")
    text = F.array_join(F.when(ends_open, F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), text).otherwise(path)


def resolve_url(base: Column, location: Column) -> Column:
    """A redirect's location joined to the URL that was asked (http or https)."""
    scheme = F.regexp_extract(base, _SCHEME, 0)
    origin = F.regexp_extract(base, r"^[^:]+://[^/?#]*", 0)
    base_path = F.regexp_extract(base, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(base_path, r"^.*/", 0), F.lit("")), F.lit("/"))
    path = F.regexp_extract(location, r"^[^?#]*", 0)
    rest = F.regexp_extract(location, r"[?#].*$", 0)
    asked = F.concat(origin, base_path, F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1))
    joined = (
        F.when(location.rlike(_SCHEME), location)
        .when(F.startswith(location, F.lit("//")), F.concat(scheme, location))
        .when(F.startswith(location, F.lit("/")), F.concat(origin, _without_dots(path), rest))
        .when((location == "") | F.startswith(location, F.lit("#")), F.concat(asked, location))
        .when(F.startswith(location, F.lit("?")), F.concat(origin, base_path, location))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest))
    )
    # A URL without a path has the path "/".
    return F.regexp_replace(joined, r"^([^:/]+://[^/?#]+)($|[?#])", "$1/$2")


def parses(location: Column) -> Column:
    """Whether a location is a reference that can be joined: if it names a host, that is not empty and its port fits."""
    named = location.rlike(r"^(?:[hH][tT][tT][pP][sS]?:)?//")
    host = r"^(?:[A-Za-z]+:)?//(?:[^/?#@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]\s<>^|\\]+)(?::([0-9]*))?(?:[/?#]|\z)"
    port = F.nullif(F.regexp_extract(location, host, 1), F.lit("")).try_cast("decimal(20,0)")
    return ~named | (location.rlike(host) & (F.coalesce(port, F.lit(0)) <= 65_535))


def source_candidates(probes: DataFrame) -> DataFrame:
    """One candidate per node: its first path that answered with a redirect.

    Probes have (rpc, path_no, probe_no, probe_url, status, location,
    content_length) and whatever measurements belong to them. The first hit is
    an aggregate with partial results, so a node with very many probes is never
    gathered in one place. A location that does not parse is no hit: the next
    path is taken.
    """
    hit = F.col("rpc").isNotNull() & F.col("status").between(300, 399) & parses(F.col("location"))
    first = F.min_by(F.struct("*"), F.struct("path_no", "probe_no"))
    return (
        probes.where(hit)
        .groupBy("rpc")
        .agg(first.alias("hit"))
        .select("hit.*")
        .withColumn("url", resolve_url(F.col("probe_url"), F.col("location")))
        .withColumn("size", _u64(F.col("content_length")))
    )


def _u64(text: Column) -> Column:
    """Digits, perhaps after a plus, up to 2^64 - 1; anything else is null."""
    number = text.cast("string").try_cast("decimal(20,0)")
    return F.when(text.cast("string").rlike(r"^[+]?[0-9]+\z") & (number <= F.lit(str(2**64 - 1)).cast("decimal(20,0)")), number)


def throughput(done: Column, seconds: Column) -> Column:
    """Bytes per second; 0 for a measurement that gave nothing."""
    return F.when((done > 0) & (seconds > 0), done / seconds).otherwise(F.lit(0.0))


def shortlist(candidates: DataFrame, done: Column, seconds: Column, keep: int = SHORTLIST) -> DataFrame:
    """The fastest candidates of the rough round."""
    return (
        candidates.withColumn("speed", throughput(done, seconds))
        .where(F.col("speed") > 0)
        .orderBy(F.desc("speed"), "url")
        .limit(keep)
    )


def final_ranking(listed: DataFrame, done: Column, seconds: Column) -> DataFrame:
    """The shortlist by measured MiB/s, with rank; rank 1 is the source to use.

    The window has no partition key: it sees the shortlist only.
    """
    measured = (done > 0) & (seconds > 0)
    order = W.orderBy(F.desc("mbps"), "url")
    return (
        listed.where(measured)
        .withColumn("mbps", done / F.lit(MIB) / seconds)
        .withColumn("rank", F.row_number().over(order))
        .orderBy("rank")
    )
