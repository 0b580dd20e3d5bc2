"""One query per operator, over the ledger that is derived from the given tables.

Keys are published as lower-case hex, u64 values and their sums as text, so that
results compare plainly with the checking SQL and no number is too large.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures.lake import DECODERS, PROGRAMS, Lake, key_of, lake_of
from fixtures.ledger import table
from ledgerlake.functions import base58, binary
from ledgerlake.functions.text import describe_account
from ledgerlake.operators import listing, ranking
from ledgerlake.operators.decoders import MINTS, TOKEN_ACCOUNTS, dispatch, is_nft
from ledgerlake.operators.filters import SnapshotFilters, accounts
from ledgerlake.operators.known import read_known_mints
from ledgerlake.operators.metrics import RunClock
from ledgerlake.operators.ordered import Previous, Rank, RowNumber, RunningSum, measured
from ledgerlake.operators.records import read_accounts
from ledgerlake.operators.sketches import ERROR, estimates, holder_sketches
from ledgerlake.plans.scratch import new_folder, shuffles_removed
from ledgerlake.plans.sql import query, query_text
from ledgerlake.schemas import ACCOUNT_VERSIONS, ENTRIES, TOKEN_PROGRAM
from ledgerlake.sources.files import list_files
from ledgerlake.sources.snapshot import ARCHIVE_PATTERNS, register
from ledgerlake.sources.views import view_counts as count_views
from ledgerlake.streaming.landing import publish_arriving_archives

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

HASHED_COLUMNS = [n for n in ACCOUNT_VERSIONS.names if n not in ("archive", "path", "rec_offset", "data")]
DESCRIBED = ("write_version", "data_len", "pubkey", "lamports", "rent_epoch", "owner", "executable", "hash")
ALL = SnapshotFilters(include_dead=True)


def lake_query(build: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
    """Register a query over the lake under the function's name, less a closing underscore."""
    QUERIES[build.__name__.rstrip("_")] = lambda spark, sf_dir: build(lake_of(spark, sf_dir))
    return build


def table_query(build: Query) -> Query:
    """Register a query over the given tables under the function's name."""
    QUERIES[build.__name__] = build
    return build


def _hex(column: Column | str) -> Column:
    return F.lower(F.hex(column))


def shown(rows: DataFrame) -> DataFrame:
    """Columns in the types the checking SQL gives."""

    def show(name: str, kind: str) -> Column:
        column = F.col(name)
        if kind == "binary":
            return _hex(column)
        if kind.startswith("decimal"):
            return column.cast("string")
        return column.cast("int") if kind == "smallint" else column

    return rows.select(*[show(name, kind).alias(name) for name, kind in rows.dtypes])


# Scans, listings and the record walk


@lake_query
def archive_entries(lake: Lake) -> DataFrame:
    register(lake.spark)
    chunks = lake.spark.read.format("ledger_snapshot").schema(ENTRIES).load(lake.archives)
    return chunks.groupBy(*listing.LISTED).agg(
        F.count("*").alias("chunks"), F.sum(F.octet_length("content")).alias("content_bytes")
    )


@lake_query
def archive_manifest(lake: Lake) -> DataFrame:
    return listing.manifest(listing.list_entries(lake.spark, lake.archives))


@lake_query
def accounts_entries_only(lake: Lake) -> DataFrame:
    entries = listing.list_entries(lake.spark, lake.archives, accounts_only=True)
    return listing.accounts_members(entries).select("archive", "path", "size")


@lake_query
def incremental_scan(lake: Lake) -> DataFrame:
    columns = ("pubkey", "lamports", "owner", "data_len", "executable", "rent_epoch")
    filters = SnapshotFilters()
    rows = read_accounts(lake.spark, lake.archives, kind="incremental", columns=columns, filters=filters)
    return shown(accounts(rows, filters))


@lake_query
def known_mints(lake: Lake) -> DataFrame:
    return shown(read_known_mints(lake.spark, lake.known_text))


@lake_query
def view_counts(lake: Lake) -> DataFrame:
    return count_views(lake.spark, lake.published)


@lake_query
def accounts_all_versions(lake: Lake) -> DataFrame:
    rows = lake.read(columns=HASHED_COLUMNS)
    return shown(rows).withColumn("executable", F.col("executable").cast("int"))


@lake_query
def bench_counts(lake: Lake) -> DataFrame:
    entries = listing.list_entries(lake.spark, lake.archives)
    return listing.counts(entries, read_accounts(lake.spark, lake.archives, columns=("executable",)))


# Projections and filters


def _accounts(lake: Lake, filters: SnapshotFilters) -> DataFrame:
    return shown(accounts(lake.headers, filters))


def _text(name: str) -> str:
    return base58.encode(key_of(name))


@lake_query
def accounts_(lake: Lake) -> DataFrame:
    return _accounts(lake, SnapshotFilters())


@lake_query
def accounts_include_dead(lake: Lake) -> DataFrame:
    return _accounts(lake, ALL)


@lake_query
def filter_owner(lake: Lake) -> DataFrame:
    return _accounts(lake, SnapshotFilters(owner=_text("loader")))


@lake_query
def filter_hash(lake: Lake) -> DataFrame:
    return _accounts(lake, SnapshotFilters(hash=_text("hash:mint:4")))


@lake_query
def filter_pubkey(lake: Lake) -> DataFrame:
    return _accounts(lake, SnapshotFilters(pubkey=_text("wallet:3")))


@lake_query
def filter_conjunction(lake: Lake) -> DataFrame:
    token_program = base58.encode(TOKEN_PROGRAM)
    return _accounts(lake, SnapshotFilters(owner=token_program, pubkey=_text("mint:9")))


@lake_query
def decoder_match(lake: Lake) -> DataFrame:
    return shown(
        lake.headers.select(
            "pubkey",
            binary.u64_of(lake.headers, "data_len").alias("data_len"),
            MINTS.matches().alias("is_mint"),
            TOKEN_ACCOUNTS.matches().alias("is_token_account"),
        )
    )


@lake_query
def decoder_dispatch(lake: Lake) -> DataFrame:
    return (
        lake.headers.select(
            dispatch(DECODERS).alias("chosen"), binary.u64_of(lake.headers, "lamports").alias("lamports")
        )
        .groupBy("chosen")
        .agg(F.count("*").alias("versions"), F.sum("lamports").cast("string").alias("lamports"))
    )


@lake_query
def zero_keys(lake: Lake) -> DataFrame:
    return lake.headers.groupBy(
        binary.is_zero(F.col("pubkey")).alias("zero_pubkey"), binary.is_zero(F.col("owner")).alias("zero_owner")
    ).agg(F.count("*").alias("versions"))


# Decoded tables


@lake_query
def mints_all(lake: Lake) -> DataFrame:
    return shown(MINTS.table(lake.decoded(MINTS)))


@lake_query
def token_accounts_all(lake: Lake) -> DataFrame:
    return shown(TOKEN_ACCOUNTS.table(lake.decoded(TOKEN_ACCOUNTS)))


@lake_query
def mints_verified(lake: Lake) -> DataFrame:
    return shown(MINTS.table(lake.decoded(MINTS), lake.known))


@lake_query
def token_accounts_verified(lake: Lake) -> DataFrame:
    return shown(TOKEN_ACCOUNTS.table(lake.decoded(TOKEN_ACCOUNTS), lake.known))


@lake_query
def nft_mints(lake: Lake) -> DataFrame:
    return shown(MINTS.table(lake.decoded(MINTS)).where(is_nft(F.col("supply"), F.col("decimals"))))


@lake_query
def option_fields(lake: Lake) -> DataFrame:
    data = F.col("data")

    def option(name: str, at: int, value: Column) -> Column:
        tag = F.conv(F.hex(binary.field(data, at, 1)), 16, 10).cast("int")
        return F.struct(F.lit(name).alias("field"), tag.alias("tag"), binary.optional(data, at, value).alias("value"))

    def key(name: str, at: int) -> Column:
        return option(name, at, _hex(binary.field(data, at + 4, 32)))

    mints = F.array(key("mint_authority", 0), key("freeze_authority", 46))
    native = option("is_native", 109, binary.u64(data, 113).cast("string"))
    tokens = F.array(key("delegate", 72), key("close_authority", 129), native)
    # One pass over the versions of both decoders, however many options they have.
    found = F.when(MINTS.matches(), mints).otherwise(tokens)
    return shown(lake.decoded(MINTS, TOKEN_ACCOUNTS).select("pubkey", F.inline(found)))


@lake_query
def custom_decoder(lake: Lake) -> DataFrame:
    return shown(PROGRAMS.table(lake.decoded(PROGRAMS)))


# Scalar functions


@lake_query
def base58_round_trip(lake: Lake) -> DataFrame:
    decoded = MINTS.table(lake.decoded(MINTS))
    there = decoded.select(
        "pubkey", *[base58.to_base58(n).alias(n) for n in ("mint_authority", "freeze_authority")],
        base58.to_base58("pubkey").alias("text"),
    )
    return shown(
        there.select(
            "pubkey", base58.from_base58("text").alias("decoded"),
            base58.from_base58("mint_authority").alias("mint_authority"),
            base58.try_from_base58("freeze_authority").alias("freeze_authority"),
        )
    )


@lake_query
def key_bytes(lake: Lake) -> DataFrame:
    return lake.headers.select(
        _hex(F.unhex(F.hex("pubkey"))).alias("pubkey"),
        F.octet_length("pubkey").alias("width"),
        binary.u8(F.col("pubkey"), 0).cast("int").alias("first_byte"),
        (F.col("owner") == binary.key(TOKEN_PROGRAM)).alias("of_token_program"),
    )


@lake_query
def u64_columns(lake: Lake) -> DataFrame:
    data = F.col("data")
    return lake.decoded(MINTS).select(
        _hex("pubkey").alias("pubkey"),
        binary.u64(data, 36).cast("string").alias("supply"),
        binary.i64_le(data, 36).alias("supply_bits"),
        binary.u8(data, 44).cast("int").alias("decimals"),
        _hex(binary.le64(binary.i64_le(data, 36))).alias("supply_bytes"),
    )


@lake_query
def describe_accounts(lake: Lake) -> DataFrame:
    # The lines taken apart again.
    parts = F.split(describe_account(lake.headers), ", ")
    values = lake.headers.select(parts.alias("parts")).select(
        *[F.substring_index(F.col("parts")[n], ": ", -1).alias(name) for n, name in enumerate(DESCRIBED)]
    )

    def value(name: str) -> Column:
        if name in ("pubkey", "owner", "hash"):
            return _hex(base58.from_base58(name))
        return F.col(name).cast("int") if name == "executable" else F.col(name)

    return values.select(*[value(name).alias(name) for name in DESCRIBED])


# Metrics, sinks, streaming


@lake_query
def run_metrics(lake: Lake) -> DataFrame:
    compressed = sum(size for _, size in list_files(lake.archives, ARCHIVE_PATTERNS["all"]))
    passing = accounts(lake.headers)
    clock = RunClock()
    clock.watch(passing).write.format("noop").mode("overwrite").save()
    return clock.summary(lake.spark, compressed).select("rows_parsed", "record_bytes")


@lake_query
def sink_round_trip(lake: Lake) -> DataFrame:
    def total(name: str, of: str, key: str) -> DataFrame:
        return lake.table(name).agg(
            F.lit(name).alias("name"),
            F.count("*").alias("rows"),
            F.sum(of).cast("string").alias("total"),
            _hex(F.max(key)).alias("last_key"),
        )

    return (
        total("accounts", "lamports", "owner")
        .unionByName(total("mints", "supply", "mint_authority"))
        .unionByName(total("token_accounts", "amount", "close_authority"))
    )


@lake_query
def stream_accounts(lake: Lake) -> DataFrame:
    out = new_folder(lake.spark, "streamed")
    for landing in lake.landings():
        publish_arriving_archives(
            lake.spark, landing, f"{out}/tables", f"{out}/progress", known=lake.known
        ).awaitTermination()
    return shown(lake.spark.read.parquet(f"{out}/tables/accounts").drop("batch"))


# Ranking of download sources


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    rpc = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("n"), user, F.lit(":8899")))
    path_no = (event % 2).cast("int")
    return table(spark, sf_dir, "events").select(
        rpc.alias("rpc"),
        path_no.alias("path_no"),
        event.alias("probe_no"),
        F.concat(
            F.lit("http://"), rpc, F.when(path_no == 0, "/snapshot.tar.zst").otherwise("/snapshot.tar.bz2")
        ).alias("probe_url"),
        F.when(F.col("event_type") == "error", 404)
        .when(F.col("event_type") == "signup", 200)
        .otherwise(302)
        .alias("status"),
        F.when(event % 3 == 0, F.concat(F.lit("/snap-"), event.cast("string"), F.lit(".tar.zst")))
        .when(event % 3 == 1, F.concat(F.lit("http://h"), user, F.lit("/s"), event.cast("string"), F.lit(".tar.zst")))
        .when(event % 12 == 2, "")
        .when(event % 12 == 5, "#f")
        .when(event % 12 == 8, "http://:80/s")
        .alias("location"),
        F.when(event % 35 == 5, F.lit("12.5"))
        .when(event % 35 == 15, F.lit("-5"))
        .when(event % 35 == 25, F.lit("99999999999999999999"))
        .when(event % 5 == 0, F.lit("bad")).otherwise((event * 1000).cast("string")).alias("content_length"),
        (event * 1000).alias("bytes"),
        F.col("value").alias("secs"),
        (event * 32000).alias("bytes2"),
        (F.col("value") * 30 + event % 7).alias("secs2"),
    )


@table_query
def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.source_candidates(_probes(spark, sf_dir))
    return found.select("rpc", "path_no", "url", F.col("size").cast("bigint").alias("size"))


def _shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.source_candidates(_probes(spark, sf_dir))
    return ranking.shortlist(found, F.col("bytes"), F.col("secs"))


@table_query
def rank_sources_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shortlist(spark, sf_dir).select("url", F.round("speed", 6).alias("speed"))


@table_query
def rank_sources_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.final_ranking(_shortlist(spark, sf_dir), F.col("bytes2"), F.col("secs2"))
    return ranked.select(
        "rank", "url", F.round("mbps", 6).alias("mbps"), (F.col("rank") == 1).alias("best")
    )


# SQL shapes over the published tables


@lake_query
def sql_top_holders(lake: Lake) -> DataFrame:
    top = (
        lake.table("token_accounts")
        .groupBy("owner")
        .agg(F.sum("amount").alias("amount"), F.count("*").alias("accounts"))
        .orderBy(F.desc("amount"), "owner")
        .limit(20)
    )
    return shown(top)


@lake_query
def sql_supply_vs_held(lake: Lake) -> DataFrame:
    # Summed per mint before the join, so a hot mint is one row there.
    held = lake.table("token_accounts").groupBy("mint").agg(F.sum("amount").alias("held"))
    mints = lake.table("mints")
    joined = held.join(mints, held["mint"] == mints["pubkey"])
    return (
        joined.groupBy("pubkey", "supply")
        .agg(F.sum("held").alias("held"))
        .select(_hex("pubkey").alias("mint"), *(F.col(n).cast("string").alias(n) for n in ("supply", "held")))
    )


@lake_query
def sql_left_unheld_mints(lake: Lake) -> DataFrame:
    held = lake.table("token_accounts").select("mint").distinct()
    mints = lake.table("mints")
    return mints.join(held, mints["pubkey"] == held["mint"], "left_anti").select(_hex("pubkey").alias("mint"))


@lake_query
def sql_wallet_balances(lake: Lake) -> DataFrame:
    # One row per (owner, mint) goes into the joins, one row per owner comes out of the first.
    positions = (
        lake.table("token_accounts")
        .groupBy("owner", "mint")
        .agg(F.sum("amount").alias("amount"), F.count("*").alias("token_accounts"))
    )
    mints = lake.table("mints").select(F.col("pubkey").alias("mint"), "decimals")
    per_owner = (
        positions.join(mints, "mint")
        .groupBy("owner")
        .agg(
            F.sum("amount").alias("amount"),
            F.sum("token_accounts").alias("token_accounts"),
            F.count("*").alias("mints"),
            F.max("decimals").alias("max_decimals"),
        )
    )
    wallets = lake.table("accounts").select("pubkey", "lamports")
    return shown(
        wallets.join(per_owner, wallets["pubkey"] == per_owner["owner"]).select(
            F.col("pubkey").alias("wallet"), "lamports", "amount", "token_accounts", "mints", "max_decimals"
        )
    )


@lake_query
def sql_distinct_holders(lake: Lake) -> DataFrame:
    return shown(lake.table("token_accounts").groupBy("mint").agg(F.count_distinct("owner").alias("holders")))


@lake_query
def sql_approx_holders(lake: Lake) -> DataFrame:
    # Sketches of two halves of the accounts, as two batches would leave them, put together.
    held = lake.table("token_accounts")
    half = F.pmod(F.xxhash64("pubkey"), F.lit(2)) == 0
    folder = new_folder(lake.spark, "holder-sketches")
    with shuffles_removed(lake.spark):
        for part in (held.where(half), held.where(~half)):
            holder_sketches(part).write.mode("append").parquet(folder)
    found = estimates(lake.spark.read.parquet(folder)).select(F.col("mint").alias("of"), "estimate")
    counted = held.groupBy("mint").agg(F.count_distinct("owner").alias("holders"))
    near = F.abs(F.col("estimate") - F.col("holders")) <= F.greatest(F.lit(1.0), ERROR * F.col("holders"))
    return shown(counted.join(found, F.col("mint") == F.col("of")).select("mint", "holders", near.alias("near")))


@lake_query
def sql_owner_state_rollup(lake: Lake) -> DataFrame:
    return query(
        lake.spark,
        lake.published,
        """SELECT CAST(state AS INT) AS state, is_native IS NOT NULL AS native,
                  count(*) AS accounts, CAST(sum(amount) AS STRING) AS amount
           FROM token_accounts
           GROUP BY ROLLUP (CAST(state AS INT), is_native IS NOT NULL)""",
    )


@lake_query
def sql_cube_accounts(lake: Lake) -> DataFrame:
    return query(
        lake.spark,
        lake.published,
        """SELECT lower(hex(owner)) AS owner, executable, accounts, lamports FROM (
             SELECT owner, executable, count(*) AS accounts, CAST(sum(lamports) AS STRING) AS lamports
             FROM accounts GROUP BY CUBE (owner, executable))""",
    )


@lake_query
def sql_grouping_sets(lake: Lake) -> DataFrame:
    return query(
        lake.spark,
        lake.published,
        """SELECT CAST(decimals AS INT) AS decimals, is_initialized,
                  CAST(grouping(CAST(decimals AS INT)) AS INT) AS all_decimals,
                  CAST(grouping(is_initialized) AS INT) AS all_initialized, count(*) AS mints
           FROM mints
           GROUP BY GROUPING SETS ((CAST(decimals AS INT)), (is_initialized), ())""",
    )


def _held_in_order(lake: Lake, measures: Sequence) -> DataFrame:
    held = lake.table("token_accounts").select("mint", "pubkey", "amount")
    return shown(measured(held, ["mint"], [F.desc("amount"), F.col("pubkey")], measures))


@lake_query
def sql_holder_rank(lake: Lake) -> DataFrame:
    return _held_in_order(lake, [RowNumber("place"), Rank("rank", ("amount",))])


@lake_query
def sql_running_amount(lake: Lake) -> DataFrame:
    return _held_in_order(lake, [RunningSum("running", "amount")])


@lake_query
def sql_lag_amount(lake: Lake) -> DataFrame:
    return _held_in_order(lake, [Previous("previous", "amount")])


@lake_query
def sql_owner_setops(lake: Lake) -> DataFrame:
    # Each side is distinct before the sets meet, so an owner of very many accounts is one row there.
    return query(
        lake.spark,
        lake.published,
        """WITH holders AS (SELECT DISTINCT owner FROM token_accounts),
                wallets AS (SELECT DISTINCT pubkey AS owner FROM accounts)
           SELECT lower(hex(owner)) AS owner, 'union' AS set
           FROM (SELECT * FROM holders UNION SELECT * FROM wallets)
           UNION ALL
           SELECT lower(hex(owner)), 'intersect' FROM (SELECT * FROM holders INTERSECT SELECT * FROM wallets)
           UNION ALL
           SELECT lower(hex(owner)), 'except' FROM (SELECT * FROM wallets EXCEPT SELECT * FROM holders)""",
    )


BANDS = [("dust", 0, 5_000), ("small", 5_000, 20_000), ("medium", 15_000, 35_000), ("large", 35_000, 2**64)]


@lake_query
def sql_theta_range(lake: Lake) -> DataFrame:
    # Bands meet amounts on the number of digits first, so this is a hash join.
    texts = [(band, str(low), str(high)) for band, low, high in BANDS]
    bands = lake.spark.createDataFrame(texts, "band string, low string, high string").select(
        "band", *[F.col(n).cast("decimal(20,0)").alias(n) for n in ("low", "high")]
    )

    def digits(column: Column) -> Column:
        return F.length(column.cast("string"))

    by_digits = bands.withColumn(
        "digits", F.explode(F.sequence(digits(F.col("low")), digits(F.col("high") - 1)))
    )
    amounts = lake.table("token_accounts").select("amount")
    inside = (F.col("amount") >= F.col("low")) & (F.col("amount") < F.col("high"))
    return (
        amounts.withColumn("digits", digits(F.col("amount")))
        .join(F.broadcast(by_digits), "digits")
        .where(inside)
        .groupBy("band")
        .agg(F.count("*").alias("accounts"), F.sum("amount").cast("string").alias("amount"))
    )


@lake_query
def sql_scalar_subquery(lake: Lake) -> DataFrame:
    # The maxima are a written table: both sides of the join are then plain scans, and a hot mint is dealt by amount.
    held = lake.table("token_accounts")
    folder = new_folder(lake.spark, "mint-maxima")
    with shuffles_removed(lake.spark):
        held.groupBy("mint").agg(F.max("amount").alias("amount")).write.parquet(folder)
    best = lake.spark.read.parquet(folder)
    return shown(held.join(best, ["mint", "amount"], "left_semi").select("mint", "pubkey", "amount"))


@lake_query
def sql_correlated_maximum(lake: Lake) -> DataFrame:
    # As a user writes it. `sql_scalar_subquery` gives the same where one mint has a large share of all accounts.
    return query(
        lake.spark,
        lake.published,
        """SELECT lower(hex(mint)) AS mint, lower(hex(pubkey)) AS pubkey, CAST(amount AS STRING) AS amount
           FROM token_accounts t
           WHERE amount = (SELECT max(amount) FROM token_accounts s WHERE s.mint = t.mint)""",
    )


@lake_query
def sql_formatted(lake: Lake) -> DataFrame:
    # Two columns of the result are named pubkey.
    rows = query_text(
        lake.spark,
        lake.published,
        """SELECT lower(hex(m.pubkey)) AS pubkey, CAST(decimals AS INT) AS decimals, is_initialized,
                  supply, CAST(supply AS DOUBLE) / 7e3 AS scaled,
                  CAST(decimals AS FLOAT) AS decimals_float, lower(hex(mint_authority)) AS authority,
                  lower(hex(t.pubkey)) AS pubkey, t.amount
           FROM mints m JOIN token_accounts t ON t.mint = m.pubkey""",
    )
    return rows.toDF(
        "mint", "decimals", "is_initialized", "supply", "scaled", "decimals_float", "authority", "token", "amount"
    )


@lake_query
def top_distinct_holders(lake: Lake) -> DataFrame:
    """The flagship: verified mints with the most holders, from decoded token accounts."""
    held = TOKEN_ACCOUNTS.table(lake.decoded(TOKEN_ACCOUNTS), lake.known)
    top = held.groupBy("mint").agg(F.count_distinct("owner").alias("holders")).orderBy(F.desc("holders"), "mint")
    return shown(top.limit(10))
