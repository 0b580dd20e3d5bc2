"""Listings and counters over archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.binary import align
from ledgerlake.schemas import ENTRIES, pick
from ledgerlake.sources.archive import BLOCK
from ledgerlake.sources.snapshot import register

LISTED = ("archive", "entry_no", "path", "typeflag", "size", "is_accounts")


def list_entries(spark: SparkSession, path: str, *, accounts_only: bool = False, kind: str = "all") -> DataFrame:
    """Members of the archives, without their bodies."""
    register(spark)
    return (
        spark.read.format("ledger_snapshot")
        .schema(pick(ENTRIES, *LISTED))
        .options(kind=kind, accountsOnly=str(accounts_only).lower(), includeContent="false", endOfArchive="emptyName")
        .load(path)
    )


def accounts_members(entries: DataFrame) -> DataFrame:
    """Members that hold accounts, as the reader tells them: a regular file with `accounts/` in its name field."""
    return entries.where("is_accounts")


def manifest(entries: DataFrame) -> DataFrame:
    """Per archive: members, account members, their bytes, and the bytes they take when padded."""
    size = F.when(F.col("is_accounts"), F.col("size")).otherwise(0)
    return entries.groupBy("archive").agg(
        F.count("*").alias("entries"),
        F.count_if("is_accounts").alias("account_files"),
        F.sum(size).alias("account_bytes"),
        F.sum(align(size, BLOCK)).alias("padded_bytes"),
    )


def counts(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row of totals: members, account members, their bytes, and account versions."""
    size = F.when(F.col("is_accounts"), F.col("size")).otherwise(0)
    totals = entries.agg(
        F.count("*").alias("entries"),
        F.count_if("is_accounts").alias("account_files"),
        F.coalesce(F.sum(size), F.lit(0)).alias("account_bytes"),
    )
    zero = F.lit(0).cast(T.LongType())
    both = totals.withColumn("accounts", zero).unionByName(
        accounts.agg(F.count("*").alias("accounts")).select(
            *[zero.alias(n) for n in ("entries", "account_files", "account_bytes")], "accounts"
        )
    )
    return both.agg(*[F.sum(name).alias(name) for name in both.columns])
