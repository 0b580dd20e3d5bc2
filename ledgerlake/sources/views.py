"""Published tables as SQL views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.sources.files import locate

TABLES = ("accounts", "mints", "token_accounts")


def open_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A published table, or None when it was never written; the folders of stream batches are no column of it."""
    try:
        return spark.read.parquet(f"{folder}/{name}").drop("batch")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def published(folder: str) -> list[str]:
    """Names of the tables in a folder: the usual ones, and those of further decoders that are there."""
    fs, path = locate(folder)

    def holds_table(place: str) -> bool:
        names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(place))]
        return any(n.endswith(".parquet") or n.startswith("batch=") for n in names)

    there = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    folders = [f for f in there if f.type == pafs.FileType.Directory and f.base_name[:1] not in "_."]
    return [*TABLES, *sorted(f.base_name for f in folders if f.base_name not in TABLES and holds_table(f.path))]


def register_views(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """A temporary view per table that is there, or of those named.

    Missing tables are left out, and so are decoded tables without rows.
    """
    names = published(folder) if names is None else names
    found = {name: open_table(spark, folder, name) for name in names}
    views = {
        name: table
        for name, table in found.items()
        if table is not None and (name == "accounts" or not table.isEmpty())
    }
    for name, table in views.items():
        table.createOrReplaceTempView(name)
    return views


def view_counts(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> DataFrame:
    """(name, rows) of each view registered."""
    counted = [
        table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, table in register_views(spark, folder, names).items()
    ]
    if not counted:
        return spark.createDataFrame([], "name string, rows bigint")
    return reduce(DataFrame.unionByName, counted)
