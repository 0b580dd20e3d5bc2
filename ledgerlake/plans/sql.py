"""SQL text over the published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.functions.text import format_rows
from ledgerlake.sources.views import register_views


def query(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The result of any Spark SQL text over the views of `folder`."""
    register_views(spark, folder)
    return spark.sql(sql)


def query_text(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The same result with every value as display text."""
    return format_rows(query(spark, folder, sql))
