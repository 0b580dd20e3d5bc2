"""Distinct holders by mergeable sketches.

A sketch is small however many holders it has seen, and sketches of parts, of stream batches say, give the sketch of the
whole. They are Spark's own HyperLogLog sketches; sums of a part are taken before the shuffle, so a hot mint is one
sketch a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of a sketch's registers; three standard deviations are below 3 * 1.04 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 12
ERROR = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)


def holder_sketches(token_accounts: DataFrame) -> DataFrame:
    """(mint, holders): a sketch of the owners of each mint."""
    return token_accounts.groupBy("mint").agg(F.hll_sketch_agg("owner", LOG_REGISTERS).alias("holders"))


def merged(sketches: DataFrame) -> DataFrame:
    """(mint, holders): one sketch for each mint, of any number of them."""
    return sketches.groupBy("mint").agg(F.hll_union_agg("holders").alias("holders"))


def estimates(sketches: DataFrame) -> DataFrame:
    """(mint, estimate) from any number of sketches of a mint."""
    return merged(sketches).select("mint", F.hll_sketch_estimate("holders").alias("estimate"))
