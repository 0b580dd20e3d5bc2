"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark removes a query's shuffle files once it has ended, not when the driver next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local folder only for a local master that names none."""
    shared = spark.conf.get(SETTING, None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    if spark not in _local_roots:
        _local_roots[spark] = tempfile.mkdtemp(prefix="ledgerlake-")
    return _local_roots[spark]


_local_roots: dict[SparkSession, str] = {}


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A folder name nobody has used."""
    return f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that end in this block go with them: what they wrote is all that is read later."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
