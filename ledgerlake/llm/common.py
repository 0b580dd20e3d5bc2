"""What several operators of this subpackage need: stored steps, words, shared vocabulary files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.plans.scratch import CLEAN_UP as _CLEAN_UP  # noqa: F401 (what tests look at)
from ledgerlake.plans.scratch import new_folder, shuffles_removed

#: A word, as every contract of this subpackage defines it: no space and no control from tab to return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(rows: DataFrame, purpose: str, instead_of: Iterable[DataFrame] = ()) -> DataFrame:
    """Write the rows to the shared folder and read them back: later jobs start there, whoever is lost.

    `instead_of`: stored tables that nothing else reads, which are removed once the new one is written.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, purpose)
    with shuffles_removed(spark):
        rows.write.parquet(folder)
    for old in instead_of:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop(old))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    found = spark.read.schema(rows.schema).parquet(folder)
    _folders[found] = folder
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8: bytes.lower and bytes.split treat ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def in_blocks(values: list, size: int) -> Iterator[list]:
    for begin in range(0, len(values), size):
        yield values[begin : begin + size]


def blocks_of(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Consecutive rows of at most so many bytes together, or one larger row."""
    begin = held = 0
    for at, size in enumerate(sizes):
        if at > begin and held + size > most:
            yield slice(begin, at)
            begin, held = at, 0
        held += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def in_parts(rows: DataFrame, key: str, sizes: DataFrame, hashed: list[str], least: int, part_rows: int = 1_000_000) -> DataFrame:
    """The rows with _part: a number by their hash, such that no (key, _part) has many more than `part_rows` rows.

    sizes(key, _rows) has a row for each key; it is broadcast, so keys must be few. Keys have `least` parts at least.
    """
    parts = F.greatest(F.lit(least), F.ceil(F.col("_rows") / part_rows))
    few = F.broadcast(sizes.select(key, parts.alias("_parts")))
    return rows.join(few, key).withColumn("_part", F.pmod(F.xxhash64(*hashed), F.col("_parts"))).drop("_parts")
