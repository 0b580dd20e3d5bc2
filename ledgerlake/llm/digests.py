"""Exact duplicates by a persistent digest index.

The index holds one row for every distinct text that was ever kept: its SHA-256, and the row that stays. It is a table
bucketed and sorted by the digest, in a folder that any later session can open again. New documents are named by their
digests, made distinct among themselves (partial sums go before the shuffle, so copies cost one row a task), and joined
against the index by a sort-merge anti-join: the new digests are dealt into the index's own buckets, the index is not
shuffled. What is left is appended, bucket by bucket. Texts never leave the task that reads them.

An increment that is run again finds all its digests in the index and adds nothing. A digest belongs to the row that
brought it first; of the rows of one increment the largest id stays.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import stored
from ledgerlake.plans.scratch import new_folder

INDEX = "digest BINARY, doc_id BIGINT, row BIGINT"
#: Rows that one bucket is planned for, and the fewest buckets.
BUCKET_ROWS, BUCKETS = 2_000_000, 16
#: A digest of more than this share of all rows is sent to them by broadcast: at most so many are.
HOT = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """SHA-256 of a text with A-Z lower-cased, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER).cast("binary"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """An index in a folder; `table` is its name in this session's catalog, `buckets` is fixed when it is made."""

    spark: SparkSession
    folder: str
    table: str
    buckets: int

    @staticmethod
    def create(spark: SparkSession, folder: str, rows: int = 0) -> DigestIndex:
        """A new index for about so many distinct texts."""
        buckets = max(BUCKETS, -(-rows // BUCKET_ROWS))
        spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).write.json(f"{folder}/made")
        return DigestIndex.open(spark, folder)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> DigestIndex:
        """An index that is there, made known to this session's catalog."""
        buckets = spark.read.schema("buckets int").json(f"{folder}/made").first().buckets
        name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} ({INDEX}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}/rows'"
        )
        return DigestIndex(spark, folder, name, buckets)

    def rows(self) -> DataFrame:
        """(digest, doc_id, row) of every text kept so far."""
        return self.spark.table(self.table)

    def unseen(self, members: DataFrame) -> DataFrame:
        """(digest, doc_id, row): of every digest in members that the index lacks, the row that is to stay."""
        best = members.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"))
        fresh = best.select("digest", "best.*").repartition(self.buckets, "digest")
        return fresh.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, members: DataFrame) -> None:
        """Add what the index lacks of members(digest, doc_id, row)."""
        fresh = self.unseen(members).select("digest", "doc_id", "row")
        fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)


def members_of(documents: DataFrame) -> DataFrame:
    """(doc_id, row, digest) of every row of documents, stored; row is a number that no other row has."""
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    return stored(documents.select(doc_id, F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest")), "digests")


def ingest(documents: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of documents that stay, with all their columns, after the index has taken them in.

    Of equal texts in documents one row stays, the one with the largest id (null least); none if the index had the text
    before. Null and empty texts are one text. Rows that repeat an id and its text: one stays. No rows give no rows;
    texts of any length count whole; column names do not matter.
    """
    names = [f"_d{k}" for k in range(len(documents.columns))]
    named = documents.toDF(*names)
    doc_id, text = (F.col(names[documents.columns.index(c)]) for c in ("doc_id", "text"))
    whole = stored(named.withColumns({"doc_id": doc_id.cast("bigint"), "row": F.monotonically_increasing_id(), "digest": digest(text)}), "numbered")
    kept = stored(index.unseen(whole.select("digest", "doc_id", "row")), "unseen")
    index.append(kept)
    return whole.join(kept.select("row"), "row", "left_semi").select(*names).toDF(*documents.columns)


def groups(members: DataFrame, index: DigestIndex) -> DataFrame:
    """(doc_id, row, digest, keep_id, keep_row, group_size) of every one of members(doc_id, row, digest): what the index keeps in its stead.

    A digest of many rows must not meet them in one task: those above a HOT-th of all rows, fewer than HOT in number,
    are broadcast; the others go through a sort-merge join in which no digest has a larger share.
    """
    sizes = members.groupBy("digest").agg(F.count("*").alias("group_size"))
    kept = index.rows().select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    sizes = stored(sizes.repartition(index.buckets, "digest").join(kept.hint("merge"), "digest"), "digest-groups")
    hot = F.col("group_size") * HOT > members.count()
    many, few = sizes.where(hot), sizes.where(~hot)
    frequent = members.join(F.broadcast(many), "digest")
    others = members.join(F.broadcast(many.select("digest")), "digest", "left_anti").join(few.hint("merge"), "digest")
    return frequent.unionByName(others)


def op12_exact(documents: DataFrame) -> DataFrame:
    """The contract's columns for every row, by two increments on an empty index.

    The larger ids come first, so that the row which the index keeps has the largest id of all; the second increment
    meets the first one's digests in the index. Nulls and repeats: as `ingest` says, but every row is returned.
    """
    spark = documents.sparkSession
    members = members_of(documents)
    middle = members.approxQuantile("doc_id", [0.5], 0.05)
    index = DigestIndex.create(spark, new_folder(spark, "digest-index"), members.count())
    later = F.coalesce(F.col("doc_id") > int(middle[0]), F.lit(False)) if middle else F.lit(True)
    index.append(members.where(later))
    index.append(members.where(~later))
    kept = F.col("row") == F.col("keep_row")
    return groups(members, index).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW same AS (PARTITION BY text)
"""
