"""The synthetic ledger as archives and tables, made once per session and scale."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from fixtures.pack import archives_of, archives_to_read, known_mint_lines, read_packed, write_archives
from ledgerlake.operators.decoders import DEFAULT_DECODERS, Decoder, Field
from ledgerlake.operators.known import read_known_mints
from ledgerlake.operators.records import read_accounts
from ledgerlake.plans.ingest import publish_archives, read_versions, write_versions
from ledgerlake.plans.scratch import new_folder, shuffles_removed
from ledgerlake.schemas import STORED_VERSIONS
from ledgerlake.sources.files import remove_folder


def key_of(text: str) -> bytes:
    """K(text) of FIXTURES.md, on the driver."""
    return hashlib.sha256(text.encode()).digest()


PROGRAMS = Decoder(
    "programs",
    key_of("loader"),
    36,
    (Field("kind", "u32", 0), Field("programdata", "key", 4)),
)
DECODERS = (*DEFAULT_DECODERS, PROGRAMS)

#: Archives that are kept, some 16 GB, for every query to read. Of a larger ledger each is read by the task that packs it.
KEPT_ARCHIVES = 1_000


@dataclass(eq=False)
class Lake:
    """Each part is written to the shared folder when it is first asked for.

    More archives than `kept` are written only for who asks for the folder
    itself. Else they pass: the task that packs one reads and removes it, and
    what is read of them is not stored either.
    """

    spark: SparkSession
    sf_dir: str
    root: str
    kept: int = KEPT_ARCHIVES

    @cached_property
    def archives(self) -> str:
        folder = f"{self.root}/archives"
        with shuffles_removed(self.spark):
            write_archives(self.spark, self.sf_dir, folder).write.mode("overwrite").parquet(f"{self.root}/packed")
        return folder

    @cached_property
    def count(self) -> int:
        return archives_of(self.spark, self.sf_dir)

    def _pass(self) -> bool:
        return "archives" not in vars(self) and self.count > self.kept

    def read(self, **options) -> DataFrame:
        """`read_accounts` over all archives."""
        if self._pass():
            return read_packed(self.spark, self.sf_dir, self.count, **options)
        return read_accounts(self.spark, self.archives, **options)

    def landings(self) -> Iterator[str]:
        """The folder where archives land, again whenever more have: half of `kept` at a time, which are then removed, or all."""
        if not self._pass():
            yield self.archives
            return
        folder, share = new_folder(self.spark, "landing"), max(1, self.kept // 2)
        for first in range(0, self.count, share):
            wanted = range(first, min(first + share, self.count))
            landed = write_archives(self.spark, self.sf_dir, folder, self.count, wanted)
            try:
                with shuffles_removed(self.spark):
                    landed.write.mode("append").parquet(f"{self.root}/landed")
                yield folder
            finally:
                remove_folder(folder)

    @cached_property
    def known_text(self) -> str:
        folder = f"{self.root}/known-text"
        known_mint_lines(self.spark, self.sf_dir).write.mode("overwrite").text(folder)
        return folder

    @cached_property
    def known(self) -> DataFrame:
        folder = f"{self.root}/known"
        read_known_mints(self.spark, self.known_text).write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder)

    @cached_property
    def versions(self) -> DataFrame:
        folder = f"{self.root}/versions"
        rows = read_accounts(self.spark, self.archives, decoders=DECODERS, schema=STORED_VERSIONS)
        write_versions(rows, folder, DECODERS)
        return read_versions(self.spark, folder)

    def _stored(self, name: str, decoders: Sequence[Decoder], columns: Sequence[str], **options) -> DataFrame:
        if self._pass():
            return self.read(columns=columns, decoders=decoders, schema=STORED_VERSIONS, **options)
        if name not in self._kept:
            folder = f"{self.root}/{name}"
            rows = read_accounts(
                self.spark, self.archives, columns=columns, decoders=decoders, schema=STORED_VERSIONS, **options
            )
            write_versions(rows, folder, decoders)
            self._kept[name] = read_versions(self.spark, folder)
        return self._kept[name]

    @cached_property
    def _kept(self) -> dict[str, DataFrame]:
        return {}

    @property
    def headers(self) -> DataFrame:
        """All versions without their data, which no query of the record's own fields reads."""
        return self._stored("headers", DECODERS, [n for n in STORED_VERSIONS.names if n != "data"])

    def decoded(self, *decoders: Decoder) -> DataFrame:
        """The versions that these decoders take, in the columns that decoding reads."""
        columns = ("pubkey", "owner", "data_len", "data")
        return self._stored("-".join(["decoded", *(d.name for d in decoders)]), decoders, columns, decoded_only=True)

    @cached_property
    def published(self) -> str:
        folder, passing = f"{self.root}/published", new_folder(self.spark, "passing")
        archives = archives_to_read(self.spark, self.sf_dir, passing, self.count) if self._pass() else self.archives
        try:
            with shuffles_removed(self.spark):
                publish_archives(self.spark, archives, lambda name: f"{folder}/{name}", known=self.known)
        finally:
            remove_folder(passing)  # holds what failed attempts left
        return folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.published}/{name}")


_lakes: dict[tuple[SparkSession, str], Lake] = {}


def lake_of(spark: SparkSession, sf_dir: str) -> Lake:
    if (spark, sf_dir) not in _lakes:
        _lakes[spark, sf_dir] = Lake(spark, sf_dir, new_folder(spark, "ledger"))
    return _lakes[spark, sf_dir]
