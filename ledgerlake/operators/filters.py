"""Which account versions reach the `accounts` table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.base58 import decode_optional
from ledgerlake.functions.binary import key, u64_of
from ledgerlake.operators.walk import Condition


@dataclass(frozen=True)
class SnapshotFilters:
    """Filters as a user states them; keys are base58 text.

    `include_dead` keeps accounts without lamports. `include_spam` concerns the
    decoded tables only. Bad base58 raises here, before any job starts.
    """

    owner: str | None = None
    pubkey: str | None = None
    hash: str | None = None
    include_dead: bool = False
    include_spam: bool = False

    def keys(self) -> dict[str, bytes]:
        """The keys asked for, as bytes."""
        asked = {"owner": self.owner, "pubkey": self.pubkey, "hash": self.hash}
        return {name: decode_optional(text) for name, text in asked.items() if text is not None}

    def predicate(self) -> Column:
        """All that was asked for, joined by AND."""
        parts = [] if self.include_dead else [F.col("lamports") != 0]
        parts += [F.col(name) == key(value) for name, value in self.keys().items()]
        return reduce(and_, parts, F.lit(True))

    def conditions(self) -> list[Condition]:
        """The same filters for the record walk."""
        parts = [] if self.include_dead else [Condition("lamports", "!=", 0)]
        return parts + [Condition(name, "==", value) for name, value in self.keys().items()]

    def reader_options(self) -> dict[str, str]:
        """The same filters as options of the ``ledger_accounts`` source."""
        options = {name + "Hex": value.hex() for name, value in self.keys().items()}
        return options | {"includeDead": str(self.include_dead).lower()}


def accounts(versions: DataFrame, filters: SnapshotFilters = SnapshotFilters()) -> DataFrame:
    """The published `accounts` table: every stored version that passes, without dedupe."""
    return versions.where(filters.predicate()).select(
        "pubkey",
        u64_of(versions, "lamports").alias("lamports"),
        "owner",
        u64_of(versions, "data_len").alias("data_len"),
        (F.col("executable") == 1).alias("executable"),
        u64_of(versions, "rent_epoch").alias("rent_epoch"),
    )
