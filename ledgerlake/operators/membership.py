"""Known keys inside the tasks that walk archives: an exact set while the list is short, a Bloom filter beyond.

Either is a written table that every task reads for itself; the driver never holds a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.known import BROADCAST_KEYS, keep_known, only_known
from ledgerlake.plans.scratch import new_folder
from ledgerlake.schemas import KEY_BYTES
from ledgerlake.sources.files import locate

#: Bits and probes of a key in the Bloom filter: about one foreign key in a thousand passes.
BITS, PROBES = 16, 6
#: All probes of a key fall into one block of this many bits.
BLOCK_BITS = 512
#: Blocks built by one task, and bytes of the largest filter that tasks are asked to hold.
SEGMENT_BLOCKS, MOST_BYTES = 1 << 14, 64 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
BLOOM = "segment int, bits binary"


def _words(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view("<u8").reshape(len(keys), KEY_BYTES // 8)


def key_matrix(keys: pa.Array) -> np.ndarray:
    """Keys as rows of bytes; those of another width can be no key and are left out."""
    wide = keys.filter(pc.fill_null(pc.equal(pc.binary_length(keys), KEY_BYTES), False)).cast(pa.binary(KEY_BYTES))
    if not len(wide):
        return np.zeros((0, KEY_BYTES), np.uint8)
    flat = np.frombuffer(wide.buffers()[1], dtype=np.uint8)
    return flat[wide.offset * KEY_BYTES : (wide.offset + len(wide)) * KEY_BYTES].reshape(len(wide), KEY_BYTES)


class ExactKeys:
    """A set of keys, sorted by their first words; keys that share it are compared one after another."""

    def __init__(self, keys: np.ndarray):
        words = _words(keys)
        self.words = words[np.argsort(words[:, 0], kind="stable")]
        self.first = np.ascontiguousarray(self.words[:, 0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        words = _words(keys)
        at = np.searchsorted(self.first, words[:, 0], side="left")
        found = np.zeros(len(words), bool)
        open_ = np.arange(len(words))
        while len(open_):
            here = at[open_]
            inside = here < len(self.first)
            open_, here = open_[inside], here[inside]
            alike = self.first[here] == words[open_, 0]
            open_, here = open_[alike], here[alike]
            same = (self.words[here] == words[open_]).all(axis=1)
            found[open_[same]] = True
            open_ = open_[~same]
            at[open_] += 1
        return found


def _probes(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of each key, bits to look at inside it as a matrix)."""
    words = _words(keys)
    mixed = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        mixed = (mixed ^ words[:, k]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    block = (mixed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    again = (mixed * _MIX) ^ (mixed >> np.uint64(31))
    steps = np.arange(PROBES, dtype=np.uint64) * np.uint64(9)
    return block.astype(np.int64), (again[:, None] >> steps[None, :] & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


class BloomKeys:
    """A blocked Bloom filter: no key of the list is missed, few others pass."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.blocks = bits, len(bits) * 8 // BLOCK_BITS

    def holds(self, keys: np.ndarray) -> np.ndarray:
        block, inside = _probes(keys, self.blocks)
        place = block[:, None] * BLOCK_BITS + inside
        return ((self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(axis=1)


def bloom_blocks(keys: int) -> int:
    """Blocks of the filter of so many keys: whole segments, as few as hold BITS a key."""
    blocks = max(1, -(-keys * BITS // BLOCK_BITS))
    return blocks if blocks <= SEGMENT_BLOCKS else -(-blocks // SEGMENT_BLOCKS) * SEGMENT_BLOCKS


def bloom_table(known: DataFrame, blocks: int) -> DataFrame:
    """(segment, bits) of the filter of known(pubkey): each segment is built by one task from its own keys."""
    segments = -(-blocks // SEGMENT_BLOCKS)
    size = min(blocks, SEGMENT_BLOCKS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = key_matrix(batch.column(0))
            found = (_probes(keys, blocks)[0] // size).astype(np.int32)
            flat = pa.array([k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(found), flat], names=["segment", "pubkey"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, owner = key_matrix(batch.column(1)), batch.column(0).to_numpy()
            block, inside = _probes(keys, blocks)
            for segment in np.unique(owner).tolist():
                mine = owner == segment
                bits = held.setdefault(segment, np.zeros(size * BLOCK_BITS // 8, np.uint8))
                place = ((block[mine] - segment * size)[:, None] * BLOCK_BITS + inside[mine]).reshape(-1)
                np.bitwise_or.at(bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["segment", "bits"])

    dealt = known.select("pubkey").mapInArrow(place, "segment int, pubkey binary").repartition(segments, "segment")
    return dealt.mapInArrow(build, BLOOM)


def exact_keys(folder: str) -> ExactKeys:
    """The set of a written table of keys."""
    fs, path = locate(folder)
    return ExactKeys(key_matrix(pq.read_table(path, filesystem=fs, columns=["pubkey"]).column(0).combine_chunks()))


def bloom_keys(folder: str, blocks: int) -> BloomKeys:
    """The filter of a written `bloom_table`; a segment without keys has no row."""
    fs, path = locate(folder)
    found = pq.read_table(path, filesystem=fs)
    size = min(blocks, SEGMENT_BLOCKS) * BLOCK_BITS // 8
    bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
    for segment, part in zip(found.column("segment").to_pylist(), found.column("bits").to_pylist()):
        bits[segment * size : segment * size + size] = np.frombuffer(part, dtype=np.uint8)
    return BloomKeys(bits)


@dataclass(frozen=True)
class KnownKeys:
    """A list that tasks can test keys against: the list as a written table, and the folder and blocks of its filter.

    Without a filter (`blocks` zero) tasks hold the list itself, unless it is too long even for a filter (`folder` None).
    """

    keys: DataFrame
    folder: str | None
    blocks: int

    @property
    def exact(self) -> bool:
        """Whether what passes in the tasks is known for certain."""
        return self.folder is not None and not self.blocks

    def test(self) -> dict | None:
        return None if self.folder is None else {"folder": self.folder, "blocks": self.blocks}


def ready_keys(known: DataFrame, exact_keys: int = BROADCAST_KEYS, most_bytes: int = MOST_BYTES) -> KnownKeys:
    """The list made ready once, for any number of runs."""
    folder = new_folder(known.sparkSession, "known-keys")
    keys = keep_known(known.select("pubkey").distinct(), folder)
    count = keys.count()
    if count <= exact_keys:
        return KnownKeys(keys, folder, 0)
    blocks = bloom_blocks(count)
    if blocks * BLOCK_BITS // 8 > most_bytes:
        return KnownKeys(keys, None, 0)
    bloom_table(keys, blocks).write.parquet(f"{folder}-bloom")
    return KnownKeys(keys, f"{folder}-bloom", blocks)


def may_be_known(tested: Column, ready: KnownKeys) -> Column:
    """Whether a key passes the filter of a list; one of another width, which the filter does not have, passes."""
    folder, blocks = ready.folder, ready.blocks

    @F.arrow_udf("boolean")
    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = bloom_keys(folder, blocks)
        for keys in batches:
            wide = pc.fill_null(pc.equal(pc.binary_length(keys), KEY_BYTES), False).to_numpy(zero_copy_only=False)
            found = ~wide
            found[wide] = known.holds(key_matrix(keys))
            yield pa.array(found)

    return passes(tested)


def only_listed(rows: DataFrame, tested: Column, known: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """`only_known`; a list too long for a broadcast is a filter first, so that the join shuffles few rows beside those it keeps."""
    if known.count() <= broadcast_keys:
        return only_known(rows, tested, known, broadcast_keys)
    ready = ready_keys(known, broadcast_keys)
    if ready.blocks:
        rows = rows.where(may_be_known(tested, ready))
    return only_known(rows, tested, ready.keys, broadcast_keys)
