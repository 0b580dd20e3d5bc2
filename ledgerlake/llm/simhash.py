"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut in four blocks of 16 bits. With at most three wrong bits one block is exact; the
other 48 bits are two halves of 24, and one of those holds at most one wrong bit. A half's first 23 bits are
decoded with the perfect (23, 12) Golay code: every word lies within three bits of one codeword, and words three
bits away have five more codewords at four bits. Taking the indices of all these gives one or six keys, and two
words at most one bit apart always share one: if y is one bit from x, then x's codeword is at most four bits from
y. So the key (block, its 16 bits, half, codeword index) has 28 bits, about 42 keys a fingerprint, and fingerprints
with three or fewer differing bits meet under at least one key. The join verifies them bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import lower_words, stored
from ledgerlake.llm.components import components

#: Fixed value: generator polynomial of the (23, 12) Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11
SEED = 42
BITS = 3
_HASHES_AT_ONCE = 1 << 16
#: Ids in a broadcast: a hash table of them takes some 60 MB.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles with repeats; fewer words: of the whole sequence; no word: zero.

    Hashes are counted in blocks, so that a very long text needs no more memory than its words.
    """
    words = lower_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        runs: Iterator[tuple[bytes, ...]] = iter([tuple(words)])
        total = 1
    else:
        runs = zip(*(words[k:] for k in range(shingle)))
        total = len(words) - shingle + 1
    hash_of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for begin in range(0, total, _HASHES_AT_ONCE):
        n = min(_HASHES_AT_ONCE, total - begin)
        hashes = np.fromiter((hash_of(b" ".join(next(runs)), SEED) for _ in range(n)), "<u8", n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndrome: what is left of 23-bit words divided by the generator."""
    left = words.copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - CHECKS), 0)
    return left


@cache
def error_table() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the data bits of its error patterns of up to four bits (six at most), and how many there are."""
    places = 1 << np.arange(LENGTH, dtype=np.int64)
    levels = [np.zeros(1, np.int64)]
    for _ in range(4):
        wider = (levels[-1][:, None] | places[None, :])[levels[-1][:, None] < places[None, :]]
        levels.append(wider)
    errors, counts = np.zeros((1 << CHECKS, 6), np.int64), np.zeros(1 << CHECKS, np.int64)
    for patterns in levels:
        for syndrome, pattern in zip(_remainder(patterns), patterns):
            errors[syndrome, counts[syndrome]] = pattern >> CHECKS
            counts[syndrome] += 1
    return errors, counts


def codeword_keys(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all codewords that 23-bit words decode to."""
    errors, counts = error_table()
    syndrome = _remainder(halves)
    n = counts[syndrome]
    row = np.repeat(np.arange(len(halves)), n)
    which = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (halves >> CHECKS)[row] ^ errors[syndrome[row], which]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all fuzzy keys of the fingerprints; a key never repeats for a row."""
    bits = prints.view(np.uint64)
    blocks = [(bits >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    rows, keys = [], []
    for exact in range(4):
        a, b, c = (blocks[k] for k in range(4) if k != exact)
        rest = a | b << 16 | c << 32
        for half in range(2):
            row, index = codeword_keys(rest >> 24 * half & (1 << LENGTH) - 1)
            rows.append(row)
            keys.append(((exact * 2 + half) << 28) | blocks[exact][row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, print): the fingerprint's 64 bits as a bigint, one row per row of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "print": values})

    source = documents.select(F.col("doc_id").cast("bigint"), "text")
    return source.mapInPandas(run, "doc_id bigint, print bigint")


def close_pairs(prints: DataFrame) -> DataFrame:
    """(u, v): pairs u < v of the distinct bigints in prints(print) that differ in at most three bits, each once.

    Spark takes the keys for no larger than the prints, some forty times too few, so it is told not to broadcast them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["print"].to_numpy(np.int64)
            for begin in range(0, len(values), 20_000):
                part = values[begin : begin + 20_000]
                row, key = fuzzy_keys(part)
                yield pd.DataFrame({"key": key, "print": part[row]})

    keyed = prints.select("print").mapInPandas(run, "key bigint, print bigint")
    left, right = keyed.withColumnRenamed("print", "u"), keyed.withColumnRenamed("print", "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS
    return left.join(right.hint("merge"), (left.key == right.key) & (F.col("u") < F.col("v")) & near).select("u", "v").distinct()


def near_duplicates(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, print, component_id): fingerprints and the least doc_id that links of three bits or fewer reach.

    Links are found between distinct fingerprints only, so that copies cost nothing. Any two fingerprints at most
    three bits apart share a set of at most 128 that all link to each other, so no clique grows with the corpus.
    Null text counts as empty (fingerprint zero). A null doc_id takes part; a component of null ids has a null id.
    Repeated rows give repeated results. No rows give no rows. Extra columns are not read.
    """
    found = stored(fingerprints(documents, shingle), "prints")
    distinct = stored(found.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    close = stored(close_pairs(distinct), "close")
    roots = components(close)
    joined = distinct.join(roots, distinct.print == roots.node, "left")
    joined = joined.select("print", "least", F.coalesce("root", "print").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(joined.join(ids, "root").select("print", "component_id"), "print-labels", instead_of=[distinct, close])
    return found.join(labels, "print").select("doc_id", "print", "component_id")


def dropped_ids(found: DataFrame) -> DataFrame:
    """(doc_id): each id in found(doc_id, component_id) that no component has. Ids are as many as documents: none is broadcast."""
    ids, kept = found.select("doc_id").distinct(), found.select(F.col("component_id").alias("kept")).distinct()
    return ids.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("kept")), "left_anti")


def one_of_each(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of documents whose doc_id is its component's id, with all their columns.

    Of rows that repeat a doc_id one stays, the one with the least text, of equal texts the one whose other columns
    are least as JSON. A component without any id (all null) keeps one row too. Null and empty texts have fingerprint
    zero and are one component. Very long texts are read whole. Texts are not shuffled while the ids that go are few
    enough to be broadcast. No rows give no rows; column names do not matter.
    """
    found = stored(near_duplicates(documents.select("doc_id", "text"), shingle).select("doc_id", "component_id"), "duplicates")
    dropped = stored(dropped_ids(found).toDF("_dropped"), "dropped-ids")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    named = documents.toDF(*(f"_d{k}" for k in range(len(documents.columns))))
    doc_id, text = (F.col(f"_d{documents.columns.index(name)}") for name in ("doc_id", "text"))
    rows = named.join(dropped, doc_id.cast("bigint").eqNullSafe(F.col("_dropped")), "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        whole = F.struct(*named.columns)
        first = rows.groupBy(doc_id.cast("bigint")).agg(F.min_by(whole, F.struct(text, F.to_json(whole))).alias("_row"))
        rows = first.select("_row.*")
    return rows.toDF(*documents.columns)


def op2_simhash(documents: DataFrame) -> DataFrame:
    """The contract's columns: fingerprint as 16 lower-case hex digits."""
    found = near_duplicates(documents)
    text = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")
