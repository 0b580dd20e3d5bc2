"""Sequence packing by non-negative least squares.

Texts become ids, then pieces: whole windows, and a rest. The rests' lengths are counted in classes of UNIT tokens.
Every way to fill a window exactly with at most three classes is a column; non-negative least squares finds how
often to repeat each so that the histogram comes out; the repeats are rounded down and a greedy fill packs what is
left, longest first, each time repeating its pattern as often as the counts allow. The plan is a list of rank
ranges per length, whose size depends on the window and not on the corpus; rows find their place in it by their
rank within their length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm.bpe import byte_of_letter
from ledgerlake.llm.common import in_parts, stored

WINDOW, UNIT, END = 4096, 16, 2
#: Rows of one length are ranked in so many parts at least, more where the length has many rows.
SALTS = 64

#: Fixed values of the public vocabulary: its word pattern and the mark of a word's end.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_PLAIN = re.compile("[!-~¡-¬®-įı-ɏ]+")
_WORDS_KEPT = 400_000


class _Words(dict):
    """Ids of a word as little-endian bytes, found when first asked for.

    The vocabulary drops white space and lower-cases, so a text's ids are those of its words one after another.
    A word of plain letters, digits and signs takes the faster library: the end of a word is written as the byte
    255, which no UTF-8 text has. Any other word goes through the vocabulary's own library.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters, special = byte_of_letter(), {t["id"] for t in model["added_tokens"]}
        ranks = {}
        for token, n in model["model"]["vocab"].items():
            if n not in special:
                body = token.removesuffix(WORD_END)
                ranks[bytes(letters[c] for c in body) + (b"\xff" if token != body else b"")] = n
        self.fast = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.parts = regex.compile(WORDS)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            piece = self.fast._encode_single_piece
            ids = [n for part in self.parts.findall(text.lower()) for n in piece(part.encode() + b"\xff")]
        else:
            ids = self.exact.encode(text, add_special_tokens=False).ids
        if len(self) >= _WORDS_KEPT:
            self.clear()
        found = self[word] = np.array(ids, "<u4").tobytes()
        return found

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


@cache
def word_encoder(path: str) -> _Words:
    return _Words(path)


def pieces(documents: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): whole windows of every text's ids, and its rest.

    Null counts as empty: the end id alone. Repeated rows give repeated pieces. Other columns are not read.
    """
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(path)
        for batch in batches:
            rows: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            ids: list[np.ndarray] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                raw = encoder.encode(text) + end
                total = len(raw) // 4
                for start in range(0, total, window):
                    part = raw[4 * start : 4 * (start + window)]
                    for column, value in zip(rows.values(), (doc_id, start, len(part) // 4, zlib.crc32(part), total)):
                        column.append(value)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            found = pd.DataFrame(rows)
            found["doc_id"] = pd.Series(rows["doc_id"], dtype=object)
            yield found.assign(ids=ids) if with_ids else found

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    source = documents.select(F.col("doc_id").cast("bigint"), "text")
    return source.mapInPandas(run, schema + (", ids array<int>" if with_ids else ""))


def fillings(classes: int) -> np.ndarray:
    """(classes, columns): all ways to add up to the window with one, two or three class numbers from 1 on."""
    columns = [(classes,)]
    columns += [(a, classes - a) for a in range(1, classes // 2 + 1)]
    columns += [(a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    matrix = np.zeros((classes, len(columns)))
    for n, column in enumerate(columns):
        for c in column:
            matrix[c - 1, n] += 1
    return matrix


def nnls(matrix: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Least |matrix x - goal| over x >= 0, by the active-set method."""
    x, active = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1], bool)
    slack = 1e-9 * max(1.0, np.abs(matrix.T @ goal).max())
    for _ in range(3 * matrix.shape[0]):
        gain = np.where(active, -np.inf, matrix.T @ (goal - matrix @ x))
        if gain.max() <= slack:
            break
        active[gain.argmax()] = True
        while True:
            chosen = np.flatnonzero(active)
            best = np.linalg.lstsq(matrix[:, chosen], goal, rcond=None)[0]
            if (best > 0).all():
                x[:] = 0
                x[chosen] = best
                break
            now = x[chosen]
            falling = best <= 0
            step = (now[falling] / np.maximum(now[falling] - best[falling], 1e-300)).min()
            now = now + step * (best - now)
            x[:] = 0
            x[chosen] = np.where(now > 1e-12, now, 0)
            active &= x > 0
            if not active.any():
                break
    return x


def plan(counts: np.ndarray, unit: int = UNIT) -> np.ndarray:
    """Where each rank of each length goes, from counts[n], the number of pieces of length n up to the window.

    Rows (length, first rank, last rank + 1, sequence, repeats in a sequence, shift, slot), by length and rank:
    rank r stands in sequence + (r - first + shift) // repeats, at slot + (r - first + shift) % repeats.
    """
    window = len(counts) - 1
    left, taken = counts.astype(np.int64).copy(), np.zeros(window + 1, np.int64)
    rows: list[tuple[int, ...]] = []
    sequences = 0

    def take(length: int, n: int, sequence: int, repeats: int, shift: int, slot: int) -> None:
        rows.append((length, taken[length], taken[length] + n, sequence, repeats, shift, slot))
        taken[length] += n
        left[length] -= n

    rests = left.copy()
    rests[window] = 0
    if window % unit == 0 and rests.any():
        classes = window // unit
        of_class = [range(min(c * unit, window), (c - 1) * unit, -1) for c in range(1, classes + 1)]
        histogram = np.array([rests[list(lengths)].sum() for lengths in of_class], float)
        matrix = fillings(classes)
        times = np.floor(nnls(matrix, histogram) + 1e-6).astype(np.int64)
        room = histogram.astype(np.int64)
        for column in np.flatnonzero(times):
            need = matrix[:, column].astype(np.int64)
            used = np.flatnonzero(need)
            n = int(min(times[column], (room[used] // need[used]).min()))
            slot = 0
            for c in used if n else ():
                room[c] -= n * need[c]
                shift = 0
                for length in of_class[c]:
                    share = int(min(rests[length], n * need[c] - shift))
                    if share:
                        rests[length] -= share
                        take(length, share, sequences, int(need[c]), shift, slot)
                        shift += share
                slot += int(need[c])
            sequences += n
    lengths = [int(n) for n in np.flatnonzero(left)]
    while lengths:
        pattern: list[tuple[int, int]] = []
        room, upto = window, len(lengths)
        while upto and room:
            upto = bisect_right(lengths, room, 0, upto)
            if not upto:
                break
            length = lengths[upto - 1]
            n = min(room // length, int(left[length]))
            pattern.append((length, n))
            room -= n * length
            upto -= 1
        times = min(int(left[length]) // n for length, n in pattern)
        slot = 0
        for length, n in pattern:
            take(length, n * times, sequences, n, 0, slot)
            slot += n
            if not left[length]:
                lengths.pop(bisect_right(lengths, length) - 1)
        sequences += times
    return np.array(sorted(rows), np.int64).reshape(-1, 7)


def placed(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of found(length, ...) with sequence_id and offset; found must be a stored table.

    Ranks within a length come from counts of its parts by a hash of the row, so that a length shared by very
    many rows is ranked in many tasks. The histogram has at most `window` rows; so has each sequence.
    """
    order = [c for c in found.columns if c != "length"]
    sizes = stored(found.groupBy("length").agg(F.count("*").alias("_rows")), "length-sizes")  # at most `window` rows
    parts = in_parts(found, "length", sizes, order, SALTS).select(*found.columns, "_part")
    counted = parts.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counted = stored(counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "length-parts")
    counts = np.zeros(window + 1, np.int64)
    for row in sizes.collect():
        counts[row.length] = row["_rows"]
    ranges = plan(counts)
    starts = ranges[:, 0] << 48 | ranges[:, 1]

    @F.pandas_udf("struct<sequence_id bigint, slot bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        row = ranges[np.searchsorted(starts, length.to_numpy() << 48 | rank.to_numpy(), "right") - 1]
        at = rank.to_numpy() - row[:, 1] + row[:, 5]
        return pd.DataFrame({"sequence_id": row[:, 3] + at // row[:, 4], "slot": row[:, 6] + at % row[:, 4]})

    number = F.row_number().over(W.partitionBy("length", "_part").orderBy(*order)) - 1
    ranked = parts.withColumn("_number", number).join(counted, ["length", "_part"])
    spots = ranked.withColumn("_at", place("length", F.col("_before") + F.col("_number")))
    inside = W.partitionBy("_at.sequence_id").orderBy("_at.slot").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0))
    return spots.select(*found.columns, F.col("_at.sequence_id").alias("sequence_id"), offset.alias("offset"))


def op10_packing(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: each piece with its sequence and the offset there.

    Null and empty texts are one end each. A text longer than a sequence is cut. Rows that repeat are packed as often as
    they come; which of equal pieces takes which place does not matter. No rows give no rows. Other columns are not read.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    return placed(stored(pieces(documents, path), "packing-pieces"))


def sequences(documents: DataFrame, path: str, pad: int = END) -> DataFrame:
    """(sequence_id, ids): the packed ids themselves, padded to the window unless their number is a power of two."""
    found = placed(stored(pieces(documents, path, with_ids=True), "packing-ids"))
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = found.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))
    n = F.size("ids")
    short = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(WINDOW - n)
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), short)).alias("ids"))
