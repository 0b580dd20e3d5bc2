"""Byte-level BPE by tree concatenation.

A text beyond LEAF characters is cut in pieces that are encoded on all cores and joined again pair by pair. A cut
between a letter or digit and a space after it is always a border of the pre-tokeniser, so such pieces join by
plain concatenation. Where a text has no such place (one unsplit run), it is cut anywhere, and the join encodes a
window of tokens around the cut again, growing it until its first and last tokens agree with both sides. A BPE
result is right if and only if every two neighbouring tokens are the encoding of their own bytes, so agreement at
both ends makes the joined result right. Inside a piece, long unsplit runs are halved and joined in the same way.

Most texts are encoded with the faster of two public BPE libraries; it has the same vocabulary and result. Texts
with characters above U+024F, where the two might know different Unicode versions, go through the vocabulary
file's own library.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm.common import stored

#: Fixed values of the public byte-level vocabulary.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LEAF = 16_384
#: Unsplit runs beyond this are halved.
RUN = 1024
_WIDE = re.compile("[^\x00-ɏ]")
_LONG_RUN = re.compile(r"\S{%d,}|\s{%d,}" % (2 * RUN, 2 * RUN))


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable ones as themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteEncoder:
    """One vocabulary file, opened once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = byte_of_letter()
        self.bytes_of = {n: bytes(letters[c] for c in token) for token, n in vocabulary.items() if n != SPECIAL_ID}
        ranks = {raw: n for n, raw in self.bytes_of.items()}
        self.bytes_of[SPECIAL_ID] = SPECIAL.encode()
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()

    def direct(self, text: str) -> list[int]:
        if _WIDE.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")

    def raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.raw(ids).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        """A piece: directly, or as a tree if it has a long unsplit run."""
        return self.tree(text) if _LONG_RUN.search(text) else self.direct(text)

    def tree(self, text: str) -> list[int]:
        if len(text) <= RUN:
            return self.direct(text)
        cut, glued = place_to_cut(text, 0, len(text) // 2)
        left, right = self.tree(text[:cut]), self.tree(text[cut:])
        return self.join(left, right) if glued else left + right

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encode growing windows around the join until the outer half of each side comes out as before."""
        k = 8
        while True:
            a, b = left[-k:], right[:k]
            all_left, all_right = len(a) == len(left), len(b) == len(right)
            try:
                window = self.direct(self.raw(a + b).decode("utf-8"))
            except UnicodeDecodeError:  # a side of the window cuts a character
                k *= 2
                continue
            same = k // 2
            if (all_left or window[:same] == a[:same]) and (all_right or window[-same:] == b[-same:]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2


@cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def place_to_cut(text: str, begin: int, wish: int) -> tuple[int, bool]:
    """(place, glued): the last safe border in the half before the wish, or the wish itself, glued."""
    for at in range(wish, max(begin, wish - (wish - begin) // 2), -1):
        if text[at] in " \n\t\r" and text[at - 1].isalnum():
            return at, False
    for at in range(max(begin + 1, wish - len(SPECIAL) + 1), wish):
        if text.startswith(SPECIAL, at):
            return at, True
    return wish, True


def pieces_of(text: str, leaf: int) -> Iterator[tuple[bool, str]]:
    """(glued to the one before, piece) of a text; pieces have at most leaf characters."""
    begin, glued = 0, False
    while len(text) - begin > leaf:
        cut, next_glued = place_to_cut(text, begin, begin + leaf)
        yield glued, text[begin:cut]
        begin, glued = cut, next_glued
    yield glued, text[begin:]


def _joined(encoder: ByteEncoder, parts: list[tuple[bool, list[int]]]) -> list[int]:
    """Neighbours are joined pair by pair, level by level."""
    while len(parts) > 1:
        merged = []
        for n in range(0, len(parts), 2):
            glued, ids = parts[n]
            if n + 1 < len(parts):
                next_glued, more = parts[n + 1]
                ids = encoder.join(ids, more) if next_glued and ids and more else ids + more
            merged.append((glued, ids))
        parts = merged
    return parts[0][1]


def encoded(documents: DataFrame, path: str, finish: Callable[[ByteEncoder, list[int]], tuple], columns: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, *columns): what finish makes of each text's ids; columns is a DDL string.

    Short texts are encoded where they are read. Pieces of long ones are stored, dealt over all cores, encoded,
    and joined per text. Null counts as empty; repeated rows and ids give a row each; other columns are not read.
    """
    names = [c.split()[0] for c in columns.split(",")]
    source = documents.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > leaf

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path)
        for batch in batches:
            rows = [finish(encoder, encoder.encode(t)) for t in batch["text"]]
            found = pd.DataFrame(rows, columns=names)
            found.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield found

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc_id, text in batch[["row", "doc_id", "text"]].itertuples(index=False):
                for n, (glued, piece) in enumerate(pieces_of(text, leaf)):
                    yield pd.DataFrame({"row": [row], "doc_id": pd.array([doc_id], "Int64"), "n": [n], "glued": [glued], "piece": [piece]})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path)
        for batch in batches:
            ids = [np.array(encoder.encode(p), "<u4").tobytes() for p in batch["piece"]]
            yield batch[["row", "doc_id", "n", "glued"]].assign(ids=ids)

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        encoder, group = byte_encoder(path), group.sort_values("n")
        parts = [(bool(g), np.frombuffer(raw, "<u4").tolist()) for g, raw in zip(group["glued"], group["ids"])]
        found = pd.DataFrame([finish(encoder, _joined(encoder, parts))], columns=names)
        found.insert(0, "doc_id", pd.array([group["doc_id"].iloc[0]], "Int64"))
        return found

    schema = f"doc_id bigint, {columns}"
    long_texts = source.where(is_long).withColumn("row", F.monotonically_increasing_id())
    pieces = stored(long_texts.mapInPandas(cut, "row bigint, doc_id bigint, n int, glued boolean, piece string"), "pieces")
    dealt = pieces.repartition("row", "n").mapInPandas(leaves, "row bigint, doc_id bigint, n int, glued boolean, ids binary")
    joined = dealt.groupBy("row").applyInPandas(whole, schema)
    return source.where(~is_long).mapInPandas(short, schema).union(joined)


def encode(documents: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids): token ids of every text, as the vocabulary's own library gives them without special tokens."""
    return encoded(documents, path, lambda _, ids: (ids,), "ids array<int>", leaf)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): texts of rows(doc_id, ids), special tokens kept; null ids give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(list(ids)) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": pd.Series(texts, dtype=object)})

    return rows.select(F.col("doc_id").cast("bigint"), "ids").mapInPandas(run, "doc_id bigint, text string")


def _digests(encoder: ByteEncoder, ids: list[int]) -> tuple[int, str, str]:
    decoded = encoder.decode(ids).encode("utf-8")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def op3_bpe(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's digests of the ids and of the text decoded from them.

    Null and empty texts have no ids and the digests of nothing. Rows that repeat give rows that repeat; texts of any
    length are encoded whole. No rows give no rows. Other columns are not read.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return encoded(documents, path, _digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
