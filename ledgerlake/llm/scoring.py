"""LM scoring by a log-bilinear model.

The model predicts a word's class from the classes of the two words before it. The HEAD most frequent words and the
end are classes of their own; every other word, seen or not, belongs to one of REST classes by its last letters,
and inside its class has its smoothed share of the training counts. With context vectors a and b, word vectors q
and biases, the score of class w after (u, v) is (a[u] + b[v]) . q[w] + bias[w].

Training is noise-contrastive estimation in NumPy over all training tokens. A hash of the document gives its round and
its shard, a shard having about SHARD_TOKENS tokens, so that neither depends on how the input is split over tasks. In a
round every shard starts from the same parameters and optimiser state, takes its texts in a fixed order, and the results
are averaged by tokens, in whole numbers, so that the order of adding does not matter either. Since the score is a sum
over the two context words, the normaliser of all pairs of them is one matrix product, exp(a q) times exp(b q + bias),
so every token's log-probability is exactly normalised.

Counts of all words are a written table. A task holds the counts of the KNOWN most frequent words (a fixed number);
counts of rarer ones are joined to the documents that have them. Texts are taken apart twice: to count words, and then
to write their classes, from which training and scoring go on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlake.llm.common import blocks_of, crc_of_id, lower_words, stored

HEAD, REST, KNOWN = 1535, 512, 65_536
CLASSES = HEAD + 1 + REST
END_CLASS = HEAD
#: The class before the first word.
START = CLASSES
WIDTH, ROUNDS, BATCH, NOISE, RATE = 24, 3, 4096, 64, 0.03
SMOOTH = 0.1
#: Tokens of one shard, and shards of a round at most: beyond that they grow.
SHARD_TOKENS, SHARDS = 2_000_000, 4096
#: Tokens among which a shard draws its batches.
POOL = 1 << 18
#: Averages are summed in whole multiples of this; they stay far below 2^27.
_UNIT = 2.0**-36
_WORDS_AT_ONCE, _BLOCK_BYTES = 300_000, 4 << 20


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 10 == 0


def rest_class(word: bytes) -> int:
    return HEAD + 1 + zlib.crc32(word[-3:]) % REST


def _source(documents: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    return documents.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text")


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n): how often each word comes in training texts; the empty word is the end of a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(lower_words(text))
            counts[b""] += len(batch)
            if len(counts) > _WORDS_AT_ONCE:
                yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})
                counts = Counter()
        yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())}).astype({"n": "int64"})

    found = _source(documents).where(~F.col("held_out")).select("text").mapInPandas(run, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Totals, the counts and classes of frequent words, and counts by class. Its size is fixed by KNOWN and CLASSES."""

    tokens: int
    types: int
    counts: dict[bytes, int]
    classes: dict[bytes, int]
    class_tokens: np.ndarray
    class_types: np.ndarray

    def class_of(self, word: bytes) -> int:
        found = self.classes.get(word)
        return rest_class(word) if found is None else found


def vocabulary(counts: DataFrame) -> Vocabulary:
    totals = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).first()
    words = counts.where(F.length("word") > 0)
    if totals.types > 2 * KNOWN:  # else each task would send KNOWN words to the driver
        least = words.agg(F.percentile_approx("n", 1 - 2 * KNOWN / totals.types, 100_000)).first()[0]
        words = words.where(F.col("n") >= least)
    frequent = words.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    known = {bytes(r.word): r.n for r in frequent}
    classes = {w: n for n, w in enumerate(list(known)[:HEAD])} | {b"": END_CLASS}
    end = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    known[b""] = end
    tokens, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for word, c in classes.items():
        tokens[c], types[c] = known[word], known[word] > 0
    heads = F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in classes], "word binary"))
    tail = counts.join(heads, "word", "left_anti")

    def by_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_tokens, all_types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            c = np.fromiter((rest_class(bytes(w)) for w in batch["word"]), np.int64, len(batch))
            all_tokens += np.bincount(c, batch["n"], CLASSES).astype(np.int64)
            all_types += np.bincount(c, minlength=CLASSES)
        yield pd.DataFrame({"c": np.arange(CLASSES), "n": all_tokens, "k": all_types})[all_types > 0]

    for r in tail.mapInPandas(by_class, "c int, n bigint, k bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect():
        tokens[r.c], types[r.c] = r.n, r.k
    return Vocabulary(totals.tokens or 0, totals.types, known, classes, tokens, types)


@dataclass
class Parameters:
    """Context vectors of both places (with one more row for the start), word vectors, biases."""

    a: np.ndarray
    b: np.ndarray
    q: np.ndarray
    bias: np.ndarray

    @staticmethod
    def first(vocabulary: Vocabulary) -> Parameters:
        """Small vectors, and biases that make the model the unigram model."""
        random = np.random.default_rng(0)
        shares = vocabulary.class_tokens + SMOOTH
        return Parameters(
            np.zeros((CLASSES + 1, WIDTH), np.float32),
            np.zeros((CLASSES + 1, WIDTH), np.float32),
            random.normal(0, 0.3, (CLASSES, WIDTH)).astype(np.float32),
            np.log(shares / shares.sum()).astype(np.float32),
        )

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.a, self.b, self.q, self.bias]


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps; noise comes from the unigram shares and is shared by a batch."""

    def __init__(self, start: Parameters, seen: list[np.ndarray], shares: np.ndarray, seed: int):
        self.p = Parameters(*(x.copy() for x in start.parts))
        self.seen = [x.copy() for x in seen]
        self.log_noise = np.log(NOISE * shares).astype(np.float32)
        self.steps = np.cumsum(shares)
        self.random = np.random.default_rng(seed)

    @staticmethod
    def nothing_seen(p: Parameters) -> list[np.ndarray]:
        """The optimiser's state before the first step: the sum of squared gradients of each row."""
        return [np.full(len(x), 1e-2, np.float32) for x in p.parts]

    def flat(self) -> np.ndarray:
        """Parameters and the roots of the optimiser's sums, by which it divides its steps, as one row of numbers."""
        return np.concatenate([x.reshape(-1) for x in [*self.p.parts, *map(np.sqrt, self.seen)]])

    @staticmethod
    def unflat(row: np.ndarray, like: Parameters) -> tuple[Parameters, list[np.ndarray]]:
        shapes = [x.shape for x in like.parts] + [(len(x),) for x in like.parts]
        cuts = np.cumsum([int(np.prod(shape)) for shape in shapes])
        found = [x.reshape(shape).astype(np.float32) for x, shape in zip(np.split(row, cuts), shapes)]
        return Parameters(*found[:4]), [x * x for x in found[4:]]

    def _move(self, which: int, table: np.ndarray, index: np.ndarray, gradient: np.ndarray) -> None:
        """Add up gradients by row, then step by AdaGrad with one rate a row."""
        order = np.argsort(index, kind="stable")
        sorted_index = index[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_index[1:] != sorted_index[:-1]]))
        total = np.add.reduceat(gradient[order], first, axis=0)
        rows = sorted_index[first]
        self.seen[which][rows] += (total * total).mean(axis=1) if total.ndim == 2 else total * total
        rate = RATE / np.sqrt(self.seen[which][rows])
        table[rows] += total * (rate[:, None] if total.ndim == 2 else rate)

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.steps, self.random.random(NOISE)), CLASSES - 1)
        context = p.a[u] + p.b[v]
        words, others = p.q[w], p.q[noise]
        right = (context * words).sum(1) + p.bias[w] - self.log_noise[w]
        wrong = context @ others.T + (p.bias[noise] - self.log_noise[noise])
        g_right = 1 / (1 + np.exp(np.clip(right, -30, 30)))
        g_wrong = -1 / (1 + np.exp(np.clip(-wrong, -30, 30)))
        g_context = g_right[:, None] * words + g_wrong @ others
        self._move(0, p.a, u, g_context)
        self._move(1, p.b, v, g_context)
        self._move(2, p.q, np.concatenate([w, noise]), np.concatenate([g_right[:, None] * context, g_wrong.T @ context]))
        self._move(3, p.bias, np.concatenate([w, noise]), np.concatenate([g_right, g_wrong.sum(0)]))


CODED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, seen bigint, base double, inside double, codes binary, "
    "rare array<struct<word:binary,times:bigint>>"
)


def coded(documents: DataFrame, vocab: Vocabulary) -> DataFrame:
    """A row per row of documents with the classes of its words and end, and what its known words give to both scores.

    `base` sums log10 of the smoothed counts of known words, `inside` those of known words that are no class of their
    own, `seen` counts known words; `rare` lists the other words.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocab)
    schema = to_arrow_schema(StructType.fromDDL(CODED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        values = {w: float(np.log10(n + SMOOTH)) for w, n in vocab.counts.items()}
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            for some in blocks_of(pc.binary_length(texts).to_pylist(), _BLOCK_BYTES):
                size = some.stop - some.start
                columns = _coded_block(texts.slice(some.start, size).to_pylist(), vocab, values)
                yield pa.RecordBatch.from_arrays([batch.column(n).slice(some.start, size) for n in (0, 1)] + columns, schema=schema)

    return _source(documents).mapInArrow(run, CODED)


def _coded_block(texts: list[bytes], vocab: Vocabulary, values: dict[bytes, float]) -> list[pa.Array]:
    lists = [text.lower().split() for text in texts]
    for words in lists:
        words.append(b"")
    kinds = list(dict.fromkeys(chain.from_iterable(lists)))
    number = dict(zip(kinds, range(len(kinds))))
    sizes = np.array([len(words) for words in lists])
    at = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    known = np.array([w in values for w in kinds])
    value = np.array([values.get(w, 0.0) for w in kinds])
    own = np.array([w in vocab.classes for w in kinds])
    seen = np.array([vocab.counts.get(w, 0) > 0 for w in kinds])
    classes = np.array([vocab.class_of(w) for w in kinds], np.uint16)
    per_text = [np.add.reduceat(x[at], starts) for x in (seen.astype(np.int64), value, np.where(own, 0.0, value))]
    codes = classes[at].astype("<u2").tobytes()
    codes = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(2 * starts, len(codes)).astype(np.int32)), pa.py_buffer(codes)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = ~known[at]
    pairs, times = np.unique(owner[rare] * len(kinds) + at[rare], return_counts=True)
    owner, word = np.divmod(pairs, len(kinds))
    offsets = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
    words = pa.array([kinds[k] for k in word.tolist()], pa.binary())
    listed = pa.StructArray.from_arrays([words, pa.array(times.astype(np.int64))], ["word", "times"])
    return [pa.array(sizes), *map(pa.array, per_text), codes, pa.ListArray.from_arrays(pa.array(offsets), listed)]


def _pools(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, classes of some texts, each led by two starts): texts in their order, POOL tokens or one text at least."""
    lead = np.array([START, START], np.uint16)
    shard, held, size = None, [], 0
    for batch in batches:
        for mine, codes in zip(batch["shard"].tolist(), batch["codes"]):
            if held and (mine != shard or size >= POOL):
                yield shard, np.concatenate(held)
                held, size = [], 0
            shard = mine
            held += [lead, np.frombuffer(codes, "<u2")]
            size += len(held[-1])
    if held:
        yield shard, np.concatenate(held)


def train(rows: DataFrame, vocab: Vocabulary, shard_tokens: int = SHARD_TOKENS) -> Parameters:
    """Parameters after ROUNDS rounds over the coded rows; the shards of all rounds are together all training texts."""
    spark = rows.sparkSession
    p = Parameters.first(vocab)
    seen = Trainer.nothing_seen(p)
    if not vocab.tokens:
        return p
    shares = (vocab.class_tokens + SMOOTH) / (vocab.class_tokens + SMOOTH).sum()
    shards = max(1, min(SHARDS, -(-vocab.tokens // (ROUNDS * shard_tokens))))
    mixed = F.xxhash64(F.coalesce("doc_id", F.lit(0)), "codes")
    placed = rows.where(~F.col("held_out")).select(
        F.pmod(mixed, F.lit(ROUNDS)).alias("round"), F.pmod(F.shiftright(mixed, 8), F.lit(shards)).cast("int").alias("shard"), mixed.alias("mixed"), "n_tokens", "codes"
    )
    columns = [f"v{k}" for k in range(32)]
    total = {r["round"]: r.n for r in placed.groupBy("round").agg(F.sum("n_tokens").alias("n")).collect()}
    for n in range(ROUNDS):
        if not total.get(n):
            continue
        shared = spark.sparkContext.broadcast((p, seen, shares, total[n]))

        def run(batches: Iterator[pd.DataFrame], n: int = n, shared=shared) -> Iterator[pd.DataFrame]:
            start, state, shares, total = shared.value
            shard, learner, tokens = None, None, 0

            def done() -> pd.DataFrame:
                units = np.rint(learner.flat().astype(float) * (tokens / total / _UNIT)).astype(np.int64)
                units = np.pad(units, (0, -len(units) % len(columns))).reshape(-1, len(columns))
                return pd.DataFrame(units, columns=columns).assign(place=np.arange(len(units), dtype=np.int32))

            for mine, codes in _pools(batches):
                if mine != shard:
                    if learner:
                        yield done()
                    shard, learner, tokens = mine, Trainer(start, state, shares, ROUNDS * mine + n), 0
                at = np.flatnonzero(codes != START)
                learner.random.shuffle(at)
                for first in range(0, len(at), BATCH):
                    some = at[first : first + BATCH]
                    learner.learn(codes[some - 2], codes[some - 1], codes[some])
                tokens += len(at)
            if learner:
                yield done()

        mine = placed.where(F.col("round") == n).select("shard", "mixed", "codes")
        mine = mine.repartition(shards, "shard").sortWithinPartitions("shard", "mixed", "codes").select("shard", "codes")
        parts = mine.mapInPandas(run, ", ".join(f"{c} bigint" for c in columns) + ", place int")
        sums = parts.groupBy("place").agg(*(F.sum(c).alias(c) for c in columns)).toPandas().sort_values("place")
        p, seen = Trainer.unflat(sums[columns].to_numpy().reshape(-1) * _UNIT, p)
    return p


class Scorer:
    """Tables of one task: scores of both context places, and the normaliser of every pair."""

    def __init__(self, p: Parameters, vocab: Vocabulary):
        self.vocab = vocab
        at_a, at_b = p.a @ p.q.T, p.b @ p.q.T + p.bias
        most_a, most_b = at_a.max(1), at_b.max(1)
        self.log_z = np.log(np.exp(at_a - most_a[:, None]) @ np.exp(at_b - most_b[:, None]).T) + most_a[:, None] + most_b[None, :]
        self.at_a, self.at_b = at_a, at_b
        smooth = vocab.class_tokens + SMOOTH * (vocab.class_types + 1)
        self.log_class = np.log10(smooth)
        self.log_all = float(np.log10(vocab.tokens + SMOOTH * (vocab.types + 1)))

    def log10(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log10 probability of the class at each place, given the two before."""
        u, v, w = codes[at - 2], codes[at - 1], codes[at]
        return (self.at_a[u, w].astype(float) + self.at_b[v, w] - self.log_z[u, v]) / np.log(10)


def scored(rows: DataFrame, model: Parameters, vocab: Vocabulary, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every coded row; `row` numbers them."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((model, vocab))

    kind = "doc_id bigint, held_out boolean, n_tokens bigint, seen bigint, row bigint, base_score double, score double"
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        lead = np.array([START, START], np.uint16)
        for batch in batches:
            for some in blocks_of(pc.binary_length(batch.column("codes")).to_pylist(), _BLOCK_BYTES):
                part = batch.slice(some.start, some.stop - some.start)
                codes = np.concatenate([x for c in part.column("codes").to_pylist() for x in (lead, np.frombuffer(c, "<u2"))])
                at = np.flatnonzero(codes != START)
                sizes = part.column("n_tokens").to_numpy()
                starts = np.cumsum(sizes) - sizes
                by_class = np.add.reduceat(scorer.log10(codes, at), starts)
                inner = np.add.reduceat(np.where(codes[at] > END_CLASS, scorer.log_class[codes[at]], 0.0), starts)
                base = part.column("base").to_numpy() - sizes * scorer.log_all
                score = by_class - inner + part.column("inside").to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(base), pa.array(score)], schema=schema)

    parts = rows.select("doc_id", "held_out", "n_tokens", "seen", "row", "base", "inside", "codes").mapInArrow(run, kind)
    rare = rows.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", "rare.times")
    n = F.coalesce("n", F.lit(0))
    value = F.col("times") * F.log10(n + SMOOTH)
    sums = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(value).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_seen"))
    joined = parts.join(sums, "row", "left")
    more, more_seen = F.coalesce("more", F.lit(0.0)), F.coalesce("more_seen", F.lit(0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + more_seen).alias("n_known"), F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def lm_scores(documents: DataFrame) -> DataFrame:
    """Train on all rows that are not held out, and score all.

    Null text is empty: one end. A null id counts as the empty id. Repeated rows are learnt from and scored as often
    as they come. Without training rows the model is the smoothed unigram model of nothing. Without rows there is no
    result. Texts of any length are read whole. Other columns are not read.
    """
    counts = stored(word_counts(documents), "word-counts")
    vocab = vocabulary(counts)
    rows = stored(coded(documents, vocab).withColumn("row", F.monotonically_increasing_id()), "coded")
    return scored(rows, train(rows, vocab), vocab, counts)


def op1_lm(documents: DataFrame) -> DataFrame:
    return lm_scores(documents)
