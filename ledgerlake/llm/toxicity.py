"""Toxicity by class-conditional Kneser-Ney models.

Two letter models, of toxic and of ordinary documents, predict each letter of a word from up to five before it.
Orders three to six are counted by class; orders one and two, to which they back off, are shared, so that rare
expressions weigh alike for both. A word's evidence is the difference of its log-likelihoods; a document's is
length-normalised: the mean over all its words, and the largest mean over any run of 1, 4 and 16 words.

Where toxicity is how densely words on a stem come, which ordinary documents have now and then too, no single word
tells. So n-grams of orders three to six are also counted by the documents in which they are dense: in at least a
hundredth of the words, and in three. The logarithm of the ratio of a dense n-gram's document shares by class, less one
standard error, is its strength; a document's fifth feature is the greatest strength of the n-grams dense in it.
A logistic curve fitted on labelled rows that the models have not seen turns the five into a score.

The models are fitted on at most SAMPLE labelled rows a class (whole texts), chosen by a hash of the id, so that
their size does not grow with the corpus. Scoring reads all words of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import blocks_of, crc_of_id, stored

#: Labelled rows of each class that a model is fitted on, at most; as many more may fit the curve.
SAMPLE = 4000
ORDER, SHARED, DISCOUNT = 6, 2, 0.75
#: N-grams of the two highest orders that came once in the sample are left out.
PRUNED_FROM, LEAST = 5, 2
RUNS = (1, 4, 16)
#: An n-gram of DENSE_FROM letters or more is dense in a document with this share of its words, and this many, on it.
DENSE_FROM, DENSE_SHARE, DENSE_WORDS, ERRORS = 3, 0.01, 3, 1.0
THRESHOLD = 0.7
START, STOP = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words whose evidence a task remembers; texts that are worked out at once, in bytes, unless one is larger; new words at once.
_WORDS_KEPT, _BLOCK_BYTES, _NEW_WORDS = 500_000, 1 << 20, 20_000


def lower_bytes(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def words_of(text: str | None) -> list[str]:
    return [w.decode("utf-8", "replace") for w in lower_bytes(text)]


def grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(where letters to predict stand, hashes by order at every letter, first letter to predict of each word)."""
    lead = START * (ORDER - 1)
    letters = np.frombuffer("".join(f"{lead}{w}{STOP}" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(lengths + ORDER - 1)
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(ends - lengths - starts, lengths) + np.arange(lengths.sum())
    hashes = [np.zeros(len(letters), np.uint64), (letters + np.uint64(1)) * _MIX]
    for _ in range(2, ORDER + 1):
        before = np.concatenate([[np.uint64(0)], hashes[-1][:-1]])
        hashes.append((before ^ before >> np.uint64(29)) * _MIX + hashes[1])
    return at, hashes, starts


def grams_by_word(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the word): the n-grams from DENSE_FROM letters on of every word, each once a word."""
    at, hashes, _ = grams(words)
    owner = np.tile(np.repeat(np.arange(len(words)), [len(w) + 1 for w in words]), ORDER + 1 - DENSE_FROM)
    keys = np.concatenate([hashes[k][at] for k in range(DENSE_FROM, ORDER + 1)]).view(np.int64)
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
    return keys[first], owner[first]


def is_dense(times: np.ndarray, words: int | np.ndarray) -> np.ndarray:
    return (times >= DENSE_WORDS) & (times >= DENSE_SHARE * words)


def dense_grams(words: list[str]) -> np.ndarray:
    """Hashes of the n-grams that are dense in a document of these words."""
    if not words:
        return np.zeros(0, np.int64)
    kinds, times = np.unique(np.array(words, object), return_counts=True)
    keys, owner = grams_by_word(list(kinds))
    found, where = np.unique(keys, return_inverse=True)
    return found[is_dense(np.bincount(where, times[owner]), len(words))]


class _Places:
    """Where hashes stand in a table: slots by their high bits, a full slot's neighbour next."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.missing = len(keys)
        self.slots = np.full(1 << bits, self.missing, np.int32)
        self.keys = np.append(keys, 0)
        left, slot = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slots[slot] == self.missing
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], slot[lost] + 1 & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, `missing` where it has none."""
        slot = self._first(keys)
        found = self.slots[slot]
        wrong = np.flatnonzero((self.keys[found] != keys) & (found != self.missing))
        while len(wrong):
            slot[wrong] = slot[wrong] + 1 & self.mask
            found[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(self.keys[found[wrong]] != keys[wrong]) & (found[wrong] != self.missing)]
        return found


class _Values:
    """Two numbers for each known hash, others for all else."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray], otherwise: float):
        self.places = _Places(table[0])
        self.values = np.concatenate([table[1].reshape(-1, 2), np.full((1, 2), otherwise, np.float32)])

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self.places.of(keys)]


class Vocabulary:
    """What a task knows of the words it has met: evidence, and the strong n-grams of each as a stretch of one array."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.evidence = np.zeros(0)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.int64)

    def learn(self, model: Model, words: list[bytes]) -> None:
        """Take in words that are new."""
        evidence, owners, grams = [self.evidence], [], [self.grams]
        for begin in range(0, len(words), _NEW_WORDS):
            some = [w.decode("utf-8", "replace") for w in words[begin : begin + _NEW_WORDS]]
            own, owner, gram = model.of_words(some)
            evidence.append(own)
            owners.append(owner + begin)
            grams.append(gram)
        count = np.bincount(np.concatenate(owners), minlength=len(words)) if owners else np.zeros(0, np.int64)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.begin = np.concatenate([self.begin, len(self.grams) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.evidence, self.grams = np.concatenate(evidence), np.concatenate(grams)


@dataclass
class Model:
    """By order: hashes of n-grams with their two discounted shares, and of contexts with their two back-off weights.

    Besides these, hashes of n-grams with the strength that each gives where it is dense.
    """

    shares: list[tuple[np.ndarray, np.ndarray]]
    backoffs: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    dense: tuple[np.ndarray, np.ndarray]
    curve: np.ndarray

    @cached_property
    def _tables(self) -> tuple[list[_Values], list[_Values], _Places]:
        return [_Values(t, 0.0) for t in self.shares], [_Values(t, 1.0) for t in self.backoffs], _Places(self.dense[0])

    def __getstate__(self) -> dict:
        return {name: value for name, value in vars(self).items() if name != "_tables"}

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(toxic less ordinary log-likelihood of each word; number of a word and place of a strong n-gram that it has, each once, by word)."""
        shares, backoffs, dense = self._tables
        at, hashes, starts = grams(words)
        p = np.full((len(at), 2), self.floor)
        found = []
        for k in range(1, ORDER + 1):
            context = hashes[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64)
            keys = hashes[k][at].view(np.int64)
            p = shares[k - 1].of(keys) + backoffs[k - 1].of(context.view(np.int64)) * p
            if k >= DENSE_FROM and dense.missing:
                place = dense.of(keys)
                hit = np.flatnonzero(place != dense.missing)
                found.append((np.searchsorted(starts, hit, side="right") - 1) * dense.missing + place[hit])
        owner, place = np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), max(dense.missing, 1))
        return np.add.reduceat(np.log(p[:, 0]) - np.log(p[:, 1]), starts), owner, place

    def evidence(self, words: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word."""
        return self.of_words(words)[0] if words else np.zeros(0)

    def features(self, texts: list[str | None], vocabulary: Vocabulary) -> np.ndarray:
        """A row of features for each text; texts without a word have zeros."""
        out = np.zeros((len(texts), 2 + len(RUNS)))
        for some in blocks_of([len(t or "") for t in texts], _BLOCK_BYTES):
            out[some] = self._block([lower_bytes(t) for t in texts[some]], vocabulary)
        return out

    def _block(self, lists: list[list[bytes]], vocabulary: Vocabulary) -> np.ndarray:
        out = np.zeros((len(lists), 2 + len(RUNS)))
        kinds = set().union(*lists)
        new = list(kinds - vocabulary.number.keys())
        if len(vocabulary.number) + len(new) > _WORDS_KEPT:
            vocabulary.__init__()
            new = list(kinds)
        vocabulary.learn(self, new)
        sizes = np.array([len(words) for words in lists])
        filled = np.flatnonzero(sizes)
        if not len(filled):
            return out
        number = np.fromiter(chain.from_iterable(map(vocabulary.number.__getitem__, words) for words in lists), np.int64, sizes.sum())
        sizes = sizes[filled]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        sums = np.concatenate([[0.0], np.cumsum(vocabulary.evidence[number])])
        out[filled, 0] = (sums[ends] - sums[begins]) / sizes
        end_of = np.repeat(ends, sizes)
        place = np.arange(len(number))
        for n, run in enumerate(RUNS):
            to = place + run
            mean = np.where(to <= end_of, (sums[np.minimum(to, len(number))] - sums[place]) / run, -np.inf)
            out[filled, 1 + n] = np.where(sizes >= run, np.maximum.reduceat(mean, begins), out[filled, 0])
        out[filled, -1] = self._strengths(number, begins, sizes, vocabulary)
        return out

    def _strengths(self, number: np.ndarray, begins: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """For each text the greatest strength of the n-grams that are dense in it; zero where there is none."""
        best = np.zeros(len(sizes))
        strong = np.flatnonzero(vocabulary.count[number])
        if not len(strong):
            return best
        text = np.searchsorted(begins, strong, side="right") - 1
        count = vocabulary.count[number[strong]]
        first = np.repeat(vocabulary.begin[number[strong]], count)
        gram = vocabulary.grams[first + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        kinds, times = np.unique(np.repeat(text, count) * len(self.dense[0]) + gram, return_counts=True)
        text, gram = np.divmod(kinds, len(self.dense[0]))
        here = is_dense(times, sizes[text])
        np.maximum.at(best, text[here], self.dense[1][gram[here]])
        return best

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + features @ self.curve[1:], -500, 500)))


def fitted_curve(features: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(features)), features])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.05] * features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, x.T @ (weights * (toxic - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 3 == 1


def _for_curve(doc_id: Column) -> Column:
    """A quarter of the rows that may be learnt from."""
    return (crc_of_id(doc_id) % 12).isin(0, 5)


def _counts(rows: DataFrame) -> DataFrame:
    """(k, gram, context, suffix, toxic, ordinary): how often every n-gram comes in rows(text, toxic)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic in (0, 1):
                texts = batch["text"][batch["toxic"] == toxic]
                words, n = np.unique(np.array([w for t in texts for w in words_of(t)], object), return_counts=True) if len(texts) else ([], [])
                for begin in range(0, len(words), 50_000):
                    some = list(words[begin : begin + 50_000])
                    at, hashes, _ = grams(some)
                    times = np.repeat(n[begin : begin + 50_000], [len(w) + 1 for w in some])
                    for k in range(1, ORDER + 1):
                        keys, first, where = np.unique(hashes[k][at], return_index=True, return_inverse=True)
                        context = hashes[k - 1][at - 1][first] if k > 1 else np.zeros(len(keys), np.uint64)
                        found = np.bincount(where, times).astype(np.int64)
                        yield pd.DataFrame({
                            "k": np.int32(k), "gram": keys.view(np.int64), "context": context.view(np.int64),
                            "suffix": hashes[k - 1][at][first].view(np.int64),
                            "toxic": found * toxic, "ordinary": found * (1 - toxic),
                        })

    schema = "k int, gram bigint, context bigint, suffix bigint, toxic bigint, ordinary bigint"
    emitted = rows.select("text", "toxic").mapInPandas(run, schema)
    return emitted.groupBy("k", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _tables(rows: DataFrame) -> tuple[list, list, float]:
    """Shares and back-off weights by order: raw counts at the highest, numbers of letters seen before below it."""
    raw = stored(_counts(rows), "letter-grams")
    before = raw.where("k > 1").groupBy((F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(
        F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("ordinary") > 0).alias("ordinary"))
    lower = raw.where(F.col("k") < ORDER).select("k", "gram", "context").join(before, ["k", "gram"])
    counts = lower.unionByName(raw.where(F.col("k") == ORDER).select("k", "gram", "context", "toxic", "ordinary"))
    both = F.col("toxic") + F.col("ordinary")
    kept = counts.where((F.col("k") < PRUNED_FROM) | (both >= LEAST))
    shared = F.col("k") <= SHARED
    kept = stored(kept.select("k", "gram", "context", *(F.when(shared, both).otherwise(F.col(c)).alias(c) for c in ("toxic", "ordinary"))), "letter-counts")
    names = ("toxic", "ordinary")
    contexts = kept.groupBy("k", "context").agg(
        *(F.sum(c).alias(f"all_{c}") for c in names), *(F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in names))
    weights = contexts.select("k", "context", *(
        F.when(F.col(f"all_{c}") > 0, DISCOUNT * F.col(f"kinds_{c}") / F.col(f"all_{c}")).otherwise(1.0).alias(c) for c in names))
    shares = kept.join(contexts, ["k", "context"]).select("k", "gram", *(
        F.when(F.col(f"all_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"all_{c}")).otherwise(0.0).alias(c) for c in names))

    def by_order(table: DataFrame, key: str) -> list[tuple[np.ndarray, np.ndarray]]:
        found = table.select("k", F.col(key), *(F.col(c).cast("float") for c in names)).toPandas().sort_values(key)
        return [(g[key].to_numpy(np.int64), g[list(names)].to_numpy(np.float32)) for g in (found[found["k"] == k] for k in range(1, ORDER + 1))]

    letters = raw.where("k = 1").count()
    return by_order(shares, "gram"), by_order(weights, "context"), 1 / (letters + 1)


def _dense(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams that are dense in a greater share of the toxic than of the ordinary rows(text, toxic), and their strengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [dense_grams(words_of(t)) for t in batch["text"]]
            if found:
                yield pd.DataFrame({"gram": np.concatenate(found), "toxic": np.repeat(batch["toxic"].to_numpy(np.int32), [len(g) for g in found])})

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, ordinary = F.count_if(F.col("toxic") == 1) + 0.5, F.count_if(F.col("toxic") == 0) + 0.5
    ratio = F.log(toxic / ordinary * ((n.get(0, 0) + 1) / (n.get(1, 0) + 1)))
    strength = ratio - ERRORS * F.sqrt(1 / toxic + 1 / ordinary)
    emitted = rows.select("text", "toxic").mapInPandas(run, "gram bigint, toxic int")
    found = emitted.groupBy("gram").agg(strength.alias("strength")).where("strength > 0").toPandas().sort_values("gram")
    return found["gram"].to_numpy(np.int64), found["strength"].to_numpy(float)


def _split(chosen: pd.DataFrame, totals: dict[tuple[int, bool], float]) -> tuple[pd.DataFrame, dict[tuple[int, bool], float]] | None:
    """The chosen rows and their totals, with every fourth row for the curve in a class that lacks curve rows or others.

    None if a class has fewer than two rows, as the curve needs rows that the models have not seen.
    """
    chosen, totals = chosen.copy(), dict(totals)
    for t in (0, 1):
        of = np.flatnonzero(chosen["toxic"] == t)
        if len(of) < 2:
            return None
        if not all(totals.get((t, c)) for c in (True, False)):
            curve = np.arange(len(of)) % 4 == 1
            chosen.iloc[of, chosen.columns.get_loc("curve")] = curve
            n = sum(totals.get((t, c), 0) for c in (True, False))
            totals[t, True], totals[t, False] = n * curve.mean(), n * (1 - curve.mean())
    return chosen, totals


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The models and the curve, from labelled rows of documents that are not held out; None with fewer than two of a class."""
    toxic = F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 0)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), toxic.alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = stored(known.join(texts.select("doc_id"), "doc_id", "left_semi").withColumn("curve", _for_curve(F.col("doc_id"))), "toxicity-labels")
    totals = {(r.toxic, r.curve): r.n for r in known.groupBy("toxic", "curve").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for t in (0, 1):
        for c in (True, False):
            some = known.where((F.col("toxic") == t) & (F.col("curve") == c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
            chosen = some if chosen is None else chosen.union(some)
    split = _split(chosen.toPandas(), totals)
    if split is None:
        return None
    chosen, totals = split
    picked = documents.sparkSession.createDataFrame(chosen, "doc_id bigint, toxic int, curve boolean")
    rows = stored(texts.join(F.broadcast(picked), "doc_id"), "toxicity-sample")
    learnt = rows.where(~F.col("curve"))
    model = Model(*_tables(learnt), _dense(learnt), np.zeros(1))
    found = _features(rows.where("curve"), model).toPandas()
    y = found["toxic"].to_numpy(float)
    weights = np.where(y == 1, totals[1, True] / y.sum(), totals[0, True] / (1 - y).sum())
    model.curve = fitted_curve(np.array(found["features"].tolist()), y, weights)
    return model


def _features(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Vocabulary()
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "features": list(shared.value.features(list(batch["text"]), known))})

    return rows.select("text", "toxic").mapInPandas(run, "toxic int, features array<double>")


def scorer(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A function from a text column to its score column, fitted on the labelled rows of documents.

    With fewer than two labelled rows of a class, not counting those held out, every score is 0. Null and empty texts have no evidence and get the curve's
    value there.
    """
    model = fit(documents, labels, sample)
    if model is None:
        return lambda text: F.lit(0.0)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Vocabulary()
        for texts in batches:
            yield pd.Series(shared.value.score(shared.value.features(list(texts), known)))

    return score


def op6_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every row of documents.

    Null and empty texts get a score too, the curve's value where there is no evidence. Rows that repeat get equal
    scores; a null id counts as the empty text where rows are held out. A document with several labels is toxic if one
    says so; labels without an id, a value or a document do not count. Texts of any length are read whole. No rows
    give no rows. Other columns are not read.
    """
    doc_id = F.col("doc_id").cast("bigint")
    found = documents.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), scorer(documents, labels)(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def not_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that are not predicted toxic, with all their columns."""
    score = scorer(documents, labels)
    named = documents.toDF(*(f"_d{k}" for k in range(len(documents.columns))))
    text = F.col(f"_d{documents.columns.index('text')}")
    return named.withColumn("_score", score(text)).where(F.col("_score") < THRESHOLD).drop("_score").toDF(*documents.columns)
