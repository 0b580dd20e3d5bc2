"""Quality rules as weak supervision. DataFrame functions only.

Each rule looks at a few counts of a document and votes good, bad, or abstains; a rule that looks for one fault
votes bad or abstains, since not having that fault says little. The patterns of votes are counted over the corpus
(at most 3 to the number of rules, whatever the corpus), and expectation-maximisation on that histogram estimates
how often each rule's votes are right, without labels and with both classes equally likely beforehand. A document
is kept if the posterior probability that it is good, the product of the odds of its votes, reaches KEEP; a document
on which every rule abstains is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import stored, words_of

KEEP = 0.5
ROUNDS = 30
GOOD, BAD, ABSTAIN = 1, -1, 0


@dataclass(frozen=True)
class Vote:
    """A rule: votes `says` where the condition holds, else abstains."""

    name: str
    says: int
    holds: Callable[[], Column]

    def column(self) -> Column:
        return F.when(self.holds(), F.lit(self.says)).otherwise(F.lit(ABSTAIN))


def _c(name: str) -> Column:
    return F.col(name)


def _few_signs() -> Column:
    return 50 * _c("n_symbols") <= _c("n_words")


#: Shares are of words, letters or lines. Documents below 50 words are judged by the base rule alone.
VOTES = (
    Vote("repeats", BAD, lambda: (_c("n_words") >= 50) & (2 * _c("n_repeat_words") > _c("n_words"))),
    Vote("symbols", BAD, lambda: 10 * _c("n_symbols") > _c("n_words")),
    Vote("lines", BAD, lambda: (_c("n_lines") >= 4) & (2 * _c("n_dup_lines") > _c("n_lines"))),
    Vote("capitals", BAD, lambda: 2 * _c("n_upper") > _c("word_chars")),
    Vote("marks", BAD, lambda: 3 * _c("n_marks") > _c("n_words")),
    Vote("even", GOOD, lambda: _few_signs() & (20 * _c("n_marks") <= _c("n_words")) & (5 * _c("n_upper") < _c("word_chars"))),
    Vote("varied", GOOD, lambda: _few_signs() & (5 * _c("n_repeat_words") <= _c("n_words")) & (_c("n_dup_lines") == 0)),
)
#: What a rule's accuracy is before any vote is seen, how many votes that belief is worth, and its bounds.
BELIEF, BELIEF_VOTES, LEAST, MOST = 0.9, 1.0, 0.55, 0.999


def _deleted(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated_starts(places: Column) -> Column:
    """Where windows begin that come twice or more; places: (hash, place) of all windows in order of their hash."""
    twice = F.filter(places, lambda x, k: (F.get(places, k - 1)["h"] == x["h"]) | (F.get(places, k + 1)["h"] == x["h"]))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def counted(documents: DataFrame) -> DataFrame:
    """documents with the column _q: a struct of all counts. Text null counts as empty.

    Windows of three words are compared by a 64-bit hash of the three.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in documents.columns]
    first = documents.select(*kept, text.alias("_q_text"), words_of(F.col("text")).alias("_q_words"))
    words, text = F.col("_q_words"), F.col("_q_text")
    hashes = F.transform(words, lambda w, k: F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2)))
    hashes = F.when(F.size(words) >= 3, F.slice(hashes, 1, F.size(words) - 2)).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    second = first.select(*kept, "_q_text", "_q_words", hashes.alias("_q_hashes"), lines.alias("_q_lines"))
    hashes, lines = F.col("_q_hashes"), F.col("_q_lines")
    places = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    letters = _deleted(text, " \t\n\x0b\x0c\r")
    counts = F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        (F.length(text) - letters).cast("bigint").alias("word_chars"),
        _deleted(text, "#*$%&|<>").cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.size(lines).cast("bigint").alias("n_lines"),
        _deleted(text, "!").cast("bigint").alias("n_marks"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("bigint").alias("n_upper"),
    )
    third = second.select(*kept, counts.alias("_q_counts"), F.when(repeated, places).otherwise(none).alias("_q_places"))
    places = F.col("_q_places")
    fourth = third.select(*kept, "_q_counts", _repeated_starts(places).alias("_q_starts"))
    starts = F.col("_q_starts")
    covered = F.transform(starts, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - at, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, n: a + n)
    return fourth.select(*kept, F.struct("_q_counts.*", total.alias("n_repeat_words")).alias("_q"))


def base_failed() -> Column:
    return (_c("n_words") < 50) | (100 * _c("n_repeat_words") > 50 * _c("n_words"))


def fit(patterns: DataFrame, votes: tuple[Vote, ...] = VOTES, rounds: int = ROUNDS) -> dict[str, float]:
    """Accuracy of each rule from patterns(one column per rule, n), by expectation-maximisation.

    A rule that never votes keeps its first accuracy; so do all without rows.
    """
    accuracies = {v.name: BELIEF for v in votes}
    for _ in range(rounds):
        p = patterns.withColumn("_p", probability(accuracies, votes))
        sums = []
        for v in votes:
            hit = F.when(_c(v.name) == v.says, F.col("n")).otherwise(F.lit(0))
            right = F.col("_p") if v.says == GOOD else 1 - F.col("_p")
            sums += [F.coalesce(F.sum(hit), F.lit(0)).alias(f"{v.name}_all"), F.coalesce(F.sum(hit * right), F.lit(0.0)).alias(f"{v.name}_right")]
        found = p.agg(*sums).first()
        before, accuracies = accuracies, {
            v.name: min(MOST, max(LEAST, (found[f"{v.name}_right"] + BELIEF * BELIEF_VOTES) / (found[f"{v.name}_all"] + BELIEF_VOTES)))
            for v in votes
        }
        if max(abs(accuracies[n] - before[n]) for n in before) < 1e-6:
            break
    return accuracies


def probability(accuracies: dict[str, float], votes: tuple[Vote, ...] = VOTES) -> Column:
    """Posterior probability of good from vote columns named as the rules."""
    odds = F.lit(0.0)
    for v in votes:
        a = accuracies[v.name]
        odds = odds + F.when(_c(v.name) == v.says, F.lit(v.says * log(a / (1 - a)))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def _voted(counts: DataFrame) -> DataFrame:
    return counts.select("*", *(v.column().alias(v.name) for v in VOTES))


def vote_patterns(counts: DataFrame) -> DataFrame:
    return stored(_voted(counts).groupBy(*(v.name for v in VOTES)).agg(F.count("*").alias("n")), "vote-patterns")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, all counts, base_failed, good, kept) for every row of documents; good is the posterior probability."""
    found = stored(counted(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "_q.*"), "quality-counts")
    good = probability(fit(vote_patterns(found)))
    return _voted(found).select(*found.columns, base_failed().alias("base_failed"), good.alias("good")).withColumn("kept", ~F.col("base_failed") & (F.col("good") >= KEEP))


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of documents that are kept, with all their columns.

    Null and empty texts fail the base rule and go; very long texts are read whole; repeated rows are judged alike and
    all stay or go; no rows give no rows. Column names do not matter: the input is renamed by position.
    Rows are stored with their counts: a filter on computed counts would be pushed below them and count again.
    """
    names = [f"_d{k}" for k in range(len(documents.columns))]
    named = documents.toDF(*names)
    found = counted(named.withColumn("text", F.col(names[documents.columns.index("text")])))
    found = stored(found.select(*names, "_q.*"), "quality-rows")
    good = probability(fit(vote_patterns(found)))
    return _voted(found).where(~base_failed() & (good >= KEEP)).select(*names).toDF(*documents.columns)


def op5_quality(documents: DataFrame) -> DataFrame:
    """The contract's columns; good, the posterior probability, is one more.

    Null and empty texts have no words and fail the base rule. Texts of any length are read whole. Rows that repeat are
    judged alike, and count as often as they come where accuracies are estimated; ties of the odds keep a document.
    No rows give no rows. Other columns are not read.
    """
    return judged(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good",
    )
