"""Periodic runs of words by grammar compression.

A block of documents becomes one sequence of word numbers that no two documents share. Re-Pair makes a grammar of it:
the pair that comes most often is replaced by a new nonterminal, wherever it stands, until no pair comes twice. A round
replaces at once every pair that comes more often than both pairs it overlaps (ties in a random but fixed order), so
that the number of rounds grows with the logarithm of the text. What is left of each document is then paired
neighbour by neighbour to one root, so that every nonterminal has two children.

A run lies across the boundary between the children of exactly one nonterminal of the derivation. So each nonterminal
is looked at once, where it stands first: a run of period q that crosses the boundary has equal words q apart at the
boundary's last or first word, and the places of that word within the nonterminal give the periods to try. The runs
found, cut at the nonterminal's ends, are moved to all its places in the derivation; of those of one period only the
maximal ones stay.

Documents are handled one block at a time; nothing of one document is needed for another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlake.llm.common import blocks_of

#: A run has at least so many words, and at least two periods.
LEAST = 12
#: Text of one block, in bytes, unless one document is larger.
BLOCK_BYTES = 4 << 20
#: Equal words on either side that are compared for all candidates at once, and candidates at once.
_STEPS, _AT_ONCE = 15, 1 << 21
_NONE = np.zeros(0, np.int64)


@dataclass
class Grammar:
    """Nonterminals by number, from `terminals` on: children, words spelt, first place, and where each round began."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    first: np.ndarray
    rounds: list[int]
    roots: np.ndarray


def _pair_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the pair, times it comes) at every place."""
    keys = a << 31 | b
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.cumsum(new) - 1
    which = np.empty(len(keys), np.int64)
    which[order] = group
    return which, np.bincount(group)[which]


def compressed(words: np.ndarray, starts: np.ndarray) -> Grammar:
    """The grammar of word numbers, dense from 0 and shared by no two documents; starts: where documents begin, none empty."""
    n, terminals = len(words), int(words.max()) + 1
    if terminals + n >= 1 << 31:
        raise ValueError("a document of more than 2^30 words")
    left, right, first = (np.zeros(terminals + n, np.int64) for _ in range(3))
    length = np.ones(terminals + n, np.int64)
    made, rounds = terminals, []

    def rules(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        nonlocal made
        new = np.arange(made, made + len(a))
        left[new], right[new], first[new], length[new] = a, b, place, length[a] + length[b]
        rounds.append(made)
        made += len(a)
        return new

    symbol, gone = words.copy(), np.zeros(n, bool)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    weight, at = np.zeros(n + 1, np.int64), np.arange(n)
    mixed = np.random.default_rng(0)
    while True:
        at = at[after[at] < n]
        which, times = _pair_counts(symbol[at], symbol[after[at]]) if len(at) else (_NONE, _NONE)
        at, which, times = at[times > 1], which[times > 1], times[times > 1]
        if not len(at):
            break
        kinds = int(which.max()) + 1
        mine = times * kinds + mixed.permutation(kinds)[which]
        weight[at] = mine
        same = np.concatenate([[False], (at[:-1] == before[at[1:]]) & (mine[1:] == mine[:-1])])
        number = np.arange(len(at))
        in_chain = number - np.maximum.accumulate(np.where(same, 0, number))
        chosen = (mine >= weight[before[at]]) & (mine >= weight[after[at]]) & (in_chain % 2 == 0)
        weight[at] = 0
        picked = at[chosen]
        _, earliest, rule = np.unique(which[chosen], return_index=True, return_inverse=True)
        place = picked[earliest]
        new = rules(symbol[place], symbol[after[place]], place)
        eaten = after[picked]
        gone[eaten] = True
        symbol[picked] = new[rule]
        after[picked] = after[eaten]
        follows = after[picked] < n
        before[after[picked][follows]] = picked[follows]
        at = np.concatenate([at, picked, before[picked]])
        at = np.unique(at[at >= 0])
        at = at[~gone[at]]

    place = np.flatnonzero(~gone)
    symbol, owner = symbol[place], np.searchsorted(starts, place, side="right")
    while len(place) > len(starts):
        number = np.arange(len(place))
        begins = np.concatenate([[True], owner[1:] != owner[:-1]])
        even = (number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0
        head = np.flatnonzero(even[:-1] & ~begins[1:])
        symbol[head] = rules(symbol[head], symbol[head + 1], place[head])
        kept = np.ones(len(place), bool)
        kept[head + 1] = False
        place, symbol, owner = place[kept], symbol[kept], owner[kept]
    return Grammar(terminals, left[:made], right[:made], length[:made], first[:made], rounds, symbol)


def _equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of a and b are equal."""
    done, step, most = 0, 64, min(len(a), len(b))
    while done < most:
        some = a[done : done + step] == b[done : done + step][: len(a) - done]
        if not some.all():
            return done + int(some.argmin())
        done += len(some)
        step *= 4
    return done


def _stretch(words: np.ndarray, begin: int, end: int, at: int, period: int) -> tuple[int, int]:
    """The largest interval of [begin, end) round `at` and `at + period`, whose words are equal, that has the period."""
    ahead = _equal_words(words[at : end - period], words[at + period : end])
    back = _equal_words(words[begin:at][::-1], words[begin + period : at + period][::-1])
    return at - back, at + ahead + period


def _repeats(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first[row] + 0, 1, ... up to counts[row] - 1)."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _candidates(words: np.ndarray, begin: np.ndarray, cut: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, at, period) with equal words at `at` and `at + period`, one of them beside the row's cut, in blocks of rows."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    places = words[order] * n + order
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    half = (end - begin) // 2
    last = cut - 1
    ahead = np.searchsorted(places, words[last] * n + np.minimum(end - 1, last + half), side="right") - rank[last] - 1
    back_from = np.searchsorted(places, words[cut] * n + np.maximum(begin, cut - half), side="left")
    back = rank[cut] - back_from
    total = np.cumsum(ahead + back)
    for low in range(0, int(total[-1]), _AT_ONCE):
        some = slice(*np.searchsorted(total, [low, low + _AT_ONCE], side="right"))
        row, where = _repeats(rank[last[some]] + 1, ahead[some])
        row2, where2 = _repeats(back_from[some], back[some])
        at = np.concatenate([last[some][row], order[where2]])
        period = np.concatenate([order[where] - last[some][row], cut[some][row2] - order[where2]])
        yield np.concatenate([row, row2]) + some.start, at, period


def _long_enough(words: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Where up to _STEPS words on either side do not rule out an interval of LEAST words and two periods."""
    found = np.ones(len(at), np.int64)
    for way in (1, -1):
        live = np.arange(len(at))
        for step in range(1, _STEPS + 1):
            here = at[live] + way * step
            inside = here >= begin[live] if way < 0 else here + period[live] < end[live]
            live, here = live[inside], here[inside]
            live = live[words[here] == words[here + period[live]]]
            if not len(live):
                break
            found[live] += 1
    return found >= np.minimum(np.maximum(period, LEAST - period), _STEPS)


def _runs_of_one(words: np.ndarray, begin: int, end: int, at: np.ndarray, period: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, period) of the runs across one boundary, from its candidates in order of their periods."""
    out = []
    while len(at):
        b, e = _stretch(words, begin, end, int(at[0]), q := int(period[0]))
        rest = np.ones(len(at), bool)
        rest[0] = False
        if e - b >= max(LEAST, 2 * q):
            out.append((b, e, q))
            rest &= (period % q != 0) | (at < b) | (at + period >= e)
        else:
            rest &= (period != q) | (at < b) | (at + period >= e)
        at, period = at[rest], period[rest]
    return out


def crossing_runs(words: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """(nonterminals, intervals): rows (begin, end, period), counted from where the nonterminal begins, that cross its boundary."""
    large = np.flatnonzero(grammar.length >= LEAST)
    large = large[large >= grammar.terminals]
    owners, intervals = [], []
    if len(large):
        begin = grammar.first[large]
        end, cut = begin + grammar.length[large], begin + grammar.length[grammar.left[large]]
        for row, at, period in _candidates(words, begin, cut, end):
            keep = _long_enough(words, begin[row], end[row], at, period)
            row, at, period = row[keep], at[keep], period[keep]
            order = np.lexsort((period, row))
            row, at, period = row[order], at[order], period[order]
            edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else _NONE
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                k = int(row[low])
                for b, e, q in _runs_of_one(words, int(begin[k]), int(end[k]), at[low:high], period[low:high]):
                    owners.append(large[k])
                    intervals.append((b - begin[k], e - begin[k], q))
    return np.array(owners, np.int64), np.array(intervals, np.int64).reshape(-1, 3)


def runs_of(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (begin, end, period), in order, of all runs of word numbers as `compressed` takes them."""
    grammar = compressed(words, starts)
    owners, intervals = crossing_runs(words, grammar)
    if not len(owners):
        return np.zeros((0, 3), np.int64)
    order = np.argsort(owners, kind="stable")
    owners, intervals = owners[order], intervals[order]
    held = np.bincount(owners, minlength=len(grammar.length))
    offset = np.cumsum(held) - held
    wanted = held > 0
    for low, high in zip(grammar.rounds, [*grammar.rounds[1:], len(grammar.length)]):
        wanted[low:high] |= wanted[grammar.left[low:high]] | wanted[grammar.right[low:high]]
    symbol, place, found = grammar.roots, starts, []
    while True:
        symbol, place = symbol[wanted[symbol]], place[wanted[symbol]]
        if not len(symbol):
            break
        row, which = _repeats(offset[symbol], held[symbol])
        found.append(intervals[which] + place[row][:, None] * np.array([1, 1, 0]))
        second = place + grammar.length[grammar.left[symbol]]
        symbol, place = np.concatenate([grammar.left[symbol], grammar.right[symbol]]), np.concatenate([place, second])
    return maximal(np.concatenate(found))


def maximal(intervals: np.ndarray) -> np.ndarray:
    """Those rows (begin, end, period) that no other of their period contains, each once, by begin and period."""
    begin, end, period = intervals[np.lexsort((-intervals[:, 1], intervals[:, 0], intervals[:, 2]))].T
    beyond = int(end.max()) + 1
    group = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]]))
    reached = np.maximum.accumulate(end + group * beyond)
    kept = np.concatenate([[True], end[1:] + group[1:] * beyond > reached[:-1]])
    out = np.column_stack([begin, end, period])[kept]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def planted(n: int, seed: int) -> np.ndarray | None:
    """Which original word stands at each of n places, if the contract plants a period for this crc32 of an id."""
    if seed % 10 or not n:
        return None
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % p
    return places


def _block(texts: Sequence[bytes], seeds: Sequence[int | None]) -> Iterator[tuple]:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each text."""
    lists, numbers, made = [], [], 0
    for text, seed in zip(texts, seeds):
        words = text.split()
        places = None if seed is None else planted(len(words), seed)
        if places is not None:
            words = [words[k] for k in places.tolist()]
        kinds = dict(zip(dict.fromkeys(words), range(made, made + len(words))))
        made += len(kinds)
        lists.append(words)
        numbers.append(np.fromiter(map(kinds.__getitem__, words), np.int64, len(words)))
    sizes = np.array([len(words) for words in lists], np.int64)
    ends = np.cumsum(sizes)
    runs = runs_of(np.concatenate(numbers), (ends - sizes)[sizes > 0]) if made else np.zeros((0, 3), np.int64)
    lows, highs = np.searchsorted(runs[:, 0], ends - sizes), np.searchsorted(runs[:, 0], ends)
    for words, offset, low, high in zip(lists, (ends - sizes).tolist(), lows.tolist(), highs.tolist()):
        mine = runs[low:high]
        if not len(mine):
            yield 0, None, None, None, None, sha256(b"").hexdigest(), sha256(b" ".join(words)).hexdigest()
            continue
        begin, end, period = mine.T
        begin, length = begin - offset, end - begin
        k = np.lexsort((period, begin, -length))[0]
        listed = "".join(f"{b},{n},{q}\n" for b, n, q in zip(begin.tolist(), length.tolist(), period.tolist()))
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, begin + period, 1)
        np.add.at(change, begin + length, -1)
        kept = np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()
        collapsed = sha256(b" ".join([words[i] for i in kept])).hexdigest()
        longest, shortest = int(length[k]), int(period[k])
        yield len(mine), int(begin[k]), longest, shortest, 1000 * longest // shortest, sha256(listed.encode()).hexdigest(), collapsed


RESULT = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def periodic_runs(documents: DataFrame, plant: bool = False) -> DataFrame:
    """One row per row of documents: its runs of periodic words, and the digest of the text without their repetitions.

    With `plant` the contract's periods are put into every tenth text first. Null texts count as empty: no run. A null
    id counts as the empty text where periods are planted. Runs of equal length are told apart by their start, then
    their period. Repeated rows give repeated results, no rows give none; a text of any length is one block, whole.
    Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, texts = batch.columns
            texts = texts.cast(pa.large_binary()).fill_null(b"")
            for some in blocks_of(pc.binary_length(texts).to_pylist(), BLOCK_BYTES):
                size = some.stop - some.start
                seeds = [zlib.crc32((name or "").encode()) if plant else None for name in names.slice(some.start, size).to_pylist()]
                found = zip(*_block(texts.slice(some.start, size).to_pylist(), seeds))
                yield pa.RecordBatch.from_arrays([ids.slice(some.start, size), *map(pa.array, found, schema.types[1:])], schema=schema)

    doc_id = F.col("doc_id").cast("bigint")
    source = documents.select(doc_id.alias("doc_id"), doc_id.cast("string").alias("name"), "text")
    schema = to_arrow_schema(StructType.fromDDL(RESULT))
    return source.mapInArrow(run, RESULT)


def op11_periodic(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return periodic_runs(documents, plant=True)
