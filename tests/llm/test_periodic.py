"""Periodic runs against brute force: by every period of every text, and by Spark on odd rows and the given documents."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from ledgerlake.llm import common, periodic, queries

SF = "/root/testdata/sf0.001"


def brute(words):
    """(begin, end, smallest period) of all runs: stretches of equal words q apart, for each q."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            b = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            run = words[b : k + q]
            if len(run) >= max(12, 2 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                found.append((b, k + q, q))
            k += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words, seed):
    n = len(words)
    if seed % 10 or not n:
        return words
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    words = planted(words, zlib.crc32(("" if doc_id is None else str(doc_id)).encode()))
    runs = brute(words)
    dropped = {k for b, e, q in runs for k in range(b + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    figures = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    listed = "".join(f"{b},{e - b},{q}\n" for b, e, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    return (doc_id, len(runs), *figures, sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest())


def random_words(rng):
    n, kinds = rng.randrange(1, 150), rng.choice([1, 2, 3, 5, 20])
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randrange(kinds) for _ in range(n)]
    if kind == 1:
        unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 30))]
        out = (unit * n)[:n]
        for _ in range(rng.randrange(4)):
            out[rng.randrange(n)] = kinds
        return out
    if kind == 2:
        lines = [[rng.randrange(8) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        return sum((rng.choice(lines) for _ in range(n // 6 + 1)), [])
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    unit = [rng.randrange(50) for _ in range(n)]
    return unit + unit + unit[: rng.randrange(n)]


def test_runs_of_random_blocks():
    rng, total = random.Random(7), 0
    for _ in range(150):
        lists, numbers, made = [random_words(rng) for _ in range(rng.randrange(1, 5))], [], 0
        for words in lists:
            kinds = {w: made + k for k, w in enumerate(dict.fromkeys(words))}
            made += len(kinds)
            numbers.append([kinds[w] for w in words])
        starts = np.cumsum([0, *map(len, lists)])[:-1]
        found = periodic.runs_of(np.array(sum(numbers, []), np.int64), starts)
        wanted = [(b + s, e + s, q) for words, s in zip(lists, starts.tolist()) for b, e, q in brute(words)]
        assert [tuple(r) for r in found.tolist()] == wanted
        total += len(wanted)
    assert total > 300


def test_the_grammar_spells_the_text():
    rng = np.random.default_rng(3)
    words = np.concatenate([rng.integers(0, 4, 500), np.zeros(100, np.int64), rng.integers(4, 9, 300)])
    words[500:600] = 2
    grammar = periodic.compressed(words, np.array([0, 600]))

    def spelt(symbol):
        if symbol < grammar.terminals:
            return [symbol]
        return spelt(grammar.left[symbol]) + spelt(grammar.right[symbol])

    assert spelt(grammar.roots[0]) + spelt(grammar.roots[1]) == words.tolist()
    for symbol in range(grammar.terminals, len(grammar.length)):
        at = grammar.first[symbol]
        assert spelt(symbol) == words[at : at + grammar.length[symbol]].tolist()


@pytest.mark.parametrize("words", [[0] * 60_000, [0, 1, 2] * 20_000, [0, 1] * 10_000 + [2] + [1, 0] * 10_000])
def test_long_texts(words):
    found = periodic.runs_of(np.array(words, np.int64), np.array([0]))
    assert len(found) == (2 if 2 in words and len(set(words)) == 3 and words[2] == 0 else 1)
    assert found[:, 2].tolist() == ([1] if len(set(words)) == 1 else [3] if len(words) == 60_000 else [2, 2])


def test_odd_rows(spark):
    line = "to be or not to be that is "
    texts = [None, "", " \t\n", "one", line * 9, "a " * 11, "a " * 12, "x y " * 6 + "x z", "É é\x85é " * 20, "w\x1cw\x1d" * 30, line * 400]
    rows = [(k, t, "n", 1) for k, t in enumerate(texts * 3)] + [(None, line * 5, "n", 1), (None, None, None, None), (4, line * 9, "n", 1)]
    rows += [(k, "a b c d e f g h i j k l " * 2, "n", 1) for k in range(40, 80)] + [(-5, line * 3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, name string, n_runs int")
    found = [tuple(r) for r in periodic.op11_periodic(docs).collect()]
    assert sorted(found, key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)
    assert periodic.op11_periodic(docs.where("false")).count() == 0


def test_the_given_documents(spark):
    """Brute force is quadratic, so texts of 2,500 words and more are left to the other tests."""
    found = queries.QUERIES["op11_periodic"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in rows if len((r.text or "").split()) < 2500}
    assert len(found) == len(rows) and len(short) > 150
    assert sorted(tuple(r) for r in found if r.doc_id in short) == sorted(expected(*r) for r in short.items())
    assert sum(r.n_runs for r in found) > 10


def test_blocks_hold_whole_rows():
    assert list(common.blocks_of([3, 3, 9, 1, 1], 6)) == [slice(0, 2), slice(2, 3), slice(3, 5)]
    assert list(common.blocks_of([], 6)) == []
