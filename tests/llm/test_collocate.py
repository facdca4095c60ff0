"""Collocations against a plain count, automata against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from echolake.llm import collocate as C

FOLDER = "/root/testdata/sf0.01"


def plain(rows, least=30, most=2_000):
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(zip(*(words[i:] for i in range(k))))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        gone = set()
        for p, a in kept.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 80 * kept[p[i : i + k]]:
                        gone.add(p[i : i + k])
        scored = []
        for p, a in kept.items():
            if p not in gone:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:most]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "text").collect()]
    got = entry.queries()["op12_collocations"](spark, FOLDER)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_small_shards_ranges_nulls_ties_and_repeats(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None, ""]), " ".join(rng.choice(["the", "The", "of", "x", "y,", "z.", "é", "w\tv", "k\n", "q\x0b", "r\x0c"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [("a", None), (None, None), ("b", ""), ("a", "new york city " * 400), ("und", "the of x " * 40)] + [("c", "one two three four five")] * 40
    df = spark.createDataFrame([(i, a, t, "x", 1) for i, (a, t) in enumerate(rows)], "range long, lang string, text string, w string, a int").repartition(5)
    got = C.collocations(df, least=5, most=50, shard_words=300, range_words=400)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 50)
    one = C.collocations(df, least=5, most=50)
    assert sorted(map(tuple, one.collect())) == plain(rows, 5, 50)


def test_nothing_to_find(spark):
    df = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert C.collocations(df).count() == 0 and C.collocations(df.limit(0)).count() == 0


def some_phrases(rng, n, words, width=4):
    return {tuple(rng.randrange(1, words) for _ in range(rng.randrange(1, width + 1))): rng.choice([1, 1, 1, 2, 50]) for _ in range(n)}


def table(phrases, width=4):
    rows = np.zeros((len(phrases), width), np.uint64)
    for i, p in enumerate(phrases):
        rows[i, : len(p)] = p
    return C.summed(rows, np.asarray(list(phrases.values()), np.int64))


@pytest.mark.parametrize("n,words", [(0, 5), (1, 5), (60, 4), (500, 6), (2_000, 200)])
def test_automata_hold_their_phrases(n, words):
    rng = random.Random(n)
    phrases = some_phrases(rng, n, words)
    rows, counts = table(phrases)
    made = C.Transducer.from_bytes(C.transducer(rows, counts).to_bytes())
    got_rows, got = made.phrases()
    assert {tuple(int(x) for x in r if x): int(c) for r, c in zip(got_rows, got)} == phrases
    asked = [*phrases, (words,), (1, words, 1), *some_phrases(rng, 50, words + 3)]
    asked_rows = np.zeros((len(asked), 4), np.uint64)
    for i, p in enumerate(asked):
        asked_rows[i, : len(p)] = p
    assert made.counts(asked_rows).tolist() == [phrases.get(p, 0) for p in asked]


def test_automata_are_minimal():
    phrases = {(a, b, c): 7 * a for a in range(1, 20) for b in range(1, 9) for c in range(1, 9)}
    made = C.transducer(*table(phrases, 3))
    assert len(made) == 4  # end, two shared states, start: the weights moved to the first arcs
    rng = random.Random(1)
    phrases = some_phrases(rng, 400, 5)
    made = C.transducer(*table(phrases))
    # by definition: states of equal continuations, up to a constant
    prefixes = {p[:k] for p in phrases for k in range(len(p) + 1)}
    futures = set()
    for p in prefixes:
        follow = {q[len(p):]: c for q, c in phrases.items() if q[: len(p)] == p}
        least = min(follow.values())
        futures.add(frozenset((q, c - least) for q, c in follow.items()))
    assert len(made) == len(futures)


def test_blocks_make_the_same_automaton():
    rng = random.Random(2)
    rows, counts = table(some_phrases(rng, 800, 12))
    whole, blocks = C.transducer(rows, counts), C.Builder()
    for first in range(1, 12):
        own = rows[:, 0] == first
        blocks.add(rows[own], counts[own])
    made = blocks.build()
    assert len(made) == len(whole) and (made.phrases()[0] == whole.phrases()[0]).all() and (made.phrases()[1] == whole.phrases()[1]).all()


def test_unions_add_counts():
    rng = random.Random(3)
    parts = [some_phrases(rng, 300, 9) for _ in range(7)]
    union = C.Union(4)
    for p in parts:
        union.add(C.transducer(*table(p)))
    rows, counts = union.sums()
    want = Counter()
    for p in parts:
        want.update(p)
    assert {tuple(int(x) for x in r if x): int(c) for r, c in zip(rows, counts)} == want


def test_filters_lose_no_key(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 5_000).astype(np.int64)
    got = C.Filter(*C.bloom(spark.createDataFrame([(int(k),) for k in keys], "key long"), len(keys)))
    assert got.has(keys.view(np.uint64)).all()
    assert got.has(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.03
