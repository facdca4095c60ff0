"""Removed words against a direct search over all windows."""

import hashlib
import random

import __spark_entry__ as entry
from echolake.llm import substrings

FOLDER = "/root/testdata/sf0.01"


def plain(rows, window=20):
    """(id, words, removed, kept) per row; rows in id order."""
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted(words, key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in words:
        drop = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                drop[s : s + window] = [True] * window
        kept = [x for x, d in zip(w, drop) if not d]
        out.append((i, len(w), sum(drop), b" ".join(kept).decode()))
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in plain(rows)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in entry.queries()["op2_substrings"](spark, FOLDER).collect()}
    assert got == want
    assert sum(r for _, r, _ in want.values()) > 1000


def test_rows(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij")
    passages = [[rng.choice("klmnopqrst") + word() + word() for _ in range(n)] for n in (19, 20, 21, 60, 200)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [word() + word() + word() for _ in range(rng.randint(0, 40))]
        rows.append((i * 3, " \n".join(parts)))
    rows += [(1, None), (4, ""), (7, "the " * 500), (8, "the " * 30), (10, "one two " * 40)]
    rows += [rows[20], rows[20]]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicate(df).collect())
    assert got == sorted(plain(rows))
    assert substrings.deduplicate(df.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, "w " * 3, 1), (None, None, 2)], "doc_id long, text string, h int")
    assert sorted((r.doc_id, r.n_words) for r in substrings.deduplicate(lost).collect()) == [(None, 0), (None, 3)]
