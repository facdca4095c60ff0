"""Fingerprints and components against a direct computation over all pairs."""

import random

import numpy as np
import xxhash

import __spark_entry__ as entry
from echolake.llm import simhash
from echolake.llm.components import components

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    p = np.asarray(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= 4) + i + 1:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    top = {}
    for i, d in enumerate(ids):
        top[find(i)] = min(d, top.get(find(i), d))
    return [top[find(i)] for i in range(len(ids))]


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, brute([r.doc_id for r in rows], prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op10_simhash"](spark, FOLDER).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_links_of_planted_bits(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(150):
        base = rng.getrandbits(64)
        for _ in range(6):
            p = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << bit
            prints.append(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(df).collect()}
    assert [got[s] for s in signed] == brute(list(range(len(prints))), prints)


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([*zip(order, order[1:]), (1000, 1001), (5, None), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_rows(spark):
    same = "one two three four five six seven"
    rows = [(4, same, 1), (2, same, 2), (2, same, 3), (None, None, 4), (None, "", 5), (9, "other words " * 40_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 2), (2, 2), (2, 2), (None, None), (None, None), (9, 9)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(kept.toPandas()["doc_id"].fillna(-1)) == [-1, 2, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0
