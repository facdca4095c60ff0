"""The draw against a plain program, the radix sort against sorted()."""

import hashlib
import math
import random
import re
import zlib

import pytest

import __spark_entry__ as entry
from echolake.llm import resample

FOLDER = "/root/testdata/sf0.01"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def runs(text, most):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, most=1, percent=10, least=20):
    s, t = [0] * 10_000, [0] * 10_000
    for _, x in rows:
        for b in runs(x, most):
            s[b] += 1
    for x in target:
        for b in runs(x, most):
            t[b] += 1
    total_s, total_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (total_s + 10_000) / ((a + 1) * (total_t + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, x in rows:
        f = runs(x, most)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("text").collect()]
    got = entry.queries()["op13_resample"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, target), key=key)


def test_nulls_ties_repeats_and_longer_runs(spark):
    text = "the quick Brown fox " * 10
    rows = [(1, None), (None, text), (2, ""), (3, text), (3, text), (4, text.upper()), (5, "... \x7f --"), (6, "naïve 한글 " * 30), (7, "x1 " * 20_000)]
    rows += [(100 + i, f"w{i % 9} " * 21) for i in range(80)]
    df = spark.createDataFrame([(a, b, 0, 1) for a, b in rows], "doc_id long, text string, row int, rank int")
    target = spark.createDataFrame([(None,), ("w3 w3 fox",), ("w4",)], "text string")
    for most in (1, 2):
        got = resample.draw(df, target, words=most, percent=50).select("doc_id", "n_features", "weight", "score", "rank")
        assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, [None, "w3 w3 fox", "w4"], most, 50), key=key)
    ids = {r.doc_id for r in resample.sample(df.where("doc_id > 99"), target, percent=10).collect()}
    assert len(ids) == 8
    assert resample.draw(df.limit(0), target).count() == 0
    assert resample.draw(df, target.limit(0)).where("rank IS NOT NULL").count() == 8


@pytest.mark.parametrize("low,high", [(0, 0), (-3, 3), (-(1 << 63), (1 << 63) - 1), (5, 70_000)])
def test_radix_sort(spark, low, high):
    rng = random.Random(low)
    rows = [(rng.choice([None, low, high, rng.randint(low, high)]) if rng.random() < 0.6 else high, rng.choice([None, rng.randint(-9, 9)]), k) for k in range(3_000)]
    df = spark.createDataFrame(rows, "part long, digit int, row long").repartition(7)
    got = resample.ranked(df, [("part", True), ("digit", False), ("row", False)], part=64).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0, r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.rank)] == want
    assert sorted(r.rank for r in got) == list(range(1, 3_001))


def test_radix_sort_of_equal_and_no_rows(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(None,)] * 0, "a long")
    assert sorted(r.rank for r in resample.ranked(df, [("a", False)], part=16).collect()) == list(range(1, 501))
    assert resample.ranked(df.limit(0), [("a", False)]).count() == 0
    nulls = spark.createDataFrame([(None,)] * 3, "a long")
    assert sorted(r.rank for r in resample.ranked(nulls, [("a", True)]).collect()) == [1, 2, 3]
