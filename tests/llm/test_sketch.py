"""Sketches against exact sets, and the distributed neighbour pass against a plain sort."""

import hashlib
import random

import numpy as np

import __spark_entry__ as entry
from echolake.llm import sketch

FOLDER = "/root/testdata/sf0.01"


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def exact(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def plain(rows):
    rows = sorted(((i, t or "") for i, t in rows if i is not None))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out.append((i, t, t[: len(t) - half] + following[:half], following))
    return out


def test_query(spark):
    want = {i: (t, e, f) for i, t, e, f in plain([tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()])}
    got = entry.queries()["op4_fingerprints"](spark, FOLDER).collect()
    assert len(got) == len(want)
    off = []
    for r in got:
        t, e, f = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        off += [abs(r.near_edited - exact(t, e)), abs(r.near_next - exact(t, f))]
        assert r.fingerprint == sketch.written(sketch.sketch(t)) and r.edited_fingerprint == sketch.written(sketch.sketch(e))
    assert np.mean(off) < 0.02 and max(off) < 0.2


def test_estimates_and_merges():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    for n in (3, 40, 3000):
        a = " ".join(rng.choice(words) for _ in range(n))
        b = a + " " + " ".join(rng.choice(words) for _ in range(n))
        x, y = sketch.sketch(a), sketch.sketch(b)
        assert abs(sketch.resemblance(x, y) - exact(a, b)) < 0.15
        assert abs(sketch.containment(x, y) - len(shingles(a) & shingles(b)) / len(shingles(a))) < 0.2
        assert abs(sketch.distinct(y) / max(1, len(shingles(b))) - 1) < 0.3
    parts = [np.sort(np.asarray([rng.getrandbits(64) for _ in range(300)], np.uint64))[:128] for _ in range(4)]
    assert (sketch.merge(sketch.merge(parts[0], parts[1]), parts[2]) == sketch.merge(parts[0], sketch.merge(parts[1], parts[2]))).all()
    assert (sketch.parsed(sketch.written(parts[0])) == parts[0]).all()


def test_rows(spark):
    rows = [(i * 7 % 101, "word " * i, "a") for i in range(101)] + [(7, "again", "b"), (7, "again", "b"), (7, None, None), (None, None, "c"), (None, "lost one", "d"), (-5, "x " * 100_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sketch.compared(df).collect()
    want = sorted((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in plain([r[:2] for r in rows]))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == want
    assert sorted(r.n_chars for r in got if r.doc_id is None) == [0, 8]
    assert sketch.compared(df.limit(0)).count() == 0
    assert [r.near_next for r in sketch.compared(df.limit(1)).collect()] == [1.0]
    made = sketch.merged(sketch.fingerprints(df.selectExpr("doc_id % 2 as k", "text"), "text"), "k").collect()
    for r in made:
        mine = [sketch.sketch(t or "") for i, t, _ in rows if (None if i is None else int(np.fmod(i, 2))) == r.k]
        total = np.zeros(0, np.uint64)
        for m in mine:
            total = sketch.merge(total, m)
        assert r.fingerprint == sketch.written(total)
