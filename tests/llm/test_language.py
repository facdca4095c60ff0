"""Base scores against plain counts, window scores against one pass over a text, gradients against differences."""

import collections
import dataclasses
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from echolake.llm import language as lm
from echolake.llm.queries import piece_model

FOLDER = "/root/testdata/sf0.01"


def words(text):
    return (text or "").encode().lower().split() + [b""]


def base(rows, learn):
    counts = collections.Counter(w for i, t in rows if learn(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want = base(rows, lambda i: not held(i))
    got = entry.queries()["op9_language"](spark, FOLDER).collect()
    assert len(got) == len(rows)
    for r in got:
        t, k, n, b = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (t, k, n, held(r.doc_id))
        assert r.base_score == pytest.approx(b, rel=1e-9)
        assert r.score < 0


def small(spark, rows, s=lm.Settings(half=4, every=4)):
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    counts = lm.word_counts(df.select("text"))
    return df, lm.train(df.select("text"), counts, piece_model(), s)


def test_windows_score_each_id_once_and_add_to_one(spark):
    rows = [(i, f"the quick brown fox number {i} jumps over lazy dogs " * (i % 5), 0.0) for i in range(60)]
    df, model = small(spark, rows)
    s, classes = model.settings, model.classes
    net = lm.Attention(s, classes.base)
    net.load(model.weights)
    net.prepare()
    for text in ("", "the quick fox", "the quick brown fox number 3 jumps over lazy dogs " * 7):
        ids = lm.word_ids([text], piece_model())[0]
        total = 0.0
        for t in range(len(ids)):  # one window at a time, ending with the id that is predicted
            x, ok, target, counted = lm.windows(ids, s, classes, np.asarray([t // s.half]))
            z, _ = net.forward(x, ok)
            assert np.exp(z).sum(2) == pytest.approx(1, abs=1e-4)
            total += z[0, t % s.half, classes.of[ids[t]]] + classes.inside[ids[t]]
        assert model.score([text])[0] == pytest.approx(total / math.log(10), rel=1e-4)
    assert np.bincount(classes.of, np.exp(classes.inside), s.classes)[np.unique(classes.of)] == pytest.approx(1, abs=1e-3)
    flat = lm.Model(s, classes, lm.Attention(s, classes.base).flat(), piece_model())
    seen = [r[1] for r in rows]
    assert model.score(seen).sum() > flat.score(seen).sum()


def test_future_is_masked():
    s = lm.Settings(half=4)
    rng = np.random.default_rng(0)
    net = lm.Attention(s, np.zeros(s.classes, np.float32))
    for n in net.names:
        net.w[n] = rng.normal(size=net.w[n].shape).astype(np.float32)
    x = rng.integers(1, 50, (1, 8)).astype(np.int32)
    ok = np.ones((1, 8), bool)
    first, _ = net.forward(x, ok)
    y = x.copy()
    y[0, 6:] += 7
    second, _ = net.forward(y, ok)
    assert np.allclose(first[0, :2], second[0, :2]) and not np.allclose(first[0, 2:], second[0, 2:])


def test_gradient_by_differences():
    s = dataclasses.replace(lm.Settings(), half=3, size=4, classes=5, single=2, inputs=9)
    rng = np.random.default_rng(1)
    net = lm.Attention(s, np.zeros(5, np.float32))
    net.w = {n: rng.normal(size=w.shape) for n, w in net.w.items()}
    net.mask = net.mask.astype(np.float64)
    x, ok = rng.integers(0, 9, (4, 6)), np.ones((4, 6), bool)
    ok[0, :3] = False
    target, counts = rng.integers(0, 5, (4, 3)), np.ones((4, 3), bool)
    counts[1, 2] = False

    def loss():
        z, _ = net.forward(x, ok)
        return -(np.take_along_axis(z, target[:, :, None], 2)[:, :, 0] * counts).sum() / counts.sum()

    g = net.gradient(x, ok, target, counts)
    for n in net.names:
        for at in list(np.ndindex(net.w[n].shape))[::3]:
            keep, e = net.w[n][at], 1e-4
            net.w[n][at] = keep + e
            up = loss()
            net.w[n][at] = keep - e
            down = loss()
            net.w[n][at] = keep
            assert g[n][at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_rows(spark):
    rows = [(1, None, 0.0), (1, "", 1.0), (2, "One two", 2.0), (2, "one TWO", 3.0), (None, "one\x1fé ▁ two\n", 4.0), (5, "long " * 60_000, 5.0), (5, "long " * 60_000, 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = lm.scores(df, F.col("doc_id") != 2, piece_model()).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted([("1", 1), ("1", 1), ("2", 3), ("2", 3), ("None", 4), ("5", 60_001), ("5", 60_001)])
    ends = {r.n_known for r in got if r.doc_id == 2}
    assert ends == {1} and {r.train_tokens for r in got} == {120_004}
    n, v = 120_004, 2
    assert [r.base_score for r in got if r.doc_id == 1] == pytest.approx([math.log10(4.5 / (n + 0.5 * (v + 1)))] * 2)
    assert lm.scores(df.limit(0), F.lit(True), piece_model()).count() == 0
    assert lm.scores(df, F.lit(False), piece_model()).count() == len(rows)


def test_learns_from_every_id_once():
    s = lm.Settings()
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 3000, n).astype(np.int32) for n in (1, 15, 16, 17, 40, 5_003, 600_001)]
    classes = lm.Classes(np.bincount(np.concatenate(texts), minlength=3000), np.arange(3000) % 2 == 0, s)
    batch = pa.RecordBatch.from_arrays([lm.lists_of(np.concatenate(texts), [len(t) for t in texts])], names=["ids"])
    want = [np.concatenate(c) for c in zip(*[lm.windows(t, s, classes) for t in texts])]
    made = [list(lm.blocks(lm.cuts([batch, batch.slice(0, 0)], s, classes, r))) for r in range(s.rounds)]
    assert all(len(m[0]) <= 2 * lm.BLOCK for r in made for m in r) and min(sum(len(m[0]) for m in r) for r in made) > 0.4 * len(want[0]) * 2 / s.rounds
    got = [np.concatenate(c) for c in zip(*[m for r in made for m in r])]
    assert got[3].sum() == sum(map(len, texts))

    def rows(x, ok, target, counted):
        return collections.Counter(r.tobytes() for r in np.hstack([np.where(ok, x, -1), np.where(counted, target, -1)]).astype(np.int16))

    same = rows(*got) == rows(*want)  # apart, as a failed comparison of these would be spelt out at length
    assert same


def test_late_words_teach(spark):
    """The tail of a long text is learnt from: with windows of a sample only, its one new order is met a few times at most."""
    text = " ".join(["alpha beta"] * 300 + ["gamma delta"] * 300)
    model = lm.train(spark.createDataFrame([(text,)], "text string"), lm.word_counts(spark.createDataFrame([(text,)], "text string")), piece_model())
    flat = lm.Model(model.settings, model.classes, lm.Attention(model.settings, model.classes.base).flat(), piece_model())
    assert model.score([text])[0] > 0.7 * flat.score([text])[0]


def test_texts_are_spelt_once(spark):
    """One pass leaves the ids of every text and the counts of words and ids of the learning rows."""
    rows = [(1, "One two two", True), (2, "", True), (3, "two three\x1f é", False), (4, "zwei " * 9_000 + "One", True)]
    got = lm.spelt(spark.createDataFrame(rows, "k long, t string, learn boolean"), piece_model()).collect()
    size = 32_000
    flat, at = lm.unpacked(pa.array([r.ids for r in got if r.ids is not None], pa.binary()), size)
    kept = [r.k for r in got if r.ids is not None]
    ids = {k: flat[a:b].tolist() for k, a, b in zip(kept, at[:-1], at[1:])}
    assert ids == {k: lm.word_ids([t], piece_model())[0].tolist() for k, t, _ in rows}
    seen, pieces = collections.Counter(), collections.Counter()
    for r in got:
        if r.word is not None:
            seen[r.word.encode()] += r.n
        if r.id is not None:
            pieces[r.id] += r.n
    assert seen == collections.Counter(w for _, t, learn in rows if learn for w in words(t))
    assert pieces == collections.Counter(i for k, _, learn in rows if learn for i in ids[k])


@pytest.mark.parametrize("scale", [0.5, 40])
def test_scores_and_gradients_equal_the_plain_form(scale):
    """Small weights take the short way; large ones, whose exponentials would overflow, the other."""
    s = lm.Settings()
    rng = np.random.default_rng(4)
    net = lm.Attention(s, rng.normal(size=s.classes).astype(np.float32))
    net.w = {n: (rng.normal(size=w.shape) * scale**0.5).astype(np.float32) for n, w in net.w.items()}
    classes = lm.Classes(rng.integers(1, 50, 3000), np.arange(3000) % 2 == 0, s)
    x, ok, target, counted = lm.windows(rng.integers(0, 3000, 700), s, classes)
    z, _ = net.forward(x, ok)
    net.prepare()
    want = np.take_along_axis(z, target[:, :, None], 2)[:, :, 0]
    assert net.target(x, ok, target) == pytest.approx(want, rel=1e-3, abs=2e-3 * scale)
    g = net.gradient(x, ok, target, counted)
    assert all(np.isfinite(v).all() for v in g.values())
    p = np.exp(z).reshape(-1, s.classes)
    p[np.arange(len(p)), target.ravel()] -= 1
    assert g["bias"] == pytest.approx((p * counted.reshape(-1, 1)).sum(0) / counted.sum(), abs=1e-3)


def test_top_words_are_whole_counts(spark):
    """No task sorts or gathers more than the words wanted: words of equal count are taken together, or none of them."""
    rows = [("", 99), ("x" * 65, 50), ("a", 9), ("b", 5), ("c", 5), ("d", 2), ("é", 2), ("f", 1)]
    counts = spark.createDataFrame(rows, "word string, n long")
    take = lambda most: lm.top_words(counts, most)
    assert take(6) == {b"a": 9, b"b": 5, b"c": 5, b"d": 2, "é".encode(): 2, b"f": 1}
    assert take(4) == {b"a": 9, b"b": 5, b"c": 5} and take(2) == {b"a": 9} and take(0) == {} == lm.top_words(counts.limit(0))


def test_every_piece_has_its_own_input(spark):
    """What follows each of many rare pieces is learnt, whichever part of the data they lie in."""
    size = 32_000
    inputs = lm.Classes(np.arange(size)[::-1], np.ones(size, bool), lm.Settings()).input
    assert len(set(inputs.tolist())) == size and inputs.min() == 1

    def part(ids):
        ids = np.asarray(ids, np.int32)
        return spark.createDataFrame([(lm.packed(ids, np.asarray([len(ids)]), size)[0].as_py(),)], "ids binary").coalesce(1)

    rows = part([20_000, 5] * 400 + [30_000, 6] * 400)
    for _ in range(3):
        rows = rows.union(part([7, 8] * 4_000))
    counts = [(5, 9_000), (6, 8_000), (7, 12_000), (8, 12_000), *[(i, 2) for i in range(9, 5_000)], (20_000, 1), (30_000, 1)]
    model = lm.learnt(rows, spark.createDataFrame(counts, "id int, n long"), piece_model())
    net = lm.Attention(model.settings, model.classes.base)
    net.load(model.weights)
    first, second = model.classes.of[[5, 6]]
    for rare, more, less in ((20_000, first, second), (30_000, second, first)):
        x, ok, _, _ = lm.windows(np.asarray([rare, 5], np.int32), model.settings, model.classes)
        z = net.forward(x, ok)[0][0, 1]
        assert z[more] - z[less] > 1
