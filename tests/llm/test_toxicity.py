"""The classifier: lookups against plain convolution, gradients by training, held-out rows, and rows of every kind."""

import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from echolake.llm import toxicity as tx


def plain(net, ids):
    """Convolution and pooling without tables."""
    x, out = net.words[net.seen(ids)], []
    for kernel, bias in zip(net.kernels, net.bias):
        w = len(kernel)
        replies = [sum(x[a + k] @ kernel[k] for k in range(w)) + bias for a in range(len(x) - w + 1)]
        out.append(np.maximum(np.max(replies, axis=0), 0))
    return float(np.concatenate(out) @ net.out + net.base[0])


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        words = [f"w{rng.integers(400)}" for _ in range(rng.integers(5, 60))]
        if i % 3 == 0:
            words[rng.integers(len(words))] = ["idiot.", "Moron", "scum,"][i % 9 // 3]
        rows.append((tx.word_ids(" ".join(words), 1 << 12), int(i % 3 == 0)))
    n = tx.Network(tx.Settings(buckets=1 << 12, epochs=6))
    n.fit(rows)
    n.prepare()
    logits = np.asarray([n.raw(i) for i, _ in rows])
    n.calibrate(logits, np.asarray([y for _, y in rows]), np.zeros(len(rows), int))
    return n


def test_lookups_match_convolution(net):
    for text in ("", "w1", "w1 w2 moron w3 unknownword ***", "w5 " * 300):
        ids = tx.word_ids(text, 1 << 12)
        assert net.raw(ids) == pytest.approx(plain(net, ids), abs=1e-4)


def test_learns_words_and_cuts(net):
    clean = " ".join(f"w{i}" for i in range(300))
    assert net.score(f"w1 w2 w3 IDIOT! w4") >= 0.3 > net.score("w1 w2 w3 w4")
    assert net.score(clean) < 0.3 <= net.score(clean + " scum")


def test_languages_by_letters():
    assert [tx.LANGUAGES[tx.guess_language(t)] for t in ("größe", "été là", "mañana", "plain", "")] == ["de", "fr", "es", "other", "other"]


def test_held_out_rows(spark):
    got = entry.queries()["op3_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()
    both = got.merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    y, order = held["toxic"].to_numpy(), held["score"].rank().to_numpy()
    assert (order[y == 1].mean() - (y.sum() + 1) / 2) / (len(y) - y.sum()) > 0.85
    assert held["predicted"][y == 0].mean() < 0.06


def test_rows(spark):
    rows = [(1, None, 0.5), (1, "", 0.5), (None, "idiot " * 3, 0.5), (2, "word " * 100_000, None), (2, "word " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert tx.train(docs, none) is None
    assert [r.score for r in tx.score(docs, None).collect()] == [0.0] * 5
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (9, 1)], "doc_id long, toxic int")
    tx.train(docs, some)
    kept = tx.keep(docs, None)
    assert kept.columns == docs.columns and sorted(str(r.score) for r in kept.collect()) == ["0.5", "0.5", "0.5", "None", "None"]
    assert tx.score(docs.limit(0), None).count() == 0 and tx.train(docs.limit(0), some) is None


def test_long_labelled_rows_are_used(spark, monkeypatch):
    rows = [(i, ("calm words here " if i % 2 else "nasty words here ") * (900 if i < 10 else 5), i % 2 == 0) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    seen = []
    fit, calibrate = tx.Network.fit, tx.Network.calibrate
    monkeypatch.setattr(tx.Network, "fit", lambda self, r: (seen.append(len(r)), fit(self, r))[1])
    monkeypatch.setattr(tx.Network, "calibrate", lambda self, x, y, z: (seen.append(len(x)), calibrate(self, x, y, z))[1])
    net = tx.train(docs, labels)
    assert seen == [60, 60]
    got = {r.doc_id: r.predicted for r in tx.score(docs, net).collect()}
    assert got == {i: int(y) for i, _, y in rows}


def test_all_labelled_rows_are_learnt_and_none_is_left_to_a_sample(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(4000):
        words = [f"w{rng.integers(200)}" for _ in range(20)]
        if i % 2:
            words[rng.integers(20)] = f"nasty{i // 2 % 50}"
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    net = tx.train(docs, labels, tx.Settings(train_rows=60))
    got = {r.doc_id: r.predicted for r in tx.score(docs, net).collect()}
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.9
    assert net.held.max() > 60  # counted over all rows that are learnt
