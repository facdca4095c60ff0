"""Leaks against brute force over all pairs of document and item, planted paraphrases, and the parts of the method."""

import collections
import random

import numpy as np

import __spark_entry__ as entry
from echolake.llm import decontaminate as d

FOLDER = "/root/testdata/sf0.01"


def containing(docs, items):
    """Pairs where 80 % of an item's five-word shingles are in the document, and those with under 20 %."""
    grams = collections.defaultdict(set)
    size = {}
    for i, t in items:
        w = d.words(t)
        parts = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        size[i] = len(parts)
        for p in parts:
            grams[p].add(i)
    sure, some = set(), set()
    for k, t in docs:
        w = d.words(t)
        hits = collections.Counter(i for p in {tuple(w[a : a + 5]) for a in range(len(w))} for i in grams.get(p, ()))
        sure |= {(k, i) for i, n in hits.items() if n >= 0.8 * size[i]}
        some |= {(k, i) for i, n in hits.items() if n >= 0.2 * size[i]}
    return sure, some


def test_query_finds_all_copies_and_nothing_else(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op7_decontaminate"](spark, FOLDER).collect()}
    sure, some = containing(docs, items)
    assert len(sure) > 5 and len(sure & got) >= 0.9 * len(sure)
    assert got <= some


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 12))] for _ in range(2))
        w = {c: rng.randint(1, 9) for c in "abcdef"}
        table = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + w[x] if x == y else 0)
        assert d.common_subsequence(a, b, w.get)[0] == table[-1, -1]


def test_sequences_share_what_the_table_gives():
    rng = random.Random(5)
    w = {c: rng.random() for c in "abcdefgh"}
    for _ in range(300):
        x, y = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] for _ in range(2))
        own = d.Sequence(x, w.get)
        assert own.shared(y) == d.common_subsequence(x, y, w.get)[0] and own.whole == sum(map(w.get, x))


def test_features_of_words():
    rng = random.Random(2)
    texts = ["", "  ", "***", "a", "A-b, (c) ''d''", "é" * 10, "x" * 50 + " " + "y." * 40]
    texts += ["".join(rng.choice("ab.,\n\té ") for _ in range(rng.randint(1, 200))) for _ in range(300)] + ["word, " * 300_000]
    for text in texts:
        own = {w: d.feature_of(w, 1 << 15) for w in set(d.words(text))}
        assert d.feature_ids(text, 1 << 15).tolist() == [own[w] for w in d.words(text)]


def test_answer():
    assert d.answer("Who? Me too.") == [b"me", b"too"]
    assert d.answer("One two. Three four.") == [b"three", b"four"]
    assert d.answer("") == [] and d.answer("...") == []


def test_paraphrases_and_rows(spark):
    rng = random.Random(3)
    vocabulary = ["w" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{text(24)}? {text(4)}.") for i in range(30)] + [(98, None), (99, ""), (5, None)]
    rows = [(i, text(rng.randint(1, 400)), "x") for i in range(200)] + [(900, None, None), (901, "", "y"), (None, text(30), "z")]
    for k in range(10):  # every sixth word of the question replaced, the answer kept
        w = items[k][1].split()
        for p in range(2, 22, 6):
            w[p] = rng.choice(vocabulary)
        rows += [(1000 + k, f"{text(120)} {' '.join(w)} {text(90)}", "p")] * 2
    rows.append((2000, text(50_000) + " " + items[20][1], "long"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect())
    assert got == {**{(1000 + k, k): 2 for k in range(10)}, (2000, 20): 1}
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 21
    assert d.leaks(docs.limit(0), bench).count() == 0
    assert d.leaks(docs, bench.limit(0)).count() == 0


def test_copies_among_thousands_of_items(spark):
    rng = random.Random(4)
    vocabulary = ["v" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(5, 60))) for i in range(3000)]
    rows = [(i, f"{text(60)} {items[i][1]} {text(60)}") for i in range(0, 3000, 3)] + [(10_000 + i, text(150)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(0, 3000, 3)}
    assert all(r.verdict == "copy" and 0 < r.cosine <= 1.001 for r in got)


def test_short_items_of_common_words_match_no_ordinary_text(spark):
    items = ["the", "What is it?", "of the", "is this the right way", "what is the name of the first"]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(150).collect()
    rows = [(r.doc_id, f"{r.text} what do you say it is the word of the day and this or the way that is right then the name is said first of all")
            for r in docs] + [(10_001, "He asked: Is this the right way? Nobody knew."), (10_002, "the"), (10_003, "Well, what is the name of the first one here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in d.leaks(df, table).collect()}
    assert found <= {(10_001, 3), (10_002, 0), (10_003, 4)} and {(10_001, 3), (10_003, 4)} <= found
    assert d.clean(df, table).count() >= len(docs)


def test_broadcasts_name_no_class_of_the_library(spark, monkeypatch):
    import pickle

    from pyspark import SparkContext

    from echolake.llm import language
    from echolake.llm.queries import piece_model

    sent, whole = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or whole(self, value))
    df = spark.createDataFrame([(i, f"some words about number {i} and nothing else here") for i in range(60)], "doc_id long, text string")
    d.leaks(df, spark.createDataFrame([(1, "words about number seven and nothing else at all")], "item_id long, text string")).collect()
    from pyspark.sql import functions as F

    language.scores(df, F.col("doc_id") % 2 == 0, piece_model()).collect()
    assert len(sent) >= 2 and not any(b"echolake" in s for s in sent)


def test_space_does_not_depend_on_a_draw_of_documents(spark):
    rng = random.Random(5)
    vocabulary = ["u" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = spark.createDataFrame([(i, text(40)) for i in range(150)], "item_id long, text string")
    items = {r.item_id: r.text for r in bench.collect()}
    rows = [(i, f"{text(60)} {items[i]} {text(60)}" if i < 20 else text(120)) for i in range(900)]
    found = []
    for shift in (0, 10_000):
        docs = spark.createDataFrame([(i + shift, t) for i, t in rows], "doc_id long, text string")
        found.append({(r.doc_id - shift, r.item_id): r.cosine for r in d.leaks(docs, bench).collect()})
    assert found[0].keys() == found[1].keys() == {(i, i) for i in range(20)}
    assert all(abs(found[0][k] - found[1][k]) < 1e-3 for k in found[0])
