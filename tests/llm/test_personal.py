"""Base spans against the plain patterns, the field's sums against enumeration, and spans that only the field finds."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

import __spark_entry__ as entry
from echolake.llm import personal

FOLDER = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1])))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) \
                    or kind == "card" and 13 <= len(digits) <= 19 and total % 10 == 0 or kind == "phone" and 9 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    for letters in ("ab.@-1%", "0123.5", "12 -4(+).", "é9@a.1+ \n"):
        for _ in range(4000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 45)))
            assert personal.written(personal.base_spans(text)) == plain(text), text


def test_long_texts_stay_linear():
    start = time.time()
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "+1 " + "( " * 150_000):
        personal.base_spans(text)
        personal.windows(text, 40)
    assert time.time() - start < 30


def test_field_by_enumeration():
    rng = np.random.default_rng(0)
    k = len(personal.KINDS)
    field = personal.Field(rng.normal(size=(k, personal.FEATURES)), rng.normal(size=(k + 1, k + 1)))
    segments = [(0, 1, [1, 2]), (0, 2, [3]), (1, 3, [4, 5]), (2, 3, [6]), (3, 4, [7])]

    def labellings(at):
        if at == 4:
            yield []
            return
        for rest in labellings(at + 1):
            yield [(at, at + 1, -1, None)] + rest
        for i, j, f in segments:
            if i == at:
                for y, rest in itertools.product(range(k), list(labellings(j))):
                    yield [(i, j, y, f)] + rest

    def value(path):
        total, last = 0.0, 0
        for _, _, y, f in path:
            total += field.moves[last, y + 1] + (field.weights[y, f].sum() if y >= 0 else 0)
            last = y + 1
        return total

    paths = list(labellings(0))
    best = max(paths, key=value)
    assert field.decode(4, segments) == [(i, j, y) for i, j, y, _ in best if y >= 0]
    p = np.exp([value(x) for x in paths])
    p /= p.sum()
    got = {}
    field.gradient(4, segments, {}, lambda f, g: got.__setitem__(None if f is None else tuple(f), g))
    for i, j, f in segments:
        want = [-sum(q for q, path in zip(p, paths) if (i, j, y, f) in path) for y in range(k)]
        assert np.allclose(got[tuple(f)], want)
    used = np.zeros_like(field.moves)
    for q, path in zip(p, paths):
        last = 0
        for _, _, y, _ in path:
            used[last, y + 1] -= q
            last = y + 1
    last = 0
    for _ in range(4):
        used[last, 0] += 1
    assert np.allclose(got[None], used)


def test_query_and_added_spans(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = entry.queries()["op8_personal"](spark, FOLDER).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == {i: hashlib.sha256(plain(t).encode()).hexdigest() for i, t in docs.items()}
    for r in got:
        base = [x for x in plain(docs[r.doc_id]).split(",") if x]
        assert set(base) <= set(r.spans.split(","))
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in r.spans.split(",") if x])


@pytest.fixture(scope="module")
def field(spark):
    return personal.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text"))


def test_rows(spark, field):
    rows = [(1, None, 0, "x"), (1, "", 0, None), (None, "no marks here", 3, "y"), (4, "call 415-555-0199 now", 5, "z"),
            (4, "call 415-555-0199 now", 5, "z"), (5, "at a@b.co and 10.0.0.1", 9, "w"), (6, "7" * 50_000, 1, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = personal.find(df, field).collect()
    assert sorted(r.spans for r in got) == sorted(["", "", "", "phone:5:17", "phone:5:17", "email:3:9,ip:14:22", ""])
    kept = personal.mask(df, field)
    assert kept.columns == df.columns
    assert [(r.text, r.n_chars) for r in kept.where("doc_id = 5").collect()] == [("at <EMAIL> and <IP>", 19)]
    assert [r.text for r in kept.where("doc_id = 4").collect()] == ["call <PHONE> now"] * 2
    assert kept.where("text is null").count() == 1
    assert personal.find(df.limit(0), None).count() == 0 and personal.train(df.limit(0)) is None


def test_digits_that_are_not_ascii_are_plain_characters(spark):
    texts = ["1234567890123²", "4111 1111 1111 111²", "①234567890123", "１２３４ 5678 ９０１２ 3456", "+49 ²²² ³³³ 1234", "call ٠١٢٣٤٥٦٧٨٩٠١٢ now", "10.0.0.²", "4111 1111 1111 1111"]
    df = spark.createDataFrame([(i, t, f"m{i}") for i, t in enumerate(texts)], "doc_id long, text string, masked_ string")
    docs = spark.createDataFrame([(i, f"mail a{i}@b.example or call +1 555 010 {i:04d} today") for i in range(40)], "doc_id long, text string")
    field = personal.train(docs)
    got = {r.doc_id: r for r in personal.find(df, field).collect()}
    assert [got[i].n_card for i in range(8)][-1] == 1 and got[0].n_card <= 1 and len(got) == 8
    kept = {r.doc_id: r for r in personal.mask(df, field).collect()}
    assert len(kept) == 8 and kept[3].masked_ == "m3" and "4111" not in kept[7].text


def test_query_counts_base_spans_only(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = entry.queries()["op8_personal"](spark, FOLDER).collect()
    assert any(r.spans != plain(docs[r.doc_id]) for r in got)  # spans are added to some
    for r in got:
        kinds = [x.split(":")[0] for x in plain(docs[r.doc_id]).split(",") if x]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in PATTERNS]


def test_learns_from_windows_beyond_the_start(spark, monkeypatch):
    """A form that no window of the start holds is learnt all the same."""
    rows = [(i, f"call (555) 010-{i:04d} now") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(personal, "PART", 15)
    s = personal.Settings(windows=2)
    first = personal.train(df, s)
    again = personal.train(df.repartition(3), s)
    assert np.allclose(first.weights, again.weights) and np.allclose(first.moves, again.moves)
    found = df.select("text").collect()
    few = personal.fit(sorted(r.text for r in found)[:2], s)
    assert np.count_nonzero(first.weights) > 0 and not np.allclose(first.weights, few.weights, atol=1e-3)
