"""Shards against the public library and plain lists."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from echolake.llm import wavelet

FOLDER = "/root/testdata/sf0.01"


def model():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(model())
    t.encode_special_tokens = True
    return t


def test_query(spark):
    tok = library()
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in entry.queries()["op11_wavelet"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    at = 0
    for (i, _), e in zip(rows, tok.encode_batch([t for _, t in rows], add_special_tokens=False)):
        ids = np.asarray([*e.ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), i
        at += len(ids)


@pytest.mark.parametrize("text", [
    "", " ", "   ", "a", " a", "a ", "  a  b ", "a\n b", "a \n b", "a\t\t b  c", "don't  we'll 's", "x　 y  z", "<|endoftext|> <|endoftext|>a", "a\x1c b \x85 c",
    "é è  ü\r\n\r\n  1 23  4", " été eté naïve's Straße ÷×a a÷ ŷ aŷ ŷa xé1 x# y' \xaa aª Œuvre éª","한글 ภา \U0001f600 \U0001f600", "a" * 5_000 + " " * 3_000 + "b",
])
def test_cutting_before_spaces_changes_no_id(text):
    got, lengths = wavelet.encoder(model()).encode(pa.array([text, "x " + text, "a  b"]), 2)
    assert lengths.sum() == len(got) and got[: lengths[0]].tolist() == [*library().encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("n,bits,block", [(0, 4, 64), (1, 1, 64), (63, 3, 64), (64, 5, 64), (65, 5, 64), (1_000, 9, 128), (5_000, 16, 1 << 17), (3_000, 20, 512)])
def test_one_file_against_a_list(n, bits, block):
    rng = random.Random(n)
    ids = [min(int(rng.expovariate(0.1)), (1 << bits) - 1) for _ in range(n)]
    shard = wavelet.Shard(wavelet.pack(np.asarray(ids, np.uint32), bits, pa.table({"doc_id": [7], "n_tokens": [n]}), block))
    assert shard.tokens().tolist() == ids and shard.documents().to_pylist() == [{"doc_id": 7, "n_tokens": n}]
    some = [rng.randrange(n) for _ in range(50)] if n else []
    assert shard.tokens(some).tolist() == [ids[i] for i in some]
    for token in [*sorted(set(ids))[:12], (1 << bits) - 1, 1 << bits]:
        where = [i for i, x in enumerate(ids) if x == token]
        assert shard.count(token) == len(where)
        assert [shard.locate(token, k) for k in range(len(where))] == where
        a, b = sorted([rng.randrange(n + 1), rng.randrange(n + 1)])
        assert shard.count(token, a, b) == ids[a:b].count(token)


def test_lookups_touch_few_blocks():
    ids = np.asarray([i % 50_000 for i in range(400_000)], np.uint32)
    shard = wavelet.Shard(wavelet.pack(ids, 16, pa.table({"doc_id": [0], "n_tokens": [len(ids)]}), 1 << 14))
    assert shard.tokens([123_456]).tolist() == [23_456]
    assert sum(len(p.held) for p in shard.planes) == 16


def test_cut_files_are_refused():
    data = wavelet.pack(np.arange(10, dtype=np.uint32), 4, pa.table({"doc_id": [0], "n_tokens": [10]}))
    with pytest.raises(ValueError):
        wavelet.Shard(data[:-1])


def test_nulls_repeats_small_shards_and_lookups_over_shards(spark):
    rows = [(3, "b b b", 1), (None, "x", 2), (1, None, 3), (3, "b b b", 4), (2, "", 5), (3, "a" * 3_000, 6), (None, None, 7)] + [(10 + i, "word " * (i % 7), 8) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    index = wavelet.write(df, model(), 2, shard_bytes=80).cache()
    got = wavelet.read(index, ids=True).collect()
    assert len(got) == len(rows) and index.count() > 3
    tok = library()
    want = sorted([(-1 if i is None else i, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == want
    in_order = sorted(got, key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in in_order] == [i for i, _ in want]
    at = 0
    for r in in_order:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        at += r.n_tokens
    flat = [t for r in in_order for t in r.ids]
    token = flat[20]
    assert {r.token: r.n for r in wavelet.count_tokens(index, [2, token, 50_000]).collect()} == {2: flat.count(2), token: flat.count(token), 50_000: flat.count(50_000)}
    found = wavelet.find(index, token).collect()
    assert sorted(r.global_position for r in found) == [i for i, t in enumerate(flat) if t == token]
    starts = {r.start: r.doc_id for r in in_order}
    assert all(starts[r.global_position - r.position] == r.doc_id for r in found)


def test_text_ids_and_an_empty_table(spark):
    df = spark.createDataFrame([("b", "y"), ("a", "x")], "doc_id string, text string")
    got = wavelet.read(wavelet.write(df, model(), 2), T.StringType()).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [("a", 0, 2), ("b", 2, 2)]
    assert wavelet.read(wavelet.write(df.limit(0), model(), 2), T.StringType()).count() == 0
