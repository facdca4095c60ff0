"""The piece encoder against the public library, its character map against a hand-made trie."""

import hashlib
import random
import struct

import pytest
import sentencepiece

import __spark_entry__ as entry
from echolake.llm import pieces
from echolake.llm.queries import _public, piece_model

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=_public("piece_bpe_32k.model"))


def test_ids_spans_and_round_trip(library):
    rng = random.Random(2)
    letters = " ab▁\t\n😀é<s></s>\0ñ中�  the"
    texts = ["", " ", "   ", "▁", "\n", "x" * 500, "the " * 100, "a" * 70 + " " * 90 + "b", "ab" * 20_000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    model = pieces.load(piece_model())
    for text, (ids, begins, ends), proto in zip(texts, model.encode_many(texts), library.encode(texts, return_type="proto")):
        assert ids.tolist() == library.encode(text)
        assert [(p.begin, p.end) for p in proto.pieces] == list(zip(begins.tolist(), ends.tolist()))
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())


def _trie(entries: dict[bytes, bytes]) -> bytes:
    """A double array for one-byte keys and two-byte keys that share no first byte, enough to exercise the reader."""
    units, texts = [0] * 2048, b""
    root = 256
    units[0] = root << 10
    for k, (key, value) in enumerate(sorted(entries.items())):
        at, node = len(texts), 0 ^ root
        texts += value + b"\0"
        base = 512 + 256 * k
        for depth, c in enumerate(key):
            slot = node ^ c
            last = depth == len(key) - 1
            units[slot] = c | (base ^ slot) << 10 | (last << 8)
            node = base
            base += 128
        units[node] = 0x80000000 | at
    blob = struct.pack("<2048I", *units)
    return struct.pack("<I", len(blob)) + blob + texts


def test_longest_prefix_of_the_map_keeps_offsets():
    model = pieces.PieceModel(piece_model())
    model.map, model.plain = pieces.CharacterMap(_trie({b"q": b"kw", "é".encode(): b"e"})), False
    assert model.map.longest(b"q", 0) == (b"kw", 1) and model.map.longest(b"z", 0) is None
    norm, align = model.normalise("éq b")
    assert norm == "▁ekw▁b"
    assert align == [0, 0, 0, 0, 2, 2, 3, 3, 3, 4, 5]
    ids, begins, ends = model.encode("éq b")
    assert model.decode(ids.tolist()) == "ekw b"
    assert begins[0] == 0 and ends[-1] == 5 and all(a <= b for a, b in zip(begins, ends))


def test_rejects_other_models():
    with pytest.raises(ValueError):
        pieces.PieceModel(b"")


def test_rows(spark, library):
    rows = [(1, None, "x"), (1, "", "y"), (None, "the  end\n", None), (3, "é▁" * 5, "z"), (3, "é▁" * 5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode(df, piece_model(), decoded=True).collect()
    assert sorted(r.ids for r in got) == sorted((library.encode(t or "") + [2]) for _, t, _ in rows)
    again = pieces.decode(pieces.encode(df, piece_model()), piece_model()).collect()
    assert sorted(r.decoded for r in again) == sorted(r.decoded for r in got)
    assert pieces.encode(df.limit(0), piece_model()).count() == 0


def test_query(spark, library):
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry.queries()["op1_pieces"](spark, FOLDER).collect()}
    assert got == want
