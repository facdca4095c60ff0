"""Recordings and interval files on disk."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake.sources import wav, zerocross


def riff(pcm, bits=16, channels=1, tag=1, rate=192_000, head=b"RIFF", size=None, before=b"", after=b""):
    frame = channels * bits // 8
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, tag, channels, rate, rate * frame, frame, bits)
    data = b"data" + struct.pack("<I", len(pcm) if size is None else size) + pcm + (b"\0" if len(pcm) & 1 else b"")
    body = b"WAVE" + before + fmt + data + after
    return head + struct.pack("<I", min(len(body), 0xFFFFFFFF)) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("wav")
    x = (np.sin(np.arange(1000) / 7) * 12_000).astype(int)
    i16 = x.astype("<i2").tobytes()
    i24 = b"".join(int(v * 256).to_bytes(3, "little", signed=True) for v in x)
    guano = b"guan" + struct.pack("<I", 11) + b"Make: Maker" + b"\0"
    cue = b"cue " + struct.pack("<II", 4 + 48, 2) + struct.pack("<II4sIII", 1, 0, b"data", 0, 0, 100) + struct.pack("<II4sIII", 2, 0, b"data", 0, 0, 700)
    labl = b"labl" + struct.pack("<II", 9, 1) + b"call\0" + b"\0"
    lst = b"LIST" + struct.pack("<I", 4 + len(labl)) + b"adtl" + labl
    ds64 = b"ds64" + struct.pack("<IQQQ", 28, 0, len(i16), 1000) + b"\0" * 4
    files = {
        "a16": riff(i16), "b24": riff(i24, 24), "c32": riff((x * 65536).astype("<i4").tobytes(), 32), "dflt": riff((x / 32768).astype("<f4").tobytes(), 32, tag=3),
        "estereo": riff(np.repeat(x, 2).astype("<i2").tobytes(), channels=2), "frf64": riff(i16, head=b"RF64", size=0xFFFFFFFF, before=ds64),
        "gunknown": riff(i16, size=0xFFFFFFFF), "hguano": riff(i16, after=guano + cue + lst), "iodd": riff(i16, before=b"junk" + struct.pack("<I", 3) + b"abc\0"),
        "jbad": b"RIFFxxxxNOPE", "kcut": riff(i16)[:20], "ltag": riff(i16, tag=85),
    }
    for name, raw in files.items():
        (root / f"{name}.wav").write_bytes(raw)
    return str(root), x / 32768.0


def test_headers_and_samples_by_range(spark, folder):
    path, x = folder
    recs = wav.scan_headers(wav.list_files(spark, path), 4).withColumn("name", F.regexp_extract("path", r"(\w+)\.wav$", 1)).cache()
    rows = {r.name: r for r in recs.collect()}
    assert {n for n, r in rows.items() if r.error} == {"jbad", "kcut", "ltag"}
    for name in ("a16", "b24", "c32", "dflt", "estereo", "frf64", "gunknown", "hguano", "iodd"):
        assert rows[name].total_frames == 1000, name
    assert rows["hguano"].guano == "Make: Maker" and rows["dflt"].is_float and rows["estereo"].channels == 2
    chunks = wav.read_chunks(recs, 96, 8).join(recs.select("recording_id", "name"), "recording_id")
    got = chunks.select("name", "channel", "start_sample", F.posexplode("samples").alias("p", "y")).toPandas()
    assert set(got["name"]) == {n for n, r in rows.items() if not r.error}
    for _, g in got.groupby(["name", "channel"]):
        y = g.assign(i=g.start_sample + g.p).sort_values("i")["y"].to_numpy()
        np.testing.assert_allclose(y, x, atol=1e-6)
    marks = wav.markers(recs.where("name = 'hguano'")).orderBy("cue_id").collect()
    assert [(m.cue_id, m.position, m.label, m.note) for m in marks] == [(1, 100, "call", None), (2, 700, None, None)]


def test_file_bytes_round_trip(spark):
    x = np.array([0.0, 0.5, -0.5, 0.25])
    raw = wav.wav_bytes(x, 48_000, "Note: x")
    head = wav.read_header(lambda at, n: raw[at:at + n], len(raw))
    assert head[:7] == (48_000, 1, 16, False, 44, 8, 4) and head[7] == "Note: x"
    np.testing.assert_allclose(wav.decode(raw[44:52], 16, False), x)


def test_interval_codes(spark):
    data = bytes([0x80, 50, 16, 16, 0xE1, 2, 0x7F, 0xA0, 1, 0, 0xC0, 0, 1, 1, 0x40])
    ticks, off = zerocross.intervals(data)
    assert ticks == [50, 66, 82, 81, 256, 257, 193]
    assert off == [False, False, False, True, True, False, False]
    head = bytearray(300)
    head[0:2], head[3], head[281:286] = struct.pack("<H", 281), 129, struct.pack("<HHB", 300, 25_000, 8)
    rows = spark.createDataFrame([("good", bytes(head) + data), ("bad", b"x" * 10)], "path string, content binary")
    got = zerocross.interval_rows(rows).toPandas()
    assert list(got[got.path == "good"].sort_values("idx").ticks) == ticks
    assert got[got.path == "bad"].error.notna().all()


def test_interval_header_fields(spark):
    block = b"GUANO|Version: 1.0\r\nNote: a: b\nnothing\n : \n\0\0"
    raw = bytearray(0x150 + len(block))
    raw[0:2], raw[3] = struct.pack("<H", 0x119), 132
    raw[0x119:0x11F] = struct.pack("<HHBB", len(raw), 25_000, 8, 17)
    raw[0x006:0x00E], raw[0x016:0x01C], raw[0x03E:0x042] = b"T1\0ape12", b" Pond\t", b"Myo\xff"
    raw[0x120:0x12A] = struct.pack("<HBBBBBBH", 2021, 2, 31, 25, 61, 7, 250, 65_535)
    raw[0x12A:0x130], raw[0x130:0x138], raw[0x150:] = b"ID0001", b"WGS84 12", block
    odd_date, not_text, old = bytearray(raw), bytearray(raw), bytearray(raw)
    odd_date[0x122], not_text[0x151], old[3] = 13, 0xFF, 131
    short = bytearray(raw[:0x13F])
    short[0x119:0x11B] = struct.pack("<H", 0x13F)
    rows = [(n, bytes(b)) for n, b in (("full", raw), ("odd_date", odd_date), ("not_text", not_text), ("old", old), ("short", short), ("bad", b"x"))]
    got = {r.path: r for r in zerocross.header_rows(spark.createDataFrame(rows, "path string, content binary")).collect()}
    full = got["full"]
    assert (full.tape, full.location, full.species, full.sensitivity, full.file_type, full.clock, full.ratio) == ("T1", "Pond?", "Myo?", 17, 132, 25_000, 8)
    assert (full.recorded, full.recorded_micros, full.id_code, full.position) == ("2021-02-31 25:61:07", 2_565_535, "ID0001", "WGS84 12")
    assert [(m.key, m.value) for m in full.metadata] == [("GUANO|Version", "1.0"), ("Note", "a: b"), ("", "")]
    assert got["odd_date"].recorded is None and got["odd_date"].recorded_micros is None and got["odd_date"].id_code == "ID0001"
    assert got["not_text"].metadata == []
    assert got["old"].metadata is None and got["old"].position is None and got["old"].tape == "T1"
    assert got["short"].recorded is None and got["short"].error is None
    assert got["bad"].error and got["bad"].tape is None
