"""Archives: what is written is read back, and the standard library reads the same files."""

import base64
import glob
import gzip
import hashlib
import random

import __spark_entry__ as entry
from echolake.llm import warc

FOLDER = "/root/testdata/sf0.01"


def plain(rows):
    top = {}
    for k, _, h in rows:
        h = (h or "").encode()
        top[h] = k if top.get(h) is None else top[h] if k is None else max(k, top[h])
    out = []
    for k, _, h in rows:
        h = (h or "").encode()
        first = k == top[h]
        out.append((k, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first else "revisit", None if first else top[h]))
    return sorted(out, key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html").collect()]
    got = entry.queries()["op5_warc"](spark, FOLDER).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(rows)
    assert all(r.fits for r in got)


def test_rows_files_and_selections(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (7, "http://a/7", "same"), (7, "http://a/7", "same"), (3, None, None), (4, "u\nv", ""),
            (5, "http://é", "é" * 10_000), (None, "http://n", "only"), (None, "http://n", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as sha")
    index = warc.write(df, folder=str(tmp_path))
    got = warc.read(index).collect()
    assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(rows)
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {(h or "") for _, _, h in rows}
    whole = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    assert [bytes(r.payload).decode() for r in warc.read(index.where("key = 5")).collect()] == ["é" * 10_000]
    always = warc.write(df, folder=str(tmp_path / "b"), least=5).where("key = 1").collect()
    assert [r.record_type for r in always] == ["response"]
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_coalesced_reads():
    rng = random.Random(1)
    for _ in range(300):
        at, ranges = 0, []
        for _ in range(rng.randint(1, 20)):
            at += rng.choice([0, 5, 50])
            n = rng.randint(1, 40)
            ranges.append((at, n))
            at += n
        reads = warc.coalesce(ranges, gap=10, most=60)
        assert sum(n for _, _, n in reads) == len(ranges)
        k = 0
        for a, b, n in reads:
            part = ranges[k : k + n]
            assert a == part[0][0] and b == max(x + y for x, y in part) and (b - a <= 60 or n == 1)
            k += n
