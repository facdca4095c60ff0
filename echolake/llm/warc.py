"""WARC archives, index first.

Each task writes its records into archive files of its own in the shared folder, one gzip member per record, and returns an index
row per record: file, offset, length, URL, digest, type. The index is what selections work on. Reading sorts the selected rows by
file and offset, joins ranges that lie close into one read, and gives back payloads after checking their digests. A payload is
stored once, in the record of the largest key; the others are revisits that refer to it.

A file carries a name that no other attempt uses, and only index rows of attempts that ended well are kept, so a lost executor
leaves at most unused files. Null payloads and URLs are empty; a revisit's payload is its response's. Rows of equal key and payload
are all responses or all revisits.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolake.session import scratch_path

from .common import stored

#: An archive file is closed at this size; ranges that lie no further apart are read together, up to the largest read.
FILE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 16 << 20

INDEX = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("url", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open_folder(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, inner


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path


def record(kind: str, url: str, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} {url} {sha} {refers_to}")
    block = b"" if kind == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Record-ID: <urn:uuid:{name}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Key: {refers_to}",
                 f"WARC-Payload-Bytes: {len(payload)}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _one_line(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else url


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives and return their index. Payloads under `least` bytes are always responses."""
    spark = pages.sparkSession
    folder = _uri(folder or scratch_path(spark, "warc"))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("key", "url", "payload", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    tops = rows.groupBy("sha").agg(F.max("key").alias("top"))  # partial sums first: copies of a payload meet as one row per task
    joined = rows.join(tops, "sha")
    kind = F.when((F.col("size") < least) | F.col("key").eqNullSafe(F.col("top")), "response").otherwise("revisit")
    ready = joined.select("key", "url", "payload", "sha", kind.alias("kind"), "top")

    def save(batches):
        out, at, name, fs = None, 0, None, None
        for batch in batches:
            made = []
            for k, u, p, sha, kind_, top in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs, inner = _open_folder(folder)
                    fs.create_dir(inner, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at = fs.open_output_stream(f"{inner}/{name}", compression=None), 0
                refers = top if kind_ == "revisit" else None
                sha32 = base64.b32encode(bytes.fromhex(sha)).decode()
                member = record(kind_, u, p, sha32, refers)
                out.write(member)
                made.append((k, u, f"{folder}/{name}", at, len(member), len(p), sha32, kind_, refers))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _TYPES)], names=INDEX.names)
        if out is not None:
            out.close()

    return stored(ready.mapInArrow(save, INDEX), "warc-index")


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """(start, end, number of ranges) of the reads that cover sorted (offset, length) ranges; one range is never cut."""
    out: list[list[int]] = []
    for a, n in ranges:
        if out and a - out[-1][1] <= gap and max(a + n, out[-1][1]) - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], a + n)
            out[-1][2] += 1
        else:
            out.append([a, a + n, 1])
    return [tuple(x) for x in out]


READ = T.StructType([T.StructField("key", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
                     T.StructField("refers_to", T.LongType()), T.StructField("payload_digest", T.StringType()),
                     T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("fits", T.BooleanType())])


def read(index: DataFrame, slices: int = 1 << 24) -> DataFrame:
    """The records of some index rows: what their headers and blocks say, and whether the block has the digest of the index.

    Rows are dealt out by file and stretch of `slices` bytes, so one large archive is read by many tasks.
    """
    chosen = index.select("key", "file", "offset", "length", "payload_digest")
    dealt = chosen.withColumn("stretch", F.floor(F.col("offset") / slices)).repartition("file", "stretch").sortWithinPartitions("file", "offset")

    def load(batches):
        opened, name = None, None
        for batch in batches:
            keys, files, offsets, lengths, shas = (batch.column(c).to_pylist() for c in ("key", "file", "offset", "length", "payload_digest"))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and files[end] == files[at]:
                    end += 1
                if files[at] != name:
                    fs, inner = _open_folder(files[at])
                    opened, name = fs.open_input_file(inner), files[at]
                for start, stop, n in coalesce(list(zip(offsets[at:end], lengths[at:end]))):
                    opened.seek(start)
                    data, made = io.BytesIO(opened.read(stop - start)).getbuffer(), []
                    for i in range(at, at + n):
                        headers, block = parse(bytes(data[offsets[i] - start : offsets[i] - start + lengths[i]]))
                        kind, sha = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        refers = int(headers["WARC-Refers-To-Key"]) if kind == "revisit" and headers["WARC-Refers-To-Key"] != "None" else None
                        size = int(headers["WARC-Payload-Bytes"]) if kind == "revisit" else len(block)
                        fits = sha == shas[i] and (kind == "revisit" or digest(block) == sha)
                        made.append((keys[i], headers["WARC-Target-URI"], kind, refers, sha, size, None if kind == "revisit" else block, fits))
                    at += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _READ_TYPES)], names=READ.names)

    return dealt.drop("stretch").mapInArrow(load, READ)


_READ_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
