"""PCM recordings from WAV and RF64 files.

Files are listed without reading them, headers are walked with small range reads, and samples are read by byte range,
one chunk per row, so a file of any size is spread over many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.plans.chunking import DEFAULT_CHUNK

HEADER_TYPE = (
    "struct<sample_rate:int,channels:int,bits_per_sample:int,is_float:boolean,data_offset:bigint,data_size:bigint,total_frames:bigint,"
    "guano:string,cues:array<struct<cue_id:bigint,position:bigint>>,labels:array<struct<cue_id:bigint,text:string>>,"
    "notes:array<struct<cue_id:bigint,text:string>>,error:string>"
)
_FIELDS = ["sample_rate", "channels", "bits_per_sample", "is_float", "data_offset", "data_size", "total_frames", "guano", "cues", "labels", "notes", "error"]


def _texts(body: bytes) -> tuple[list, list]:
    """Labels and notes of an associated-data list, as (cue id, text)."""
    found, pos = {b"labl": [], b"note": []}, 0
    while pos + 8 <= len(body):
        kind, size = body[pos:pos + 4], struct.unpack_from("<I", body, pos + 4)[0]
        item = body[pos + 8:pos + 8 + size]
        if kind in found and len(item) >= 4:
            found[kind].append((struct.unpack_from("<I", item)[0], item[4:].decode("utf-8", "ignore").rstrip("\0")))
        pos += 8 + size + (size & 1)
    return found[b"labl"], found[b"note"]


def read_header(read: Callable[[int, int], bytes], size: int) -> tuple:
    """Walk the chunks of one file through ``read(offset, n)``; problems are returned in the error field."""
    head = read(0, 12)
    if len(head) < 12 or head[8:12] != b"WAVE" or head[:4] not in (b"RIFF", b"RF64"):
        return (None,) * 11 + ("not a RIFF/WAVE or RF64/WAVE file",)
    fmt = data = long_size = guano = None
    cues, labels, notes = [], [], []
    pos = 12
    while pos + 8 <= size:
        top = read(pos, 8)
        if len(top) < 8:
            break
        kind, length = top[:4], struct.unpack_from("<I", top, 4)[0]
        body, fits = pos + 8, pos + 8 + length <= size
        if kind == b"ds64":
            block = read(body, 24)
            long_size = struct.unpack_from("<Q", block, 8)[0] if len(block) == 24 else None
        elif kind == b"fmt ":
            if length < 16 or not fits:
                return (None,) * 11 + ("format chunk too small or truncated",)
            fmt = struct.unpack("<HHIIHH", read(body, 16))
        elif kind == b"data":
            real = long_size if head[:4] == b"RF64" and length == 0xFFFFFFFF else length
            data = (body, real)
            if length == 0xFFFFFFFF and real is not None and real != length and body + real <= size:
                length, fits = real, True
            if not fits:
                break
        elif fits and kind == b"guan":
            guano = read(body, length).decode("utf-8", "ignore").rstrip("\0")
        elif fits and kind == b"cue " and length >= 4:
            block = read(body, length)
            for i in range(struct.unpack_from("<I", block)[0]):
                at = 4 + 24 * i
                if at + 24 > len(block):
                    break
                cues.append((struct.unpack_from("<I", block, at)[0], struct.unpack_from("<I", block, at + 20)[0]))
        elif fits and kind == b"LIST" and length >= 4:
            block = read(body, length)
            if block[:4] == b"adtl":
                more_labels, more_notes = _texts(block[4:])
                labels += more_labels
                notes += more_notes
        pos = body + length + (length & 1)
    if fmt is None or data is None or data[1] is None:
        return (None,) * 11 + ("no format or data chunk",)
    tag, channels, rate, _, _, bits = fmt
    frame = channels * (bits // 8)
    if tag not in (1, 3) or frame == 0:
        return (None,) * 11 + (f"unsupported format tag {tag}" if frame else "zero bytes per frame",)
    if bits not in ((32,) if tag == 3 else (8, 16, 24, 32)):
        return (None,) * 11 + (f"unsupported sample width {bits}",)
    offset, length = data
    room = max(size - offset, 0)
    if length == 0xFFFFFFFF or (room > length + 1024 and room > 1_000_000):
        length = room // frame * frame
    return rate, channels, bits, tag == 3, offset, length, length // frame, guano, cues, labels, notes, None


def decode(raw: bytes, bits: int, is_float: bool) -> np.ndarray:
    """Interleaved samples in [-1, 1); other widths are a ValueError."""
    if is_float and bits == 32:
        return np.frombuffer(raw, "<f4").astype(np.float32)
    if not is_float and bits in (16, 32):
        return (np.frombuffer(raw, f"<i{bits // 8}") / 2.0 ** (bits - 1)).astype(np.float32)
    if not is_float and bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        whole = parts[:, 0] | (parts[:, 1] << 8) | (parts[:, 2] << 16)
        return (((whole ^ 0x800000) - 0x800000) / 2.0**23).astype(np.float32)
    if not is_float and bits == 8:
        return ((np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128).astype(np.float32)
    raise ValueError(f"unsupported sample width {bits}")


def _open(path: str):
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
    scheme, mark, rest = uri.partition("://")
    if not mark:
        return pafs.LocalFileSystem().open_input_file(uri)
    if scheme == "file":
        return pafs.LocalFileSystem().open_input_file(unquote("/" + rest.lstrip("/")))
    fs, inner = pafs.FileSystem.from_uri(f"{scheme}://{quote(unquote(rest), safe='/:@')}")
    return fs.open_input_file(inner)


def list_files(spark: SparkSession, path: str, pattern: str = "*.[wW][aA][vV]") -> DataFrame:
    """File names, sizes and times; the content column is pruned, so nothing is read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
        .select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"))
    )


def scan_headers(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Recording rows from file rows, by range reads of the chunk heads only.

    A bad file is a row with an `error`; errors of the storage fail the task, so that Spark tries it again.
    """

    def scan(paths: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = []
        for path, size in zip(paths, sizes):
            with _open(path) as f:
                def read(at, n, f=f):
                    f.seek(at)
                    return f.read(n)

                try:
                    rows.append(read_header(read, int(size)))
                except (ValueError, struct.error) as e:
                    rows.append((None,) * 11 + (str(e),))
        return pd.DataFrame(rows, columns=_FIELDS)

    spread = files.repartition(tasks, "path") if tasks else files.repartition("path")
    return _recordings(spread.withColumn("h", F.pandas_udf(scan, HEADER_TYPE)("path", "file_size")))


def headers_of_content(rows: DataFrame) -> DataFrame:
    """Recording rows from rows(path, content) that already hold small files."""

    def scan(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_header(lambda at, n, c=c: bytes(c[at:at + n]), len(c)) for c in contents], columns=_FIELDS)

    return _recordings(rows.withColumn("h", F.pandas_udf(scan, HEADER_TYPE)("content")).withColumn("file_size", F.octet_length("content")))


def _recordings(rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("h",)]
    return rows.select(*kept, "h.*").withColumn("recording_id", F.sha2("path", 256)).withColumn(
        "duration_secs", F.col("total_frames") / F.col("sample_rate")
    )


def markers(recordings: DataFrame) -> DataFrame:
    """Cue points with the first label and note of the same cue."""
    cues = recordings.select("recording_id", "labels", "notes", F.inline("cues"))

    def first(kind):
        return F.get(F.filter(kind, lambda x: x["cue_id"] == F.col("cue_id")), F.lit(0))["text"]

    return cues.select("recording_id", "cue_id", "position", first("labels").alias("label"), first("notes").alias("note"))


def chunk_plan(recordings: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """One row per chunk of frames with its byte range."""
    good = recordings.where("error IS NULL AND total_frames > 0")
    frame = F.col("channels") * (F.col("bits_per_sample") / 8).cast("int")
    last = F.floor((F.col("total_frames") - 1) / chunk)
    rows = good.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("chunk") * chunk
    return rows.withColumn("start_sample", start).withColumn("byte_at", F.col("data_offset") + start * frame).withColumn(
        "byte_n", F.least(F.lit(chunk), F.col("total_frames") - start) * frame
    )


CHUNK_TYPE = "array<array<float>>"


def _split(raw: bytes, bits: int, is_float: bool, channels: int) -> list:
    frame = channels * bits // 8
    whole = decode(raw[:len(raw) // frame * frame], bits, is_float).reshape(-1, channels)
    return list(np.ascontiguousarray(whole.T))


def _as_chunks(rows: DataFrame) -> DataFrame:
    return rows.select("recording_id", "chunk", "start_sample", F.posexplode("_c").alias("channel", "samples"))


def read_chunks(recordings: DataFrame, chunk: int = DEFAULT_CHUNK, tasks: int | None = None) -> DataFrame:
    """Chunk arrays per channel, each read by its own byte range; chunks of one file go to many tasks.

    A chunk that ends before the planned bytes has the whole frames there are and an `error`; one without bytes, or whose samples
    cannot be decoded, is one row without channel and samples and with an `error`. Errors of the storage fail the task, so that
    Spark tries it again.
    """

    def load(paths: pd.Series, at: pd.Series, n: pd.Series, bits: pd.Series, flt: pd.Series, channels: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(paths, at, n, bits, flt, channels):
            with _open(row[0]) as f:
                raw = b""
                if int(row[1]) < f.size():
                    f.seek(int(row[1]))
                    raw = f.read(int(row[2]))
            short = f"{len(raw)} of {int(row[2])} bytes" if len(raw) < int(row[2]) else None
            try:
                out.append((_split(raw, int(row[3]), bool(row[4]), int(row[5])) if raw else None, short))
            except ValueError as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["c", "error"])

    plan = chunk_plan(recordings, chunk)
    plan = plan.repartition(tasks, "recording_id", "chunk") if tasks else plan.repartition("recording_id", "chunk")
    kind = f"struct<c:{CHUNK_TYPE},error:string>"
    rows = plan.withColumn("_r", F.pandas_udf(load, kind)("path", "byte_at", "byte_n", "bits_per_sample", "is_float", "channels"))
    return rows.select("recording_id", "chunk", "start_sample", F.col("_r.error").alias("error"), F.posexplode_outer("_r.c").alias("channel", "samples")).select(
        "recording_id", "chunk", "start_sample", "channel", "samples", "error")


def chunks_of_content(recordings: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Chunk arrays from rows that hold small files."""

    def load(raw: pd.Series, bits: pd.Series, flt: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([_split(bytes(r), int(b), bool(x), int(c)) for r, b, x, c in zip(raw, bits, flt, channels)])

    plan = chunk_plan(recordings, chunk).withColumn("_b", F.substr("content", F.col("byte_at").cast("int") + 1, F.col("byte_n").cast("int")))
    return _as_chunks(plan.withColumn("_c", F.pandas_udf(load, CHUNK_TYPE)("_b", "bits_per_sample", "is_float", "channels")))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + (b"\0" if len(body) & 1 else b"")


def wav_bytes(samples: np.ndarray, rate: int, guano: str | None = None, marks: list[tuple[int, int, str]] | None = None, clip: bool = True) -> bytes:
    """A mono 16-bit file of samples in [-1, 1), with optional metadata text and (id, position, label) markers.

    Samples beyond full scale are clipped; with ``clip`` off, a file that holds any has 32-bit float samples in the same steps.
    """
    steps = np.round(np.asarray(samples, dtype=float) * 32768)
    if not clip and len(steps) and (steps.min() < -32768 or steps.max() > 32767):
        form, pcm = struct.pack("<HHIIHH", 3, 1, rate, rate * 4, 4, 32), (steps / 32768).astype("<f4").tobytes()
    else:
        form, pcm = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16), np.clip(steps, -32768, 32767).astype("<i2").tobytes()
    body = b"WAVE" + _chunk(b"fmt ", form) + _chunk(b"data", pcm)
    if guano:
        body += _chunk(b"guan", guano.encode())
    if marks:
        points = b"".join(struct.pack("<II4sIII", i, 0, b"data", 0, 0, at) for i, at, _ in marks)
        body += _chunk(b"cue ", struct.pack("<I", len(marks)) + points)
        body += _chunk(b"LIST", b"adtl" + b"".join(_chunk(b"labl", struct.pack("<I", i) + t.encode() + b"\0") for i, _, t in marks))
    return _chunk(b"RIFF", body)


def encode_wav(rows: DataFrame, rate: int, samples: str = "samples", guano: str | None = None, marks: str | None = None, clip: bool = True) -> DataFrame:
    """Add a ``content`` column holding each row's samples as a file (`wav_bytes`); ``marks`` names an array of (id, position, label)."""

    def run(x: pd.Series, text: pd.Series, points: pd.Series) -> pd.Series:
        def listed(p):
            return None if p is None else [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in p]

        return pd.Series([wav_bytes(np.asarray(a), rate, t, listed(p), clip) for a, t, p in zip(x, text, points)])

    text = F.col(guano) if guano else F.lit(None).cast("string")
    points = F.col(marks) if marks else F.lit(None).cast("array<struct<id:bigint,position:bigint,label:string>>")
    return rows.withColumn("content", F.pandas_udf(run, "binary")(F.col(samples), text, points))
