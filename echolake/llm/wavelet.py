"""Token ids in succinct files: one wavelet matrix per shard.

Rows are dealt out by range of id, so that shards follow each other in id order; the task of a range encodes its texts and
writes a shard file for every `SHARD_BYTES` of text at most (a longer text has one of its own). A file has one bit-plane per bit of an id, from the high end. A plane holds that bit of all ids, in
an order in which each plane is stably sorted by the bits before it (zeros first). Planes are cut in blocks, packed one by one, with the number
of ones before each block; rank and select unpack only the blocks they touch. From one file this gives the id at a position, the number of
occurrences of an id before a position, and the position of the k-th occurrence, in one step per plane. The ids of the documents and their lengths
are in the same file; the footer, read first, tells where everything lies.

Files are written under names no other attempt uses and count only by the index row of an attempt that ended well. The index has a
row per shard; the ids before a shard are a two-level prefix sum over it.

Null texts are empty and give the end id alone; long texts are encoded whole. Rows of equal id follow each other by a hash of the text; rows
without id come first. Repeated rows are kept. Any type of id that can be ordered is taken. An empty table gives no shard. Strings of special tokens
within a text are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolake.plans.chunking import carry_in
from echolake.session import scratch_path

from .common import slices, stored, worker_cache

MAGIC = b"WAVELET1"
SHARD_BYTES = 12 << 20
BLOCK_BITS = 1 << 17
#: Text that one range holds about.
RANGE_BYTES = 16 << 20
#: Spaced words whose ids a worker keeps (about 200 bytes each); tasks that read shards at most.
CACHED = 1_000_000
MOST_TASKS = 10_000


#: Fixed rule: byte-level models spell a byte as its own character where that can be seen, else by the next character from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SEEN)}
_SPACE = _BYTES[32]
_SPELT = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Encoder:
    """Ids by the public library, which encodes each distinct spaced word of a shard once, if the worker does not know it.

    Its splitting rules never join a character that is not white space with a space after it, so a text may be cut before such spaces. A full
    memory keeps the words that came first, which the frequent ones are among, and starts anew when it has missed too often.
    """

    _odd = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
    _edge = re.compile(r"(?<=\S)(?= )")
    _word = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\x00-@\[-`{-\x7f]|\Z)")

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.encode_special_tokens = True
        self.known: dict[str, bytes] = {}  # by spaced word, without its space
        self.missed = 0

    def bits(self, end: int) -> int:
        return max(self.library.get_vocab_size() - 1, end, 1).bit_length()

    def _library(self, pieces: list[str]) -> list[bytes]:
        """Ids of texts. A spaced word of Latin letters, up to the end or a character that is no letter, is one unit of the splitting rules and goes to
        the merges alone; what follows it is another text."""
        merge = self.library.model.tokenize
        words, tails = [], []
        for p in pieces:
            word = self._word.match(p)
            end = word.end() if word else 0
            words.append(p[1:end])
            tails.append(p[end:])
        known = {w: array("I", [t.id for t in merge((_SPACE + w).translate(_SPELT))]).tobytes() for w in set(words) - {""}}
        texts = list(set(tails) - {""})
        got = dict(zip(texts, (array("I", e.ids).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False))))
        known[""] = got[""] = b""
        return [known[w] + got[t] for w, t in zip(words, tails)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        if self.missed > 20 * CACHED:
            self.known, self.missed = {}, 0
        found = [*map(self.known.get, words)]
        gaps = [i for i, ids in enumerate(found) if ids is None]
        made = self._library([" " + words[i] for i in gaps])
        for i, ids in zip(gaps, made):
            found[i] = ids
        if len(self.known) < CACHED:
            self.known.update(zip([words[i] for i in gaps], made))
        else:
            self.missed += len(made)
        return found

    def cut(self, texts: pa.Array) -> pa.Array:
        """Each text up to its first cut, then its pieces without the space they begin with."""
        lists = pc.split_pattern(texts, " ")
        odd = np.flatnonzero(pc.match_substring_regex(texts, self._odd).to_numpy(zero_copy_only=False))
        if not len(odd):
            return lists
        other = pa.array([[h, *(p[1:] for p in rest)] for h, *rest in (self._edge.split(texts[i].as_py()) for i in odd)], lists.type)
        place = np.arange(len(texts))
        place[odd] = len(texts) + np.arange(len(odd))
        return pa.concat_arrays([lists, other]).take(pa.array(place))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with `end` behind it, and how many each has."""
        lists = self.cut(texts)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        heads = np.cumsum(sizes) - sizes
        spaced, first = flat.dictionary_encode(), flat.take(pa.array(heads)).dictionary_encode()
        units = self._spaced(spaced.dictionary.to_pylist())
        code = spaced.indices.to_numpy().copy()
        code[heads] = first.indices.to_numpy() + len(units)
        units += self._library(first.dictionary.to_pylist())
        code = np.insert(code, heads + sizes, len(units))
        units.append(array("I", [end]).tobytes())
        length = np.fromiter(map(len, units), np.int64, len(units)) // 4
        begin = np.cumsum(length) - length
        pool, taken = np.frombuffer(b"".join(units), np.uint32), length[code]
        at = np.arange(taken.sum()) + np.repeat(begin[code] - (np.cumsum(taken) - taken), taken)
        starts = heads + np.arange(len(heads))
        return pool[at], np.add.reduceat(taken, starts) if len(starts) else np.zeros(0, np.int64)


def encoder(model: str) -> Encoder:
    cache = worker_cache("encoders")
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in cache:
        cache[key] = Encoder(model)
    return cache[key]


def pack(ids: np.ndarray, bits: int, docs: pa.Table, block_bits: int = BLOCK_BITS) -> bytes:
    """A shard file from the ids of its documents."""
    codec = pa.Codec("zstd", compression_level=3)
    out, at = [MAGIC], len(MAGIC)

    def put(data: bytes) -> list[int]:
        nonlocal at
        packed = codec.compress(data, asbytes=True)
        where = [at, len(packed), len(data)]
        out.append(packed)
        at += len(packed)
        return where

    now, planes = ids.astype(np.uint32 if bits > 16 else np.uint16), []
    for shift in range(bits - 1, -1, -1):
        bit = (now >> shift) & 1 == 1
        data = np.packbits(bit, bitorder="little")
        step = block_bits // 8
        ones = np.add.reduceat(np.bitwise_count(data), np.arange(0, len(data), step), dtype=np.int64) if len(data) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(ones)])
        planes.append({"ones": before.tolist(), "blocks": [put(data[i : i + step].tobytes()) for i in range(0, len(data), step)]})
        now = np.concatenate([now[~bit], now[bit]])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as stream:
        stream.write_table(docs)
    foot = json.dumps({"n": len(ids), "block_bits": block_bits, "planes": planes, "docs": put(sink.getvalue().to_pybytes())}).encode()
    foot = codec.compress(foot, asbytes=True) + struct.pack("<Q", len(foot))
    return b"".join([*out, foot, struct.pack("<Q", len(foot)), MAGIC])


class _Plane:
    """One bit-plane, unpacked block by block."""

    def __init__(self, shard: Shard, spec: dict):
        self.shard, self.spec = shard, spec
        self.ones = np.asarray(spec["ones"], np.int64)
        self.zeros = shard.n - int(self.ones[-1])
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of a block and the ones before each."""
        if i not in self.held:
            data = self.shard.section(self.spec["blocks"][i])
            words = np.frombuffer(data + bytes(-len(data) % 8), "<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.held[i] = words, before
        return self.held[i]

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at positions, and the ones before them; a position may be the end."""
        bit, rank = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        number = np.minimum(at // self.shard.block_bits, max(len(self.spec["blocks"]) - 1, 0))
        for i in np.unique(number) if len(self.spec["blocks"]) else []:
            own = np.flatnonzero(number == i)
            words, before = self.block(int(i))
            rest = at[own] - int(i) * self.shard.block_bits
            word, low = np.minimum(rest >> 6, len(words) - 1), rest - (np.minimum(rest >> 6, len(words) - 1) << 6)
            value = words[word]
            below = np.where(low >= 64, value, value & ((np.uint64(1) << np.minimum(low, 63).astype(np.uint64)) - np.uint64(1)))
            rank[own] = self.ones[i] + before[word] + np.bitwise_count(below)
            bit[own] = (value >> np.minimum(low, 63).astype(np.uint64)) & np.uint64(1) == 1
        return bit, rank

    def select(self, one: bool, k: int) -> int:
        """Position of the k-th one or zero, from 0."""
        size = self.shard.block_bits
        before = self.ones if one else np.minimum(np.arange(len(self.ones)) * size, self.shard.n) - self.ones
        i = int(np.searchsorted(before, k, side="right")) - 1
        words, ones = self.block(i)
        within = ones if one else np.arange(len(ones)) * 64 - ones
        left = k - int(before[i])
        w = int(np.searchsorted(within, left, side="right")) - 1
        bits = np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little") == one
        return i * size + w * 64 + int(np.flatnonzero(bits)[left - int(within[w])])


class Shard:
    """A shard file, read by section."""

    def __init__(self, file):
        """`file`: bytes, or an open file with seek and read."""
        self.file = pa.BufferReader(file) if isinstance(file, bytes) else file
        self.codec = pa.Codec("zstd")
        size = self.file.size() if hasattr(self.file, "size") else self.file.seek(0, 2)
        tail = len(MAGIC) + 8
        self.file.seek(size - tail)
        length, magic = struct.unpack(f"<Q{len(MAGIC)}s", self.file.read(tail))
        if magic != MAGIC:
            raise ValueError("not a shard file, or one that was cut")
        self.file.seek(size - tail - length)
        foot = self.file.read(length)
        foot = json.loads(self.codec.decompress(foot[:-8], decompressed_size=struct.unpack("<Q", foot[-8:])[0], asbytes=True))
        self.n, self.block_bits = foot["n"], foot["block_bits"]
        self.planes = [_Plane(self, p) for p in foot["planes"]]
        self._docs = foot["docs"]

    def section(self, where: list[int]) -> bytes:
        at, length, size = where
        self.file.seek(at)
        return self.codec.decompress(self.file.read(length), decompressed_size=size, asbytes=True) if size else b""

    def documents(self) -> pa.Table:
        """`doc_id` and `n_tokens` in order."""
        return pa.ipc.open_stream(self.section(self._docs)).read_all()

    def tokens(self, at: Iterable[int] | None = None) -> np.ndarray:
        """The ids at some positions, or all."""
        if at is None:
            return self._all()
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for plane in self.planes:
            bit, rank = plane.look(at)
            out = out << np.uint32(1) | bit
            at = np.where(bit, plane.zeros + rank, at - rank)
        return out

    def _all(self) -> np.ndarray:
        """All ids: from the last plane back, each plane's stable sort is undone."""
        out = np.zeros(self.n, np.uint32)
        for i, plane in enumerate(reversed(self.planes)):
            data = b"".join(self.section(b) for b in plane.spec["blocks"])
            bit = np.unpackbits(np.frombuffer(data, np.uint8), count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, np.uint32)
            back[~bit] = out[: plane.zeros]
            back[bit] = out[plane.zeros :] | np.uint32(1 << i)
            out = back
        return out

    def _down(self, token: int, at: np.ndarray) -> tuple[np.ndarray, list[tuple[bool, int]]]:
        path, bits = [], len(self.planes)
        for i, plane in enumerate(self.planes):
            one = bool(token >> (bits - 1 - i) & 1)
            _, rank = plane.look(at)
            at = plane.zeros + rank if one else at - rank
            path.append((one, i))
        return at, path

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in [start, stop)."""
        if token < 0 or token >> len(self.planes) or not self.n:
            return 0
        start, stop, _ = slice(start, stop).indices(self.n)
        (a, b), _ = self._down(token, np.asarray([start, max(start, stop)]))
        return int(b - a)

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of an id, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        (a,), path = self._down(token, np.asarray([0]))
        at = int(a) + k
        for one, i in reversed(path):
            plane = self.planes[i]
            at = plane.select(one, at - plane.zeros if one else at)
        return at


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = path.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


INDEX = T.StructType([T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("file", T.StringType()),
                      T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("file_bytes", T.LongType())])


def write(df: DataFrame, model: str, end: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards and return their index: `part`, `seq`, `file`, `n_docs`, `n_tokens`, `file_bytes`, `start` (ids in all shards before)."""
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "wavelet")
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")  # `row` spreads equal rows
    dealt = keyed.repartitionByRange(max(1, -(-size // RANGE_BYTES)), "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[doc_id].dataType)

    def save(batches):
        enc, part, seq = encoder(model), TaskContext.get().partitionId(), 0
        bits, held, size_ = enc.bits(end), [], 0

        def flush():
            nonlocal seq, size_
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, lengths = enc.encode(rows["text"].combine_chunks(), end)
            data = pack(ids, bits, pa.table({"doc_id": rows["doc_id"].cast(kind), "n_tokens": pa.array(lengths)}))
            fs, inner = _folder(folder)
            fs.create_dir(inner, recursive=True)
            name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.wm"
            with fs.open_output_stream(f"{inner}/{name}", compression=None) as f:
                f.write(data)
            row = (part, seq, f"{folder}/{name}", len(lengths), len(ids), len(data))
            seq, size_ = seq + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _INDEX_TYPES)], names=INDEX.names)

        for batch in batches:
            for some in slices(batch, "text", shard_bytes):
                held.append(some)
                size_ += pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
                if size_ >= shard_bytes // 2:
                    yield flush()
        if held:
            yield flush()

    index = stored(dealt.select("doc_id", "text").mapInArrow(save, INDEX), "wavelet-index")
    one = index.withColumn("one", F.lit(1)).groupBy("one", F.col("part").alias("chunk")).agg(F.sum("n_tokens").alias("n"))
    before = carry_in(one, ["one"], {"before": ("sum", "n")}).select(F.col("chunk").alias("part"), "before")
    from pyspark.sql import Window

    earlier = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return index.join(before, "part").select(*INDEX.names, (F.col("before") + F.coalesce(earlier, F.lit(0))).alias("start"))


_INDEX_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def _opened(batches, *columns):
    """The shard of each index row, with the values of some columns."""
    for batch in batches:
        for file, *rest in zip(*(batch.column(c).to_pylist() for c in ("file", *columns))):
            fs, inner = _folder(file)
            with fs.open_input_file(inner) as f:
                yield Shard(f), *rest


def _spread(index: DataFrame, *columns: str) -> DataFrame:
    """Index rows are small but stand for much work, so their number of tasks is set here."""
    return index.select("file", *columns).repartition(max(1, min(index.count(), MOST_TASKS)), "file")


def read(index: DataFrame, id_type: T.DataType = T.LongType(), ids: bool = False) -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids_crc32` (of the ids as little-endian 32-bit numbers) and, if asked for, `ids` per document."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * ids
    kinds, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]

    def load(batches):
        for shard, start in _opened(batches, "start"):
            tokens, docs = shard.tokens().astype("<u4"), shard.documents()
            lengths = docs["n_tokens"].to_numpy()
            ends = np.cumsum(lengths)
            for a in range(0, len(ends), 2_000):
                here = slice(a, a + 2_000)
                spans = list(zip((ends[here] - lengths[here]).tolist(), ends[here].tolist()))
                made = [docs["doc_id"].slice(a, 2_000).combine_chunks().cast(kinds[0]), pa.array([start + x for x, _ in spans], pa.int64()), pa.array(lengths[here]),
                        pa.array([zlib.crc32(tokens[x:y].tobytes()) for x, y in spans], pa.int64())]
                if ids:
                    made.append(pa.array([tokens[x:y].astype(np.int64) for x, y in spans], kinds[4]))
                yield pa.RecordBatch.from_arrays(made, names=names)

    return _spread(index, "start").mapInArrow(load, T.StructType(fields))


def count_tokens(index: DataFrame, tokens: list[int]) -> DataFrame:
    """`token`, `n`: occurrences over all shards, by rank alone."""
    def count(batches):
        for (shard,) in _opened(batches):
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _spread(index).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find(index: DataFrame, token: int, id_type: T.DataType = T.LongType()) -> DataFrame:
    """`doc_id`, `position` (in the document), `global_position` of every occurrence of an id, by select."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)

    def locate(batches):
        for shard, start in _opened(batches, "start"):
            docs = shard.documents()
            ends = np.cumsum(docs["n_tokens"].to_numpy())
            for a in range(0, n := shard.count(token), 10_000):
                at = np.asarray([shard.locate(token, k) for k in range(a, min(n, a + 10_000))], np.int64)
                own = np.searchsorted(ends, at, side="right")
                first = ends[own] - docs["n_tokens"].to_numpy()[own]
                yield pa.RecordBatch.from_arrays([docs["doc_id"].take(pa.array(own)).combine_chunks().cast(kind), pa.array(at - first), pa.array(at + start)],
                                                 names=["doc_id", "position", "global_position"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("position", T.LongType()), T.StructField("global_position", T.LongType())])
    return _spread(index, "start").mapInArrow(locate, schema)
