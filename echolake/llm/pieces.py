"""Offset-preserving encoding and decoding with a SentencePiece BPE model.

The model file is read here: pieces, scores, types and the compiled character map. A text is normalised by the longest
matching prefix of that map, and each normalised byte remembers the source byte it came from, so every piece is projected to a
byte span of the original text. Pieces never hold a space after another character, so a text is merged run by run (spaces and
the word after them), and the runs of a worker are kept in a bounded cache.

Null is read as empty; an empty text has only the end id. Very long runs are merged with a heap, so the time stays n log n.
Only BPE models with byte fallback and without user-defined pieces are accepted (ValueError).
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, lists_of, worker_cache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Runs kept by a worker; the cache is emptied when it is full.
CACHE_RUNS = 400_000
LONG_RUN = 60


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes):
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else _varint(b, i)
            value = b[i : i + n]
            i += n
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie of byte strings followed by their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, source: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix at `at`, and the prefix's length."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = _offset(unit)
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != source[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.texts[start : self.texts.index(b"\0", start)], found[1]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class PieceModel:
    def __init__(self, data: bytes):
        pieces, kind, self.unknown, fallback, charsmap = [], 1, 0, False, b""
        self.dummy_prefix = self.squeeze = self.escape = True
        for n, v in _fields(data):
            if n == 1:
                p = dict(_fields(v))
                score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                pieces.append((p.get(1, b"").decode(), score, p.get(3, NORMAL)))
            elif n == 2:
                spec = dict(_fields(v))
                kind, fallback = spec.get(3, 1), bool(spec.get(35, 0))
            elif n == 3:
                spec = dict(_fields(v))
                charsmap = spec.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if kind != 2 or not fallback or not self.escape or any(t == USER for _, _, t in pieces):
            raise ValueError("only BPE models with byte fallback and no user-defined pieces")
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
            raise ValueError("a piece holds a space after another character")
        self.map = CharacterMap(charsmap)
        self.scores = {p: s for p, s, t in pieces if t == NORMAL}
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.end = next((i for i, (p, _, t) in enumerate(pieces) if t == CONTROL and p == "</s>"), -1)
        self.raw = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN
                    else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.kinds = [t for _, _, t in pieces]
        self.plain = not self.map.units and not self.squeeze
        line = "\n" * (not any("\n" in p for p, _, _ in pieces))  # a character that no piece holds always stands alone
        self.runs = re.compile(f" +[^ {line}]*|[^ {line}]+" + "|\n" * bool(line))
        self.cache: dict[str, bytes] = {}
        self._tables()

    def _tables(self) -> None:
        """Pairs of pieces that join to a piece, as sorted keys with priority and joined id, and the piece of each character."""
        order = {s: i for i, s in enumerate(sorted(set(self.scores.values())))}
        rows = [(self.ids[p[:k]] << 32 | self.ids[p[k:]], order[s], self.ids[p])
                for p, s in self.scores.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        rows.sort()
        self.pairs, self.priority, self.joined = (np.asarray([r[k] for r in rows], np.int64) for k in range(3))
        self.letters = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        self.width = np.asarray([len(r) for r in self.raw], np.int32)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Priority (-1: none) and joined id of neighbours."""
        if not len(self.pairs):
            return np.full(a.shape, -1), np.full(a.shape, -1)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.priority[at], -1), self.joined[at]

    def merge_equal(self, runs: list[str], symbols: np.ndarray) -> None:
        """Pieces of runs of one length at once, from one row of character ids each, put into the cache."""
        rank, into = self._look(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(symbols))
        while len(rows):
            width = symbols.shape[1]
            best = rank.argmax(1) if width > 1 else np.zeros(len(rows), np.int64)
            go = rank[np.arange(len(rows)), best] >= 0 if width > 1 else np.zeros(len(rows), bool)
            done = symbols[~go]
            packed, size = np.stack([done, self.width[done]], 2).astype(np.int32).tobytes(), 8 * width
            self.cache.update((runs[r], packed[k * size : k * size + size]) for k, r in enumerate(rows[~go].tolist()))
            rows, symbols, rank, into, best = rows[go], symbols[go], rank[go], into[go], best[go]
            if not len(rows):
                break
            n = np.arange(len(rows))
            symbols[n, best] = into[n, best]
            shift = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, shift + (shift > best[:, None]), 1)
            shift = shift[:-1]
            pick = shift + (shift >= best[:, None])
            rank, into = np.take_along_axis(rank, pick, 1), np.take_along_axis(into, pick, 1)
            for side in (best - 1, best):
                ok = (side >= 0) & (side < width - 2)
                m, c = n[ok], side[ok]
                rank[m, c], into[m, c] = self._look(symbols[m, c], symbols[m, c + 1])

    def warm(self, runs) -> None:
        """Put the pieces of new runs into the cache: short runs of known characters together, by length, others one by one."""
        groups: dict[int, list[str]] = {}
        for run in runs:
            groups.setdefault(min(len(run), LONG_RUN + 1), []).append(run)
        for n, same in groups.items():
            rest = same
            if n <= LONG_RUN:
                codes = np.frombuffer("".join(same).replace(" ", SPACE).encode("utf-32-le"), "<u4").reshape(-1, n)
                symbols = self.letters[codes]
                known = (symbols >= 0).all(1)
                rest = [same[i] for i in np.flatnonzero(~known)]
                self.merge_equal([same[i] for i in np.flatnonzero(known)] if rest else same, symbols[known])
            for run in rest:
                self.cache[run] = self._single(run)

    def _single(self, run: str) -> bytes:
        ids, sizes = self.run_pieces(run.replace(" ", SPACE))
        sizes = [len(self.raw[i]) if self.raw[i][:1] == b" " else n for i, n in zip(ids, sizes)]  # a mark takes three bytes, a space one
        return np.asarray([ids, sizes], np.int32).T.tobytes()

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The text that is cut into pieces, and for each of its bytes (and its end) the source byte it came from."""
        source = text.encode()
        out, align, i, n = bytearray(), [], 0, len(source)

        def step(at):
            hit = self.map.longest(source, at)
            if hit:
                return hit
            c = source[at]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            return source[at : at + width], width

        if self.squeeze:
            while i < n and step(i)[0] in (b" ", b""):
                i += step(i)[1]
        if i >= n:
            return "", [i]
        mark = SPACE.encode()

        def put(piece, at):
            piece = piece.replace(b" ", mark)
            out.extend(piece)
            align.extend([at] * len(piece))

        if self.dummy_prefix:
            put(b" ", i)
        spaced = self.squeeze and self.dummy_prefix
        while i < n:
            piece, width = step(i)
            if spaced:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece, i)
                spaced = self.squeeze and piece.endswith(b" ")
            i += width
        end = n
        if self.squeeze:
            while out.endswith(mark):
                del out[-3:]
                end = align[-3]
                del align[-3:]
        return out.decode(), align + [end]

    def merge(self, run: str) -> list[str]:
        """Join the best-scored neighbours, leftmost first among equals, until no pair is a piece."""
        get, none = self.scores.get, -float("inf")
        s = list(run)
        if len(s) > LONG_RUN:
            return self._merge_long(s)
        pairs = [get(a + b, none) for a, b in zip(s, s[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(s[i - 1] + s[i], none)
            if i < len(pairs):
                pairs[i] = get(s[i] + s[i + 1], none)
        return s

    def _merge_long(self, s: list[str]) -> list[str]:
        n, get = len(s), self.scores.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i, j):
            if i >= 0 and j >= 0 and (score := get(s[i] + s[j])) is not None:
                heapq.heappush(heap, (-score, i, j, s[i], s[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if s[i] != a or s[j] != b or right[i] != j:
                continue
            s[i], s[j] = a + b, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for x in s if x]

    def run_pieces(self, run: str) -> tuple[list[int], list[int]]:
        """Ids of one run and the bytes each takes of it; of a character cut into bytes, the last byte takes all."""
        ids, sizes, known = [], [], self.ids.get
        for piece in self.merge(run):
            i = known(piece)
            if i is not None:
                ids.append(i)
                sizes.append(len(piece.encode()))
            else:
                raw = piece.encode()
                ids.extend(self.bytes[c] for c in raw)
                sizes.extend([0] * (len(raw) - 1) + [len(raw)])
        return ids, sizes

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begins and ends of their source bytes, without the end id."""
        norm, align = self.normalise(text)
        ids, sizes = [], []
        for run in _RUNS.findall(norm):
            a, b = self.run_pieces(run)
            ids += a
            sizes += b
        at = np.asarray(align, np.int32)
        ends = np.asarray([0, *accumulate(sizes)], np.int64)
        return np.asarray(ids, np.int32), at[ends[:-1]], at[ends[1:]]

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """`encode` of each text; runs that are not cached are merged together."""
        shift = int(self.dummy_prefix)
        easy = [self.plain and t != "" and SPACE not in t for t in texts]
        runs = [self.runs.findall(" " * shift + t) if ok else () for t, ok in zip(texts, easy)]
        needed = set().union(*runs)
        if len(self.cache) + len(new := needed.difference(self.cache)) > CACHE_RUNS:
            self.cache.clear()
            new = needed
        self.warm(new)
        got = []
        for text, ok, own in zip(texts, easy, runs):
            if not ok:
                got.append(self.encode(text))
                continue
            flat = np.frombuffer(b"".join(map(self.cache.__getitem__, own)), np.int32).reshape(-1, 2)
            ends = np.cumsum(flat[:, 1], dtype=np.int32) - shift
            begins = np.empty_like(ends)
            begins[0], begins[1:] = 0, ends[:-1]
            got.append((flat[:, 0], begins, ends))
        return got

    def decode(self, ids) -> str:
        raw, kinds = self.raw, self.kinds
        joined = b"".join(map(raw.__getitem__, ids))
        if self.dummy_prefix or self.squeeze:
            first = next((i for i in ids if kinds[i] != CONTROL), None)
            if first is not None and kinds[first] == NORMAL and raw[first][:1] == b" ":
                joined = joined.lstrip(b" ") if self.squeeze else joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return joined.decode(errors="replace")


_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def load(data: bytes) -> PieceModel:
    """The model of a worker, read once per worker."""
    kept = worker_cache("pieces")
    key = hashlib.sha256(data).digest()
    if key not in kept:
        kept[key] = PieceModel(data)
    return kept[key]


IDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("begins", T.ArrayType(T.IntegerType())),
       T.StructField("ends", T.ArrayType(T.IntegerType()))]


def encode(df: DataFrame, model: bytes, text: str = "text", end: bool = True, decoded: bool = False) -> DataFrame:
    """Add `ids`, `begins`, `ends` (bytes of the source), and with `decoded` the text that the ids give back.

    `end` appends the end id with an empty span at the end of the text.
    """

    def run(texts):
        m = load(model)
        got = m.encode_many(texts)
        if end:
            size = [len(t.encode()) for t in texts]
            got = [(np.append(a, np.int32(m.end)), np.append(b, np.int32(n)), np.append(c, np.int32(n)))
                   for (a, b, c), n in zip(got, size)]
        lengths = [len(x[0]) for x in got]
        out = [lists_of(np.concatenate([x[k] for x in got]).astype(np.int32), lengths) for k in range(3)]
        if decoded:
            out.append(pa.array([m.decode(x[0].tolist()) for x in got], pa.string()))
        return out

    return add_columns(df, text, IDS + [T.StructField("decoded", T.StringType())] * decoded, run)


def decode(df: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Add `decoded`, the text of an array of ids (null: empty)."""
    fields = [f for f in df.schema.fields if f.name != "decoded"]
    names = [f.name for f in fields] + ["decoded"]

    def run(batches):
        m = load(model)
        for batch in batches:
            texts = [m.decode(x or []) for x in batch.column(ids).to_pylist()]
            kept = [batch.column(n) for n in names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(run, T.StructType(fields + [T.StructField("decoded", T.StringType())]))
