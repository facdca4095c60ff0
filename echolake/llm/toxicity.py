"""Toxicity by a convolutional text classifier.

Words are hashed into embeddings; filters of several widths slide over them and keep their largest response; a logistic unit
joins these. Which words are too rare to learn is counted over all labelled rows. Training starts in numpy on some of them
(`Settings.train_rows` of each label, by hash of the id); where there are more, each part of the data then takes the network through all its
labelled rows but one in `Settings.every`, and the networks are averaged: a word's embedding by how often a part changed it, the rest by rows.
For each language, guessed from the letters of the text alone, a threshold is chosen on all the rows left out (on all rows where few are
labelled), counted by logits in steps of `Settings.step`, and scores are shifted so that it falls on `Settings.cut`. Every row is scored over its whole text.

Null and empty texts get the score of a text without words. Labels may repeat: the largest counts. Without labelled rows of both
kinds every score is 0.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, lists_of, stored, worker_cache

PAD, RARE, FIRST = 0, 1, 2
EDGES = b".,;:!?\"'()[]{}*#$%&|-_<>/\\~`^+="
#: Letters that tell the languages apart; none of them means the remaining language.
LETTERS = {"de": "äöüßÄÖÜ", "fr": "éèêçàùâîôûÉÈÊÇÀ", "es": "ñíóáúÑÍÓÁÚ¿¡"}
LANGUAGES = (*LETTERS, "other")
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    size: int = 8
    filters: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    train_rows: int = 1500
    every: int = 4
    step: float = 1 / 128
    least_rows: int = 3
    spread: float = 0.01
    epochs: int = 8
    rate: float = 0.05
    decay: float = 1e-4
    start: float = 1e-4
    fade: float = 0.003
    drop: float = 0.1
    seed: int = 7
    cut: float = 0.3


def word_ids(text: str, buckets: int) -> np.ndarray:
    """Buckets of the words, without edge punctuation and in ASCII lower case."""
    cache = worker_cache(f"toxic{buckets}")
    out = []
    for w in text.encode().lower().split():
        i = cache.get(w)
        if i is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            core = w.strip(EDGES)
            i = cache[w] = FIRST + zlib.crc32(core) % (buckets - FIRST) if core else PAD
        out.append(i)
    return np.asarray(out, np.int32)


def guess_language(text: str) -> int:
    """The language whose letters are most frequent."""
    counts = [sum(map(text.count, letters)) for letters in LETTERS.values()]
    best = int(np.argmax(counts))
    return best if counts[best] else len(LETTERS)


class Network:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.words = np.zeros((s.buckets, s.size), np.float32)
        self.live = np.zeros(s.buckets, bool)
        self.kernels = [rng.normal(0, 0.3, (w, s.size, s.filters)).astype(np.float32) for w in s.widths]
        self.bias = [np.zeros(s.filters, np.float32) for _ in s.widths]
        self.out = rng.normal(0, 0.3, s.filters * len(s.widths)).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.cuts = np.full(len(LANGUAGES), s.cut)
        self.held = None

    def seen(self, ids: np.ndarray) -> np.ndarray:
        """Ids with a margin of padding; buckets that too few training rows hold are one common word."""
        margin = max(self.s.widths) - 1
        return np.pad(np.where(self.live[ids] | (ids == PAD), ids, RARE), (margin, margin)) if len(ids) else np.zeros(2 * margin + 1, np.int32)

    def prepare(self) -> None:
        """Responses of every bucket at every place of every filter, so that scoring only looks up and adds."""
        self.tables = [[self.words @ kernel[k] for k in range(len(kernel))] for kernel in self.kernels]

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        best = []
        for tables, bias in zip(self.tables, self.bias):
            top = np.full(self.s.filters, -np.inf, np.float32)
            w = len(tables)
            for start in range(0, len(ids) - w + 1, 8192):
                stop = min(start + 8192, len(ids) - w + 1)
                total = tables[0][ids[start:stop]]
                for k in range(1, w):
                    total += tables[k][ids[start + k : stop + k]]
                np.maximum(top, total.max(0), out=top)
            best.append(np.maximum(top + bias, 0))
        return np.concatenate(best)

    def raw(self, ids: np.ndarray) -> float:
        return float(self.pooled(self.seen(ids)) @ self.out + self.base[0])

    def fit(self, rows: list[tuple[np.ndarray, int]]) -> None:
        """Stochastic gradients with a step per weight that shrinks with its past gradients."""
        s = self.s
        rng = np.random.default_rng(s.seed)
        held = self.held
        if held is None:
            held = np.zeros(s.buckets, np.int64)
            for ids, _ in rows:
                held[np.unique(ids)] += 1
        self.live = held >= s.least_rows
        self.live[[PAD, RARE]] = False
        self.words[self.live] = rng.normal(0, s.spread, (int(self.live.sum()), s.size))
        self.past = [np.full(p.shape, s.start, np.float32) for p in self.dense()]
        self.past_words = np.full(s.buckets, s.start, np.float32)
        self.descend(rows, rng, s.epochs, s.decay, s.fade)

    def dense(self) -> list[np.ndarray]:
        return [*self.kernels, *self.bias, self.out, self.base]

    def descend(self, rows: list[tuple[np.ndarray, int]], rng, epochs: int, decay: float = 0.0, fade: float = 0.0) -> np.ndarray:
        """Go through the rows; how many steps changed each word."""
        s = self.s
        inputs = [self.seen(ids) for ids, _ in rows]
        dense, past, past_words = self.dense(), self.past, self.past_words
        alive, changed = np.flatnonzero(self.live), np.zeros(s.buckets, np.int64)
        span, f = len(s.widths), s.filters
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), 16):
                grads = [np.zeros_like(p) for p in dense]
                touched, slopes = [], []
                for r in order[start : start + 16]:
                    ids, label = inputs[r], rows[r][1]
                    if s.drop:
                        ids = np.where(rng.random(len(ids)) < s.drop, RARE, ids)
                    x, best, value = self.words[ids], [], []
                    for kernel, bias in zip(self.kernels, self.bias):
                        n = len(ids) - len(kernel) + 1
                        reply = sum(x[k : k + n] @ kernel[k] for k in range(len(kernel)))
                        best.append(reply.argmax(0))
                        value.append(reply[best[-1], np.arange(f)] + bias)
                    hidden = np.maximum(np.concatenate(value), 0)
                    error = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.base[0], -30, 30))) - label
                    grads[-1] += error
                    grads[-2] += error * hidden
                    back = (error * self.out * (hidden > 0)).reshape(span, f)
                    for i, kernel in enumerate(self.kernels):
                        grads[span + i] += back[i]
                        for k in range(len(kernel)):
                            grads[i][k] += (x[best[i] + k] * back[i][:, None]).T
                            touched.append(ids[best[i] + k])
                            slopes.append(back[i][:, None] * kernel[k].T)
                for p, g, h in zip(dense, grads, past):
                    g = g / 16 + decay * p
                    h += g * g
                    p -= s.rate * g / np.sqrt(h)
                where, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                slope = np.zeros((len(where), s.size), np.float32)
                np.add.at(slope, inverse, np.concatenate(slopes) / 16)
                slope[where < FIRST] = 0
                past_words[where] += (slope * slope).mean(1)
                self.words[where] -= s.rate * slope / np.sqrt(past_words[where])[:, None]
                changed[where] += 1
                if fade:
                    self.words[alive] *= 1 - fade
        changed[:FIRST] = 0
        return changed

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, languages: np.ndarray, times: np.ndarray | None = None) -> None:
        """The cut of each language that gives the best F1; a language with under ten rows of label 1 takes the common cut. Each row counts `times`."""
        times = np.ones(len(labels), np.int64) if times is None else times
        labels = labels * times

        def best(mask):
            x, y = logits[mask], labels[mask]
            order = np.argsort(-x)
            hits = np.cumsum(y[order])
            f1 = 2 * hits / (np.cumsum(times[mask][order]) + y.sum())
            k = int(np.argmax(f1))
            below = x[order[k + 1]] if k + 1 < len(x) else x[order[k]] - 1
            return (x[order[k]] + below) / 2

        common = best(np.ones(len(labels), bool)) if labels.sum() else 0.0
        self.cuts = np.asarray([best(m) if labels[m := languages == i].sum() >= 10 else common for i in range(len(LANGUAGES))])

    def score(self, text: str) -> float:
        lift = np.log(self.s.cut / (1 - self.s.cut)) - self.cuts[guess_language(text)]
        x = self.raw(word_ids(text, self.s.buckets)) + lift
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Network | None:
    """A network from the labelled rows, or None where only one label occurs. What reaches the driver is bounded by `s`."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.max(label) > 0).cast("int").alias("y"))
    rows = docs.select(doc_id, F.col(text).alias("t")).join(known.hint("merge"), doc_id)  # labels grow with the documents: no broadcast, whatever their size now

    def hashed(texts):
        ids = [word_ids(t, s.buckets) for t in texts]
        return [lists_of(np.concatenate([*ids, np.zeros(0, np.int32)]), [len(i) for i in ids]), pa.array([guess_language(t) for t in texts], pa.int32())]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lang_", T.IntegerType())]
    rows = stored(add_columns(rows, "t", fields, hashed).drop("t").withColumn("left", F.pmod(F.xxhash64(F.lit(s.seed + 1), doc_id), F.lit(s.every)) == 0), "labelled")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    net, many = Network(s), max(sizes.values()) > s.train_rows
    order = [F.xxhash64(F.lit(s.seed), doc_id), doc_id]
    learnt = rows.where("NOT left") if many else rows
    picks = [learnt.where(F.col("y") == y).orderBy(*order).limit(s.train_rows) for y in (0, 1)]
    fit = picks[0].unionByName(picks[1]).select(doc_id, "y", "ids").toArrow().sort_by([(doc_id, "ascending")]).to_pandas()  # 2 * train_rows rows at most
    if many:
        net.held = _rows_by_bucket(learnt, s)
    net.fit([(np.asarray(i, np.int32), int(y)) for i, y in zip(fit["ids"], fit["y"])])
    if not many:
        net.prepare()
        tune = rows.select(doc_id, "y", "lang_", "ids").toArrow().sort_by([(doc_id, "ascending")]).to_pandas()
        net.calibrate(np.asarray([net.raw(np.asarray(i, np.int32)) for i in tune["ids"]]), tune["y"].to_numpy(), tune["lang_"].to_numpy())
        del net.tables
        return net
    _go_through(net, learnt)
    small = _plain(net)

    def logits(batches):
        own = _network(small)
        for batch in batches:
            x = [own.raw(ids) for ids in _lists(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("lang_"), pa.array(np.floor(np.asarray(x) / s.step).astype(np.int64))], names=["y", "lang_", "bin"])

    bins = rows.where("left").select("y", "lang_", "ids").mapInArrow(logits, "y int, lang_ int, bin long").groupBy("y", "lang_", "bin").agg(F.count(F.lit(1)).alias("n"))
    tune = bins.orderBy("lang_", "bin", "y").toArrow().to_pandas()  # a row per step of the logits at most, label and language
    if len(tune):
        net.calibrate((tune["bin"].to_numpy() + 0.5) * s.step, tune["y"].to_numpy(), tune["lang_"].to_numpy(), tune["n"].to_numpy())
    return net


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, cuts = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _rows_by_bucket(rows: DataFrame, s: Settings) -> np.ndarray:
    """How many rows hold each bucket."""
    buckets = s.buckets

    def count(batches):
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for ids in _lists(batch.column("ids")):
                seen[np.unique(ids)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["bucket", "n"])

    got = rows.select("ids").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket at most
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def _go_through(net: Network, rows: DataFrame) -> None:
    """Take the network through all rows, each part of the data on its own, and average."""
    s, size = net.s, net.s.size
    small, past = _plain(net), (net.past, net.past_words)

    def learn(batches):
        own = _network(small)
        own.past, own.past_words = [p.copy() for p in past[0]], past[1].copy()
        own.kernels, own.bias, own.out, own.base = [k.copy() for k in own.kernels], [b.copy() for b in own.bias], own.out.copy(), own.base.copy()
        before, changed, n = own.words.copy(), np.zeros(s.buckets, np.int64), 0
        rng = np.random.default_rng(s.seed)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):  # ids of some rows at a time
                part = batch.slice(a, 512)
                held = list(zip(_lists(part.column("ids")), part.column("y").to_pylist()))
                changed += own.descend(held, rng, 1)
                n += len(held)
        if n:
            at = np.flatnonzero(changed)
            flat = np.concatenate([p.ravel() for p in own.dense()])
            flat = np.pad(flat, (0, -len(flat) % size)).reshape(-1, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([at, -1 - np.arange(len(flat))]).astype(np.int32)), pa.array(np.concatenate([changed[at], np.full(len(flat), n)])),
                 lists_of(np.concatenate([own.words[at] - before[at], flat]).astype(np.float32).ravel(), [size] * (len(at) + len(flat)))], names=["place", "n", "v"])

    mean = F.array(*[F.sum(F.col("n") * F.col("v")[i]) / F.sum("n") for i in range(size)]).alias("v")
    got = rows.select("y", "ids").mapInArrow(learn, "place int, n long, v array<float>").groupBy("place").agg(mean).toArrow()  # the weights, whatever the data
    place, v = got.column("place").to_numpy(), got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
    net.words[place[place >= 0]] += v[place >= 0].astype(np.float32)
    own = place < 0
    flat, at = v[own][np.argsort(-place[own])].ravel().astype(np.float32), 0
    for p in net.dense():
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size


def score(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Add `score` (0 to 1) and `predicted` (1 from the cut on)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if net is None:
        keep = [c for c in df.columns if c not in ("score", "predicted")]
        return df.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(own, texts):
        scores = np.asarray([own.score(t) for t in texts])
        return [pa.array(scores), pa.array((scores >= own.s.cut).astype(np.int32))]

    return _with_network(df, net, text, fields, run)


def _plain(net: Network) -> tuple:
    """The network as plain values, bounded by the bucket count."""
    live = np.flatnonzero(net.live)
    return live, net.words[live], net.s, net.kernels, net.bias, net.out, net.base, net.cuts


def _network(small: tuple) -> Network:
    n = Network(small[2])
    n.live[small[0]], n.words[small[0]] = True, small[1]
    n.kernels, n.bias, n.out, n.base, n.cuts = small[3:]
    n.prepare()
    return n


def _with_network(df: DataFrame, net: Network, text: str, fields: list, fn) -> DataFrame:
    """Add what `fn` gives for the network and some texts."""
    small = _plain(net)

    def run(texts):
        kept = worker_cache("network")
        key = (small[1].tobytes()[:4096], small[7].tobytes())
        if kept.get("key") != key:
            kept.update(key=key, net=_network(small))
        return fn(kept["net"], texts)

    return add_columns(df, text, fields, run)


def keep(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic; columns named like the scores keep their values."""
    own = [c for c in ("score", "predicted") if c in df.columns]
    renamed = df.withColumnsRenamed({c: f"__{c}" for c in own})
    kept = score(renamed, net, text).where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({f"__{c}": c for c in own}).select(*df.columns)
