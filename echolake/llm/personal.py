"""Personal data: fixed patterns, and a semi-Markov conditional random field that finds further spans.

The patterns give the base spans. Around digits, at signs and spelt-out at signs a text is cut into windows of tokens. In a
window every run of a few tokens that holds such a mark is a candidate segment; features of the whole span and its neighbours
score it for each kind, weights between kinds score what follows what, and dynamic programming over segments of at most
`Settings.longest` tokens chooses boundaries and kinds together. The weights maximise the likelihood of labelled windows: all distinct
windows of the corpus of at most eight times the reach and 200 tokens, where base spans are the labels and a share
of them is rewritten into other spellings (at and dot in words, other separators) or into numbers that fail the checks. They start from `Settings.windows`
windows, learnt several times in the driver; then every window is learnt from once, in parts of about `PART` windows dealt by hash, whose weights are
averaged by their number of windows. Decoded spans that overlap no base span are added.

Offsets count code points. Null is read as empty. Without any window in the corpus nothing is added to the base spans.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, begin_pass, free_name, give_back, lists_of, stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]| at [\w.-]+ dot ", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_AT = re.compile(r"@|[\[({] ?at ?[\])}]| at ", re.I)
FEATURES = 1 << 13
PART = 2000


@dataclass(frozen=True)
class Settings:
    windows: int = 1500
    reach: int = 40
    longest: int = 15
    epochs: int = 4
    rate: float = 0.3
    seed: int = 11


def is_digits(token: str) -> bool:
    """Whether all are 0 to 9; other digits (superscript, circled, full-width) are plain characters here."""
    return token.isascii() and token.isdigit()


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def small_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns, leftmost and without overlap per kind, by kind and start; linear in the text."""
    out = []
    at, used = text.find("@"), 0
    while at >= 0:
        start = at
        while start > used and text[start - 1] in LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append((0, start, m.end()))
            used = m.end()
        else:
            used = max(used, at + 1)
        at = text.find("@", used)
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() >= 7 and (parts := m.group().split(".")) and len(parts) >= 4:
            start = m.start()
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                if small_parts(parts[k : k + 4]):
                    out.append((1, start, start + size))
                start += size + 1
    for kind, pattern, low, high in ((2, _CARD, 13, 19), (3, _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def windows(text: str, reach: int) -> list[tuple[int, int]]:
    """Ranges around marks, widened to the next white space, merged where they touch."""
    out: list[list[int]] = []
    for m in _MARK.finditer(text):
        if out and m.end() <= out[-1][1] - reach // 2:
            continue
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        while a > 0 and m.start() - a < 2 * reach and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b - m.end() < 2 * reach and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _code(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def _edge(token: str) -> str:
    return "none" if not token else "space" if token.isspace() else "digit" if is_digits(token) else "word" if token.isalpha() else token


def candidates(tokens: list[str], longest: int) -> list[tuple[int, int, list[int]]]:
    """(first token, after last token, features of the whole span)."""
    out, n = [], len(tokens)
    numeric = [is_digits(t) or t.isspace() or t in "+().-/:" for t in tokens]
    for i in range(n):
        if tokens[i].isspace() or not (tokens[i][0].isalnum() or tokens[i] in "+("):
            continue
        all_numeric = True
        span, digits, shape = "", "", ""
        for j in range(i + 1, min(n, i + longest) + 1):
            t = tokens[j - 1]
            all_numeric &= numeric[j - 1]
            span += t
            if is_digits(t):
                digits += t
                shape += f"d{min(len(t), 5)}"
            else:
                shape += "_" if t.isspace() else t.lower() if t.lower() in ("at", "dot") else "a" if t.isalpha() else t
            if len(span) > 80 or "\n" in t:
                break
            if not t[-1].isalnum() or not (digits if all_numeric else _AT.search(span)) or not all_numeric and not t.isalnum():
                continue
            if all_numeric and j < n and is_digits(tokens[j]) or len(digits) > 40:
                continue
            parts = re.split(r"[^0-9]+", span.strip("+"))
            names = [
                "bias", "shape" + shape[:40], f"n{min(len(digits), 20)}", f"tokens{j - i}",
                "left" + _edge(tokens[i - 1] if i else ""), "right" + _edge(tokens[j] if j < n else ""),
                f"numeric{all_numeric}", f"plus{span[0] == '+'}",
                f"card{all_numeric and 13 <= len(digits) <= 19 and luhn(digits)}",
                f"phone{all_numeric and 9 <= len(digits) <= 15}{len(parts) > 2}",
                f"ip{all_numeric and len(parts) == 4 and small_parts(parts) and span.count('.') == 3}",
                f"at{len(_AT.findall(span))}", f"dot{bool(re.search(r'[.]| dot |[(\[{] ?dot', span))}",
                f"edges{i == 0 or tokens[i - 1].isspace()}{j == n or not tokens[j].isalnum()}",
                f"spaces{min(3, len(span.split()) - 1)}",
            ]
            out.append((i, j, [_code(x) for x in names]))
    return out


class Field:
    """Weights of features by kind and of one kind after another; kind 0 is one token outside any span."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        k = len(KINDS) + 1
        self.weights = np.zeros((k - 1, FEATURES)) if weights is None else weights
        self.moves = np.zeros((k, k)) if moves is None else moves

    def _lattice(self, n: int, segments):
        scores = [self.weights[:, f].sum(1) for _, _, f in segments]
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (_, j, _) in enumerate(segments):
            ending[j].append(s)
        return scores, ending

    def decode(self, n: int, segments) -> list[tuple[int, int, int]]:
        """The best labelling: (first token, after last, kind index)."""
        scores, ending = self._lattice(n, segments)
        k = len(self.moves)
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0
        back: list[list] = [[None] * k for _ in range(n + 1)]
        for j in range(1, n + 1):
            into = best[j - 1] + self.moves[:, 0]
            p = int(into.argmax())
            best[j, 0], back[j][0] = into[p], (j - 1, p, 0)
            for s in ending[j]:
                i = segments[s][0]
                into = best[i][:, None] + self.moves[:, 1:]
                prev = into.argmax(0)
                total = into[prev, np.arange(k - 1)] + scores[s]
                for y in np.flatnonzero(total > best[j, 1:]).tolist():
                    best[j, y + 1], back[j][y + 1] = total[y], (i, int(prev[y]), y + 1)
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, p, y = back[j][y]
            if y:
                out.append((i, j, y - 1))
            j, y = i, p
        return out[::-1]

    def gradient(self, n: int, segments, gold: dict[tuple[int, int], int], step) -> None:
        """One step up the likelihood of `gold` (kind by segment): observed minus expected features."""
        scores, ending = self._lattice(n, segments)
        k = len(self.moves)
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (i, _, _) in enumerate(segments):
            starting[i].append(s)

        def total(x, axis):
            m = x.max(axis, keepdims=True)
            m = np.where(np.isfinite(m), m, 0)
            with np.errstate(divide="ignore"):
                return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

        ahead = np.full((n + 1, k), -np.inf)
        ahead[0, 0] = 0
        for j in range(1, n + 1):
            ahead[j, 0] = total(ahead[j - 1] + self.moves[:, 0], 0)
            for s in ending[j]:
                ahead[j, 1:] = np.logaddexp(ahead[j, 1:], total(ahead[segments[s][0]][:, None] + self.moves[:, 1:], 0) + scores[s])
        behind = np.full((n + 1, k), -np.inf)
        behind[n] = 0
        for i in range(n - 1, -1, -1):
            behind[i] = self.moves[:, 0] + behind[i + 1, 0]
            for s in starting[i]:
                behind[i] = np.logaddexp(behind[i], total(self.moves[:, 1:] + scores[s] + behind[segments[s][1], 1:], 1))
        z = total(ahead[n], 0)
        moves = np.zeros_like(self.moves)
        for i in range(n):
            moves[:, 0] -= np.exp(ahead[i] + self.moves[:, 0] + behind[i + 1, 0] - z)
        for s, (i, j, features) in enumerate(segments):
            p = np.exp(ahead[i][:, None] + self.moves[:, 1:] + scores[s] + behind[j, 1:] - z)
            moves[:, 1:] -= p
            g = -p.sum(0)
            if (y := gold.get((i, j))) is not None:
                g[y] += 1
            step(features, g)
        at, last = 0, 0
        ends = {i: (j, y) for (i, j), y in gold.items()}
        while at < n:
            j, y = ends.get(at, (at + 1, -1))
            moves[last, y + 1] += 1
            at, last = j, y + 1
        step(None, moves)


def _respell(kind: int, span: str, rng) -> tuple[str, int]:
    """Another spelling of a span, or a number of its form that fails the checks (kind -1)."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        local, host = span.split("@", 1)
        name, end = host.rsplit(".", 1)
        return [(f"{local} at {name} dot {end}", 0), (f"{local}(at){host}", 0), (f"{local} [at] {name} [dot] {end}", 0), (f"{local}@", -1)][rng.integers(4)]
    if kind == 1:
        return [(f"{span}:{rng.integers(80, 9999)}", 1), (".".join(str(rng.integers(256, 999)) for _ in range(4)), -1), (f"{rng.integers(9)}.{rng.integers(20)}.{rng.integers(9)}", -1)][rng.integers(3)]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + rng.integers(8)) % 10)
        sep = "./"[rng.integers(2)]
        return [(sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)), 2), (wrong, -1), (digits[: rng.integers(4, 9)], -1)][rng.integers(3)]
    local = digits[-10:]
    return [(f"({local[:3]}) {local[3:6]}-{local[6:]}", 3), (f"{local[:3]}-{local[3:6]}-{local[6:]}", 3), (f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", -1)][rng.integers(3)]


def cases(samples, s: Settings, rng):
    """(tokens, segments, kind by segment) of windows as they are and respelt."""
    for text in samples:
        spans = base_spans(text)
        spans = [x for x in spans if not any(y[1] < x[2] and x[1] < y[2] for y in spans if y is not x)]
        for copy in range(2):
            made, gold, at = "", [], 0
            for kind, a, b in sorted(spans, key=lambda x: x[1]):
                made += text[at:a]
                new, k = _respell(kind, text[a:b], rng) if copy else (text[a:b], kind)
                if k >= 0:
                    cut = new.rsplit(":", 1)[0] if k == 1 else new
                    gold.append((len(made), len(made) + len(cut), k))
                made += new
                at = b
            made += text[at:]
            tokens = _TOKEN.findall(made)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(int).tolist()
            where = {p: i for i, p in enumerate(starts)}
            segments = candidates(tokens, s.longest)
            known = {(i, j) for i, j, _ in segments}
            truth = {(where[a], where[b]): k for a, b, k in gold if a in where and b in where and (where[a], where[b]) in known}
            if tokens and segments and len(tokens) <= 200:
                yield len(tokens), segments, truth


class Learner:
    """A field and how far it has moved."""

    def __init__(self, s: Settings, state: tuple | None = None):
        self.s, self.field = s, Field()
        self.past, self.past_moves = np.full(self.field.weights.shape, 1.0), np.full(self.field.moves.shape, 1.0)
        if state is not None:
            self.field.weights[:], self.field.moves[:], self.past[:], self.past_moves[:] = state

    def state(self) -> tuple:
        return self.field.weights, self.field.moves, self.past, self.past_moves

    def _step(self, features, g) -> None:
        if features is None:
            self.past_moves += g * g
            self.field.moves += self.s.rate * g / np.sqrt(self.past_moves)
        elif np.abs(g).max() > 1e-4:
            self.past[:, features] += (g * g)[:, None]
            self.field.weights[:, features] += self.s.rate * g[:, None] / np.sqrt(self.past[:, features])

    def learn(self, made: list, rng) -> None:
        for c in rng.permutation(len(made)):
            self.field.gradient(*made[c], self._step)


def start(samples: list[str], s: Settings) -> Learner | None:
    """What some windows teach, `Settings.epochs` times."""
    rng = np.random.default_rng(s.seed)
    made = list(cases(samples, s, rng))
    if not made:
        return None
    learner = Learner(s)
    for _ in range(s.epochs):
        learner.learn(made, rng)
    return learner


def fit(samples: list[str], s: Settings) -> Field | None:
    """A field from windows of text."""
    learner = start(samples, s)
    return learner and learner.field


def averaged(found: DataFrame, state: tuple, s: Settings) -> Field:
    """The field after every window `w` of a table has been learnt from once, from a state on: the mean over parts by their windows."""
    parts, step = -(-found.count() // PART), 64
    size = state[0].size

    def learn(batches):
        begin_pass(__name__)
        learner, rng, total = Learner(s, state), None, 0
        for batch in batches:
            texts = batch.column("w").to_pylist()
            for a in range(0, len(texts), 100):
                rng = rng or np.random.default_rng([s.seed, zlib.crc32(texts[0].encode())])
                learner.learn(list(cases(texts[a : a + 100], s, rng)), rng)
                total += len(texts[a : a + 100])
        if total:
            flat = np.concatenate([learner.field.weights.ravel(), learner.field.moves.ravel()])
            flat = np.pad(flat, (0, -len(flat) % step)).reshape(-1, step)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.full(len(flat), total, np.int64)),
                                              lists_of(flat.ravel(), [step] * len(flat))], names=["part", "n", "v"])
        give_back()

    dealt = found.repartition(max(parts, 1), "w").sortWithinPartitions("w")
    rows = dealt.mapInArrow(learn, "part int, n long, v array<double>").groupBy("part").agg(
        F.array(*[F.sum(F.col("n") * F.col("v")[i]) / F.sum("n") for i in range(step)]).alias("v")).toArrow()  # the weights, whatever the data
    flat = rows.sort_by("part").column("v").combine_chunks().flatten().to_numpy()
    moves = state[1]
    return Field(flat[:size].reshape(state[0].shape).copy(), flat[size : size + moves.size].reshape(moves.shape).copy())


def train(df: DataFrame, s: Settings = Settings(), text: str = "text") -> Field | None:
    """A field from all distinct windows of the table of at most eight times the reach."""
    reach = s.reach

    def cut(texts):
        return [pa.array([[t[a:b] for a, b in windows(t, reach) if b - a <= 8 * reach] for t in texts], pa.list_(pa.string()))]

    found = add_columns(df.select(text), text, [T.StructField("found", T.ArrayType(T.StringType()))], cut)
    found = stored(found.where(F.size("found") > 0).select(F.explode("found").alias("w")).distinct(), "personal-windows")
    rows = found.orderBy(F.xxhash64(F.lit(s.seed), "w"), "w").limit(s.windows).collect()
    if not rows:
        return None
    learner = start(sorted(r.w for r in rows), s) or Learner(s)
    return averaged(found, learner.state(), s)


def spans(text: str, field: Field | None, s: Settings) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans by kind and start."""
    base = base_spans(text)
    if field is None:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for a, b in windows(text, s.reach):
        tokens = _TOKEN.findall(text[a:b])
        segments = candidates(tokens, s.longest)
        if not segments:
            continue
        starts = np.concatenate([[a], a + np.cumsum([len(t) for t in tokens])]).astype(int).tolist()
        here = [x for x in taken if x[0] < b and a < x[1]]
        segments = [x for x in segments if not any(p < starts[x[1]] and starts[x[0]] < q for p, q in here)]
        if not segments:
            continue
        for i, j, y in field.decode(len(tokens), segments):
            added.append((y, starts[i], starts[j]))
    return base, sorted(base + added)


def written(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


FIELDS = [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()),
          *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS]]


def find(df: DataFrame, field: Field | None, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """Add `base_spans`, `spans` (kind:start:end, comma-joined) and the number of spans of each kind."""
    state = None if field is None else (field.weights.astype(np.float32), field.moves)

    def run(texts):
        f = None if state is None else Field(*state)
        got = [spans(t, f, s) if _MARK.search(t) else ([], []) for t in texts]
        counts = [pa.array([sum(x[0] == k for x in all_) for _, all_ in got], pa.int64()) for k in range(len(KINDS))]
        return [pa.array([written(b) for b, _ in got]), pa.array([written(a) for _, a in got]), *counts]

    return add_columns(df, text, FIELDS, run)


def masked(text: str, found) -> str:
    """The text with each span replaced by its kind; spans that overlap become one."""
    out, at = [], 0
    for k, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask(df: DataFrame, field: Field | None, s: Settings = Settings(), text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The rows with spans masked in the text (null stays null) and its length brought up to date."""
    columns = df.columns
    state = None if field is None else (field.weights.astype(np.float32), field.moves)

    def run(texts):
        f = None if state is None else Field(*state)
        return [pa.array([masked(t, spans(t, f, s)[1]) if _MARK.search(t) else t for t in texts], pa.string())]

    name = free_name(df, "masked_")
    got = add_columns(df, text, [T.StructField(name, T.StringType())], run)
    got = got.withColumn(text, F.when(F.col(text).isNotNull(), F.col(name))).drop(name)
    if n_chars in columns:
        got = got.withColumn(n_chars, F.length(text).cast("long"))
    return got.select(*columns)
