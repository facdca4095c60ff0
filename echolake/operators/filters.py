"""Sample-domain filters as chunk-parallel jobs.

Linear recursions are exact across chunks: each chunk reports the state it would leave behind from rest, the affine maps
are composed over chunks in two levels, and a second pass runs every chunk from its true starting state. The non-linear
envelope contracts, so a halo of known length gives the same values. Spectral filters need only neighbouring samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.operators.spectral import hann
from echolake.plans.chunking import chunk_window, div, lengths, to_chunks, to_samples, with_halo

KEYS = ("recording_id",)
BLOCK = 128
CARRY_FAN = 1024


@dataclass(frozen=True)
class Linear:
    """s' = A s + b x, y = c.s + d x, started from s = init * (first input)."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    init: np.ndarray

    def then(self, other: Linear) -> Linear:
        n, m = len(self.b), len(other.b)
        a = np.block([[self.a, np.zeros((n, m))], [np.outer(other.b, self.c), other.a]])
        first = float(self.c @ self.init + self.d)
        return Linear(
            a, np.concatenate([self.b, other.b * self.d]), np.concatenate([other.d * self.c, other.c]),
            self.d * other.d, np.concatenate([self.init, other.init * first]),
        )

    def plus(self, other: Linear) -> Linear:
        n, m = len(self.b), len(other.b)
        a = np.block([[self.a, np.zeros((n, m))], [np.zeros((m, n)), other.a]])
        cat = lambda x, y: np.concatenate([x, y])
        return Linear(a, cat(self.b, other.b), cat(self.c, other.c), self.d + other.d, cat(self.init, other.init))

    def scaled(self, k: float) -> Linear:
        return Linear(self.a, self.b, self.c * k, self.d * k, self.init)


def gain(k: float = 1.0) -> Linear:
    return Linear(np.zeros((0, 0)), np.zeros(0), np.zeros(0), k, np.zeros(0))


def low_pass(cutoff: float, rate: float, passes: int = 1) -> Linear:
    dt, rc = 1.0 / rate, 1.0 / (2 * math.pi * cutoff)
    k = dt / (rc + dt)
    one = Linear(np.array([[1 - k]]), np.array([k]), np.array([1 - k]), k, np.ones(1))
    out = one
    for _ in range(passes - 1):
        out = out.then(one)
    return out


def without(system: Linear) -> Linear:
    """The input minus the system's output."""
    return gain().plus(system.scaled(-1.0))


def high_pass(cutoff: float, rate: float) -> Linear:
    dt, rc = 1.0 / rate, 1.0 / (2 * math.pi * cutoff)
    k = rc / (rc + dt)
    return Linear(np.array([[k, -k], [0.0, 0.0]]), np.array([k, 1.0]), np.array([k, -k]), k, np.array([0.0, 1.0]))


def band_pass(low_hz: float, high_hz: float, rate: float, passes: int = 4) -> Linear:
    out = gain()
    if 0 < low_hz < rate / 2:
        out = out.then(without(low_pass(low_hz, rate, passes)))
    if 0 < high_hz < rate / 2:
        out = out.then(low_pass(high_hz, rate, passes))
    return out


def biquad(b0: float, b1: float, b2: float, a1: float, a2: float) -> Linear:
    return Linear(np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0]), b0, np.zeros(2))


def _section(center: float, q: float, rate: float, gain_db: float | None) -> Linear:
    """Band-reject section, or a peaking one where a gain is given (standard cookbook forms)."""
    w = 2 * math.pi * center / rate
    al, co = math.sin(w) / (2 * q), math.cos(w)
    if gain_db is None:
        num, den = (1.0, -2 * co, 1.0), (1 + al, -2 * co, 1 - al)
    else:
        g = 10 ** (gain_db / 40)
        num, den = (1 + al * g, -2 * co, 1 - al * g), (1 + al / g, -2 * co, 1 - al / g)
    return biquad(*(n / den[0] for n in num), den[1] / den[0], den[2] / den[0])


def notch_chain(bands: Sequence[tuple[float, float]], rate: float, suppression: float = 0.0) -> Linear:
    """Band-reject sections at (centre, q), with optional cuts at twice and three times each centre."""
    usable = [(c, q) for c, q in bands if c > 0 and q > 0]
    out = gain()
    for c, q in usable:
        if c < rate / 2:
            out = out.then(_section(c, q, rate, None))
    if suppression > 0:
        for c, q in usable:
            for m in (2.0, 3.0):
                if c * m < rate / 2:
                    out = out.then(_section(c * m, max(q * 0.7, 3.0), rate, -48.0 * suppression))
    return out


def harmonics_bounds(low_hz: float, high_hz: float, bands: int) -> tuple[float, float] | None:
    if bands != 4 or high_hz <= 0 or low_hz >= high_hz:
        return None
    lo, hi = max(2 * low_hz, high_hz), 2 * high_hz
    return (lo, hi) if lo < hi else None


def fast_equalizer(low_hz: float, high_hz: float, gains_db: dict[str, float], bands: int, rate: float) -> Linear:
    """Recursive equaliser: one linear system whose outputs are the weighted bands."""
    g = {k: 10 ** (x / 20) for k, x in gains_db.items()}
    low = low_pass(low_hz, rate, 4)
    rest = without(low)
    mid = rest.then(low_pass(high_hz, rate, 4))
    out = low.scaled(g["below"]).plus(mid.scaled(g["selected"]))
    above = g["above"] if bands >= 3 else g["selected"]
    top = rest.then(without(low_pass(high_hz, rate, 4)))
    bounds = harmonics_bounds(low_hz, high_hz, bands)
    if not bounds:
        return out.plus(top.scaled(above))
    beyond = top.then(without(low_pass(bounds[1], rate, 4)))
    from_lower = top.then(without(low_pass(bounds[0], rate, 4))) if bounds[0] > high_hz else top
    harmonics = from_lower.plus(beyond.scaled(-1.0))
    remainder = top.plus(from_lower.scaled(-1.0)).plus(beyond)
    return out.plus(harmonics.scaled(g["harmonics"])).plus(remainder.scaled(above))


class _Runner:
    """Block form of a linear system: matrix products inside blocks, one small step between them."""

    def __init__(self, sys: Linear):
        self.sys = sys
        powers = [np.eye(len(sys.b))]
        for _ in range(BLOCK):
            powers.append(sys.a @ powers[-1])
        self.powers = np.stack(powers)
        response = np.array([sys.d] + [float(sys.c @ p @ sys.b) for p in powers[:BLOCK - 1]])
        lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
        self.inside = np.where(lag >= 0, response[np.clip(lag, 0, None)], 0.0)
        self.observe = np.stack([sys.c @ p for p in powers[:BLOCK]]) if len(sys.b) else np.zeros((BLOCK, 0))
        self.absorb = np.stack([p @ sys.b for p in powers[:BLOCK][::-1]], axis=1) if len(sys.b) else np.zeros((0, BLOCK))

    def run(self, x: np.ndarray, state: np.ndarray, want_output: bool = True):
        whole = len(x) // BLOCK
        blocks = x[:whole * BLOCK].reshape(whole, BLOCK)
        gained = blocks @ self.absorb.T
        states = np.empty((whole, len(state)))
        for i in range(whole):
            states[i] = state
            state = self.powers[BLOCK] @ state + gained[i]
        tail = x[whole * BLOCK:]
        out = None
        if want_output:
            body = blocks @ self.inside.T + states @ self.observe.T
            m = len(tail)
            last = self.inside[:m, :m] @ tail + self.observe[:m] @ state
            out = np.concatenate([body.ravel(), last])
        if len(tail):
            state = self.powers[len(tail)] @ state + self.absorb[:, BLOCK - len(tail):] @ tail
        return out, state


def linear_filter(chunks: DataFrame, system: Linear, keys: Sequence[str] = KEYS) -> DataFrame:
    """Run a linear system over chunk arrays (keys, chunk, start_sample, samples), exactly as one pass would."""
    keys = list(keys)
    size = len(system.b)
    if size == 0:
        return chunks.withColumn("samples", F.transform("samples", lambda x: x * F.lit(float(system.d))))
    runner = _Runner(system)

    def leave(samples: pd.Series) -> pd.Series:
        return pd.Series([runner.run(np.asarray(x, dtype=float), np.zeros(size), False)[1] for x in samples])

    def through(samples: pd.Series, states: pd.Series) -> pd.Series:
        return pd.Series([runner.run(np.asarray(x, dtype=float), np.asarray(s, dtype=float))[0] for x, s in zip(samples, states)])

    ends = chunks.select(
        *keys, "chunk", F.size("samples").alias("n"), F.pandas_udf(leave, "array<double>")("samples").alias("left"),
        F.when(F.col("start_sample") == 0, F.get("samples", F.lit(0)).cast("double")).alias("x0"),
    )
    states = carry_states(ends, _power_step(system.a), system.init, keys)
    joined = chunks.join(states, [*keys, "chunk"])
    return joined.withColumn("samples", F.pandas_udf(through, "array<double>")("samples", "state")).drop("state")


def carry_states(ends: DataFrame, advance: Callable, init: np.ndarray, keys: list[str]) -> DataFrame:
    """Starting state per chunk from ends(keys, chunk, n, left, x0): affine maps composed in blocks, then over blocks.

    A block lists at most ``CARRY_FAN`` chunks; the upper list is that many times shorter than the chunk list.
    """

    def scan(ns, lefts, state):
        """States before each entry, and the state after the last one."""
        memo, before = {}, []
        for n, left in zip(ns, lefts):
            before.append(state)
            state = advance(state, int(n), memo) + np.asarray(left, dtype=float)
        return before, state

    def compose(ns: pd.Series, lefts: pd.Series) -> pd.Series:
        return pd.Series([scan(n, x, np.zeros(len(init)))[1] for n, x in zip(ns, lefts)])

    def upper(ns: pd.Series, lefts: pd.Series, firsts: pd.Series) -> pd.Series:
        return pd.Series([scan(n, x, init * (0.0 if pd.isna(f) else f))[0] for n, x, f in zip(ns, lefts, firsts)])

    def lower(ns: pd.Series, lefts: pd.Series, begins: pd.Series) -> pd.Series:
        return pd.Series([scan(n, x, np.asarray(b, dtype=float))[0] for n, x, b in zip(ns, lefts, begins)])

    nested = "array<array<double>>"
    blocks = ends.groupBy(*keys, div("chunk", CARRY_FAN).alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("chunk", "n", "left"))).alias("i"), F.sum("n").alias("n"), F.max("x0").alias("x0")
    )
    totals = blocks.select(*keys, "blk", "n", "x0", F.pandas_udf(compose, "array<double>")("i.n", "i.left").alias("left"))
    tops = totals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("blk", "n", "left"))).alias("t"), F.max("x0").alias("x0"))
    tops = tops.select(*keys, F.col("t.blk").alias("blk"), F.pandas_udf(upper, nested)("t.n", "t.left", "x0").alias("begin"))
    begins = tops.select(*keys, F.inline(F.arrays_zip("blk", "begin")))
    opened = blocks.select(*keys, "blk", "i").join(begins, [*keys, "blk"])
    states = opened.select(*keys, F.col("i.chunk").alias("chunk"), F.pandas_udf(lower, nested)("i.n", "i.left", "begin").alias("state"))
    return states.select(*keys, F.inline(F.arrays_zip("chunk", "state")))


def _power_step(a: np.ndarray) -> Callable:
    def advance(state, n, memo):
        if n not in memo:
            memo[n] = np.linalg.matrix_power(a, n)
        return memo[n] @ state

    return advance


def attack_release(samples: DataFrame, window: int, chunk: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Envelope that rises with 1/w and falls with 1/4w; a halo of 64.5 w samples makes each chunk independent."""
    keys = list(keys)
    halo = math.ceil(64.5 * window)
    rise, fall = 1.0 / window, 1.0 / (4.0 * window)
    rows = with_halo(samples, chunk, before=halo)
    arrays = rows.groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("idx", "y"))).alias("a"), F.max("core").alias("has")
    ).where("has").select(*keys, "chunk", F.col("a")[0]["idx"].alias("from"), F.col("a.y").alias("y"))

    def follow(series: pd.Series) -> pd.Series:
        """All chunks of the batch advance together, one vector step per sample."""
        rows_ = [np.abs(np.asarray(x, dtype=float)) for x in series]
        longest = max((len(x) for x in rows_), default=0)
        grid = np.zeros((longest, len(rows_)))
        for j, x in enumerate(rows_):
            grid[:len(x), j] = x
        state = np.zeros(len(rows_))
        for i in range(longest):
            gap = grid[i] - state
            state = state + np.where(gap > 0, rise, fall) * gap
            grid[i] = state
        return pd.Series([grid[:len(x), j] for j, x in enumerate(rows_)])

    followed = arrays.withColumn("env", F.pandas_udf(follow, "array<double>")("y"))
    env = followed.select(*keys, "chunk", "from", F.posexplode(F.arrays_zip("y", "env")).alias("p", "v"))
    out = env.select(*keys, "chunk", (F.col("from") + F.col("p")).alias("idx"), F.col("v.y").alias("y"), F.col("v.env").alias("env"))
    return out.where(div("idx", chunk) == F.col("chunk"))


def around(chunks: DataFrame, size: int, extra: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Chunk arrays widened by up to ``extra`` samples on both sides; only edge slices travel."""
    far = -(-extra // size)
    n = F.size("samples")
    to, own = F.col("_to"), F.col("chunk")
    parts = chunks.select(*keys, "chunk", "start_sample", "samples", F.explode(F.sequence(F.greatest(own - far, F.lit(0)), own + far)).alias("_to"))
    skip = F.greatest((to - own) * size - extra, F.lit(0))
    take = F.least(n, (to - own + 1) * size + extra) - skip
    piece = F.slice("samples", (skip + 1).cast("int"), F.greatest(take, F.lit(0)).cast("int"))
    parts = parts.where((skip < n) & (take > 0)).select(
        *keys, to.alias("chunk"), (F.col("start_sample") + skip).alias("at"), piece.alias("samples"),
        F.when(to == own, F.col("start_sample")).alias("own_start"), F.when(to == own, n).alias("own_n"),
    )
    wide = parts.groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("at", "samples"))).alias("p"), F.max("own_start").alias("start_sample"), F.max("own_n").alias("core")
    )
    return wide.where("core IS NOT NULL").select(
        *keys, "chunk", "start_sample", "core", F.col("p")[0]["at"].alias("at"), F.flatten("p.samples").alias("samples")
    )


def _overlap_add(x: np.ndarray, at: int, start: int, core: int, fft: int, change: Callable) -> np.ndarray:
    """Windowed analysis, spectral change and weighted resynthesis of samples [start, start + core)."""
    hop, window = fft // 2, hann(fft)
    first = max(-(-(start - fft + 1) // hop), 0)
    last = (start + core - 1) // hop
    base = first * hop
    span = np.zeros((last - first) * hop + fft)
    lo, hi = max(at, base), min(at + len(x), base + len(span))
    span[lo - base:hi - base] = x[lo - at:hi - at]
    frames = np.lib.stride_tricks.sliding_window_view(span, fft)[::hop] * window
    back = np.fft.irfft(change(np.fft.rfft(frames, axis=1)), n=fft, axis=1) * window
    out, weight = np.zeros(len(span)), np.zeros(len(span))
    for k in range(len(back)):
        out[k * hop:k * hop + fft] += back[k]
        weight[k * hop:k * hop + fft] += window * window
    out = np.where(weight > 1e-6, out / np.where(weight > 1e-6, weight, 1.0), out)
    return out[start - base:start - base + core]


def spectral_gain(chunks: DataFrame, size: int, fft: int, gains: np.ndarray, keys: Sequence[str] = KEYS) -> DataFrame:
    """Multiply every transform bin by a fixed gain (equalisers, weighting curves, band splits)."""
    def run(x: pd.Series, at: pd.Series, start: pd.Series, core: pd.Series) -> pd.Series:
        return pd.Series([_overlap_add(np.asarray(a, dtype=float), p, s, c, fft, lambda z: z * gains) for a, p, s, c in zip(x, at, start, core)])

    wide = around(chunks, size, fft, keys)
    return wide.select(*keys, "chunk", "start_sample", F.pandas_udf(run, "array<double>")("samples", "at", "start_sample", "core").alias("samples"))


def spectral_subtraction(chunks: DataFrame, floors: DataFrame, size: int, fft: int, strength: float, floor_factor: float,
                         suppression: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Take a learned floor(keys, floor array) off each magnitude, keeping phase; recordings without one pass through."""
    if strength <= 0:
        return chunks

    def one(x, at, start, core, floor):
        if floor is None:
            return np.asarray(x[start - at:start - at + core], dtype=float)
        base = np.asarray(floor, dtype=float)
        raised = base.copy()
        for m in (2, 3):
            if suppression > 0:
                b = np.arange((len(base) - 1) // m + 1)
                raised[b * m] += np.where(base[b] >= 1e-20, suppression * base[b], 0.0)

        def change(z):
            mag = np.abs(z)
            clean = np.maximum(mag - raised * strength, floor_factor * mag)
            return np.where(mag > 1e-20, z * (clean / np.where(mag > 1e-20, mag, 1.0)), z)

        return _overlap_add(np.asarray(x, dtype=float), at, start, core, fft, change)

    def run(x: pd.Series, at: pd.Series, start: pd.Series, core: pd.Series, floor: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(x, at, start, core, floor)])

    wide = around(chunks, size, fft, keys).join(floors.select(*keys, "floor"), list(keys), "left")
    return wide.select(*keys, "chunk", "start_sample", F.pandas_udf(run, "array<double>")("samples", "at", "start_sample", "core", "floor").alias("samples"))


def equalizer_gains(fft: int, rate: float, low_hz: float, high_hz: float, gains_db: dict[str, float], bands: int) -> np.ndarray:
    f = np.arange(fft // 2 + 1) * (rate / fft)
    above = np.full(len(f), gains_db["above"] if bands >= 3 else gains_db["selected"])
    bounds = harmonics_bounds(low_hz, high_hz, bands)
    if bounds:
        above[(f >= bounds[0]) & (f <= bounds[1])] = gains_db["harmonics"]
    db = np.where(f < low_hz, gains_db["below"], np.where(f <= high_hz, gains_db["selected"], above))
    return 10 ** (db / 20)


def split_gains(fft: int, rate: float, low_hz: float, high_hz: float) -> list[np.ndarray]:
    """Gates of the three bands below, inside and above a range."""
    b = np.arange(fft // 2 + 1)
    lo, hi = math.floor(low_hz * fft / rate + 0.5), math.floor(high_hz * fft / rate + 0.5)
    return [(b < lo).astype(float), ((b >= lo) & (b <= hi)).astype(float), (b > hi).astype(float)]


def demodulate(samples: DataFrame, rate: float, carriers: Sequence[float], cutoff: float, chunk: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mix with carriers and low-pass. The filter is linear, so the carriers are averaged before one filter run."""
    phase = F.col("idx") * (2 * math.pi / rate)
    mix = sum((F.cos(phase * f) for f in carriers[1:]), F.cos(phase * carriers[0])) / len(carriers)
    mixed = samples.withColumn("y", F.col("y") * mix)
    return to_samples(linear_filter(to_chunks(mixed, chunk, keys), low_pass(cutoff, rate, 4), keys), keys).select(*keys, "idx", "y")


def comb_carriers(base: float, spacing: float, count: int) -> list[float]:
    return [base + i * spacing for i in range(count)]


def decimate(chunks: DataFrame, source_rate: int, target_rate: int, keys: Sequence[str] = KEYS) -> tuple[DataFrame, int]:
    """Low-pass at half the target rate, then keep every m-th sample; returns the samples and their rate."""
    m = math.floor(source_rate / target_rate + 0.5) if 0 < target_rate < source_rate else 1
    if m <= 1:
        return to_samples(chunks, keys), source_rate
    filtered = to_samples(linear_filter(chunks, low_pass(target_rate / 2, source_rate, 4), keys), keys)
    kept = filtered.where(F.col("idx") % m == 0).withColumn("idx", (F.col("idx") / m).cast("long")).drop("chunk")
    return kept, source_rate // m


def resample(samples: DataFrame, sample_counts: DataFrame, factor: float, chunk: int, stretch: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """Linear interpolation to ``factor`` times (or one over factor) the length: each sample emits the outputs that start at it."""
    step = 1.0 / factor if stretch else factor
    source = (lambda i: i / factor) if stretch else (lambda i: i * factor)
    total = F.floor(F.col("n") * factor) if stretch else F.floor(F.col("n") / factor)
    rows = with_halo(samples, chunk, after=1)
    nxt = F.coalesce(F.lead("y").over(chunk_window(keys)), F.col("y"))
    rows = rows.withColumn("y1", nxt).where("core").join(sample_counts, list(keys))
    lo, hi = F.floor(F.col("idx") / step) - 1, F.floor((F.col("idx") + 1) / step) + 1
    out = rows.withColumn("i", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.greatest(F.least(hi, total - 1), F.greatest(lo, F.lit(0))))))
    out = out.where((F.col("i") < total) & (F.floor(source(F.col("i"))) == F.col("idx")))
    frac = source(F.col("i")) - F.col("idx")
    return out.select(*keys, F.col("i").alias("idx"), (F.col("y") + frac * (F.col("y1") - F.col("y"))).alias("y"))


def apply_gain(samples: DataFrame, db: float | Column) -> DataFrame:
    db = db if isinstance(db, Column) else F.lit(float(db))
    return samples.withColumn("y", F.col("y") * F.pow(F.lit(10.0), db / 20))


def normalize_peak(samples: DataFrame, target_db: float = -3.0, keys: Sequence[str] = KEYS) -> DataFrame:
    peaks = samples.groupBy(*keys).agg(F.max(F.abs("y")).alias("_pk"))
    scale = F.when(F.col("_pk") > 1e-10, 10 ** (target_db / 20) / F.col("_pk")).otherwise(1.0)
    return samples.join(peaks, list(keys)).withColumn("y", F.col("y") * scale).drop("_pk")


@dataclass(frozen=True)
class Chain:
    """Order of the listening chain: equaliser or band-pass, notches, floor subtraction, then demodulation or expansion."""

    rate: int
    band: tuple[float, float] | None = None
    equalizer: dict[str, float] | None = None
    notches: Sequence[tuple[float, float]] = ()
    suppression: float = 0.0
    subtract: float = 0.0
    carriers: Sequence[float] = ()
    cutoff: float = 15_000.0
    expansion: float = 1.0
    fft: int = 4096


def run_chain(samples: DataFrame, chain: Chain, chunk: int, floors: DataFrame | None = None, keys: Sequence[str] = KEYS) -> tuple[DataFrame, float]:
    """Apply a chain; returns samples and the rate they are to be read at."""
    chunks = to_chunks(samples, chunk, keys)
    system = gain()
    if chain.band:
        system = fast_equalizer(*chain.band, chain.equalizer, 4, chain.rate) if chain.equalizer else band_pass(*chain.band, chain.rate)
    if chain.notches:
        system = system.then(notch_chain(chain.notches, chain.rate, chain.suppression))
    chunks = linear_filter(chunks, system, keys)
    if chain.subtract > 0 and floors is not None:
        chunks = spectral_subtraction(chunks, floors, chunk, chain.fft, chain.subtract, 0.02, keys=keys)
    out = to_samples(chunks, keys).select(*keys, "idx", "y")
    if chain.carriers:
        out = demodulate(out, chain.rate, chain.carriers, chain.cutoff, chunk, keys)
    return out, chain.rate / chain.expansion


def export_regions(samples: DataFrame, regions: DataFrame, chain: Chain, chunk: int, floors: DataFrame | None = None,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Processed samples of each region(keys, region_id, start_time, end_time), numbered from the region's start.

    The chain runs once over each recording, so overlapping regions share the work and need no warm-up.
    """
    from echolake.operators.intervals import points_in_intervals

    keys = list(keys)
    done, rate = run_chain(samples.join(regions.select(*keys).distinct(), keys, "left_semi"), chain, chunk, floors, keys)
    spans = regions.select(
        *keys, "region_id", F.floor(F.col("start_time") * chain.rate).alias("a"), F.floor(F.col("end_time") * chain.rate).alias("b")
    )
    hits = points_in_intervals(done, spans, keys, "idx", "a", "b", float(chunk), closed=False)
    return hits.select(*keys, "region_id", (F.col("idx") - F.col("a")).alias("pos"), "y", F.lit(float(rate)).alias("rate"))


def smooth_both_ways(series: DataFrame, tau: float, chunk: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exponential smoothing forwards, then backwards over the result (no lag); series(keys, idx, y)."""
    keys = list(keys)
    k = 1.0 - math.exp(-1.0 / tau) if tau > 0.5 else 1.0
    ema = Linear(np.array([[1 - k]]), np.array([k]), np.array([1 - k]), k, np.ones(1))
    last = lengths(series, keys)

    def one_way(s):
        return to_samples(linear_filter(to_chunks(s, chunk, keys), ema, keys), keys).select(*keys, "idx", "y")

    def flipped(s):
        return s.join(last, keys).select(*keys, (F.col("n") - 1 - F.col("idx")).alias("idx"), "y")

    return flipped(one_way(flipped(one_way(series))))


def adaptive_norm(energy: Column, peak: Column, local: Column, gain_db: float = 0.0, adapt: float = 0.0, floor_db: float = -80.0) -> Column:
    """Energy on a 0-1 amplitude scale against a blend of the global and the smoothed local maximum."""
    top = peak / 10 ** (gain_db / 10)
    floor = 10 ** (min(floor_db, 0.0) / 10)
    divisor = (1 - adapt) * top + adapt * F.greatest(local, floor * top) if adapt > 0 else top
    ratio = F.least(energy / divisor, F.lit(1.0))
    return F.when((divisor <= 0) | (ratio <= floor), F.lit(0.0)).otherwise(F.sqrt((ratio - floor) / max(1 - floor, 1e-38)))
