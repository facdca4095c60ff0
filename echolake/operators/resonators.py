"""Banks of single-pole complex resonators: spectra with a bandwidth per bin instead of a window length.

Each bin keeps z <- (1 - alpha) z + alpha x exp(-i w n). A chunk is reduced to what it leaves from rest, the decay is
carried over chunks, and the second pass starts every chunk from its exact state.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.operators.filters import carry_states

KEYS = ("recording_id",)


@dataclass(frozen=True)
class Bank:
    """Frequencies, smoothing factors, the bank row shown in each output row, and the magnitude scale."""

    freqs: np.ndarray
    alphas: np.ndarray
    rows: np.ndarray
    scale: float
    rate: float


def spectrum_bank(rate: float, fft: int, bandwidth_hz: float, q: float | None = None, log: bool = False,
                  hz_range: tuple[float, float] | None = None, density: float = 1.0) -> Bank:
    """Linear or logarithmic layout over a range; constant bandwidth, or bandwidth f/q where ``q`` is given."""
    nyquist, rows = rate / 2, fft // 2 + 1
    count = min(max(int(rows * density + 0.5), min(8, rows)), rows) if density < 0.999 else rows
    if hz_range:
        lo, hi = max(hz_range[0], 0.01), max(min(hz_range[1], nyquist), hz_range[0] + 0.1)
    else:
        lo, hi = (20.0, max(nyquist, 40.0)) if log else (0.01, nyquist)
    if log:
        hi = max(hi, 2 * lo)
        freqs = lo * (hi / lo) ** (np.arange(count) / max(count - 1, 1))
        target = lo * (hi / lo) ** (np.arange(rows) / max(rows - 1, 1))
        shown = np.abs(np.log(freqs[None, :]) - np.log(target[:, None])).argmin(axis=1)
    else:
        freqs = np.maximum(lo + np.arange(count) * (hi - lo) / max(count - 1, 1), 0.01)
        shown = np.floor(np.arange(rows) / max(rows - 1, 1) * (count - 1) + 0.5).astype(int)
    width = np.clip(freqs / max(q, 0.1), 2.0, nyquist * 0.99) if q else np.full(count, min(max(bandwidth_hz, 0.1), nyquist * 0.99))
    alphas = 1.0 - np.exp(-2 * math.pi * width / rate)
    return Bank(freqs, alphas, shown, fft / 2, rate)


def note_bank(rate: float, first_note: int, count: int, q: float = 24.0, max_tau: float = 0.03) -> Bank:
    """One resonator per semitone below Nyquist; the time constant q/(pi f) is capped."""
    notes = np.arange(first_note, first_note + count)
    freqs = 440.0 * 2.0 ** ((notes - 69) / 12)
    freqs = freqs[freqs < rate / 2]
    tau = np.minimum(q / (math.pi * freqs), max_tau)
    return Bank(freqs, 1.0 - np.exp(-1.0 / (tau * rate)), np.arange(len(freqs)), 1.0, rate)


def warmup(rate: float, bandwidth_hz: float) -> int:
    """Samples until a bin has settled: five time constants, at least 256."""
    return max(math.ceil(5 * rate / (2 * math.pi * max(bandwidth_hz, 1.0))), 256)


def run_bank(bank: Bank, x: np.ndarray, start: int, hop: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states at the end of every whole hop, state after all samples); ``start`` is the index of x[0]."""
    omega = 2 * math.pi * bank.freqs / bank.rate
    decay = 1.0 - bank.alphas
    whole = len(x) // hop
    kernel = bank.alphas * decay ** np.arange(hop - 1, -1, -1)[:, None] * np.exp(-1j * omega * np.arange(hop)[:, None])
    gained = (x[:whole * hop].reshape(whole, hop) @ kernel) * np.exp(-1j * np.outer(start + np.arange(whole) * hop, omega))
    ends = np.empty_like(gained)
    for j in range(whole):
        state = decay**hop * state + gained[j]
        ends[j] = state
    tail = x[whole * hop:]
    if len(tail):
        m = len(tail)
        at = start + whole * hop + np.arange(m)
        state = decay**m * state + (bank.alphas * decay ** np.arange(m - 1, -1, -1)[:, None] * np.exp(-1j * np.outer(at, omega)) * tail[:, None]).sum(axis=0)
    return ends, state


def resonator_columns(chunks: DataFrame, bank: Bank, chunk_size: int, hop: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Columns (col, t, mags) at the end of every hop; the hop must divide the chunk size."""
    if chunk_size % hop:
        raise ValueError("hop must divide the chunk size")
    keys = list(keys)
    k = len(bank.freqs)

    def leave(samples: pd.Series, starts: pd.Series) -> pd.Series:
        zero = np.zeros(k, dtype=complex)
        ends = (run_bank(bank, np.asarray(x, dtype=float), s, hop, zero)[1] for x, s in zip(samples, starts))
        return pd.Series([np.concatenate([z.real, z.imag]) for z in ends])

    def columns(samples: pd.Series, starts: pd.Series, states: pd.Series) -> pd.Series:
        out = []
        for x, s, z in zip(samples, starts, states):
            z = np.asarray(z, dtype=float)
            ends, _ = run_bank(bank, np.asarray(x, dtype=float), s, hop, z[:k] + 1j * z[k:])
            out.append(list((np.abs(ends) * bank.scale)[:, bank.rows]))
        return pd.Series(out)

    decay = np.tile(1.0 - bank.alphas, 2)
    ends = chunks.select(*keys, "chunk", F.size("samples").alias("n"), F.pandas_udf(leave, "array<double>")("samples", "start_sample").alias("left"), F.lit(0.0).alias("x0"))
    states = carry_states(ends, lambda s, n, memo: decay**n * s, np.zeros(2 * k), keys)
    done = chunks.join(states, [*keys, "chunk"]).select(
        *keys, "start_sample", F.pandas_udf(columns, "array<array<double>>")("samples", "start_sample", "state").alias("c")
    )
    rows = done.select(*keys, "start_sample", F.posexplode("c").alias("p", "mags"))
    col = (F.col("start_sample") / hop).cast("long") + F.col("p")
    return rows.select(*keys, col.alias("col"), ((col + 1) * hop / bank.rate).alias("t"), "mags")
