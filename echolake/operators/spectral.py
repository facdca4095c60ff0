"""Framing and Fourier transforms of chunked recordings.

Spark has no FFT, so frames are transformed by numpy inside Arrow batches. A task sees one chunk plus the samples its
last frames reach into, whatever the length of the recording; sums over frames are combined per chunk before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("recording_id",)
FRAME_BATCH = 2048


def hann(size: int) -> np.ndarray:
    return 0.5 * (1.0 - np.cos(2.0 * np.pi * np.arange(size) / (size - 1)))


def reach(chunks: DataFrame, chunk_size: int, extra: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Append to each chunk the ``extra`` samples that follow it; only those head slices are sent to neighbours."""
    far = -(-extra // chunk_size)
    target = F.explode(F.sequence(F.greatest(F.col("chunk") - far, F.lit(0)), F.col("chunk"))).alias("_to")
    room = (F.col("_to") - F.col("chunk") + 1) * chunk_size + extra
    parts = chunks.select(*keys, "chunk", "start_sample", "samples", target).select(
        *keys,
        F.col("_to").alias("chunk"),
        "start_sample",
        F.when(F.col("_to") == F.col("chunk"), F.col("samples"))
        .otherwise(F.slice("samples", F.lit(1), F.greatest(F.least(room, F.size("samples")), F.lit(0)).cast("int")))
        .alias("samples"),
        (F.col("_to") == F.col("chunk")).alias("_own"),
    )
    joined = parts.groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("start_sample", "samples"))).alias("_p"),
        F.max(F.when(F.col("_own"), F.size("samples"))).alias("core"),
    )
    return joined.where("core IS NOT NULL").select(
        *keys, "chunk", F.col("_p")[0]["start_sample"].alias("start_sample"), "core", F.flatten(F.col("_p.samples")).alias("samples")
    )


def _frames(samples: np.ndarray, start: int, core: int, fft: int, hop: int):
    """Frames that start inside the chunk core and end inside the samples at hand, in bounded batches."""
    first = -(-start // hop)
    last = min((start + core - 1) // hop, (start + len(samples) - fft) // hop)
    for lo in range(first, last + 1, FRAME_BATCH):
        cols = np.arange(lo, min(lo + FRAME_BATCH, last + 1))
        view = np.lib.stride_tricks.sliding_window_view(samples, fft)
        yield cols, view[cols * hop - start]


def _rows(batch: pa.RecordBatch):
    samples = batch.column("samples")
    flat, offsets = samples.values.to_numpy(zero_copy_only=False), samples.offsets.to_numpy()
    starts, cores = batch.column("start_sample").to_pylist(), batch.column("core").to_pylist()
    for i in range(batch.num_rows):
        yield i, flat[offsets[i]:offsets[i + 1]], starts[i], cores[i]


def _listed(matrix: np.ndarray) -> pa.ListArray:
    n, m = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(matrix.ravel()))


def _schema(df: DataFrame, keys: Sequence[str], *fields: T.StructField) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + list(fields))


_ARRAY = T.ArrayType(T.DoubleType())


def stft(chunks: DataFrame, chunk_size: int, fft: int, hop: int, sample_rate: float, complex_output: bool = False,
         keys: Sequence[str] = KEYS) -> DataFrame:
    """Hann-windowed transform columns: (col, t, mags) or (col, t, re, im)."""
    names = ("re", "im") if complex_output else ("mags",)
    schema = _schema(chunks, keys, T.StructField("col", T.LongType()), T.StructField("t", T.DoubleType()),
                     *[T.StructField(n, _ARRAY) for n in names])
    kept = list(keys)

    def run(batches):
        window = hann(fft)
        for batch in batches:
            for i, samples, start, core in _rows(batch):
                for cols, frames in _frames(samples, start, core, fft, hop):
                    spectrum = np.fft.rfft(frames * window, axis=1)
                    parts = (spectrum.real, spectrum.imag) if complex_output else (np.abs(spectrum),)
                    heads = [pa.array([batch.column(k)[i].as_py()] * len(cols), batch.column(k).type) for k in kept]
                    yield pa.RecordBatch.from_arrays(
                        [*heads, pa.array(cols), pa.array(cols * hop / sample_rate), *[_listed(p) for p in parts]],
                        names=[*kept, "col", "t", *names],
                    )

    return reach(chunks, chunk_size, fft - 1, keys).mapInArrow(run, schema)


def frame_sums(chunks: DataFrame, chunk_size: int, fft: int, hop: int, power: bool, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per-bin sums of |X| or |X|^2 over all frames, with the frame count: one partial row per chunk and bin."""
    schema = _schema(chunks, keys, T.StructField("frames", T.LongType()), T.StructField("sums", _ARRAY))
    kept = list(keys)

    def run(batches):
        window = hann(fft)
        for batch in batches:
            for i, samples, start, core in _rows(batch):
                count, total = 0, np.zeros(fft // 2 + 1)
                for cols, frames in _frames(samples, start, core, fft, hop):
                    mag = np.abs(np.fft.rfft(frames * window, axis=1))
                    total += (mag * mag if power else mag).sum(axis=0)
                    count += len(cols)
                if count:
                    heads = [pa.array([batch.column(k)[i].as_py()], batch.column(k).type) for k in kept]
                    yield pa.RecordBatch.from_arrays(
                        [*heads, pa.array([count]), _listed(total.reshape(1, -1))], names=[*kept, "frames", "sums"]
                    )

    partial = reach(chunks, chunk_size, fft - 1, keys).mapInArrow(run, schema)
    return (
        partial.select(*keys, "frames", F.posexplode("sums").alias("bin", "s"))
        .groupBy(*keys, "bin")
        .agg(F.sum("frames").alias("frames"), F.sum("s").alias("total"))
    )


def welch_psd(chunks: DataFrame, chunk_size: int, fft: int, sample_rate: float | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """One-sided power spectral density in dB per bin, half-overlapping frames; the rate may be a column among ``keys``."""
    return density_db(frame_sums(chunks, chunk_size, fft, fft // 2, power=True, keys=keys), fft, sample_rate, keys)


def density_db(sums: DataFrame, fft: int, sample_rate: float | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Densities from sums(keys, bin, frames, total) of squared magnitudes."""
    norm = float((hann(fft) ** 2).sum()) * sample_rate
    sided = F.when((F.col("bin") > 0) & (F.col("bin") < fft // 2), 2.0).otherwise(1.0)
    psd = F.col("total") / (F.col("frames") * norm) * sided
    return sums.select(
        *keys, "bin", "frames", (F.col("bin") * (sample_rate / fft)).alias("freq_hz"),
        F.when(psd > 0, 10 * F.log10(psd)).otherwise(-200.0).alias("power_db"),
    )


def mean_spectrum(chunks: DataFrame, chunk_size: int, fft: int, keys: Sequence[str] = KEYS, min_frames: int = 2) -> DataFrame:
    """Mean magnitude per bin over half-overlapping frames (the learned noise floor)."""
    sums = frame_sums(chunks, chunk_size, fft, fft // 2, power=False, keys=keys).where(F.col("frames") >= min_frames)
    return sums.select(*keys, "bin", "frames", (F.col("total") / F.col("frames")).alias("mean_mag"))


def learning_fft(sample_rate: int) -> int:
    return 8192 if sample_rate >= 192_000 else 4096


def reassigned(chunks: DataFrame, lengths: DataFrame, chunk_size: int, fft: int, hop: int, threshold_db: float,
               per_hop: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Energy moved to its local centre of time and frequency, summed on the (col, bin) grid.

    Each chunk combines its own cells first. The time displacement is in samples; ``per_hop`` scales it to columns.
    """
    schema = _schema(chunks, keys, T.StructField("t_hat", T.DoubleType()), T.StructField("bin", T.LongType()),
                     T.StructField("power", T.DoubleType()))
    kept = list(keys)
    scale = float(hop) if per_hop else 1.0

    def run(batches):
        ramp = np.arange(fft) - (fft - 1) / 2.0
        h = hann(fft)
        dh = -np.pi / (fft - 1) * np.sin(2.0 * np.pi * np.arange(fft) / (fft - 1))
        floor = 10.0 ** (threshold_db / 10.0)
        bins = np.arange(fft // 2 + 1)
        for batch in batches:
            for i, samples, start, core in _rows(batch):
                for cols, frames in _frames(samples, start, core, fft, hop):
                    xh, xt, xd = (np.fft.rfft(frames * w, axis=1) for w in (h, ramp * h, dh))
                    power = xh.real ** 2 + xh.imag ** 2
                    keep = power >= floor
                    base = xh[keep]
                    t_hat = np.broadcast_to(cols[:, None], power.shape)[keep] - (xt[keep] / base).real / scale
                    f_hat = np.broadcast_to(bins, power.shape)[keep] + fft / (2 * np.pi) * (xd[keep] / base).imag
                    f_hat = np.clip(np.sign(f_hat) * np.floor(np.abs(f_hat) + 0.5), 0, fft // 2).astype(np.int64)
                    heads = [pa.array([batch.column(k)[i].as_py()] * len(base), batch.column(k).type) for k in kept]
                    yield pa.RecordBatch.from_arrays(
                        [*heads, pa.array(t_hat), pa.array(f_hat), pa.array(power[keep])], names=[*kept, "t_hat", "bin", "power"]
                    )

    moved = reach(chunks, chunk_size, fft - 1, keys).mapInArrow(run, schema)
    cols = F.floor((F.col("n") - fft) / hop)
    placed = moved.join(lengths, list(keys)).withColumn(
        "col", F.greatest(F.lit(0), F.least(F.round("t_hat"), cols)).cast("long")
    )
    cells = placed.groupBy(*keys, "col", "bin").agg(F.sum("power").alias("power"))
    return cells.select(*keys, "col", "bin", (10 * F.log10("power")).alias("power_db"))


def frame_rows(samples: DataFrame, chunk: int, fft: int, hop: int, lengths: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frames as rows of samples (col, pos, y), for work that needs no transform."""
    n_cols = F.floor((F.col("n") - fft) / hop)
    first = F.greatest(F.ceil((F.col("idx") - fft + 1) / hop), F.lit(0))
    last = F.least(F.floor(F.col("idx") / hop), n_cols)
    return (
        samples.join(lengths, list(keys))
        .where(first <= last)
        .withColumn("col", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        .select(*keys, "col", (F.col("idx") - F.col("col") * hop).alias("pos"), "y")
    )


def frame_power(frames):
    """|X|^2 of one Hann-windowed frame per row."""
    def power(series: pd.Series) -> pd.Series:
        return pd.Series([np.abs(np.fft.rfft(np.asarray(f, dtype=float) * hann(len(f)))) ** 2 for f in series])

    return F.pandas_udf(power, "array<double>")(frames)


def ultrasonic_share(samples: DataFrame, lengths: DataFrame, sample_rate: int, fft: int = 4096, cut_hz: float = 20_000.0,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of energy above the cut in up to three frames around the middle."""
    keys = list(keys)
    start = F.greatest(F.floor(F.col("n") / 2) - 2 * fft, F.lit(0))
    near = samples.join(lengths, keys).withColumn("_o", F.col("idx") - start)
    near = near.where((F.col("_o") >= 0) & (F.col("_o") < 3 * fft)).withColumn("_f", F.floor(F.col("_o") / fft))
    frames = near.groupBy(*keys, "_f").agg(F.array_sort(F.collect_list(F.struct("idx", "y")))["y"].alias("y")).where(F.size("y") == fft)
    cut = int(cut_hz / (sample_rate / fft))
    energy = frames.select(*keys, frame_power("y").alias("p"))
    total = energy.select(
        *keys,
        F.aggregate(F.slice("p", 1, cut), F.lit(0.0), lambda a, x: a + x).alias("below"),
        F.aggregate(F.slice("p", cut + 1, fft), F.lit(0.0), lambda a, x: a + x).alias("above"),
    ).groupBy(*keys).agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    share = F.when(F.col("below") + F.col("above") >= 1e-20, F.col("above") / (F.col("below") + F.col("above")))
    return total.select(*keys, share.alias("share")).select(
        *keys, "share",
        F.when(F.col("share") > 0.5, "ultrasonic")
        .when((F.col("share") > 0.001) & F.lit(sample_rate >= 256_000), "possible").otherwise("none").alias("content"),
    )
