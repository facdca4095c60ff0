"""Measures on spectrum columns kept as arrays: no per-bin rows unless bins are what is grouped."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolake.functions.levels import grey_level, wrap_phase
from echolake.plans.chunking import div, running_last, with_chunk, with_halo

KEYS = ("recording_id",)
COLS_PER_CHUNK = 256


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def indices(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def at(arr: Column | str, i: Column) -> Column:
    return F.get(arr, i.cast("int"))


def with_previous(columns: DataFrame, names: Sequence[str], keys: Sequence[str] = KEYS, size: int = COLS_PER_CHUNK) -> DataFrame:
    """Each column next to its predecessor's arrays, by column chunks with one column of halo."""
    rows = with_halo(columns, size, before=1, idx="col")
    w = Window.partitionBy(*keys, "chunk").orderBy("col")
    return rows.select("*", *[F.lag(n).over(w).alias(f"prev_{n}") for n in names]).where("core").drop("core", "chunk")


def flux(columns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rise of magnitude against the previous column, with first-column rows left out."""
    paired = with_previous(columns, ["mags"], keys).where("prev_mags IS NOT NULL")
    rises = F.zip_with("prev_mags", "mags", lambda p, c: F.pow(F.greatest(c - p, F.lit(0.0)), F.lit(2.0)))
    last_peak = lambda a: F.size(a) - F.array_position(F.reverse(F.col(a)), F.array_max(a))
    return paired.select(
        *keys, "col", F.sqrt(total(rises)).alias("flux"), (last_peak("prev_mags") == last_peak("mags")).alias("same_peak")
    )


def flux_summary(fluxes: DataFrame, keys: Sequence[str] = KEYS, size: int = COLS_PER_CHUNK) -> DataFrame:
    """Mean and peak flux, pre-ringing columns and the share of active columns whose peak bin stays put."""
    keys = list(keys)
    peaks = fluxes.groupBy(*keys).agg(F.avg("flux").alias("flux_mean"), F.max("flux").alias("flux_peak"))
    rows = with_halo(fluxes, size, after=5, idx="col")
    ahead = Window.partitionBy(*keys, "chunk").orderBy("col").rowsBetween(1, 5)
    seen = rows.withColumn("ahead", F.max("flux").over(ahead)).where("core").join(peaks, keys)
    live = F.col("flux_peak") >= 1e-10
    quiet = (F.col("flux") >= 0.12 * F.col("flux_peak")) & (F.col("flux") < 0.4 * F.col("flux_peak"))
    active = live & (F.col("flux") >= 0.1 * F.col("flux_peak"))
    agg = seen.groupBy(*keys).agg(
        F.first("flux_mean").alias("flux_mean"), F.first("flux_peak").alias("flux_peak"),
        F.count_if(live & quiet & (F.col("ahead") > 0.4 * F.col("flux_peak"))).alias("preringing"),
        F.count_if(active).alias("_active"), F.count_if(active & F.col("same_peak")).alias("_stuck"),
    )
    return agg.withColumn("staircasing", F.when(F.col("_active") > 0, F.col("_stuck") / F.col("_active")).otherwise(0.0)).drop("_active", "_stuck")


def phase_deviation(columns: DataFrame, fft: int, hop: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per column and bin: deviation of the phase advance from the bin's nominal advance; null where too quiet."""
    paired = with_previous(columns, ["re", "im"], keys).where("prev_re IS NOT NULL")

    def dev(k):
        a, b, c, d = at("re", k), at("im", k), at("prev_re", k), at("prev_im", k)
        loud = (F.sqrt(a * a + b * b) >= 1e-8) & (F.sqrt(c * c + d * d) >= 1e-8)
        advance = F.atan2(b * c - a * d, a * c + b * d)
        return F.when(loud, wrap_phase(advance - k * (2 * math.pi * hop / fft)))

    return paired.select(*keys, "col", F.transform(indices(F.size("re")), dev).alias("deviation"))


def phase_coherence(deviations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per bin: one minus the RMS deviation over pi."""
    bins = deviations.select(*keys, F.posexplode("deviation").alias("bin", "dev"))
    rms = F.sqrt(F.avg(F.col("dev") * F.col("dev")))
    frame = 1 / (1 + F.abs("dev") / math.pi)
    return bins.groupBy(*keys, "bin").agg(
        F.coalesce(1 - F.least(rms / math.pi, F.lit(1.0)), F.lit(0.0)).alias("coherence"),
        F.avg(F.coalesce(frame, F.lit(0.0))).alias("frame_coherence"),
    )


def phase_angle(columns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Phase of every bin over pi, zero where too quiet."""
    def angle(r, i):
        return F.when(F.sqrt(r * r + i * i) < 1e-8, F.lit(0.0)).otherwise(F.atan2(i, r) / math.pi)

    return columns.select(*keys, "col", F.zip_with("re", "im", angle).alias("angle"))


# Cells (rows times bins) of a block of `flow_shift`, which bounds a worker's memory whatever the batch size.
FLOW_CELLS = 1 << 16


def flow_shift(columns: DataFrame, method: str, keys: Sequence[str] = KEYS, radius: int = 3, reach: int = 2) -> DataFrame:
    """Vertical movement of energy since the previous column, per bin: centroid, gradient or correlation."""
    paired = with_previous(columns, ["mags"], keys).where("prev_mags IS NOT NULL")

    def padded(m, left, right):
        return np.pad(m, ((0, 0), (left, right)))

    def box(m):
        """Sum over bins within ``radius``, edges truncated."""
        return np.lib.stride_tricks.sliding_window_view(padded(m, radius, radius), 2 * radius + 1, axis=1).sum(axis=2)

    def centroid(p, c):
        b = np.arange(c.shape[1], dtype=float)

        def center(m):
            weight = box(m * m)
            return np.where(weight > 0, box(m * m * b) / np.where(weight > 0, weight, 1.0), b)

        return (center(c) - center(p)) / radius

    def gradient(p, c):
        diff = padded(c - p, 1, 1)
        return (diff[:, 2:] - diff[:, :-2]) / (2 * np.maximum(np.maximum(c, p), 1e-10))

    def correlation(p, c):
        n = c.shape[1]
        wide = padded(p, reach + 1, reach + 1)
        scores = np.stack([box(c * wide[:, reach + 1 + d:reach + 1 + d + n]) for d in range(-reach - 1, reach + 2)])
        best = scores[1:-1].argmax(axis=0)
        d = best - reach
        before, peak, after = (np.take_along_axis(scores, (best + k)[None], axis=0)[0] for k in (0, 1, 2))
        curve = 2 * (2 * peak - before - after)
        fine = (np.abs(d) < reach) & (np.abs(curve) > 1e-10)
        out = np.where(fine, d + (before - after) / np.where(fine, curve, 1.0), d) / reach
        return np.where(box(c) < 1e-8, 0.0, out)

    measure = {"centroid": centroid, "gradient": gradient, "correlation": correlation}[method]

    source = paired.select(*keys, "col", "prev_mags", "mags")
    schema = T.StructType([*source.schema.fields[:-2], T.StructField("shift", T.ArrayType(T.DoubleType()))])

    def numbers(lists, size):
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)

    def run(batches):
        for batch in batches:
            sizes = np.stack([pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("prev_mags", "mags")], axis=1)
            for before, size in np.unique(sizes, axis=0).tolist() if len(sizes) else []:
                rows = np.flatnonzero((sizes == (before, size)).all(axis=1))
                step = max(FLOW_CELLS // max(size, 1), 1)
                for at in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[at:at + step]))
                    found = np.ascontiguousarray(measure(numbers(part.column("prev_mags"), before), numbers(part.column("mags"), size)))
                    cuts = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                    yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.ListArray.from_arrays(cuts, pa.array(found.ravel()))], names=schema.names)

    return source.mapInArrow(run, schema)


# First octave and octave count of the named chroma ranges.
CHROMA_RANGES = {"full": (0, 16), "audible": (0, 11), "musical": (0, 9), "ultrasound": (10, 6)}


def _note_cells(n_bins: int, hz_per_bin: float, range_name: str):
    first, count = CHROMA_RANGES[range_name]
    lo_hz, hi_hz = 16.35 * 2**first * 0.95, 15.89 * 2 ** (first + count) * 1.05
    cells: dict[tuple[int, int], list[int]] = {}
    for b in range(1, n_bins):
        f = b * hz_per_bin
        if not lo_hz <= f <= hi_hz:
            continue
        midi = 69 + 12 * math.log2(f / 440)
        if midi < 0:
            continue
        note = math.floor(midi + 0.5)
        octave = max(note // 12 - 1, 0)
        if first <= octave < first + count:
            cells.setdefault((note % 12, octave), []).append(b)
    return [(pc, o, min(bs), len(bs)) for (pc, o), bs in sorted(cells.items())]


def chroma(columns: DataFrame, n_bins: int, hz_per_bin: float, range_name: str = "full", keys: Sequence[str] = KEYS) -> DataFrame:
    """Energy per pitch class and octave of each column; the bins of a note are one slice of the array."""
    cells = _note_cells(n_bins, hz_per_bin, range_name)
    entries = [
        F.struct(
            F.lit(pc).alias("pitch_class"), F.lit(o).alias("octave"),
            total(F.transform(F.slice("mags", b + 1, k), lambda x: x * x)).alias("energy"),
        )
        for pc, o, b, k in cells
    ]
    return columns.select(*keys, "col", F.inline(F.array(*entries)))


def chroma_classes(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return cells.groupBy(*keys, "col", "pitch_class").agg(F.sum("energy").alias("energy"))


def chroma_maxima(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    keys = list(keys)
    notes = cells.groupBy(*keys, "col", "pitch_class").agg(F.sum("energy").alias("c"), F.max("energy").alias("n"))
    return notes.groupBy(*keys).agg(F.max("c").alias("max_class"), F.max("n").alias("max_note"))


def lod_rollup(columns: DataFrame, factor: int, lengths: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest magnitude per bin over groups of ``factor`` columns; a partial last group is dropped."""
    rows = columns.join(lengths, list(keys)).where(F.col("col") < F.floor(F.col("n") / factor) * factor)
    groups = rows.groupBy(*keys, div("col", factor).alias("col")).agg(F.collect_list("mags").alias("_m"))
    stacked = F.aggregate(
        F.slice("_m", 2, factor), F.get("_m", 0), lambda a, m: F.zip_with(a, m, lambda x, y: F.greatest(x, y))
    )
    return groups.select(*keys, "col", stacked.alias("mags"))


# Level-of-detail ladder as (fft, hop), and the transform sizes of the adaptive modes per level.
LOD_LADDER = [(256, 8192), (256, 2048), (256, 512), (256, 128), (256, 32), (256, 8), (256, 2), (128, 1)]
ADAPTIVE_FFT = {
    "XS": [1024, 1024, 512, 256, 128, 64, 32, 16],
    "S": [1024, 1024, 512, 512, 256, 128, 64, 32],
    "M": [1024, 1024, 1024, 512, 512, 256, 128, 64],
    "L": [2048, 2048, 2048, 1024, 512, 512, 256, 128],
}


def lod_plan(lengths: DataFrame, mode: str = "M", tile_cols: int = 256, keys: Sequence[str] = KEYS) -> DataFrame:
    """Transform size, hop and tile count of every level for each recording."""
    levels = F.array(*[
        F.struct(F.lit(i).alias("lod"), F.lit(ADAPTIVE_FFT[mode][i]).alias("fft"), F.lit(f).alias("base_fft"), F.lit(h).alias("hop"))
        for i, (f, h) in enumerate(LOD_LADDER)
    ])
    rows = lengths.select(*keys, "n", F.inline(levels))
    cols = F.floor((F.col("n") - F.col("base_fft")) / F.col("hop")) + 1
    return rows.select(
        *keys, "lod", "fft", "hop",
        F.when(F.col("n") < F.col("base_fft"), F.lit(0)).otherwise(F.ceil(cols / tile_cols)).cast("long").alias("tiles"),
    )


def overview_grid(columns: DataFrame, max_cols: int = 1024, max_rows: int = 256, keys: Sequence[str] = KEYS) -> DataFrame:
    """Nearest-column, nearest-bin grey levels against the loudest cell of the recording."""
    keys = list(keys)
    size = columns.groupBy(*keys).agg((F.max("col") + 1).alias("w"), F.max(F.array_max("mags")).alias("peak"))
    out_w, n = F.least(F.col("w"), F.lit(max_cols)), F.size("mags")
    rows = columns.join(size, keys).where("peak > 0").withColumn("x", F.ceil(F.col("col") * out_w / F.col("w")))
    rows = rows.where((F.col("x") < out_w) & (F.floor(F.col("x") * F.col("w") / out_w) == F.col("col")))
    out_h = F.least(n, F.lit(max_rows))
    picks = F.transform(indices(out_h), lambda y: at("mags", n - 1 - F.floor(y * n / out_h)))
    return rows.select(*keys, "x", "peak", F.posexplode(picks).alias("y", "mag")).select(
        *keys, "x", "y", grey_level(F.col("mag"), F.col("peak")).alias("grey")
    )


def center_shift(fft: int, hop: int) -> int:
    value = 1.0 - fft / (2.0 * max(hop, 1))
    return int(math.copysign(math.floor(abs(value) + 0.5), value))


def _shifted(columns: DataFrame, other: DataFrame, shift: int, last: str, keys: Sequence[str]) -> DataFrame:
    """Columns next to column (col + shift) of ``other``, clamped to its range."""
    target = F.least(F.greatest(F.col("col") + shift, F.lit(0)), F.col(last))
    return columns.withColumn("_at", target.cast("long")).join(other.withColumnRenamed("col", "_at"), [*keys, "_at"]).drop("_at")


def clean_gate(columns: DataFrame, gate: DataFrame, fft: int, hop: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scale each cell by a soft gate from a transform of the same signal."""
    keys = list(keys)
    top = gate.groupBy(*keys).agg(F.max(F.array_max("mags")).alias("_max"), F.max("col").alias("_last"))
    rows = _shifted(columns.join(top, keys), gate.select(*keys, "col", F.col("mags").alias("_g")), center_shift(fft, hop), "_last", keys)
    thresh = F.greatest(0.03 * F.greatest(F.col("_max"), F.lit(1e-9)), F.lit(1e-9))
    return rows.select(*keys, "col", F.zip_with("mags", "_g", lambda m, g: m * F.least(F.greatest(g / thresh, F.lit(0.0)), F.lit(1.0))).alias("mags"))


def adaptive_blend(sharp: DataFrame, fast: DataFrame, tonal: DataFrame, fft: int, tonal_fft: int, hop: int,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Blend two banks by how steady a short transform is: steady cells keep the sharp bank."""
    keys = list(keys)
    top = tonal.groupBy(*keys).agg(F.max(F.array_max("mags")).alias("_max"), F.max("col").alias("_last"))
    change = with_previous(tonal, ["mags"], keys).select(
        *keys, "col", F.zip_with("mags", F.coalesce("prev_mags", "mags"), lambda c, p: F.abs(c - p)).alias("_d")
    )
    fast_last = fast.groupBy(*keys).agg(F.max("col").alias("_flast"))
    rows = sharp.join(top, keys).join(fast_last, keys)
    rows = _shifted(rows, fast.select(*keys, "col", F.col("mags").alias("_f")), 0, "_flast", keys)
    rows = _shifted(rows, change, center_shift(tonal_fft, hop), "_last", keys)
    peak = F.greatest(F.col("_max"), F.lit(1e-9))

    def blend(m, b):
        tb = F.least(F.round(b * F.lit(tonal_fft / fft)), F.size("_d") - 1)
        w = 1 / (1 + 80.0 * at("_d", tb) / peak)
        return w * m + (1 - w) * at("_f", b)

    return rows.select(*keys, "col", F.transform("mags", blend).alias("mags"))


def nearest_columns(left: DataFrame, right: DataFrame, width: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each left column the right column nearest in time; the earlier one on equal distance.

    Both sides are merged and scanned by time chunks in both directions, so gaps of any length are bridged by carries.
    """
    keys = list(keys)
    a = left.select(*keys, "t", F.col("col").alias("lcol"), F.lit(None).cast("struct<t:double,col:bigint>").alias("r"))
    b = right.select(*keys, "t", F.lit(None).cast("bigint").alias("lcol"), F.struct("t", "col").alias("r"))
    both = a.unionByName(b)
    is_left = F.col("lcol").isNotNull().cast("int")
    past = both.withColumn("chunk", F.floor(F.col("t") / width)).withColumn("_o", F.struct("t", is_left))
    past = running_last(past, keys, {"before": F.col("r")}, idx="_o").where("lcol IS NOT NULL").select(*keys, "lcol", "t", "before")
    ahead = both.withColumn("chunk", -F.floor(F.col("t") / width)).withColumn("_o", F.struct(-F.col("t"), 1 - is_left))
    ahead = running_last(ahead, keys, {"after": F.col("r")}, idx="_o").where("lcol IS NOT NULL").select(*keys, "lcol", "after")
    both_sides = past.join(ahead, [*keys, "lcol"])
    nearer = F.col("before").isNull() | (F.abs(F.col("after.t") - F.col("t")) < F.abs(F.col("before.t") - F.col("t")))
    return both_sides.select(*keys, F.col("lcol").alias("col"), F.coalesce(F.when(nearer, F.col("after.col")), F.col("before.col"), F.col("after.col")).alias("nearest"))


def geometric_mean(x: Column, y: Column) -> Column:
    """High only where both are."""
    return F.sqrt(x * y)


def resample_to(left: DataFrame, right: DataFrame, bin_ratio: float, width: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spectra of one grid on another: for each left column the right column nearest in time, for each of its bins the nearest right bin.

    Rows (keys, t, col, mags); `bin_ratio` is the left grid's width of a bin over the right one's; frequencies above the right grid take its last
    bin. Adds `other` to left. Only times meet in the scan; each array moves once, in the join that brings it to its left columns.
    """
    keys = list(keys)
    near = nearest_columns(left.select(*keys, "t", "col"), right.select(*keys, "t", "col"), width, keys)
    held = right.select(*keys, F.col("col").alias("nearest"), F.col("mags").alias("_right"))
    rows = left.join(near, [*keys, "col"], "left").join(held, [*keys, "nearest"], "left").drop("nearest")

    def taken(_, b):
        return F.get("_right", F.least(F.round(b * F.lit(float(bin_ratio))), F.size("_right") - 1).cast("int"))

    return rows.withColumn("other", F.when(F.col("_right").isNotNull(), F.transform("mags", taken))).drop("_right")


def fuse(left: DataFrame, right: DataFrame, bin_ratio: float, width: float, op: Callable[[Column, Column], Column] = geometric_mean,
         keys: Sequence[str] = KEYS) -> DataFrame:
    """Combine two grids element by element on the left one; columns of recordings without right columns are dropped."""
    rows = resample_to(left, right, bin_ratio, width, keys).where("other IS NOT NULL")
    return rows.withColumn("mags", F.zip_with("mags", "other", op)).drop("other")


def band_gains(floors: DataFrame, bins: int, max_hz: float, low_hz: float, high_hz: float, gains: dict[str, float], band_count: int,
               notches: DataFrame | None, suppression: float, floor_strength: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """dB adjustment per bin: equaliser bands, notch bands with their harmonics, and a learned floor(keys, bin, mean_mag)."""
    keys = list(keys)
    grid = floors.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    freq = F.col("bin") * (max_hz / max(bins - 1, 1))
    grid = grid.withColumn("freq_hz", freq)
    f = F.col("freq_hz")
    above = F.lit(gains["above"])
    if band_count == 4 and low_hz < high_hz:
        above = F.when((f >= max(2 * low_hz, high_hz)) & (f <= 2 * high_hz), gains["harmonics"]).otherwise(above)
    selected = F.lit(gains["selected"])
    eq = F.when(f < low_hz, gains["below"]).when(f <= high_hz, selected).otherwise(above if band_count >= 3 else selected)
    floor_bins = floors.groupBy(*keys).agg(F.max("bin").alias("_top"))
    rows = grid.withColumn("eq_db", eq).join(floor_bins, keys).withColumn("_fb", F.round(f / max_hz * F.col("_top")).cast("int"))
    learned = floors.select(*keys, F.col("bin").alias("_fb"), "mean_mag")
    rows = rows.join(learned, [*keys, "_fb"], "left")
    floor_db = F.when(F.col("mean_mag") > 1e-15, 20 * F.log10("mean_mag") * floor_strength).otherwise(0.0)
    rows = rows.withColumn("floor_db", floor_db)
    if notches is not None:
        half = F.col("bandwidth_hz") / 2
        # One row per band and multiple; each covers an interval of bins that is exploded, then summed by bin.
        lines = notches.select(*keys, "center_hz", half.alias("half"), "strength_db",
                               F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("m"))
        lines = lines.where((F.col("m") == 1) | F.lit(suppression > 0))
        step = max_hz / max(bins - 1, 1)
        lo = F.greatest(F.ceil((F.col("center_hz") - F.col("half")) * F.col("m") / step - 1e-9), F.lit(0)).cast("int")
        hi = F.least(F.floor((F.col("center_hz") + F.col("half")) * F.col("m") / step + 1e-9), F.lit(bins - 1)).cast("int")
        cut = F.col("strength_db") * F.when(F.col("m") == 1, 1.0).otherwise(suppression)
        cuts = lines.where(lo <= hi).select(*keys, F.explode(F.sequence(lo, hi)).alias("bin"), cut.alias("cut"))
        cuts = cuts.groupBy(*keys, "bin").agg(F.sum("cut").alias("notch_db"))
        rows = rows.join(cuts, [*keys, "bin"], "left")
    else:
        rows = rows.withColumn("notch_db", F.lit(0.0))
    return rows.select(*keys, "bin", (F.col("eq_db") - F.coalesce("notch_db", F.lit(0.0)) - F.col("floor_db")).alias("gain_db"))


def column_quality(columns: DataFrame, hz_per_bin: float, true_hz: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ridge error, half-power width and power-weighted spread, averaged over columns(keys, col, t, mags)."""
    n = F.size("mags")
    body = F.slice("mags", 2, n - 2)
    k = F.array_position(body, F.array_max(body)).cast("int")
    rows = columns.withColumn("k", k).withColumn("best", F.array_max(body)).where("best > 0")
    m0, m1, m2 = at("mags", F.col("k") - 1), at("mags", F.col("k")), at("mags", F.col("k") + 1)
    denom = m0 - 2 * m1 + m2
    delta = F.when(F.abs(denom) > 1e-12, F.least(F.greatest(0.5 * (m0 - m2) / denom, F.lit(-0.5)), F.lit(0.5))).otherwise(0.0)
    half = F.col("best") * F.col("best") * 0.5

    def edge(side: Column) -> Column:
        """Distance in bins from the peak to the half-power crossing along one side, peak first."""
        power = F.transform(side, lambda x: x * x)
        stop = F.array_position(F.transform(power, lambda p: p > half), False).cast("int")
        inside, outside = F.get(power, stop - 2), F.get(power, stop - 1)
        frac = F.when(F.abs(inside - outside) > 1e-20, F.least(F.greatest((inside - half) / (inside - outside), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.when(stop > 0, stop - 2 + frac).otherwise(F.size(side) - 1)

    right = edge(F.slice("mags", F.col("k") + 1, n))
    left = edge(F.reverse(F.slice("mags", F.lit(1), F.col("k") + 1)))
    weight = total(F.transform("mags", lambda x: x * x))
    mean = total(F.transform("mags", lambda x, j: x * x * j)) / weight
    spread = F.sqrt(total(F.transform("mags", lambda x, j: x * x * F.pow(j - mean, F.lit(2.0)))) / weight)
    err = (F.col("k") + delta) * hz_per_bin - true_hz
    return rows.groupBy(*keys).agg(
        F.sqrt(F.avg(err * err)).alias("ridge_rms_hz"),
        (F.avg(F.greatest(left + right, F.lit(0.0))) * hz_per_bin).alias("width_3db_hz"),
        (F.avg(spread) * hz_per_bin).alias("spread_hz"),
    )


def time_spread(columns: DataFrame, lo_bin: int, hi_bin: int, transient: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """RMS spread in time (ms) of band energy; ``transient`` first removes each bin's minimum over time."""
    keys = list(keys)
    band = F.slice("mags", lo_bin + 1, hi_bin - lo_bin)
    rows = columns.select(*keys, "col", "t", band.alias("b"))
    if transient:
        base = rows.select(*keys, F.posexplode("b").alias("j", "m")).groupBy(*keys, "j").agg(F.min("m").alias("m"))
        base = base.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", "m")))["m"].alias("_base"))
        rows = rows.join(base, keys).withColumn("b", F.zip_with("b", "_base", lambda x, y: F.greatest(x - y, F.lit(0.0))))
    energy = rows.select(*keys, "t", total(F.transform("b", lambda x: x * x)).alias("e"))
    sums = energy.groupBy(*keys).agg(
        F.sum("e").alias("e"), F.sum(F.col("e") * F.col("t")).alias("et"), F.sum(F.col("e") * F.col("t") * F.col("t")).alias("ett")
    )
    mean = F.col("et") / F.col("e")
    return sums.where("e > 0").select(*keys, (F.sqrt(F.greatest(F.col("ett") / F.col("e") - mean * mean, F.lit(0.0))) * 1000).alias("spread_ms"))
