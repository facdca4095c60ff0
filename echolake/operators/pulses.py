"""Pulses and crossings from chunk arrays.

A chunk is turned into a small summary that holds for either state of the latch before it: the stretch up to its first event (the lead), which is armed
only if the chunk is entered armed, and the armed runs after it, which are the same in both cases. Summaries of neighbours join to one of
the same kind, so chunks are folded in blocks, and blocks (few, and of a few numbers each) per recording. Samples themselves are grouped once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolake.plans.chunking import carry_in

#: Chunks folded by one step.
BLOCK = 1024
_NUMBERS = T.ArrayType(T.DoubleType())


def packed(rows: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Rows(keys, chunk, idx, values) as one row per chunk: `first` index and an array per value. No shuffle if rows lie by (keys, chunk)."""
    sorted_ = F.sort_array(F.collect_list(F.struct("idx", *values)))
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)  # said here, so that all uses of the chunks share one shuffle
    return rows.where(known).groupBy(*keys, "chunk").agg(sorted_.alias("_a")).select(
        *keys, "chunk", F.col("_a")[0]["idx"].alias("first"), *[F.col(f"_a.{v}").alias(v) for v in values])


def _events(env: np.ndarray, high: float, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Places where the latch gets another event than before, and these events (1 arms, 0 disarms)."""
    event = np.where(env >= high, 1, np.where(env < low, 0, -1))
    at = np.flatnonzero(event >= 0)
    kind = event[at]
    new = np.ones(len(at), bool)
    new[1:] = kind[1:] != kind[:-1]
    return at[new], kind[new]


def _peak(env: np.ndarray, a: int, b: int, first: int) -> tuple[float, float]:
    """Largest value in [a, b) and its index, the earliest on ties."""
    if b <= a:
        return -np.inf, -1.0
    i = a + int(np.argmax(env[a:b]))
    return float(env[i]), float(first + i)


def chunk_runs(env: np.ndarray, first: int, high: float, low: float) -> tuple[int, list[float], list[float]]:
    """(state left behind or -1, lead as end, peak, index of peak, runs as start, end, peak, index of peak each)."""
    at, kind = _events(env, high, low)
    lead = int(at[0]) if len(at) else len(env)
    runs: list[float] = []
    stops = np.append(at[1:], len(env))
    for i in np.flatnonzero(kind == 1):
        a, b = int(at[i]), int(stops[i])
        runs += [float(first + a), float(first + b), *_peak(env, a, b, first)]
    return (int(kind[-1]) if len(kind) else -1), [float(first + lead), *_peak(env, 0, lead, first)], runs


def _longer(pulse: list[float], end: float, peak: float, index: float) -> None:
    """Extend a pulse; its earlier peak wins ties."""
    pulse[1] = end
    if peak > pulse[2]:
        pulse[2], pulse[3] = peak, index


class Fold:
    """The summary of chunks (or blocks) that follow each other."""

    def __init__(self):
        self.state, self.lead, self.runs = -1, None, []

    def add(self, state: int, lead: list[float], runs: list[list[float]]) -> None:
        if self.lead is None:
            self.lead = list(lead)
        elif self.state < 0:
            _longer(stretch := [0.0, *self.lead], *lead)
            self.lead = stretch[1:]
        elif self.state == 1:
            _longer(self.runs[-1], *lead)
            if runs and runs[0][0] == lead[0]:  # armed again while armed
                _longer(self.runs[-1], *runs[0][1:])
                runs = runs[1:]
        self.runs += runs
        if state >= 0:
            self.state = state


def merged(runs: list[list[float]], gap: int) -> list[list[float]]:
    """Closed runs with those joined that follow within `gap`."""
    out: list[list[float]] = []
    for run in runs:
        if out and run[0] - out[-1][1] < gap:
            _longer(out[-1], *run[1:])
        else:
            out.append(list(run))
    return out


def _grouped(batches, width: int):
    """(values of the first `width` columns, rows that agree in them) of sorted batches."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:width] != now:
                if held:
                    yield now, held
                now, held = row[:width], []
            held.append(row[width:])
    if held:
        yield now, held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def find_pulses(chunks: DataFrame, gap: int, shortest: int, longest: int, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """`no`, `start_idx`, `end_idx`, `peak_amp`, `peak_idx`, `floor` of the pulses of chunks(keys, chunk, first, env, high, low, n, floor).

    Runs that follow within `gap` are one pulse, but a run still open at the end of the recording never joins its predecessor. Pulses outside
    [shortest, longest] go after that; the rest is numbered from 0.
    """
    keys, n_keys = list(keys), len(keys)
    heads = [chunks.schema[k] for k in keys]

    # Chunks to summaries.
    lone = T.StructType([*heads, T.StructField("block", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()),
                         T.StructField("floor", T.DoubleType()), T.StructField("state", T.IntegerType()), T.StructField("lead", _NUMBERS), T.StructField("runs", _NUMBERS)])
    lone_arrow = _arrow(lone)

    def summarise(batches):
        for batch in batches:
            names = [batch.column(k) for k in keys]
            env = batch.column("env")
            flat, cuts = env.values.to_numpy(zero_copy_only=False), env.offsets.to_numpy()
            rows = []
            for i, (c, first, high, low, n, floor) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("chunk", "first", "high", "low", "n", "floor")))):
                state, lead, runs = chunk_runs(flat[cuts[i] : cuts[i + 1]], first, high, low)
                rows.append((*(k[i].as_py() for k in names), c // block, c, n, floor, state, lead, runs))
            if rows:
                yield _batch(rows, lone_arrow)

    summaries = chunks.mapInArrow(summarise, lone)

    # Summaries to blocks: what lies inside is settled, the ends wait for the neighbours.
    whole = T.StructType([*heads, T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("floor", T.DoubleType()),
                          T.StructField("state", T.IntegerType()), T.StructField("lead", _NUMBERS), T.StructField("ends", _NUMBERS), T.StructField("open", _NUMBERS),
                          T.StructField("inner", T.LongType()), T.StructField("pulses", _NUMBERS)])
    whole_arrow = _arrow(whole)

    def accepted(pulses):
        return [p for p in pulses if shortest <= p[1] - p[0] <= longest]

    def fold_blocks(batches):
        for head, rows in _grouped(batches, n_keys + 1):
            fold = Fold()
            for _, n, floor, state, lead, runs in rows:
                fold.add(state, lead, [runs[i : i + 4] for i in range(0, len(runs), 4)])
            last = [fold.runs.pop()] if fold.state == 1 else []
            closed = merged(fold.runs, gap)
            ends = [closed[0], closed[-1]] if len(closed) > 1 else closed
            inside = accepted(closed[1:-1])
            yield _batch([(*head, n, floor, fold.state, fold.lead, sum(ends, []), sum(last, []), len(inside), sum(inside, []))], whole_arrow)

    blocks = summaries.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "chunk").mapInArrow(fold_blocks, whole)

    # Blocks of a recording in order: the pulses at their ends, and how many come before those inside.
    final = T.StructType([*heads, T.StructField("block", T.LongType()), T.StructField("before", T.LongType()), T.StructField("floor", T.DoubleType()),
                          T.StructField("pulses", _NUMBERS)])
    final_arrow = _arrow(final)

    def fold_recordings(batches):
        for head, rows in _grouped(batches, n_keys):
            count, out, pending, running, floor = 0, [], None, None, 0.0

            def settle(pulse):
                nonlocal count
                if pulse is not None and shortest <= pulse[1] - pulse[0] <= longest:
                    out.append((*head, None, count, floor, pulse))
                    count += 1

            def follow(pulse):
                """A closed pulse after the pending one."""
                nonlocal pending
                if pending is not None and pulse[0] - pending[1] < gap:
                    _longer(pending, *pulse[1:])
                else:
                    settle(pending)
                    pending = pulse

            for number, _, floor, state, lead, ends, last, inner in rows:
                closed = [ends[i : i + 4] for i in range(0, len(ends), 4)]
                fresh = list(last) or None
                if running is not None:
                    _longer(running, *lead)
                    if state < 0:
                        continue
                    if closed and closed[0][0] == lead[0]:
                        _longer(running, *closed[0][1:])
                        closed[0] = running
                    elif not closed and fresh is not None and fresh[0] == lead[0]:
                        _longer(running, *fresh[1:])
                        fresh = running
                    else:
                        follow(running)
                    running = None
                if closed:
                    follow(closed[0])
                if len(closed) > 1:
                    settle(pending)
                    out.append((*head, number, count, floor, None))
                    count += inner
                    pending = closed[1]
                running = fresh
            settle(pending)
            settle(running)
            for i in range(0, len(out), 10_000):
                yield _batch(out[i : i + 10_000], final_arrow)

    order = blocks.drop("pulses").repartition(*keys).sortWithinPartitions(*keys, "block")
    resolved = order.mapInArrow(fold_recordings, final)
    at_ends = resolved.where("block IS NULL").select(*keys, F.col("before").alias("no"), "floor", F.col("pulses").alias("p"))
    lists = F.posexplode(F.expr("transform(sequence(0, size(pulses) div 4 - 1), i -> slice(pulses, i * 4 + 1, 4))")).alias("i", "p")
    inside = blocks.where("inner > 0").select(*keys, "block", "floor", lists)
    places = resolved.where("block IS NOT NULL").select(*keys, "block", "before")
    numbered = inside.join(places, [*keys, "block"]).select(*keys, (F.col("before") + F.col("i")).alias("no"), "floor", "p")
    p = F.col("p")
    return at_ends.unionByName(numbered).select(
        *keys, "no", p[0].cast("long").alias("start_idx"), p[1].cast("long").alias("end_idx"), p[2].alias("peak_amp"), p[3].cast("long").alias("peak_idx"), "floor")


def crossing_bins(chunks: DataFrame, bin_samples: int, keys: Sequence[str]) -> DataFrame:
    """`bin`, `crossings`, `last` (index), `n` from chunks(keys, chunk, first, y, env, high, low, n).

    Sign changes count where the latch (armed above high, disarmed below low) is armed; bin k holds the indices (k * b, (k + 1) * b].
    """
    keys = list(keys)
    numbers = T.ArrayType(T.LongType())
    schema = T.StructType([*[chunks.schema[k] for k in keys], T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("state", T.IntegerType()),
                           T.StructField("sign", T.IntegerType()), T.StructField("first_sign", T.IntegerType()), T.StructField("first_state", T.IntegerType()),
                           T.StructField("bin", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
                           T.StructField("lead", numbers), T.StructField("rest", numbers)])
    arrow = _arrow(schema)

    def summarise(batches):
        for batch in batches:
            names, rows = [batch.column(k) for k in keys], []
            parts = [(batch.column(c).values.to_numpy(zero_copy_only=False), batch.column(c).offsets.to_numpy()) for c in ("y", "env")]
            for i, (c, first, high, low, n) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("chunk", "first", "high", "low", "n")))):
                y, env = (flat[cuts[i] : cuts[i + 1]] for flat, cuts in parts)
                event = np.where(env > high, 1, np.where(env < low, 0, -1))
                if first == 0:
                    event[0] = -1
                at = np.flatnonzero(event >= 0)
                held = np.maximum.accumulate(np.where(event >= 0, np.arange(len(y)), -1))
                armed = np.where(held >= 0, event[held] == 1, False)
                cross = np.zeros(len(y), bool)
                cross[1:] = (y[1:] >= 0) != (y[:-1] >= 0)
                bins = np.maximum(first + np.arange(len(y)) - 1, 0) // bin_samples
                size = int(bins[-1] - bins[0]) + 1
                lead = np.bincount(bins[cross & (held < 0)] - bins[0], minlength=size)
                rest = np.bincount(bins[cross & armed] - bins[0], minlength=size)
                rows.append((*(k[i].as_py() for k in names), c, n, int(event[at[-1]]) if len(at) else None, int(y[-1] >= 0), int(y[0] >= 0),
                             int(event[0]) if event[0] >= 0 else None, int(bins[0]), first, first + len(y) - 1, lead.tolist(), rest.tolist()))
            if rows:
                yield _batch(rows, arrow)

    made = chunks.mapInArrow(summarise, schema)
    entered = carry_in(made, keys, {"entry": ("last", "state"), "before": ("last", "sign")})
    armed = F.coalesce(F.col("entry"), F.lit(0)) == 1
    turned = F.col("before").isNotNull() & (F.col("before") != F.col("first_sign")) & (F.coalesce("first_state", "entry", F.lit(0)) == 1)
    counts = F.zip_with("lead", "rest", lambda a, b: F.when(armed, a).otherwise(0) + b)
    rows = entered.where("last > 0").select(*keys, "n", "bin", "first", "last", turned.alias("turned"), F.posexplode(counts).alias("i", "c"))
    end = (F.col("bin") + F.col("i") + 1) * bin_samples
    return rows.select(
        *keys, "n", (F.col("bin") + F.col("i")).alias("bin"), (F.col("c") + F.when((F.col("i") == 0) & F.col("turned"), 1).otherwise(0)).alias("c"),
        F.least("last", end).alias("last"),
    ).groupBy(*keys, "bin").agg(F.sum("c").alias("crossings"), F.max("last").alias("last"), F.first("n").alias("n"))
