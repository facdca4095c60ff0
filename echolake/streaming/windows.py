"""Bounded state on live feeds: the newest spectrum columns, sliding means of spectra, and the arrival schedule.

State never grows with the length of a feed: a ring holds the columns it keeps and drops the others in the batch in which they leave, sliding
means hold one sum per pane of their window, a schedule holds four numbers. State of a stream that falls silent expires after `idle_secs`
where that is given; such a feed needs a processing-time trigger, since Spark gives expiring state one batch after another without end under `availableNow`.
Columns may come in any order; those too late for their pane are counted, those too late for the ring still count for its running maximum. A
ring takes a repeated column once; sliding means and schedules expect each row once. Empty feeds give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from echolake.operators.profile import noise_bands


def _mode(idle_secs: int | None) -> str:
    return "ProcessingTime" if idle_secs else "None"


class _Ring(StatefulProcessor):
    """One part of a stream's columns: those above `newest - keep`, and marks over everything seen."""

    def __init__(self, keep: int, idle_secs: int | None):
        self.keep, self.idle = keep, idle_secs and idle_secs * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cols = handle.getMapState("columns", "col bigint", "mags array<double>", self.idle)
        self.marks = handle.getValueState("marks", "newest bigint, running_max double, held bigint, lowest bigint", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, top, held, lowest = self.marks.get() if self.marks.exists() else (-1, 0.0, 0, None)
        for pdf in rows:
            newest = max(newest, int(pdf["col"].max()))
            top = max(top, max((float(np.max(m)) for m in pdf["mags"] if len(m)), default=0.0))
            least, added = newest - self.keep + 1, []
            for col, mags in zip(pdf["col"].tolist(), pdf["mags"]):
                if col >= least and not self.cols.containsKey((col,)):
                    self.cols.updateValue((col,), (list(map(float, mags)),))
                    added.append((col, mags))
            lowest = min([newest if lowest is None else lowest, *(a[0] for a in added)])
            # columns leave in order, so the ring is scanned only after a gap wider than itself
            passed = range(lowest, least) if least - lowest <= self.keep else [k[0] for k in self.cols.keys()]
            gone = [c for c in passed if c < least and self.cols.containsKey((c,))]
            for col in gone:
                self.cols.removeKey((col,))
            lowest, held = max(lowest, least), held + len(added) - len(gone)
            cols = [a[0] for a in added] + gone
            # the last row tells of the marks alone, also where no column came or went
            yield pd.DataFrame({"stream_id": key[0], "part": key[1], "col": pd.array([*cols, None], "Int64"), "mags": [*[a[1] for a in added], *[None] * (len(gone) + 1)],
                                "evicted": [False] * len(added) + [True] * len(gone) + [False], "newest": newest, "running_max": top, "held": held})
        self.marks.update((newest, top, held, lowest))

    def close(self) -> None:
        pass


def ring_changes(columns: DataFrame, keep: int = 30_000, parts: int = 8, idle_secs: int | None = None) -> DataFrame:
    """Changes of the ring of the newest ``keep`` columns of columns(stream_id, col, mags): a row per column that came or left (`evicted`).

    Columns are dealt to ``parts`` keys per stream, so one busy stream is spread over tasks; each part holds keep / parts columns.
    A row without `col` carries the marks of the part: newest column, running maximum over everything seen, columns held.
    """
    dealt = columns.select("stream_id", "col", "mags", F.pmod("col", F.lit(parts)).alias("part"))
    return dealt.groupBy("stream_id", "part").transformWithStateInPandas(
        statefulProcessor=_Ring(keep, idle_secs), outputMode="Append", timeMode=_mode(idle_secs),
        outputStructType="stream_id bigint, part bigint, col bigint, mags array<double>, evicted boolean, newest bigint, running_max double, held bigint")


def ring(changes: DataFrame, keep: int) -> DataFrame:
    """The ring as it stands after all changes, with the marks of the whole stream."""
    marks = changes.groupBy("stream_id").agg(F.max("newest").alias("newest"), F.max("running_max").alias("running_max"))
    left = changes.where("col IS NOT NULL").groupBy("stream_id", "col").agg(F.bool_or("evicted").alias("gone"), F.first("mags", ignorenulls=True).alias("mags"))
    live = left.where("NOT gone").drop("gone").join(marks, "stream_id").where(F.col("col") > F.col("newest") - keep)
    return live.withColumn("oldest", F.greatest(F.col("newest") - keep + 1, F.lit(0)))


class _Panes(StatefulProcessor):
    """Sums of the panes of one window; a pane closes when it is full, or when the feed has run a whole window past it."""

    def __init__(self, slide: int, panes: int, idle_secs: int | None):
        self.slide, self.panes, self.idle = slide, panes, idle_secs and idle_secs * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("panes", "next bigint, pane array<bigint>, n array<bigint>, sums array<array<double>>, late bigint", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        nxt, late, held = None, 0, {}
        if self.state.exists():
            nxt, pane, n, sums, late = self.state.get()
            held = {p: (k, np.asarray(s, float)) for p, k, s in zip(pane, n, sums)}
        for pdf in rows:
            pane = pdf["col"].to_numpy(np.int64) // self.slide
            for p in np.unique(pane):
                own = pdf["mags"][pane == p]
                if nxt is not None and p < nxt:
                    late += len(own)
                    continue
                k, s = held.get(int(p), (0, 0.0))
                held[int(p)] = (k + len(own), s + np.sum(np.stack(list(own)), axis=0))
        out = []
        nxt = min(held) if nxt is None else nxt
        while (ahead := [p for p in held if p >= nxt]) and ((nxt in held and held[nxt][0] >= self.slide) or max(ahead) >= nxt + self.panes):
            held = {p: v for p, v in held.items() if p > nxt - self.panes}
            window = [held[p] for p in sorted(held) if p <= nxt]
            if not window:  # a gap wider than the window
                nxt = min(ahead)
                continue
            n = sum(k for k, _ in window)
            out.append((key[0], nxt, n, sum(s for _, s in window) / n, late))
            nxt += 1
        pane = sorted(held)
        self.state.update((nxt, pane, [held[p][0] for p in pane], [held[p][1].tolist() for p in pane], late))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "pane", "n", "mean", "late"])

    def close(self) -> None:
        pass


def sliding_means(columns: DataFrame, slide: int, panes: int, idle_secs: int | None = None) -> DataFrame:
    """Mean spectrum of the last ``panes`` panes of ``slide`` columns of columns(stream_id, col, mags), once per pane as it closes.

    Each column is added once; state is one sum per pane of the window and of what runs ahead. `n` counts the columns in the mean, `late`
    those so far that came after their pane had closed. The first windows of a feed hold the panes there are.
    """
    return columns.select("stream_id", "col", "mags").groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=_Panes(slide, panes, idle_secs), outputMode="Append", timeMode=_mode(idle_secs),
        outputStructType="stream_id bigint, pane bigint, n bigint, mean array<double>, late bigint")


def live_bands(columns: DataFrame, hz_per_bin: float, slide: int, panes: int, **settings) -> DataFrame:
    """Noise bands of the recent window, in the stream: bands(stream_id, pane, bands) of `profile.noise_bands` on each sliding mean."""
    return noise_bands(sliding_means(columns, slide, panes), hz_per_bin, keys=("stream_id", "pane"), **settings)


class _Schedule(StatefulProcessor):
    """Where each chunk of a stream continues: at the cursor, or at its arrival after an underrun or a backlog."""

    def __init__(self, lookahead: float, allowed: float, idle_secs: int | None):
        self.lookahead, self.allowed, self.idle = lookahead, allowed, idle_secs and idle_secs * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cursor", "cursor double, newest double", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cursor, newest = self.state.get() if self.state.exists() else (None, None)
        pdf = pd.concat(list(rows)).sort_values(["arrived", "chunk"], kind="stable")  # bounded by the size of a micro-batch
        starts, kinds = [], []
        for at, own, dur in zip(pdf["arrived"].tolist(), pdf["own"].tolist(), pdf["dur"].tolist()):
            if newest is not None and own < newest - self.allowed:
                starts.append(None)
                kinds.append("late")
                continue
            newest = own if newest is None else max(newest, own)
            kind = "underrun" if cursor is None or cursor < at else "backlog" if cursor - at > self.lookahead else "steady"
            start = cursor if kind == "steady" else at
            cursor = start + dur
            starts.append(start)
            kinds.append(kind)
        if cursor is not None:
            self.state.update((cursor, newest))
        yield pd.DataFrame({"stream_id": key[0], "chunk": pdf["chunk"].to_numpy(), "start": pd.array(starts, "Float64"), "kind": kinds})

    def close(self) -> None:
        pass


def schedule(chunks: DataFrame, lookahead_secs: float, allowed_secs: float, idle_secs: int | None = None) -> DataFrame:
    """Start and kind of each of chunks(stream_id, chunk, own, arrived, dur), times in seconds, in order of arrival.

    A chunk continues at the end of its predecessor (`steady`). If that end lies before its arrival the queue ran dry (`underrun`); if it lies
    more than the lookahead past it, what is queued is stale (`backlog`): both start again at the arrival. A chunk whose own time is more than
    ``allowed_secs`` behind the newest one seen is `late`, has no start and moves nothing. Every chunk gives one row.
    """
    return chunks.select("stream_id", "chunk", "own", "arrived", "dur").groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=_Schedule(lookahead_secs, allowed_secs, idle_secs), outputMode="Append", timeMode=_mode(idle_secs),
        outputStructType="stream_id bigint, chunk bigint, start double, kind string")
