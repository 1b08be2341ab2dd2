"""The sampler and the scene grouper over unbounded frame streams, and windowed counts.

State is one row a video, as JSON: the sampler's few numbers, or the open scenes
of the last ``gap`` frames. Frames of a micro-batch are put in order; a frame
that comes after later ones of an earlier batch is late and left out. A video
that sends nothing for ``idle`` has ended: its open scenes are given out and its
state leaves; should it go on, it starts anew. With ``idle`` None no video ends: for
a run over what is there (``availableNow``), which a timer would keep going.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stateful import Sampler, SceneGrouper


def _keyed(frames: DataFrame, by: str, order: str, schema: str, start: Callable[[], dict], feed: Callable, finish: Callable[[dict], list], idle: int | None) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"last": None, "own": start()}
        if state.hasTimedOut:
            state.remove()
            if out := finish(kept["own"]):
                yield pd.DataFrame([(key[0], *x) for x in out], columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values(order)
        if kept["last"] is not None:
            rows = rows[rows[order] > kept["last"]]
        out = feed(kept["own"], rows)
        if len(rows):
            kept["last"] = int(rows[order].iloc[-1])
        state.update((json.dumps(kept),))
        if idle:
            state.setTimeoutDuration(idle * 1000)
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=columns)

    return frames.groupBy(by).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


#: Seconds without a frame after which a video has ended.
IDLE = 3600


def adaptive_sample(frames: DataFrame, by: str, order: str, shift: str, idle: int | None = IDLE) -> DataFrame:
    """by, order, stride of the sampled frames, as the batch operator gives them for frames in order."""

    def feed(own: dict, rows: pd.DataFrame) -> list[tuple]:
        s, out = Sampler(), []
        vars(s).update(own)
        for at, v in zip(rows[order].tolist(), rows[shift].tolist(), strict=True):
            if s.take(v):
                out.append((at, s.stride))
        own.update(vars(s))
        return out

    return _keyed(frames.select(by, order, shift), by, order, f"{by} {dict(frames.dtypes)[by]}, {order} long, stride int", lambda: vars(Sampler()), feed, lambda _: [], idle)


def group_scenes(frames: DataFrame, by: str, order: str, score: str, sig: str, alike: Callable, gap: int = 300, idle: int | None = IDLE) -> DataFrame:
    """Scenes as they close: when no frame of the last ``gap`` was theirs, or the video has ended."""
    row = lambda s: (s["scene"], s["first"], s["last"], s["n"], s["best"], float(s["score"]))

    def feed(own: dict, rows: pd.DataFrame) -> list[tuple]:
        g = SceneGrouper(alike, gap)
        g.open, g.n = own["open"], own["n"]
        out = []
        for at, v, x in zip(rows[order].tolist(), rows[score].tolist(), rows[sig].tolist(), strict=True):
            out += map(row, g.add(at, v, list(x) if hasattr(x, "__len__") else x))
        own["open"], own["n"] = g.open, g.n
        return out

    schema = f"{by} {dict(frames.dtypes)[by]}, scene long, first_frame long, last_frame long, n_frames long, best_frame long, best_score double"
    return _keyed(frames.select(by, order, score, sig), by, order, schema, lambda: {"open": [], "n": 0}, feed, lambda own: list(map(row, own["open"])), idle)


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts a time window and key, with late data up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def upsert_sink(write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each micro-batch with its number, so a replay can be told apart."""

    def put(batch: DataFrame, number: int) -> None:
        write(batch.withColumn("batch_id", F.lit(number)))

    return put
