"""Streaming forms of the chunked readers: carried window tails, a pending last frame, idempotent appends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.schema import FRAME, KEY


def _gathered(parts: Iterator[pd.DataFrame], value: str, last: str | None) -> tuple[list[tuple[int, float]], bool]:
    """A batch's frames of one track in order, whatever Arrow chunks they came in, and whether the track ends here."""
    columns = [FRAME, value, *([last] if last else [])]
    rows = sorted(r for part in parts for r in part[columns].itertuples(index=False, name=None))
    return [(int(r[0]), float(r[1])) for r in rows], bool(last) and any(r[2] for r in rows)


def windowed_means(frames: DataFrame, window: int, value: str = "pos", last: str | None = None) -> DataFrame:
    """A stream of frames in order to (video_id, slot, value): the mean of each full window. Frames of an open window are carried as state; a batch may end anywhere.

    A track ends with the frame whose column `last` is true: its open window is then padded with that frame and given.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        slot, carried = state.get if state.exists else (0, [])
        rows, ends = _gathered(parts, value, last)
        values = [*carried, *(v for _, v in rows)]
        if ends and len(values) % window:
            values += values[-1:] * (window - len(values) % window)
        full = len(values) // window
        means = [sum(values[k * window : (k + 1) * window]) / window for k in range(full)]
        if ends:
            if state.exists:
                state.remove()
        else:
            state.update((slot + full, values[full * window :]))
        yield pd.DataFrame({KEY: [key[0]] * full, "slot": range(slot, slot + full), "value": means})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return frames.groupBy(KEY).applyInPandasWithState(step, f"{KEY} string, slot long, value double", "slot long, carried array<double>", "append", GroupStateTimeout.NoTimeout)


def interleaved(frames: DataFrame, value: str = "pos", last: str | None = None) -> DataFrame:
    """A stream of frames in order to (video_id, frame, value) with each frame followed by its successor's value; the last one waits for it, and is repeated where the column `last` says that the track ends."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = [(state.get[0], state.get[1])] if state.exists else []
        new, ends = _gathered(parts, value, last)
        rows += new
        out = [(key[0], 2 * f + h, v) for (f, a), (_, b) in zip(rows, rows[1:], strict=False) for h, v in ((0, a), (1, b))]
        if ends:
            out += [(key[0], 2 * rows[-1][0] + h, rows[-1][1]) for h in (0, 1)]
            if state.exists:
                state.remove()
        elif rows:
            state.update((int(rows[-1][0]), float(rows[-1][1])))
        yield pd.DataFrame(out, columns=[KEY, FRAME, value])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return frames.groupBy(KEY).applyInPandasWithState(step, f"{KEY} string, {FRAME} long, {value} double", f"{FRAME} long, {value} double", "append", GroupStateTimeout.NoTimeout)


def append_once(path: str):
    """A foreachBatch sink: each batch has its own folder, so a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def sessions(frames: DataFrame, times: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(video_id, start, end, n): frames at most `gap` apart in event time, with a watermark."""
    w = F.session_window(times, gap)
    return frames.withWatermark(times, late).groupBy(KEY, w.alias("w")).agg(F.count("*").alias("n")).select(KEY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
