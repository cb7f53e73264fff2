"""Streams of tracks that end by falling silent: windows and pairs whose open rest is given by a timer.

State stands in the state store: a list of the frames of the open window (or the one frame that waits for its
successor), and a value for where it stands. Every arrival moves the track's timer; when event time has passed the last
frame by the silence, what is open is given as at a track's end and the state goes. The session needs a state store with
timers (`spark.sql.streaming.stateStore.providerClass`: the RocksDB provider).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from trackloom.schema import FRAME, KEY


class _Open(StatefulProcessor):
    """Keeps a track's open frames and a timer behind the last of them; subclasses say what is given and what stays open."""

    def __init__(self, value: str, silence_ms: int, columns: list[str]):
        self.value, self.silence_ms, self.columns = value, silence_ms, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"{FRAME} long, value double")
        self.place = handle.getValueState("place", "given long, last long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, last = [], None
        for part in rows:
            new += [(int(f), float(v)) for f, v in zip(part[FRAME], part[self.value], strict=True)]
            last = max(int(part["ms"].max()), last or 0)
        given, before = self.place.get() if self.place.exists() else (0, 0)
        frames = [*((int(f), float(v)) for f, v in self.open.get()), *sorted(new)]
        out, kept, given = self.passed(given, frames)
        if kept:
            self.open.put(kept)
        else:
            self.open.clear()
        last = max(last, before)
        self.place.update((given, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(last + self.silence_ms)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        given = self.place.get()[0] if self.place.exists() else 0
        out = self.ended(given, [(int(f), float(v)) for f, v in self.open.get()])
        self.open.clear()
        self.place.clear()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def passed(self, given: int, frames: list) -> tuple[list, list, int]:
        raise NotImplementedError

    def ended(self, given: int, frames: list) -> list:
        raise NotImplementedError


class _Windows(_Open):
    def __init__(self, window: int, value: str, silence_ms: int):
        super().__init__(value, silence_ms, [KEY, "slot", "value"])
        self.window = window

    def passed(self, given: int, frames: list) -> tuple[list, list, int]:
        full = len(frames) // self.window
        means = [sum(v for _, v in frames[k * self.window : (k + 1) * self.window]) / self.window for k in range(full)]
        return list(enumerate(means, given)), frames[full * self.window :], given + full

    def ended(self, given: int, frames: list) -> list:
        if not frames:
            return []
        padded = [v for _, v in frames] + [frames[-1][1]] * (self.window - len(frames))
        return [(given, sum(padded) / self.window)]


class _Pairs(_Open):
    def __init__(self, value: str, silence_ms: int):
        super().__init__(value, silence_ms, [KEY, FRAME, value])

    def passed(self, given: int, frames: list) -> tuple[list, list, int]:
        out = [(2 * f + h, v) for (f, a), (_, b) in zip(frames, frames[1:], strict=False) for h, v in ((0, a), (1, b))]
        return out, frames[-1:], given

    def ended(self, given: int, frames: list) -> list:
        return [(2 * f + h, v) for f, v in frames for h in (0, 1)]


def _run(frames: DataFrame, processor: _Open, times: str, late: str, schema: str) -> DataFrame:
    value = processor.value
    timed = frames.select(KEY, FRAME, value, times).withWatermark(times, late).withColumn("ms", F.unix_millis(times))
    return timed.groupBy(KEY).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def windowed_means(frames: DataFrame, window: int, times: str, silence: float, late: str = "0 seconds", value: str = "pos") -> DataFrame:
    """(video_id, slot, value): the mean of each window of frames; of a track silent for `silence` seconds the last one padded with its last frame."""
    return _run(frames, _Windows(window, value, round(1000 * silence)), times, late, f"{KEY} string, slot long, value double")


def interleaved(frames: DataFrame, times: str, silence: float, late: str = "0 seconds", value: str = "pos") -> DataFrame:
    """(video_id, frame, value): each frame and its successor's value; the last of a track that is silent for `silence` seconds twice."""
    return _run(frames, _Pairs(value, round(1000 * silence)), times, late, f"{KEY} string, {FRAME} long, {value} double")
