"""Peaks and troughs of tracks of any length: maxima with plateaus, thinned by distance, then those prominent enough.

A maximum counts as prominent if on both sides a sample lies low enough before one lies higher. What a chunk answers to
a maximum of height h that comes from outside depends on h alone: below one threshold it meets a higher sample first,
from another on a low one, between them neither. Such answers compose, so a track's chunks give each chunk one threshold
a side. Plateaus are joined across chunks by their lengths. Thinning is by height, so its decisions can follow from one
another over any distance: a chunk decides with a margin on both sides, and what it has to leave open is decided in
further rounds, from what its neighbours have decided.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import staging
from trackloom.functions import kernels
from trackloom.operators import chunks as C
from trackloom.schema import FRAME, KEY

#: frames that a chunk sees beyond its own when it thins, in distances, and at least
MARGIN_DISTANCES, LEAST_MARGIN = 64, 1024
_REMOVED, _KEPT, _OPEN = 0, 1, 2


def _answers(x: np.ndarray, prominence: float) -> list[float]:
    """From the array's first sample on: a height below the first number meets a higher sample first, one from the second on a low one."""
    high, low = np.maximum.accumulate(x), kernels.least_height(np.minimum.accumulate(x), prominence)
    return [float(np.minimum(high, low).max()), float(np.maximum(high, low).min())]


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def _summary(x: np.ndarray, prominence: float) -> list[float]:
    """Size; first value and length of its run; last value, length of its run and the value before it; answers of both signs from both ends."""
    starts = _runs(x)
    before = x[starts[-1] - 1] if len(starts) > 1 else np.nan
    after = x[starts[1]] if len(starts) > 1 else np.nan
    first = starts[1] if len(starts) > 1 else len(x)
    ends = [a for v in (x, -x) for side in (v[::-1], v) for a in _answers(side, prominence)]
    return [len(x), x[0], first, after, x[-1], len(x) - starts[-1], before, *ends]


def _carries(s: np.ndarray) -> np.ndarray:
    """A line a chunk: the value before its first run (NaN: none), whether that run begins here, how far its last run goes on beyond it and the value after that (NaN: none), and from which height on the outside answers for prominence, by sign and side."""
    size, first, first_run, second, last = s[:, 0], s[:, 1], s[:, 2], s[:, 3], s[:, 4]
    n = len(s)
    out = np.empty((n, 8))
    out[:, 0] = np.append(np.nan, last[:-1])
    out[:, 1] = np.append(True, last[:-1] != first[1:])
    further, behind = 0.0, np.nan  # of the run that the next chunk begins with
    reach = np.full(2, np.inf)
    for i in range(n - 1, -1, -1):
        goes_on = i + 1 < n and first[i + 1] == last[i]
        out[i, 2:4] = (further, behind) if goes_on else (0.0, first[i + 1] if i + 1 < n else np.nan)
        one_run = first_run[i] == size[i]
        further, behind = (size[i] + out[i, 2], out[i, 3]) if one_run else (first_run[i], second[i])
        out[i, [5, 7]] = reach
        reach = np.clip(reach, s[i, [9, 13]], s[i, [10, 14]])
    reach = np.full(2, np.inf)
    for i in range(n):
        out[i, [4, 6]] = reach
        reach = np.clip(reach, s[i, [7, 11]], s[i, [8, 12]])
    return out


def _maxima(frames: np.ndarray, x: np.ndarray, carry: np.ndarray, prominence: float, left: float, right: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maxima whose plateau begins in the chunk: frame, height, and whether they are prominent enough."""
    starts = _runs(x)
    level = x[starts]
    before, after = np.append(carry[0], level[:-1]), np.append(level[1:], carry[3])
    length = np.diff(np.append(starts, len(x))).astype(np.float64)
    length[-1] += carry[2]
    with np.errstate(invalid="ignore"):
        top = (level > before) & (level > after)  # NaN, a track's end, is never lower
    top[0] &= carry[1] > 0
    at = np.flatnonzero(top)
    where = frames[starts[at]] + ((length[at] - 1) // 2).astype(np.int64)
    if not len(at) or prominence <= 0:
        return where, level[at], np.ones(len(at), bool)
    enough = np.ones(len(at), bool)
    inner = kernels.higher_bases(level)
    for (low, is_open), outside in zip(inner, (left, right), strict=True):
        enough &= (level[at] - low[at] >= prominence) | (is_open[at] & (level[at] >= outside))
    return where, level[at], enough


def maxima(track: DataFrame, column: str, prominence: float | str | None, signs: tuple[int, ...] = (1, -1), single: bool = False, size: int = C.CHUNK_FRAMES) -> DataFrame:
    """(video_id, sign, frame, height, enough): the maxima of sign * column; `single` looks at it in single precision. Values are numbers, frames consecutive. The prominence is a number, or a column that has each track's own."""
    own = [prominence] if isinstance(prominence, str) else []
    fixed = 0.0 if own else prominence or 0.0
    of = (lambda v: v.astype(np.float32).astype(np.float64)) if single else (lambda v: v)

    def finish(frames: np.ndarray, values: np.ndarray, *rest: np.ndarray) -> dict:
        x, found, carry = of(values), [], rest[-1]
        least = float(rest[0][0]) if own else fixed
        for sign in signs:
            turned = carry * [sign, 1, 1, sign, 1, 1, 1, 1]
            sides = carry[[4, 5]] if sign > 0 else carry[[6, 7]]
            where, height, enough = _maxima(frames, sign * x, turned, least, *sides)
            found.append((np.full(len(where), sign), where, height, enough))
        return dict(zip(("sign", FRAME, "height", "enough"), map(np.concatenate, zip(*found, strict=True)), strict=True))

    return C.scan(C.packed(track, [column, *own], size), [FRAME, column, *own], lambda f, v, *p: _summary(of(v), float(p[0][0]) if own else fixed), _carries, finish, {"sign": "int", FRAME: "long", "height": "double", "enough": "boolean"})


def decided(frames: np.ndarray, heights: np.ndarray, known: np.ndarray, distance: int, low: float, high: float) -> np.ndarray:
    """What becomes of each maximum of a stretch [low, high): the highest go first (of equals the later) and remove those nearer than the distance. What may depend on maxima beyond the stretch stays open."""
    a, b = np.searchsorted(frames, frames - distance + 1), np.searchsorted(frames, frames + distance)
    exposed = (frames - distance < low) | (frames + distance > high)
    out, tainted = known.copy(), np.zeros(len(frames), bool)
    free = out == _OPEN
    for k in np.argsort(heights, kind="stable")[::-1].tolist():
        if out[k] == _REMOVED:
            continue
        near = slice(a[k], b[k])
        if out[k] == _KEPT or not (tainted[k] or exposed[k]):
            out[near] = np.where(free[near], _REMOVED, out[near])
            out[k], free[near] = _KEPT, False
        else:
            tainted[near] = True
    return out


def thinned(found: DataFrame, distance: int, size: int = C.CHUNK_FRAMES) -> DataFrame:
    """The maxima that the distance leaves, with the columns of `maxima`."""
    if distance <= 2:  # maxima are never next to each other
        return found
    size = max(size, 2 * distance)  # a chunk's own maxima see all that is near, so each round decides the highest that are open
    margin = min(size, max(distance, LEAST_MARGIN, MARGIN_DISTANCES * distance))
    own = C.chunk_of(FRAME, size)
    names = ["sign", FRAME, "height", "enough", "state"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(FRAME, ignore_index=True)
        number = part["part"].iloc[0]
        low, high = number * size - margin, (number + 1) * size + margin
        part["state"] = decided(part[FRAME].to_numpy(), part["height"].to_numpy(), part["state"].to_numpy(), distance, -math.inf if low <= 0 else low, high)
        return part.loc[part[FRAME] // size == number, [KEY, *names]]

    state = staging.staged(found.withColumn("state", F.lit(_OPEN)), "maxima")
    while True:
        near = F.array_distinct(F.array(own, C.chunk_of(F.greatest(F.col(FRAME) - margin, F.lit(0)), size), C.chunk_of(F.col(FRAME) + margin, size)))
        dealt = state.withColumn("part", F.explode(near))
        state = staging.staged(dealt.groupBy(KEY, "sign", "part").applyInPandas(run, f"{KEY} string, sign int, {FRAME} long, height double, enough boolean, state int"), "thinned")
        if state.where(F.col("state") == _OPEN).isEmpty():
            return state.where(F.col("state") == _KEPT).drop("state")


def turns(track: DataFrame, fps: float, prominence: float | str | None, seconds: float, column: str = "pos", signs: tuple[int, ...] = (1, -1), single: bool = True, size: int = C.CHUNK_FRAMES) -> DataFrame:
    """(video_id, frame) of the peaks (sign 1) and troughs (-1), prominent and far enough apart."""
    distance = max(1, round(max(0.0, seconds) * fps))
    own = [prominence] if isinstance(prominence, str) else []

    def whole(frames: np.ndarray, x: np.ndarray, *least: np.ndarray) -> dict:
        x, bound = x.astype(np.float32 if single else np.float64), float(least[0][0]) if own else prominence
        return {FRAME: np.unique(np.concatenate([frames[kernels.find_peaks(sign * x.astype(np.float64), distance, bound)] for sign in signs]))}

    def short(rows: DataFrame) -> DataFrame:
        return C.each_track(rows, [column, *own], f"{FRAME} long", whole)

    def long(rows: DataFrame) -> DataFrame:
        return thinned(maxima(rows, column, prominence, signs, single, size), distance, size).where("enough").select(KEY, FRAME).distinct()

    return C.by_size(track, size, short, long)


def numbered(track: DataFrame, starts: DataFrame, name: str = "span", size: int = C.CHUNK_FRAMES) -> DataFrame:
    """Adds how many of the starts (video_id, frame) lie at or before each row: counts by chunk, and a window within a chunk."""
    here = C.chunk_of(FRAME, size)
    marked = track.join(starts.withColumn("_t", F.lit(1)), [KEY, FRAME], "left").withColumn("_c", here)
    by_chunk = starts.groupBy(KEY, here.alias("_c")).agg(F.count("*").alias("_n"))
    seen = marked.select(KEY, "_c").distinct().join(by_chunk, [KEY, "_c"], "left")
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(KEY).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(F.coalesce("_t", F.lit(0))).over(Window.partitionBy(KEY, "_c").orderBy(FRAME))
    return marked.join(seen.select(KEY, "_c", earlier.alias("_e")), [KEY, "_c"]).withColumn(name, F.col("_e") + within).select(*track.columns, name)
