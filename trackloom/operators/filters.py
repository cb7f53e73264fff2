"""Signal filters over tracks of any length: low-pass as a scan over chunks, smoothing as window frames with literal weights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import kernels
from trackloom.operators import chunks as C
from trackloom.schema import FRAME, KEY

_EDGE = 9  # samples that the filter's track is extended by on both sides
_ARRAYS = {FRAME: "array<bigint>", "value": "array<double>"}


def filled(packed: DataFrame, column: str) -> DataFrame:
    """(video_id, chunk, frame, value): chunks whose non-finite samples lie on the line between their finite neighbours, wherever these are; constant at the ends, zero where there are none."""

    def summary(frames: np.ndarray, x: np.ndarray) -> list[float]:
        good = np.flatnonzero(np.isfinite(x))
        return [np.nan] * 4 if not len(good) else [frames[good[0]], x[good[0]], frames[good[-1]], x[good[-1]]]

    def fold(s: np.ndarray) -> np.ndarray:
        out, at = np.full((len(s), 4), np.nan), np.flatnonzero(np.isfinite(s[:, 0]))
        before = np.searchsorted(at, np.arange(len(s))) - 1
        after = np.searchsorted(at, np.arange(len(s)), "right")
        out[before >= 0, :2] = s[at[before[before >= 0]], 2:]
        out[after < len(at), 2:] = s[at[after[after < len(at)]], :2]
        return out

    def finish(frames: np.ndarray, x: np.ndarray, carry: np.ndarray) -> dict:
        good = np.isfinite(x)
        if good.all():
            return {FRAME: frames, "value": x}
        known = np.concatenate([carry[:1], frames[good], carry[2:3]]), np.concatenate([carry[1:2], x[good], carry[3:]])
        there = np.isfinite(known[0])
        line = np.interp(frames, known[0][there], known[1][there]) if there.any() else np.zeros(len(frames))
        return {FRAME: frames, "value": np.where(good, x, line)}

    return C.scan(packed, [FRAME, column], summary, fold, finish, _ARRAYS, rows=False)


def lowpass(track: DataFrame, fps: float, column: str = "pos", cutoff: float = 8.0, size: int = C.CHUNK_FRAMES) -> DataFrame:
    """(video_id, frame, value): second-order Butterworth forwards and backwards, as kernels.lowpass.

    The filter is linear, so a chunk's end state is a matrix power of its entry state plus what it adds from rest. Two
    scans over chunks, one a direction, give every chunk its entry states.
    """

    def short(rows: DataFrame) -> DataFrame:
        return C.each_track(rows, [column], f"{FRAME} long, value double", lambda f, x: {FRAME: f, "value": kernels.lowpass(kernels.fill_bad(x), fps, cutoff)})

    return C.by_size(track, size, short, lambda rows: _lowpass_scan(rows, fps, column, cutoff, size))


def _lowpass_scan(track: DataFrame, fps: float, column: str, cutoff: float, size: int) -> DataFrame:
    filter_ = kernels.Biquad(fps, cutoff)
    whole = filled(C.packed(track, [column], size), column)

    def ahead(frames: np.ndarray, x: np.ndarray) -> list[float]:
        first, last = np.full(_EDGE + 1, np.nan), np.full(_EDGE + 1, np.nan)
        first[: len(x)], last[-len(x) :] = x[: _EDGE + 1], x[-_EDGE - 1 :]
        return [len(x), *filter_.run(x, np.zeros(2))[1], *first, *last]

    def forwards(s: np.ndarray) -> np.ndarray:
        """By chunk: whether the track is filtered at all, entry state, whether it is the last, and the extension behind the last."""
        n, out = int(s[:, 0].sum()), np.full((len(s), 4 + _EDGE), np.nan)
        out[:, 0], out[:, 3] = filter_.applies(n), 0
        out[-1, 3] = 1
        if not out[0, 0]:
            return out
        pad = min(_EDGE, n - 1)
        wide = _EDGE + 1
        heads = np.concatenate([line[3 : 3 + wide][: int(line[0])] for line in s[: wide + 1]])[: pad + 1]
        tails = np.concatenate([line[3 + wide :][-int(min(line[0], wide)) :] for line in s[-wide - 1 :]])[-pad - 1 :]
        front = 2 * heads[0] - heads[:0:-1]
        out[-1, 4 : 4 + pad] = 2 * tails[-1] - tails[-2::-1]
        state = filter_.run(front, filter_.rest * front[0])[1]
        for i, line in enumerate(s):
            out[i, 1:3] = state
            state = filter_.carried(int(line[0]), state) + line[1:3]
        return out

    def forth(frames: np.ndarray, x: np.ndarray, carry: np.ndarray) -> dict:
        if not carry[0]:
            return {FRAME: frames, "value": x, "back": np.array([0.0, len(x), 0, 0, 0, 0])}
        y, state = filter_.run(x, carry[1:3])
        own, enters = filter_.run(y[::-1], np.zeros(2))[1], np.zeros(2)
        if carry[3]:
            behind = filter_.run(carry[4:][np.isfinite(carry[4:])], state)[0][::-1]
            enters = filter_.run(behind, filter_.rest * behind[0])[1]
        return {FRAME: frames, "value": y, "back": np.array([1.0, len(x), *own, *enters])}

    def backwards(s: np.ndarray) -> np.ndarray:
        out = np.zeros((len(s), 3))
        out[:, 0], state = s[:, 0], s[-1, 4:6]
        for i in range(len(s) - 1, -1, -1):
            out[i, 1:] = state
            state = filter_.carried(int(s[i, 1]), state) + s[i, 2:4]
        return out

    def back(frames: np.ndarray, y: np.ndarray, carry: np.ndarray) -> dict:
        return {FRAME: frames, "value": filter_.run(y[::-1], carry[1:])[0][::-1] if carry[0] else y}

    once = C.scan(whole, [FRAME, "value"], ahead, forwards, forth, _ARRAYS | {"back": "array<double>"}, rows=False)
    entries = C.folded(once.select(KEY, "chunk", F.col("back").alias("summary")), backwards)
    return C.each(once.join(entries, [KEY, "chunk"]), [FRAME, "value", "carry"], back, {FRAME: "long", "value": "double"})


def with_margins(track: DataFrame, margin: int, size: int = C.CHUNK_FRAMES) -> DataFrame:
    """Rows dealt to chunks (`part`, `own`) with `margin` frames of their neighbours, so that a window frame never needs a whole track in one task."""
    chunk = [C.chunk_of(c, size) for c in (F.greatest(F.col(FRAME) - margin, F.lit(0)), F.col(FRAME), F.col(FRAME) + margin)]
    return track.withColumn("part", F.explode(F.array_distinct(F.array(*chunk)))).withColumn("own", F.col("part") == chunk[1])


def _dot(values: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)


def _lengths(track: DataFrame) -> DataFrame:
    return track.groupBy(KEY).agg((F.max(FRAME) + 1).alias("n"))


def gaussian(track: DataFrame, sigma: float, column: str = "pos", size: int = C.CHUNK_FRAMES) -> DataFrame:
    """(video_id, frame, value): gaussian weights to four deviations, the end samples repeated beyond the ends."""
    half = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    dealt = with_margins(track.select(KEY, FRAME, F.col(column).cast("double").alias("x")).join(_lengths(track), KEY), half, max(size, half))
    near = F.collect_list("x").over(Window.partitionBy(KEY, "part").orderBy(FRAME).rowsBetween(-half, half))
    met = dealt.select(KEY, FRAME, "n", "own", near.alias("near")).where("own")
    missing = lambda c: F.greatest(c, F.lit(0)).cast("int")
    wide = F.concat(F.array_repeat(F.element_at("near", 1), missing(half - F.col(FRAME))), F.col("near"), F.array_repeat(F.element_at("near", -1), missing(half - (F.col("n") - 1 - F.col(FRAME)))))
    return met.select(KEY, FRAME, _dot(wide, [w / sum(raw) for w in raw]).alias("value"))


def polynomial_window(seconds: float, fps: float) -> int:
    return max(5, round(max(0.0, seconds) * fps)) | 1


def polynomial(track: DataFrame, window: int, column: str = "pos", shrink: bool = True, size: int = C.CHUNK_FRAMES, few: bool = False) -> DataFrame:
    """(video_id, frame, value): a quadratic fitted around each sample; the ends take that of the first and last window.

    A track no longer than the window takes the largest odd window below the window that it holds (shrink), and stays
    as it is where that is under 5 or without shrink. `few` is for long tracks alone: their lengths, a row for more than a
    chunk, are broadcast, so that no join deals rows by track.
    """
    half = window // 2
    lengths = F.broadcast(_lengths(track)) if few else _lengths(track)
    rows = track.select(KEY, FRAME, F.col(column).cast("double").alias("x")).join(lengths, KEY)
    centre = kernels.savgol(np.eye(window), window)[half].tolist()
    long = rows.where(F.col("n") > window)
    inner = Window.partitionBy(KEY, "part").orderBy(FRAME).rowsBetween(-half, half)
    dealt = with_margins(long, half, max(size, window)).select(KEY, FRAME, "n", "own", F.collect_list("x").over(inner).alias("near"))
    middle = dealt.where(F.col("own") & (F.col(FRAME) >= half) & (F.col(FRAME) < F.col("n") - half)).select(KEY, FRAME, _dot(F.col("near"), centre).alias("value"))

    def by_matrix(lines: DataFrame, weights: dict[int, np.ndarray], length: Column) -> DataFrame:
        """Samples of a few rows a track at once: each is a line of a literal matrix times all of them."""
        if not weights:
            return lines.select(KEY, "side", FRAME, F.col("x").alias("value")).where(F.lit(False))
        held = lines.groupBy(KEY, "side").agg(F.sort_array(F.collect_list(F.struct(FRAME, "x"))).alias("s"), F.first(length).alias("k"))
        table = F.create_map(*[v for n, m in weights.items() for v in (F.lit(n), F.array(*[F.array(*map(F.lit, line.tolist())) for line in m]))])
        made = held.select(KEY, "side", "s", F.explode(F.transform(F.element_at(table, F.col("k")), lambda line, i: F.struct(i.alias("i"), F.aggregate(F.zip_with("s", line, lambda a, w: a["x"] * w), F.lit(0.0), lambda t, v: t + v).alias("v")))).alias("o"))
        return made.select(KEY, "side", F.get("s", F.col("o.i"))[FRAME].alias(FRAME), F.col("o.v").alias("value"))

    ends = long.where((F.col(FRAME) < window) | (F.col(FRAME) >= F.col("n") - window))
    sides = ends.select("*", F.explode(F.filter(F.array(F.when(F.col(FRAME) < window, 0), F.when(F.col(FRAME) >= F.col("n") - window, 1)), lambda s: s.isNotNull())).alias("side"))
    full = by_matrix(sides, {window: kernels.savgol(np.eye(window), window)}, F.lit(window))
    near_end = full.join(lengths, KEY).where(F.when(F.col("side") == 0, F.col(FRAME) < half).otherwise(F.col(FRAME) >= F.col("n") - half)).select(KEY, FRAME, "value")
    short = rows.where(F.col("n") <= window)
    fitted = {n: kernels.savgol(np.eye(n), w) for n in range(5, window + 1) if shrink and (w := n - 1 + n % 2) >= 5}
    small = by_matrix(short.where(F.col("n").isin(*fitted) if fitted else F.lit(False)).withColumn("side", F.lit(0)), fitted, F.col("n").cast("int")).drop("side")
    same = short.where(~F.col("n").isin(*fitted) if fitted else F.lit(True)).select(KEY, FRAME, F.col("x").alias("value"))
    return middle.unionByName(near_end).unionByName(small).unionByName(same)
