"""Order-bound operators: one grouped Arrow or pandas call a track, the rest stays in DataFrame operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import kernels
from trackloom.functions.scalars import quantised
from trackloom.operators import filters, turns
from trackloom.operators.simplify import keyframes as keyframes  # noqa: PLC0414
from trackloom.schema import FRAME, KEY, rows, whole

CHUNK_SECONDS, OVERLAP_SECONDS = 300.0, 2.0


def filtered(track: DataFrame, kind: str, fps: float, pos: str = "pos") -> DataFrame:
    """(video_id, frame, value): lowpass, gaussian, or savgol with its window shrunk to the track."""
    if kind == "lowpass":
        return filters.lowpass(track, fps, pos)
    if kind == "gaussian":
        return filters.gaussian(track, max(0.5, 0.12 * fps), pos)
    return filters.polynomial(track, filters.polynomial_window(0.45, fps), pos)


def turning_points(track: DataFrame, fps: float, prominence: float = 0.035, seconds: float = 0.15, pos: str = "pos") -> DataFrame:
    """Peaks, troughs and both ends."""
    ends = track.groupBy(KEY).agg(F.array(F.min(FRAME), F.max(FRAME)).alias("e")).select(KEY, F.explode("e").alias(FRAME))
    return turns.turns(track, fps, prominence, seconds, pos, single=False).union(ends).distinct()


def turning_spans(track: DataFrame, fps: float, prominence: float = 0.035, seconds: float = 0.15, pos: str = "pos") -> DataFrame:
    """Adds span: the number of the stretch between successive peaks and troughs, prominent and far enough apart, that a frame lies in."""
    return turns.numbered(track, turns.turns(track, fps, prominence, seconds, pos))


def troughs(track: DataFrame, fps: float, seconds: float = 0.15, pos: str = "pos", prominence: float | None = None) -> DataFrame:
    return turns.turns(track, fps, prominence, seconds, pos, signs=(-1,))


def reconstruction(track: DataFrame, kept: DataFrame, pos: str = "pos") -> DataFrame:
    """A row a track: raw and kept counts, kept share, and mean, 95th percentile and maximum of the error of the monotone cubic and of straight lines through the kept frames, rounded half to even.

    The knots' slopes follow from neighbouring knots and each frame's curve from its own stretch, so all of it is
    window expressions and aggregates; only the windows are by track.
    """
    dense = track.withColumn("y", quantised(F.col(pos)).cast("double")).select(KEY, FRAME, "y")
    fitted = interpolated(dense, kept.select(KEY, FRAME))
    errors = fitted.select(KEY, F.col("knot"), F.abs(F.col("cubic") - F.col("y")).alias("cubic"), F.abs(F.col("linear") - F.col("y")).alias("linear"))
    stats = [F.bround(f, 3).alias(f"{c}_{name}") for c in ("cubic", "linear") for name, f in (("mean", F.avg(c)), ("p95", F.percentile(c, F.lit(0.95))), ("max", F.max(c)))]
    return errors.groupBy(KEY).agg(F.count("*").alias("raw"), F.count_if("knot").alias("kept"), F.bround(F.count_if("knot") / F.count("*"), 5).alias("kept_share"), *stats)


def interpolated(dense: DataFrame, kept: DataFrame) -> DataFrame:
    """(video_id, frame, y, knot, cubic, linear) of rows (video_id, frame, y): the monotone cubic and the line through the kept frames' values."""
    w = Window.partitionBy(KEY).orderBy(FRAME)
    knots = dense.join(kept.distinct(), [KEY, FRAME], "left_semi").select(KEY, F.col(FRAME).alias("x"), F.col("y").alias("v"))
    kw = Window.partitionBy(KEY).orderBy("x")
    step, rise = F.lead("x").over(kw) - F.col("x"), F.lead("v").over(kw) - F.col("v")
    knots = knots.withColumn("h", step.cast("double")).withColumn("d", rise / F.col("h"))
    before, after = (lambda c, k=1: F.lag(c, k).over(kw)), (lambda c, k=1: F.lead(c, k).over(kw))
    knots = knots.withColumns({"hb": before("h"), "db": before("d"), "hbb": before("h", 2), "dbb": before("d", 2), "ha": after("h"), "da": after("d")})

    def end(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
        raw = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return F.when(d1.isNull(), d0).when(raw * d0 <= 0, 0.0).when((d0 * d1 <= 0) & (F.abs(raw) > 3 * F.abs(d0)), 3 * d0).otherwise(raw)

    h, d, hb, db = (F.col(c) for c in ("h", "d", "hb", "db"))
    harmonic = (3 * h + 3 * hb) / ((2 * h + hb) / db + (h + 2 * hb) / d)
    inner = F.when(db * d > 0, harmonic).otherwise(0.0)
    slope = F.when(db.isNull() & d.isNull(), 0.0).when(db.isNull(), end(h, F.col("ha"), d, F.col("da"))).when(d.isNull(), end(hb, F.col("hbb"), db, F.col("dbb"))).otherwise(inner)
    knots = knots.withColumn("m", slope).withColumns({"v1": after("v")}).withColumn("m1", F.lead("m").over(kw)).select(KEY, F.col("x").alias(FRAME), "v", "v1", "m", "m1", "h")
    met = dense.join(knots, [KEY, FRAME], "left").withColumn("knot", F.col("v").isNotNull())
    own = F.last(F.when(F.col("knot"), F.struct(F.col(FRAME).alias("x"), "v", "v1", "m", "m1", "h")), True).over(w)
    met = met.select(KEY, FRAME, "y", "knot", own.alias("k"))
    t = (F.col(FRAME) - F.col("k.x")) / F.col("k.h")
    curve = F.col("k.v") * (1 + 2 * t) * (1 - t) * (1 - t) + F.col("k.m") * F.col("k.h") * t * (1 - t) * (1 - t) + F.col("k.v1") * t * t * (3 - 2 * t) + F.col("k.m1") * F.col("k.h") * t * t * (t - 1)
    line = F.col("k.v") + (F.col("k.v1") - F.col("k.v")) * t
    return met.select(KEY, FRAME, "y", "knot", F.when(F.col("knot"), F.col("k.v")).otherwise(curve).alias("cubic"), F.when(F.col("knot"), F.col("k.v")).otherwise(line).alias("linear"))


def postprocessed(track: DataFrame, fps: float, pos: str = "pos", chunk_s: float = CHUNK_SECONDS, overlap_s: float = OVERLAP_SECONDS, stats: bool = False) -> DataFrame:
    """(video_id, frame, value), or with `stats` a row of counts and the highest thresholds a track: overlapping chunks, each one task's group, blended by ramps; so one long track spreads over many tasks."""
    chunk, overlap = max(1, round(chunk_s * fps)), max(0, round(overlap_s * fps))
    track = track.withColumn("n", F.max(FRAME).over(whole()) + 1)
    n = F.col("n")
    step = max(1, chunk - overlap)
    single = (n <= chunk) | F.lit(chunk <= overlap + 2)
    count = F.greatest(F.ceil((n - overlap) / step), F.lit(1))
    first, last = F.greatest(F.ceil((F.col(FRAME) - chunk + 1) / step), F.lit(0)), F.least(F.floor(F.col(FRAME) / step), count - 1)
    parts = F.when(single, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))
    cut = track.select(KEY, FRAME, pos, "n", single.alias("whole"), parts.alias("parts")).withColumn("part", F.explode("parts")).drop("parts")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(FRAME)
        f, size = part[FRAME].to_numpy(), len(part)
        w = np.ones(size)
        if not part["whole"].iloc[0] and overlap:
            ramp = np.linspace(0, 1, overlap + 2)[1:-1][:size]
            if f[0] > 0:
                w[: len(ramp)] *= ramp
            if f[-1] < part["n"].iloc[0] - 1:
                w[-len(ramp) :] *= ramp[::-1]
        return pd.DataFrame({KEY: part[KEY], FRAME: f, "w": w, "value": kernels.postprocessed(part[pos].to_numpy(np.float64), fps)[0]})

    def count(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(FRAME)
        return pd.DataFrame([{KEY: part[KEY].iloc[0], **kernels.postprocessed(part[pos].to_numpy(np.float64), fps)[1]}])

    if stats:
        names = [*kernels.COUNTS, "low", "high"]
        each = cut.groupBy(KEY, "part").applyInPandas(count, f"{KEY} string, " + ", ".join(f"{c} {'double' if c in ('low', 'high') else 'long'}" for c in names))
        sums = [F.sum(c).alias(c) for c in kernels.COUNTS[1:]]
        size = cut.groupBy(KEY).agg(F.first("n").alias("samples"))  # frames in two chunks count once here, twice in the sums
        return size.join(each.groupBy(KEY).agg(F.count("*").alias("chunks"), *sums, F.max("low").alias("low"), F.max("high").alias("high")), KEY)
    done = cut.groupBy(KEY, "part").applyInPandas(run, f"{KEY} string, {FRAME} long, w double, value double")
    mean = F.sum(F.col("w") * F.col("value")) / F.greatest(F.sum("w"), F.lit(1e-6))
    return done.groupBy(KEY, FRAME).agg(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("value"))
