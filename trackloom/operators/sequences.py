"""Window operators over tracks (video_id, frame, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators.chunks import CHUNK_FRAMES, chunk_of
from trackloom.schema import FRAME, KEY, in_order, rows, whole

# Hold gate, confidence and window constants.
HOLD_THRESHOLD, HOLD_SECONDS = 0.35, 0.75
RESIDUAL_HALF_RANGE, GAP_CEILING, SMOOTH = 0.085, 0.25, 9
LEAST_FIT, CROP, WEIGHT_FLOOR = 32, 256, 0.01


def moving_average(x: Column, window: int = SMOOTH, short: bool = False) -> Column:
    """Centred, divided by the true count, of an even window the earlier half is the longer. The window is no longer than the track: `short` is for tracks of fewer frames than it, see `by_length`."""
    if window < 2:
        return x.cast("double")
    if not short:
        return F.avg(x).over(rows(-(window // 2), (window - 1) // 2))
    # a track shorter than the window stands whole in this bounded frame
    n, i, near = F.count("*").over(whole()), F.row_number().over(in_order()) - 1, F.collect_list(x).over(rows(1 - window, window - 1))
    low = F.greatest(i - F.floor(n / 2), F.lit(0))
    size = F.least(i + F.floor((n - 1) / 2), n - 1) - low + 1
    return F.aggregate(F.slice(near, (low + 1).cast("int"), size.cast("int")), F.lit(0.0), lambda a, v: a + v) / size


def by_length(track: DataFrame, window: int, make: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """make(rows, short) for the tracks that are shorter than the window, if there are any, and for the others."""
    short = track.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") < window).select(KEY)
    if short.isEmpty():
        return make(track, False)
    return make(track.join(short, KEY, "left_anti"), False).unionByName(make(track.join(short, KEY, "left_semi"), True))


def gradient(x: Column) -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(x).over(in_order()), F.lead(x).over(in_order())
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def running_median(x: Column, window: int) -> Column:
    return F.percentile(x, F.lit(0.5)).over(rows(-(window - 1), 0))


def with_runs(track: DataFrame, flag: Column, run: str = "run") -> DataFrame:
    """Adds the number of each run of true rows within its track; null elsewhere. Frames are consecutive."""
    on = flag.cast("int")
    marked = track.withColumn("_on", on)
    first = (F.col("_on") == 1) & (F.coalesce(F.lag("_on").over(in_order()), F.lit(0)) == 0)
    return marked.withColumn("_first", first.cast("int")).withColumn(run, F.when(F.col("_on") == 1, F.sum("_first").over(rows(None, 0)))).drop("_on", "_first")


def runs(track: DataFrame, flag: Column) -> DataFrame:
    """(video_id, start, end) of the runs of true rows, half-open."""
    return with_runs(track, flag).where("run is not null").groupBy(KEY, "run").agg(F.min(FRAME).alias("start"), (F.max(FRAME) + 1).alias("end")).drop("run")


def merged(found: DataFrame, gap: int, least: int = 1) -> DataFrame:
    """Runs at most `gap` apart become one; those shorter than `least` go."""
    order = Window.partitionBy(KEY).orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("end").over(order) > gap).cast("int"), F.lit(1))
    grouped = found.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(KEY, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") >= least).drop("_g")


def hold_gate(track: DataFrame, fps: float, threshold: float = HOLD_THRESHOLD, seconds: float = HOLD_SECONDS, pos: str = "pos", act: str = "act") -> DataFrame:
    """Low-activity runs long enough take the trailing median at their start."""
    least = max(1, round(seconds * fps))
    found = with_runs(track.withColumn("_median", running_median(F.col(pos), least)), F.col(act) < threshold)
    island = Window.partitionBy(KEY, "run").orderBy(FRAME)
    whole = Window.partitionBy(KEY, "run")
    held = F.col("run").isNotNull() & (F.count("*").over(whole) >= least)
    return found.withColumn("gated", F.when(held, F.first("_median").over(island)).otherwise(F.col(pos))).drop("_median", "run")


def linear_fill(track: DataFrame, column: str, size: int = CHUNK_FRAMES) -> DataFrame:
    """The track with the column's non-finite samples on the line between their finite neighbours, constant at the ends, zero if there is none.

    The nearest finite samples are looked for within chunks, forwards and, in falling order, backwards; chunks have
    the last one before them and the first one after them from a row a chunk.
    """
    x = F.col(column)
    ok = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    marked = track.withColumn("_c", chunk_of(FRAME, size)).withColumn("_ok", F.when(ok.isNotNull(), F.struct(F.col(FRAME).alias("f"), ok.alias("x"))))
    chunk = Window.partitionBy(KEY).orderBy("_c")
    later = Window.partitionBy(KEY).orderBy(F.desc("_c"))
    ends = marked.groupBy(KEY, "_c").agg(F.min("_ok").alias("first"), F.max("_ok").alias("last"))
    up_to = lambda c, w: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    outside = ends.select(F.col(KEY).alias("_k"), F.col("_c").alias("_d"), up_to("last", chunk).alias("_before"), up_to("first", later).alias("_after"))
    met = marked.join(outside, F.col(KEY).eqNullSafe(F.col("_k")) & (F.col("_c") == F.col("_d")))
    here = Window.partitionBy(KEY, "_c")
    near = lambda order: F.last("_ok", True).over(here.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    a, b = F.coalesce(near(F.asc(FRAME)), F.col("_before")), F.coalesce(near(F.desc(FRAME)), F.col("_after"))
    met = met.withColumn("_a", a).withColumn("_b", b)
    between = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col(FRAME) - F.col("_a.f")) / F.nullif(F.col("_b.f") - F.col("_a.f"), F.lit(0))
    return met.withColumn(column, F.coalesce("_ok.x", between, "_a.x", "_b.x", F.lit(0.0))).select(*track.columns)


def interleave(track: DataFrame, column: str) -> DataFrame:
    """Each sample and its successor; the last is repeated."""
    after = F.coalesce(F.lead(column).over(in_order()), F.col(column))
    paired = track.select(KEY, FRAME, F.array(F.col(column), after).alias("_pair"))
    return paired.select(KEY, FRAME, F.posexplode("_pair").alias("half", column)).select(KEY, (F.col(FRAME) * 2 + F.col("half")).alias(FRAME), column)


def min_max(x: Column) -> Column:
    low, high = F.min(x).over(whole()), F.max(x).over(whole())
    return F.when(high - low > 1e-9, (x - low) / (high - low)).otherwise(x)


def hopping_windows(track: DataFrame, crop: int = CROP, stride: int | None = None) -> DataFrame:
    """Each row once for each window it lies in, with the window's start. Windows follow from the frame number, no join."""
    stride = min(max(1, stride or crop // 2), crop)
    track = track.withColumn("_n", F.max(FRAME).over(whole()) + 1)
    n = F.col("_n")
    last = F.floor((n - crop) / stride)
    regular = F.when(n <= crop, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.transform(F.sequence(F.greatest(F.ceil((F.col(FRAME) - crop + 1) / stride), F.lit(0)), F.floor(F.col(FRAME) / stride)), lambda k: k * stride), lambda s: s <= last * stride)
    )
    tail = F.when((n > crop) & ((n - crop) % stride != 0) & (F.col(FRAME) >= n - crop), F.array((n - crop).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return track.withColumn("start", F.explode(F.concat(regular, tail))).drop("_n")


def bartlett(k: Column, size: int) -> Column:
    return 1 - F.abs(2 * k / (size - 1) - 1) + WEIGHT_FLOOR


def blended(windows: DataFrame, value: str, crop: int = CROP) -> DataFrame:
    """Weighted mean over the windows of each frame."""
    w = bartlett((F.col(FRAME) - F.col("start")).cast("double"), max(2, crop))
    return windows.groupBy(KEY, FRAME).agg((F.sum(w * F.col(value)) / F.greatest(F.sum(w), F.lit(1e-8))).alias(value))


def blended_distributions(windows: DataFrame, probs: str = "p", act: str = "act", bins: int = 64, crop: int = CROP) -> DataFrame:
    """(video_id, frame, p, act): the windows' bin probabilities and activities, blended by weight and renormalised, to be decoded afterwards.

    One sum a bin in one aggregate, so map-side sums move and no row is multiplied by its bins.
    """
    w = bartlett((F.col(FRAME) - F.col("start")).cast("double"), max(2, crop))
    sums = F.array(*(F.sum(w * F.get(probs, F.lit(i))) for i in range(bins)))
    found = windows.groupBy(KEY, FRAME).agg(sums.alias("p"), F.sum(w * F.col(act)).alias("act"), F.greatest(F.sum(w), F.lit(1e-8)).alias("w"))
    found = found.select(KEY, FRAME, F.transform("p", lambda x: x / F.col("w")).alias("p"), (F.col("act") / F.col("w")).alias("act"))
    all_ = F.greatest(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), F.lit(1e-12))
    return found.withColumn("sum", all_).select(KEY, FRAME, F.transform("p", lambda x: x / F.col("sum")).alias("p"), "act")


def speed_residual(track: DataFrame, pos: str = "pos", spread: str = "spread", short: bool = False) -> DataFrame:
    """Spread minus its fit on speed; the mean where there are too few samples or no spread of speed."""
    moved = track.withColumn("speed", F.abs(gradient(F.col(pos)))).withColumn("speed", moving_average(F.col("speed"), short=short))
    fits = (F.count("*").over(whole()) >= LEAST_FIT) & (F.stddev_pop("speed").over(whole()) > 1e-9)
    line = F.regr_slope(F.col(spread), F.col("speed")).over(whole()) * F.col("speed") + F.regr_intercept(F.col(spread), F.col("speed")).over(whole())
    return moved.withColumn("residual", F.col(spread) - F.when(fits, line).otherwise(F.avg(spread).over(whole())))


def confidence(track: DataFrame, spans: Callable[[DataFrame], DataFrame], pos: str = "pos", spread: str = "spread", gap: str = "gap") -> DataFrame:
    """c1 from the spread's residual, c2 from the mode gap, c3 the lower of their medians in each stroke; spans(positions) adds the strokes' numbers as span."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    def signals(part: DataFrame, short: bool) -> DataFrame:
        both = speed_residual(part, pos, spread, short)
        return both.withColumn("c1", clip(0.5 - moving_average(F.col("residual"), short=short) / (2 * RESIDUAL_HALF_RANGE))).withColumn("c2", clip(1 - moving_average(F.col(gap), short=short) / GAP_CEILING))

    stroke = Window.partitionBy(KEY, "span")
    c3 = F.least(F.percentile("c1", F.lit(0.5)).over(stroke), F.percentile("c2", F.lit(0.5)).over(stroke))
    strokes = spans(track.select(KEY, FRAME, pos)).select(KEY, FRAME, "span")
    return by_length(track, SMOOTH, signals).join(strokes, [KEY, FRAME]).withColumn("c3", c3)


def stretched(track: DataFrame, segment: str, pos: str = "pos", gain: float = 4.0, linear: bool = False) -> Column:
    """Each segment widened by its own range or, by tanh, its own deviation."""
    w = Window.partitionBy(KEY, segment)
    low, high = F.min(pos).over(w), F.max(pos).over(w)
    if linear:
        return F.when(high - low > 1e-6, (F.col(pos) - low) / (high - low)).otherwise(F.col(pos))
    std = F.stddev_pop(pos).over(w)
    scale = F.when(std > 1e-6, std).otherwise(F.greatest((high - low) / 6, F.lit(1e-6)))
    return 0.5 * (F.tanh(gain * (F.col(pos) - F.avg(pos).over(w)) / scale) + 1)
