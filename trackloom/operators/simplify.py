"""Keyframes of tracks of any length: turning points of the smoothed track, refined until the curve through them fits, then fit for a device.

Refinement inserts the worst frame first, one after the other; a knot changes its own stretch between first knots and the
next on either side. Tracks are cut once a chunk, and each piece is refined together with some stretches of its
neighbours. Two pieces share what happens around their cut: if both insert the same frames there, with the same errors,
in the same order and set off by the same insertions, then each saw from the other all that reaches it, and either
side of the cut is what it is in the whole track. Where they differ, the cut is given up and the pieces become one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import staging
from trackloom.functions import kernels
from trackloom.functions.scalars import quantised
from trackloom.operators import chunks as C
from trackloom.operators import filters, turns
from trackloom.schema import FRAME, KEY

# Seconds of smoothing and between turning points, their prominence as a share of the usual range, the error allowed, and the fewest frames that are simplified.
SMOOTH_SECONDS, APART_SECONDS, PROMINENCE, MOST_ERROR, LEAST_FRAMES = 0.1, 0.2, 0.1, 3.0, 8
#: stretches that a piece sees beyond its own, and stretches on each side of a cut on which two pieces must agree
MARGIN, AROUND = 32, 2


def seeds(dense: DataFrame, fps: float, size: int = C.CHUNK_FRAMES) -> DataFrame:
    """(video_id, frame): the prominent turning points of the smoothed tracks (video_id, frame, y), and both ends. For tracks longer than a chunk: a row a track is broadcast."""
    bounds = dense.groupBy(KEY).agg(F.percentile("y", F.array(F.lit(0.05), F.lit(0.95))).alias("p"), F.array(F.min(FRAME), F.max(FRAME)).alias("ends"))
    smooth = filters.polynomial(dense, filters.polynomial_window(SMOOTH_SECONDS, fps), "y", shrink=False, size=size, few=True)
    # nine digits, so that what is equal but for rounding is a plateau
    even = smooth.join(F.broadcast(bounds), KEY).select(KEY, FRAME, F.round("value", kernels.DIGITS).alias("value"), (PROMINENCE * F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(1e-6))).alias("least"))
    return turns.turns(even, fps, "least", APART_SECONDS, "value", single=False, size=size).unionByName(bounds.select(KEY, F.explode("ends").alias(FRAME))).distinct()


def refined(dense: DataFrame, starts: DataFrame, most_error: float = MOST_ERROR, size: int = C.CHUNK_FRAMES, margin: int = MARGIN) -> DataFrame:
    """(video_id, frame, y): the knots of kernels.refine for tracks (video_id, frame, y) and their first knots, which hold both ends."""
    knots = dense.select(KEY, FRAME, "y").join(starts.select(KEY, FRAME, F.lit(True).alias("knot")), [KEY, FRAME], "left")
    own = staging.staged(turns.numbered(knots, starts, "stretch", size).withColumn("chunk", C.chunk_of(FRAME, size)), "stretches")
    spans = own.groupBy(KEY, "chunk").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high"), F.min(F.when(F.col("knot"), F.col("stretch"))).alias("piece"))
    spans = staging.staged(spans, "spans")
    cuts = spans.where("piece is not null").select(KEY, "piece")
    while True:
        found = staging.staged(_refined_pieces(own, spans, cuts, most_error, margin), "refined")
        insertion = ["piece", "turn", FRAME, "y", "level", "cause"]
        differ = found.where("cut").groupBy(KEY, *insertion).agg(F.count("*").alias("n")).where("n <> 2").select(KEY, "piece").distinct()
        if differ.isEmpty():
            return found.where("not cut").select(KEY, FRAME, "y")
        cuts = staging.staged(cuts.join(differ, [KEY, "piece"], "left_anti"), "cuts")


def _refined_pieces(own: DataFrame, spans: DataFrame, cuts: DataFrame, most_error: float, margin: int) -> DataFrame:
    """The knots of each piece, which begins with the stretch of its number, and as rows with `cut` what happens around the cuts (`piece`) on both its sides."""
    after = F.lead("piece").over(Window.partitionBy(KEY).orderBy("piece"))
    pieces = cuts.select(KEY, "piece", after.alias("after"))
    low, high = F.col("piece") - margin, F.col("after") + margin
    seen = spans.drop("piece").join(pieces, KEY).where((F.col("high") >= low) & (high.isNull() | (F.col("low") <= high)))
    dealt = own.join(seen.select(KEY, "chunk", "piece", "after"), [KEY, "chunk"])
    # a piece ends with the knot behind its last stretch
    inside = (F.col("stretch") >= low) & (high.isNull() | (F.col("stretch") < high) | ((F.col("stretch") == high) & F.col("knot")))
    dealt = dealt.where(inside).select(KEY, "piece", "after", FRAME, "y", F.coalesce("knot", F.lit(False)).alias("knot"), "stretch")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(FRAME, ignore_index=True)
        frames, y, stretch, log = part[FRAME].to_numpy(), part["y"].to_numpy(np.float64), part["stretch"].to_numpy(), []
        k = kernels.refine(y, np.flatnonzero(part["knot"].to_numpy()), most_error, log=log)
        first, after = part["piece"].iloc[0], part["after"].iloc[0]
        home = k[(stretch[k] >= first) & ~(stretch[k] >= after)]
        out = [pd.DataFrame({"piece": first, FRAME: frames[home], "y": y[home], "cut": False, "turn": -1, "level": 0.0, "cause": -1})]
        at, error, level, cause = (np.array([line[i] for line in log], t) for i, t in enumerate((np.int64, np.float64, np.float64, np.int64)))
        for number in (first, after):
            near = np.abs(stretch[at] - number + 0.5) < AROUND
            if number > 1:  # not at a track's ends
                out.append(pd.DataFrame({"piece": int(number), FRAME: frames[at[near]], "y": error[near], "cut": True, "turn": np.arange(near.sum()), "level": level[near], "cause": frames[cause[near]]}))
        return pd.concat([o for o in out if len(o)], ignore_index=True).assign(**{KEY: part[KEY].iloc[0]}) if any(map(len, out)) else out[0].assign(**{KEY: ""})

    return dealt.groupBy(KEY, "piece").applyInPandas(run, f"{KEY} string, piece long, {FRAME} long, y double, cut boolean, turn long, level double, cause long")


def device_pieces(knots: DataFrame, fps: float, size: int = C.CHUNK_FRAMES) -> DataFrame:
    """Knots (video_id, frame, y) dealt to pieces (`piece`, `home`) that kernels.device_points takes by themselves.

    A piece begins at the first knot of a chunk whose neighbours are both far enough away, in time and in value: these three
    stay, and behind the third only the other two are remembered. The piece before sees the second and third too.
    """
    near = Window.partitionBy(KEY, "chunk").orderBy(FRAME)
    own = knots.withColumn("chunk", C.chunk_of(FRAME, size))
    gap = kernels.LEAST_GAP_MS * fps / 1000
    apart = lambda f, y: (F.abs(F.col(FRAME) - f) >= gap) & (F.abs(F.col("y") - y) >= kernels.LEAST_MOVE)
    before, after = (F.lag(FRAME).over(near), F.lag("y").over(near)), (F.lead(FRAME).over(near), F.lead("y").over(near))
    free = own.withColumn("third", after[0]).withColumn("free", apart(*before) & apart(*after))
    chunks = free.groupBy(KEY, "chunk").agg(F.min(F.when(F.col("free"), F.struct(FRAME, "third"))).alias("cut"))
    earlier = F.last(F.col(f"cut.{FRAME}"), True).over(Window.partitionBy(KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    met = own.join(chunks.withColumn("earlier", F.coalesce(earlier, F.lit(-1))), [KEY, "chunk"])
    begun = F.coalesce(F.col(FRAME) >= F.col(f"cut.{FRAME}"), F.lit(False))
    home = F.struct(F.when(begun, F.col(f"cut.{FRAME}")).otherwise(F.col("earlier")).alias("piece"), F.lit(True).alias("home"))
    also = F.when(begun & (F.col(FRAME) <= F.col("cut.third")), F.struct(F.col("earlier").alias("piece"), F.lit(False).alias("home")))
    return met.select(KEY, FRAME, "y", F.inline(F.array_compact(F.array(home, also))))


def keyframes(track: DataFrame, fps: float, pos: str = "pos", size: int = C.CHUNK_FRAMES) -> DataFrame:
    """(video_id, frame, dense) of the frames that the simplification keeps; a track of under eight frames keeps all.

    Long tracks are refined, and then passed over for the device, in pieces of about a chunk.
    """
    dense = track.select(KEY, FRAME, quantised(F.col(pos)).cast("double").alias("y"))

    def whole(frames: np.ndarray, y: np.ndarray) -> dict:
        k = kernels.simplified(y, fps, LEAST_FRAMES)
        return {FRAME: frames[k], "y": y[k]}

    def device(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(FRAME, ignore_index=True)
        values = dict(zip(part[FRAME].tolist(), part["y"].tolist(), strict=True))
        return part.loc[part[FRAME].isin(kernels.device_points(values, part[FRAME].to_numpy(), fps)) & part["home"], [KEY, FRAME, "y"]]

    def long(rows: DataFrame) -> DataFrame:
        rows = staging.staged(rows, "dense")
        knots = refined(rows, staging.staged(seeds(rows, fps, size), "seeds"), size=size)
        return device_pieces(knots, fps, size).groupBy(KEY, "piece").applyInPandas(device, f"{KEY} string, {FRAME} long, y double")

    kept = C.by_size(dense, max(size, LEAST_FRAMES), lambda rows: C.each_track(rows, ["y"], f"{FRAME} long, y double", whole), long)
    return kept.withColumnRenamed("y", "dense")
