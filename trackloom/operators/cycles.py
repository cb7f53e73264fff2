"""Cycle normalisation of tracks of any length: what each cycle holds is aggregated, one number is carried along chains of cycles, frames follow from their own cycle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators import chunks as C
from trackloom.operators import turns as T
from trackloom.schema import FRAME, KEY


def normalised(track: DataFrame, troughs: DataFrame, fps: float, pos: str = "pos", reference: str = "pos", amplitude: float = 0.3, least_hz: float = 0.5, size: int = C.CHUNK_FRAMES) -> DataFrame:
    """(video_id, frame, value, inside): stretches from trough to trough of enough range (of the reference) and speed, widened to [0, 1].

    A trough is the end of one cycle and the start of the next, which reads what the former has made of it. So a cycle's
    range depends on the former's, but only where the two meet: cycles that fit and follow on form chains, the value is
    carried along a chain's rows (six numbers a cycle), and no frame takes part in it. Equals kernels.normalised_cycles.
    """
    longest = max(1, math.floor(fps / least_hz)) if fps > 0 and least_hz > 0 else 0
    at = troughs.select(KEY, FRAME).distinct()
    # behind a trough the next cycle's own frames begin; the trough itself is the last one's
    cut = T.numbered(track.select(KEY, FRAME, F.col(pos).alias("x"), F.col(reference).alias("r")), at.select(KEY, (F.col(FRAME) + 1).alias(FRAME)), "cycle", size)
    marked = cut.join(at.withColumn("_end", F.lit(True)), [KEY, FRAME], "left")
    own = marked.groupBy(KEY, "cycle").agg(F.max(FRAME).alias("e"), F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.max_by("x", FRAME).alias("x_end"), F.min("r").alias("r_low"), F.max("r").alias("r_high"), F.max_by("r", FRAME).alias("r_end"), F.bool_or("_end").alias("closed"))
    order = Window.partitionBy(KEY).orderBy("cycle")
    before = lambda c: F.lag(c).over(order)
    reach = F.greatest("r_high", before("r_end")) - F.least("r_low", before("r_end"))
    fits = F.coalesce((F.col("cycle") > 0) & F.col("closed") & (F.col("n") >= 2) & (F.col("n") <= longest) & (reach >= amplitude), F.lit(False))
    known = own.select(KEY, "cycle", "e", "low", "high", "x_end", before("x_end").alias("x_start"), fits.alias("fits"))
    new = (~F.col("fits") | ~F.coalesce(before("fits"), F.lit(False))).cast("int")
    chained = known.withColumn("_n", new).withColumn("chain", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")
    columns = [KEY, "chain", "cycle", "e", "low", "high", "x_end", "x_start", "fits"]

    def carry(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Along each chain: a cycle that is made gives the next what it has made of their trough; one too flat gives it as it was."""
        chain, carried = None, None
        for part in parts:
            starts, lows, spans, made = [], [], [], []
            for key, number, low, high, x_end, x_start, ok in zip(*(part[c].tolist() for c in (KEY, "chain", "low", "high", "x_end", "x_start", "fits")), strict=True):
                first = carried if chain == (key, number) and carried is not None else x_start
                if ok:
                    low, high = min(first, low), max(first, high)
                wide = bool(ok and high - low > 1e-6)
                chain, carried = (key, number), (x_end - low) / (high - low) if wide else None
                starts.append((first - low) / (high - low) if wide else None)
                lows.append(low)
                spans.append(high - low)
                made.append(wide)
            yield pd.DataFrame({KEY: part[KEY], "cycle": part["cycle"], "e": part["e"], "low": lows, "span": spans, "made": made, "start": pd.array(starts, "Float64")})

    ordered = chained.select(*columns).repartition(KEY, "chain").sortWithinPartitions(KEY, "chain", "cycle")
    done = ordered.mapInPandas(carry, f"{KEY} string, cycle long, e long, low double, span double, made boolean, start double")
    done = done.withColumn("next_start", F.lead("start").over(order))
    met = cut.join(done, [KEY, "cycle"])
    ends = (F.col(FRAME) == F.col("e")) & F.col("next_start").isNotNull()
    value = F.when(ends, F.col("next_start")).when(F.col("made"), (F.col("x") - F.col("low")) / F.col("span")).otherwise(F.col("x"))
    return met.select(KEY, FRAME, value.alias("value"), (ends | F.col("made")).alias("inside"))
