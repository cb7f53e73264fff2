"""Logical tables of the track engine, and how the driver's tables stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY, FRAME = "video_id", "frame"


def in_order():
    return Window.partitionBy(KEY).orderBy(FRAME)


def whole():
    return Window.partitionBy(KEY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(before: int | None, after: int | None):
    """The frame of rows from `before` to `after` around the current one; None is unbounded."""
    return in_order().rowsBetween(Window.unboundedPreceding if before is None else before, Window.unboundedFollowing if after is None else after)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame, pos, pts): one dense track an event type; pts are irregular seconds."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    numbered = events.select(F.col("event_type").alias(KEY), (F.row_number().over(order) - 1).cast("long").alias(FRAME), F.least(F.col("value") / 100, F.lit(1.0)).alias("pos"), seconds.alias("s"))
    return numbered.select(KEY, FRAME, "pos", (F.col("s") - F.min("s").over(whole())).alias("pts"))


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame, logits): 64 bins a sample."""
    order = Window.partitionBy("label").orderBy("vec_id")
    logits = F.transform("embedding", lambda x: x.cast("double") * 20)
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias(KEY), (F.row_number().over(order) - 1).cast("long").alias(FRAME), logits.alias("logits"))
