"""Script sinks and sources: nested JSON, and the project file's binary scripts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.schema import FRAME, KEY
from trackloom.sources.layout import decode_actions, encode_actions


def _listed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "pos"))).alias("actions"))


def script_json(keyframes: DataFrame, axes: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """(video_id, json) of rows (video_id, at, pos): one document a track, actions in order of time. A track's actions are its keyframes, so the list is bounded by the track.

    `axes` has rows (video_id, axis, at, pos) at the main track's times, else the query fails; a document with axes is
    version 1.1. `metadata` has one row a track: video_id and a struct or map `metadata`.
    """
    made = _listed(keyframes, [KEY])
    version = F.lit("1.0")
    parts = [F.lit(False).alias("inverted"), F.lit(100).alias("range"), F.col("actions")]
    if axes is not None:
        each = _listed(axes, [KEY, "axis"])
        found = F.array_sort(F.collect_list(F.struct(F.col("axis").alias("id"), "actions")))
        found = F.transform(found, lambda x: F.struct(x["id"].alias("id"), F.create_map().cast("map<string,string>").alias("metadata"), x["actions"].alias("actions")))
        made = made.join(each.groupBy(KEY).agg(found.alias("axes")), KEY, "left")
        times = lambda c: F.transform(c, lambda a: a["at"])
        same = F.forall(F.col("axes"), lambda x: times(x["actions"]) == times(F.col("actions")))
        made = made.withColumn("axes", F.when(F.col("axes").isNull() | same, F.col("axes")).otherwise(F.raise_error(F.concat(F.lit("an axis of "), KEY, F.lit(" does not share the track's times")))))
        version = F.when(F.col("axes").isNotNull(), "1.1").otherwise("1.0")
        parts.append(F.col("axes"))
    if metadata is not None:
        made = made.join(metadata.select(KEY, "metadata"), KEY, "left")
        parts.append(F.col("metadata"))
    return made.select(KEY, F.to_json(F.struct(version.alias("version"), *parts)).alias("json"))


def script_pair(dense: DataFrame, kept: DataFrame, stats: DataFrame, least: int = 8, axes: DataFrame | None = None) -> DataFrame:
    """(video_id, variant, json): the dense document of every track, and the simplified one of those with `least` frames.

    dense has (video_id, frame, at, pos), kept (video_id, frame), stats one row a track, axes (video_id, axis, frame, at,
    pos); the simplified document has the kept frames of the track and of its axes, and the errors in its metadata.
    """
    size = dense.groupBy(KEY).agg(F.count("*").alias("n"))
    long = size.where(F.col("n") >= least).select(KEY)
    few_frames = kept.join(long, KEY, "left_semi")
    cut = lambda rows: rows.join(few_frames, [KEY, FRAME], "left_semi")
    named = lambda rows, variant, *more: rows.select(KEY, F.struct(F.lit(variant).alias("variant"), *more).alias("metadata"))
    raw = script_json(dense, axes, metadata=named(size, "dense", (F.col("n") >= least).alias("has_simplified")))
    errors = [c for c in stats.columns if c != KEY]
    few = script_json(cut(dense), cut(axes) if axes is not None else None, metadata=named(stats, "simplified", *errors))
    return raw.withColumn("variant", F.lit("dense")).unionByName(few.withColumn("variant", F.lit("simplified"))).select(KEY, "variant", "json")


def read_script_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, pos) of every script below a folder."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    parsed = F.from_json("value", "actions array<struct<at:bigint,pos:int>>")
    return raw.select("path", F.inline(F.coalesce(parsed["actions"], F.array().cast("array<struct<at:bigint,pos:int>>"))))


def packed_scripts(keyframes: DataFrame) -> DataFrame:
    """(video_id, data): binary scripts; per float32 second the last action stays, negative times go."""
    seconds = (F.col("at") / 1000).cast("float")
    pos = F.least(F.greatest(F.col("pos"), F.lit(0)), F.lit(100))
    last = keyframes.where("at >= 0").withColumn("s", seconds).groupBy(KEY, "s").agg(F.max_by(F.struct("at", pos.alias("pos")), F.col("at")).alias("v"))
    listed = last.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("s", F.col("v.pos").cast("int").alias("pos")))).alias("rows"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            keys, rows = p.column(0), p.column(1)
            for i, key in enumerate(keys.to_pylist()):  # one script at a time, as columns
                seconds, pos = rows.slice(i, 1).flatten().flatten()
                data = encode_actions(seconds.to_numpy(zero_copy_only=False), pos.to_numpy(zero_copy_only=False), f"{key}.funscript", key)
                yield pa.RecordBatch.from_arrays([keys.slice(i, 1), pa.array([data], pa.binary())], [KEY, "data"])

    return listed.select(KEY, "rows").mapInArrow(run, f"{KEY} string, data binary")


#: actions of an output batch
ACTION_ROWS = 1 << 17


def unpacked_scripts(packed: DataFrame) -> DataFrame:
    """(video_id, seconds, pos) of binary scripts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for key, data in zip(p.column(0), p.column(1), strict=True):
                seconds, pos = decode_actions(memoryview(data.as_buffer()).tobytes())
                for at in range(0, len(seconds), ACTION_ROWS):
                    s, v = seconds[at : at + ACTION_ROWS], pos[at : at + ACTION_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, len(s)), pa.array(np.ascontiguousarray(s), pa.float32()), pa.array(v.astype(np.int32))], [KEY, "seconds", "pos"])

    return packed.select(KEY, "data").mapInArrow(run, f"{KEY} string, seconds float, pos int")


def list_videos(spark: SparkSession, target: str, excluded: list[str] = (), again: bool = False, pattern: str = "*.mp4") -> DataFrame:
    """(path, modificationTime, length) of the videos below a folder without a script beside them, newest first; excluded folders are prefixes of the whole path. A file that is named itself is always kept."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    named = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (read if named else read.option("pathGlobFilter", pattern)).load(target).select("path", "modificationTime", "length")
    if named:
        return found
    stem = F.regexp_replace("path", r"\.[^./]*$", "").alias("stem")
    if not again:
        scripts = read.option("pathGlobFilter", "*.funscript").load(target).select(stem)
        found = found.withColumn("stem", stem).join(scripts, "stem", "left_anti").drop("stem")
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    for path in excluded:
        found = found.where(~F.startswith(plain, F.lit(re.sub("^[a-z]+:/+", "/", path).rstrip("/") + "/")))
    return found.orderBy(F.desc("modificationTime"))


def progress(store: DataFrame, expected: DataFrame) -> DataFrame:
    """(video_id, completed, expected, resume_at) of an append-only slot store: the slots that are there without a gap from 0."""
    done = store.groupBy(KEY).agg(F.count_distinct(FRAME).alias("n"), F.max(FRAME).alias("top"))
    completed = F.when(F.col("n") == F.col("top") + 1, F.col("n")).otherwise(F.lit(0))
    met = expected.join(done, KEY, "left").withColumn("completed", F.coalesce(completed, F.lit(0)))
    return met.select(KEY, "completed", "expected", F.when(F.col("completed") > F.col("expected"), 0).otherwise(F.col("completed")).alias("resume_at"))


def resume_points(store: DataFrame, wanted: DataFrame, slots_per_window: int = 1) -> DataFrame:
    """(video_id, completed, resume_at, restart) of an append-only slot store (video_id, slot, identity).

    A store whose identity isn't the wanted one starts anew, and so does one with a gap or more slots than expected;
    else it resumes after its last whole window, or is done.
    """
    held = store.groupBy(KEY).agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("top"), F.min("identity").alias("low"), F.max("identity").alias("high"))
    met = wanted.join(held, KEY, "left")
    fits = (F.col("low") == F.col("identity")) & (F.col("high") == F.col("identity")) & (F.col("n") == F.col("top") + 1) & (F.col("n") <= F.col("expected"))
    whole = F.floor(F.col("n") / slots_per_window) * slots_per_window
    completed = F.when(F.coalesce(fits, F.lit(False)), F.when(F.col("n") == F.col("expected"), F.col("n")).otherwise(whole)).otherwise(0)
    return met.select(KEY, completed.cast("long").alias("completed"), (completed < F.col("expected")).alias("pending"), (F.col("n").isNotNull() & ~F.coalesce(fits, F.lit(False))).alias("restart"))


def packet_spans(tokens: DataFrame) -> DataFrame:
    """(video_id, first_pts, packets) of probed packet times (video_id, token): the earliest, and how many are numbers."""
    pts = F.col("token").try_cast("double")
    return tokens.groupBy(KEY).agg(F.min(pts).alias("first_pts"), F.count(pts).alias("packets"))


def time_tables(tokens: DataFrame, least: int = 1) -> DataFrame:
    """(video_id, frame, pts) of probed packet times (video_id, token): in order of time; one token that is no number voids a video's table, and so do too few."""
    pts = F.col("token").try_cast("double")
    read = tokens.select(KEY, pts.alias("pts"))
    good = read.groupBy(KEY).agg(F.bool_and(F.col("pts").isNotNull()).alias("ok"), F.count("*").alias("n")).where(f"ok and n >= {max(1, least)}").select(KEY)
    order = Window.partitionBy(KEY).orderBy("pts")
    return read.join(good, KEY, "left_semi").select(KEY, (F.row_number().over(order) - 1).cast("long").alias(FRAME), "pts")


def merged_probes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(video_id, fps, total_frames, pts): what is known of each video, new entries over old ones, key by key; a frame count of 0 is no entry."""
    both = old.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    entry = lambda c, ok: F.min_by(c, F.when(ok, F.col("age"))).alias(c)
    counted = F.col("total_frames") > 0
    return both.groupBy(KEY).agg(entry("fps", F.col("fps").isNotNull() & counted), entry("total_frames", counted), entry("pts", F.col("pts").isNotNull()))


def reads_media(wanted: DataFrame, probes: DataFrame, store: DataFrame, clips: DataFrame) -> DataFrame:
    """(video_id, reads): whether a run would open the video: unless its rate is known and its slots are all stored or a clip covers it."""
    known = probes.where("fps is not null and total_frames is not null").select(KEY, F.lit(True).alias("known"))
    done = store.select(KEY, "completed")
    covered = clips.select(KEY).distinct().withColumn("clip", F.lit(True))
    met = wanted.join(known, KEY, "left").join(done, KEY, "left").join(covered, KEY, "left")
    enough = F.coalesce(F.col("completed") >= F.col("expected"), F.lit(False)) | F.col("clip").isNotNull()
    return met.select(KEY, (~(F.col("known").isNotNull() & enough)).alias("reads"))
