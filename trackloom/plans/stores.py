"""Registered queries around the slot store, project files, isolated failures and head checks, with SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import staging
from trackloom.functions import scalars as X
from trackloom.operators import relational as R
from trackloom.operators.projection import Projector, projected
from trackloom.plans.catalogue import FPS, TRACK, query
from trackloom.schema import FRAME, KEY, frame_scores, table, tracks
from trackloom.sources import projects, scripts
from trackloom.sources.store import SlotStore


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS slot, count(*) OVER (PARTITION BY user_id) AS n, value AS e FROM events)
SELECT video_id, slot, e FROM s WHERE video_id NOT LIKE '%5' OR n <= 40 OR slot < 32""")
def slot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that come in three interleaved batches, one of them twice; where slot 40 never comes the store ends with the chunk before it."""
    order, all_ = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id")
    slots = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias(KEY), F.lit("v1").alias("identity"), F.count("*").over(all_).alias("expected"), (F.row_number().over(order) - 1).cast("long").alias("slot"), F.col("value").alias("e"))
    given = staging.staged(slots.where((F.col("slot") != 40) | ~F.col(KEY).endswith("5")), "slots")
    store = SlotStore(spark, f"{staging.folder(spark)}/store-{uuid.uuid4().hex}", "e double", chunk_slots=16)
    for batch in (0, 1, 1, 2):
        store.append(given.where(F.col("slot") % 3 == batch), str(batch))
    return store.read().select(KEY, "slot", "e")


@query(TRACK + """, a AS (SELECT video_id, CAST(round_even(frame / 30.0::DOUBLE * 1000, 0) AS BIGINT) AS ms, CAST(least(greatest(round_even(pos * 100, 0), 0), 100) AS INT) AS pos FROM track WHERE frame % 10 = 0)
SELECT video_id, 'basic' AS type, video_id AS title, video_id || '.mp4' AS media, round(max(ms) / 1000.0::DOUBLE, 3) AS duration, 0 AS tags, 1 AS scripts, count(*) AS actions, sum(pos)::BIGINT AS positions FROM a GROUP BY 1""")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New projects with every tenth frame as their script, written as CBOR and opened again."""
    t = tracks(spark, sf_dir)
    actions = t.where(F.col(FRAME) % 10 == 0).select(KEY, X.at_ms(F.col(FRAME) / FPS).alias("at"), X.quantised(F.col("pos")).cast("int").alias("pos"))
    media = t.select(KEY).distinct().select(KEY, F.col(KEY).alias("title"), F.lit("").alias("creator"), F.concat(KEY, F.lit(".mp4")).alias("media_path"))
    files = projects.project_files(projects.new_states(media, actions), scripts.packed_scripts(actions))
    opened = projects.opened(files).where("error is null")
    sums = scripts.unpacked_scripts(opened.select(KEY, F.explode("scripts").alias("data"))).groupBy(KEY).agg(F.count("*").alias("actions"), F.sum("pos").alias("positions"))
    at = lambda path: F.get_json_object("json", f"$.{path}")
    found = opened.select(KEY, at("metadata.type").alias("type"), at("metadata.title").alias("title"), at("relativeMediaPath").alias("media"), F.round(at("metadata.duration").cast("double"), 3).alias("duration"), F.json_array_length(at("metadata.tags")).alias("tags"), F.size("scripts").alias("scripts"))
    return found.join(sums, KEY)


@query("""WITH g AS (SELECT CAST(user_id AS VARCHAR) AS video_id, count(*) AS n, round(sum(value), 3) AS total, max(value) AS top FROM events GROUP BY 1)
SELECT video_id, CASE WHEN top >= 300 THEN 'failed' ELSE 'done' END AS status, CASE WHEN top < 300 THEN n END AS n, CASE WHEN top < 300 THEN total END AS total, CASE WHEN top >= 300 THEN 'ValueError: a value of 300 or more' END AS error FROM g""")
def isolated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track whose function raises gives a dead letter; the others are done."""

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        if part["value"].max() >= 300:
            raise ValueError("a value of 300 or more")
        return pd.DataFrame({"n": [len(part)], "total": [part["value"].sum()]})

    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias(KEY), "value")
    groups = staging.staged(R.isolated(events, [KEY], summed, "n long, total double"), "isolated")
    good, bad = R.parted(groups, [KEY])
    done = good.select(KEY, F.lit("done").alias("status"), "n", F.round("total", 3).alias("total"), F.lit(None).cast("string").alias("error"))
    return done.unionByName(bad.select(KEY, F.lit("failed").alias("status"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("total"), "error"))


@query("""WITH t AS (SELECT DISTINCT c_nationkey AS stem, CAST(c_custkey % 40 AS INT) AS number FROM customer UNION SELECT s_nationkey, CAST(s_suppkey % 45 AS INT) FROM supplier),
n AS (SELECT stem, unnest(range(1, 31))::INT AS number FROM (SELECT DISTINCT c_nationkey AS stem FROM customer)), f AS (SELECT * FROM n WHERE NOT EXISTS (FROM t WHERE t.stem = n.stem AND t.number = n.number))
SELECT stem, (SELECT min(number) FROM f WHERE f.stem = s.stem) AS number FROM (SELECT DISTINCT stem FROM n) s""")
def companion_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number up to 30 that neither a script nor its companion has; none where all are taken."""
    taken = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("stem"), (F.col("c_custkey") % 40).cast("int").alias("number"))
    beside = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("stem"), (F.col("s_suppkey") % 45).cast("int").alias("number"))
    return R.first_free(taken, taken, companions=[beside], most=30)


@query("SELECT CAST(user_id AS VARCHAR) AS video_id, round(min(value), 5) AS first_pts, count(*) AS packets FROM events GROUP BY 1")
def packet_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scripts.packet_spans(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias(KEY), F.col("value").cast("string").alias("token")))
    return found.select(KEY, F.round("first_pts", 5).alias("first_pts"), "packets")


@query("""WITH h AS (SELECT p_partkey, p_size % 4 AS frames, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS declared, CASE WHEN p_size % 2 = 0 THEN 'vjepa21' ELSE 'videomae' END AS family, CASE p_size % 5 WHEN 0 THEN 5 WHEN 1 THEN 14 WHEN 2 THEN 54 ELSE 7 END AS tokens FROM part)
SELECT p_partkey, CASE WHEN frames NOT IN (1, 2) THEN 'frames_per_slot' WHEN declared <> (frames = 1) THEN 'interleave_input' WHEN frames = 1 AND family <> 'vjepa21' THEN 'family' WHEN tokens = 7 THEN 'pooling' ELSE 'ok' END AS status, frames = 1 AS interleave FROM h""")
def head_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    declared = F.when(size % 3 == 0, True).when(size % 3 == 1, False)
    tokens = F.when(size % 5 == 0, 5).when(size % 5 == 1, 14).when(size % 5 == 2, 54).otherwise(7)
    status = X.head_status(size % 4, declared, F.when(size % 2 == 0, "vjepa21").otherwise("videomae"), tokens)
    return table(spark, sf_dir, "part").select("p_partkey", status.alias("status"), (size % 4 == 1).alias("interleave"))


@query(TRACK + """, k AS (SELECT *, max(frame) OVER (PARTITION BY video_id) AS top FROM track),
a AS (SELECT video_id, frame, top, CAST(round_even(frame / 30.0::DOUBLE * 1000, 0) AS BIGINT) AS ms, CAST(least(greatest(round_even(pos * 100, 0), 0), 100) AS INT) AS pos, CAST(least(greatest(round_even((1 - pos) * 100, 0), 0), 100) AS INT) AS inv FROM k),
v AS (SELECT 'dense' AS variant, * FROM a UNION ALL SELECT 'simplified', * FROM a WHERE frame % 10 = 0 OR frame = top)
SELECT video_id, variant, 'main' AS axis, ms AS "at", pos FROM v UNION ALL SELECT video_id, variant, 'C1', ms, inv FROM v""")
def script_pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of documents with every tenth frame and the last kept, read back: the axis is cut to the kept frames too."""
    t = tracks(spark, sf_dir).withColumn("top", F.max(FRAME).over(Window.partitionBy(KEY)))
    kept = t.where((F.col(FRAME) % 10 == 0) | (F.col(FRAME) == F.col("top"))).select(KEY, FRAME)
    at = X.at_ms(F.col(FRAME) / FPS).alias("at")
    dense = t.select(KEY, FRAME, at, X.quantised(F.col("pos")).alias("pos"))
    axes = t.select(KEY, FRAME, F.lit("C1").alias("axis"), at, X.quantised(1 - F.col("pos")).alias("pos"))
    stats = kept.groupBy(KEY).agg(F.count("*").alias("kept"))
    pair = scripts.script_pair(dense, kept, stats, axes=axes)
    action = "array<struct<at:bigint,pos:int>>"
    read = pair.select(KEY, "variant", F.from_json("json", f"actions {action}, axes array<struct<id:string,actions:{action}>>").alias("d"))
    lists = F.array_append(F.col("d.axes"), F.struct(F.lit("main").alias("id"), F.col("d.actions").alias("actions")))
    return read.select(KEY, "variant", F.explode(lists).alias("l")).select(KEY, "variant", F.col("l.id").alias("axis"), F.inline("l.actions"))


@query()
def projected_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's four quarters as a slot's tokens, projected to eight numbers by weights that follow a rule."""
    scores = frame_scores(spark, sf_dir)
    tokens = scores.select(KEY, FRAME, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("logits", i * 16 + 1, 16))).alias("token", "e"))
    at = np.arange(64)
    rule = Projector(np.cos(np.outer(np.arange(1, 9), at) / 10) / 8, np.arange(8) / 100, 1 + np.arange(8) / 50, np.full(8, 0.01), np.sin(at).reshape(4, 16) / 10)
    return projected(tokens, rule).select(KEY, FRAME, F.transform("e", lambda x: F.round(x, 5)).alias("e"))
