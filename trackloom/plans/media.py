"""Registered queries around scripts, probes, stores and projects, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import distribution as D
from trackloom.functions import scalars as X
from trackloom.operators import per_track as K
from trackloom.operators import relational as R
from trackloom.operators import sequences as S
from trackloom.plans.catalogue import FPS, TRACK, query
from trackloom.schema import FRAME, KEY, frame_scores, table, tracks
from trackloom.sources import scripts

CROP, STRIDE = 16, 8


def _actions(rows: DataFrame, value) -> DataFrame:
    return rows.select(KEY, X.at_ms(F.col(FRAME) / FPS).alias("at"), X.quantised(value).alias("pos"))


def _json(value: str) -> str:
    return f"string_agg('{{\"at\":' || CAST(round_even(frame / 30.0::DOUBLE * 1000, 0) AS BIGINT) || ',\"pos\":' || CAST(least(greatest(round_even(({value}) * 100, 0), 0), 100) AS INT) || '}}', ',' ORDER BY frame)"


@query(TRACK + f"""SELECT video_id, '{{"version":"1.1","inverted":false,"range":100,"actions":[' || {_json("pos")} || '],"axes":[{{"id":"C1","metadata":{{}},"actions":[' || {_json("1 - pos")} || ']}}],"metadata":{{"variant":"dense"}}}}' AS json FROM track WHERE frame < 40 GROUP BY video_id""")
def script_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 frames' documents with one axis and metadata."""
    t = tracks(spark, sf_dir).where(F.col(FRAME) < 40)
    axis = _actions(t, 1 - F.col("pos")).withColumn("axis", F.lit("C1"))
    return scripts.script_json(_actions(t, F.col("pos")), axis, t.select(KEY).distinct().withColumn("metadata", F.struct(F.lit("dense").alias("variant"))))


@query()
def script_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    kept = K.keyframes(t, FPS)
    dense = t.select(KEY, FRAME, X.at_ms(F.col(FRAME) / FPS).alias("at"), X.quantised(F.col("pos")).alias("pos"))
    return scripts.script_pair(dense, kept.select(KEY, FRAME), K.reconstruction(t, kept))


@query("""WITH sc AS (SELECT CAST(label AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: x::DOUBLE * 20) AS l FROM embeddings),
n AS (SELECT video_id, count(*) AS n FROM sc GROUP BY 1), st AS (SELECT video_id, unnest(list_distinct(list_append(range(0, greatest(n - 16, 0) + 1, 8), greatest(n - 16, 0)))) AS start FROM n),
j AS (SELECT s.video_id, frame, start, 1 - abs(2 * (frame - start)::DOUBLE / 15 - 1) + 0.01 AS w, unnest(l) * (1 + 0.1 * (start % 3)) AS l, unnest(range(0, 64)) AS k FROM sc s JOIN st ON s.video_id = st.video_id AND frame >= start AND frame < start + 16),
e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY video_id, frame, start)) AS e FROM j), p AS (SELECT *, e / sum(e) OVER (PARTITION BY video_id, frame, start) AS p FROM e),
b AS (SELECT video_id, frame, k, sum(w * p) AS p FROM p GROUP BY 1, 2, 3), m AS (SELECT video_id, frame, sum(p * (k + 0.5) / 64) / sum(p) AS pos FROM b GROUP BY 1, 2),
a AS (SELECT video_id, frame, sum(w / (1 + exp(-l))) / sum(w) AS act FROM j WHERE k = 0 GROUP BY 1, 2) SELECT video_id, frame, round(pos, 5) AS pos, round(act, 5) AS act FROM m JOIN a USING (video_id, frame)""")
def blend_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window scores its frames a little differently; what is blended are bin probabilities, decoded afterwards."""
    windows = S.hopping_windows(frame_scores(spark, sf_dir), CROP, STRIDE)
    logits = F.transform("logits", lambda x: x * (1 + 0.1 * (F.col("start") % 3)))
    scored = windows.select(KEY, FRAME, "start", D.softmax(logits).alias("p"), D.sigmoid(F.get(logits, F.lit(0))).alias("act"))
    found = S.blended_distributions(scored, crop=CROP)
    return found.select(KEY, FRAME, F.round(D.decoded(F.col("p")), 5).alias("pos"), F.round("act", 5).alias("act"))


@query("""WITH t AS (SELECT CAST(user_id AS VARCHAR) AS video_id, CASE WHEN user_id % 10 = 3 AND event_id % 50 = 0 THEN 'N/A' ELSE CAST(value AS VARCHAR) END AS token FROM events),
g AS (SELECT video_id FROM t GROUP BY 1 HAVING bool_and(try_cast(token AS DOUBLE) IS NOT NULL) AND count(*) >= 5) SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY token::DOUBLE) - 1 AS frame, token::DOUBLE AS pts FROM t JOIN g USING (video_id)""")
def probed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    token = F.when((F.col("user_id") % 10 == 3) & (F.col("event_id") % 50 == 0), "N/A").otherwise(F.col("value").cast("string"))
    return scripts.time_tables(e.select(F.col("user_id").cast("string").alias(KEY), token.alias("token")), 5)


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 30000 / 1001.0::DOUBLE WHEN p_size % 4 = 1 THEN p_size::DOUBLE WHEN p_size % 4 = 2 AND p_size % 3 = 0 THEN 24.5::DOUBLE ELSE 30.0::DOUBLE END AS fps FROM part""")
def declared_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared as a fraction, as a number, or not at all: then the average rate, then 30."""
    size = F.col("p_size")
    text = F.when(size % 4 == 0, "30000/1001").when(size % 4 == 1, size.cast("string")).when(size % 4 == 2, "0/0").otherwise("n/a")
    average = F.when((size % 4 == 2) & (size % 3 == 0), F.lit(24.5))
    return table(spark, sf_dir, "part").select("p_partkey", X.frame_rate(text, average).alias("fps"))


OLD_NEW = "o AS (SELECT CAST(c_custkey AS VARCHAR) AS video_id, CASE WHEN c_custkey % 2 = 0 THEN 30.0::DOUBLE END AS fps, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey + 1) * 10 END AS total_frames, CASE WHEN c_custkey % 3 = 0 THEN [c_custkey / 2.0::DOUBLE] END AS pts FROM customer), n AS (SELECT CAST(c_custkey AS VARCHAR) AS video_id, 60.0::DOUBLE AS fps, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE (c_custkey + 1) * 20 END AS total_frames, NULL::DOUBLE[] AS pts FROM customer WHERE c_custkey % 4 < 2)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", key.cast("string").alias(KEY))
    old = c.select(KEY, F.when(key % 2 == 0, F.lit(30.0)).alias("fps"), F.when(key % 2 == 0, (key + 1) * 10).alias("total_frames"), F.when(key % 3 == 0, F.array(key / 2.0)).alias("pts"))
    new = c.where(key % 4 < 2).select(KEY, F.lit(60.0).alias("fps"), F.when(key % 5 == 0, F.lit(0)).otherwise((key + 1) * 20).cast("long").alias("total_frames"), F.lit(None).cast("array<double>").alias("pts"))
    return scripts.merged_probes(old, new)


MERGED = "WITH " + OLD_NEW + ", m AS (SELECT video_id, CASE WHEN n.total_frames > 0 THEN n.fps ELSE o.fps END AS fps, CASE WHEN n.total_frames > 0 THEN n.total_frames ELSE o.total_frames END AS total_frames, coalesce(n.pts, o.pts) AS pts FROM o LEFT JOIN n USING (video_id)) "


@query(MERGED + "SELECT video_id, fps, total_frames, pts[1] AS pts FROM m")
def merged_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probes(spark, sf_dir).withColumn("pts", F.get("pts", F.lit(0)))


@query(MERGED + "SELECT video_id, NOT (fps IS NOT NULL AND total_frames IS NOT NULL AND (CASE WHEN video_id::INT % 7 < 5 THEN 100 ELSE 60 END >= 100 OR video_id::INT % 11 = 0)) AS reads FROM m")
def media_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _probes(spark, sf_dir)
    key = F.col(KEY).cast("int")
    wanted = probes.select(KEY, F.lit(100).alias("expected"))
    store = probes.select(KEY, F.when(key % 7 < 5, 100).otherwise(60).alias("completed"))
    return scripts.reads_media(wanted, probes, store, probes.where(key % 11 == 0))


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS video_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS slot FROM events),
w AS (SELECT video_id, user_id, count(*) AS expected FROM s GROUP BY 1, 2), k AS (SELECT * FROM s WHERE CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN slot < 21 WHEN 2 THEN slot <> 7 ELSE slot < 9 END),
h AS (SELECT video_id, user_id, count(*) AS n FROM k GROUP BY 1, 2)
SELECT video_id, CASE WHEN user_id % 4 = 0 THEN n WHEN user_id % 4 = 1 THEN CASE WHEN n = expected THEN n ELSE n // 8 * 8 END ELSE 0 END::BIGINT AS completed, CASE WHEN user_id % 4 = 0 THEN false WHEN user_id % 4 = 1 THEN n < expected ELSE true END AS pending, user_id % 4 IN (2, 3) AS restart FROM w LEFT JOIN h USING (video_id, user_id)""")
def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores that are whole, cut, have a gap, or belong to another identity; windows of eight slots."""
    user = F.col("user_id")
    order = Window.partitionBy("user_id").orderBy("event_id")
    slots = table(spark, sf_dir, "events").select("user_id", user.cast("string").alias(KEY), (F.row_number().over(order) - 1).cast("long").alias("slot"))
    wanted = slots.groupBy(KEY).agg(F.count("*").alias("expected")).withColumn("identity", F.lit("now"))
    there = F.when(user % 4 == 0, True).when(user % 4 == 1, F.col("slot") < 21).when(user % 4 == 2, F.col("slot") != 7).otherwise(F.col("slot") < 9)
    store = slots.where(there).select(KEY, "slot", F.when(user % 4 == 3, "before").otherwise("now").alias("identity"))
    return scripts.resume_points(store, wanted, 8)


@query("""SELECT c_custkey, substr(sha256(c_name || CASE WHEN c_custkey % 3 = 0 THEN '|' || c_mktsegment WHEN c_custkey % 3 = 1 THEN '|' || c_nationkey || '|' || c_custkey ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN '_w64' ELSE '' END), 1, 12) AS print,
sha256(c_name || '{"a":' || c_nationkey || '}') AS hash, CASE WHEN c_custkey >= 50 THEN c_custkey - 50 END AS "offset", '../x/' || c_name || '.mp4' AS rel,
regexp_replace(c_name, '[^\\p{L}\\p{N}_-]', '_', 'g') || '__ab_f' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '-' || lpad(CAST(c_custkey + 100 AS VARCHAR), 6, '0') || '_crop_p5' AS key FROM customer""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    print_ = X.backbone_print(F.col("c_name"), F.when(key % 3 == 0, F.col("c_mktsegment")), F.when(key % 3 == 1, F.col("c_nationkey")), key, F.when(key % 2 == 0, "_w64"))
    cache = X.cache_key(F.col("c_name"), F.lit("ab"), key, key + 100, X.crop_tag(X.crop_box(F.lit("none"))), F.lit(5))
    rel = X.relative_path(F.concat(F.lit("/a/b/x/"), "c_name", F.lit(".mp4")), F.lit("/a/b/c"))
    config = F.to_json(F.struct(F.col("c_nationkey").alias("a")))
    return table(spark, sf_dir, "customer").select("c_custkey", print_.alias("print"), X.model_hash(F.col("c_name").cast("binary"), config).alias("hash"), X.clip_offset(key, F.lit(50)).alias("offset"), rel.alias("rel"), cache.alias("key"))


GRID = "WITH c AS (SELECT CAST(label AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, embedding AS e FROM embeddings), g AS (SELECT video_id, r // 15 AS slot, r % 15 // 5 AS y, r % 5 AS x, e[1]::DOUBLE AS a, e[2]::DOUBLE AS b FROM c), "


@query(GRID + "p AS (SELECT k, i, j, CASE k WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 5 END + i * k + j AS token FROM (SELECT unnest([1, 2, 3]) AS k), range(0, 3) a(i), range(0, 3) b(j) WHERE i < k AND j < k) SELECT video_id, slot, token::INT AS token, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM g JOIN p ON y >= 3 * i // k AND y < -(-3 * (i + 1) // k) AND x >= 5 * j // k AND x < ceil(5 * (j + 1) / k::DOUBLE) AND y < ceil(3 * (i + 1) / k::DOUBLE) GROUP BY 1, 2, 3".replace("AND y < -(-3 * (i + 1) // k) ", ""))
def pyramid_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of 3 by 5 cells pooled over one, four and nine parts, which overlap."""
    r = F.col(FRAME)
    cells = frame_scores(spark, sf_dir).select(KEY, F.floor(r / 15).alias("slot"), F.floor(r % 15 / 5).alias("y"), (r % 5).alias("x"), F.lit(3).alias("height"), F.lit(5).alias("width"), F.transform("logits", lambda v: v / 20).alias("e"))
    return R.pooled_grid(cells, [1, 2, 3], 2).select(KEY, "slot", "token", *(F.round(F.get("e", F.lit(i)), 6).alias(n) for i, n in enumerate("ab")))


@query("""WITH e AS (SELECT CAST(label AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), l AS (SELECT unnest(range(-8, 8)) AS lag)
SELECT a.video_id, a.frame, lag::INT AS lag, round(coalesce(list_cosine_similarity(a.v, b.v), 0) * 10, 4) AS similarity, b.v IS NOT NULL AS valid FROM e a CROSS JOIN l LEFT JOIN e b ON a.video_id = b.video_id AND b.frame = a.frame - lag""")
def periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frame_scores(spark, sf_dir).withColumnRenamed("logits", "e")
    return R.lagged_similarity(e, -8, 7, temperature=10.0).withColumn("similarity", F.round("similarity", 4))


@query("""WITH r AS (SELECT l_orderkey % 50 AS id, l_orderkey AS lo, l_orderkey + l_linenumber AS hi FROM lineitem), c AS (SELECT o_orderkey % 50 AS id, o_orderkey AS lo, o_orderkey + 3 AS hi FROM orders)
SELECT DISTINCT id, lo, hi FROM r WHERE NOT EXISTS (FROM c WHERE c.id = r.id AND c.lo <= r.lo AND c.hi >= r.hi AND c.lo > r.lo - 4)""")
def uncovered_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("id"), F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("hi")).distinct()
    clips = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("id"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("clip_lo"), (F.col("o_orderkey") + 3).alias("clip_hi"))
    return R.uncovered(asked, R.smallest_cover(asked, clips, "id"))


@query("""WITH o AS (SELECT c_nationkey AS project, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_name FROM customer), n AS (SELECT DISTINCT project, CASE WHEN project % 2 = 0 THEN 's1' ELSE 'new' END AS rel_path FROM o)
SELECT o.project, o.i::INT AS "index", 's' || o.i AS rel_path, CASE WHEN n.project IS NOT NULL THEN 'fresh' ELSE o.c_name END AS script, n.project IS NOT NULL AS active FROM o LEFT JOIN n ON n.project = o.project AND n.rel_path = 's' || o.i
UNION ALL SELECT n.project, (SELECT count(*) FROM o WHERE o.project = n.project)::INT, n.rel_path, 'fresh', true FROM n WHERE NOT EXISTS (FROM o WHERE o.project = n.project AND 's' || o.i = n.rel_path)""")
def project_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    old = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project"), (F.row_number().over(order) - 1).alias("index"), F.col("c_name").alias("script"))
    old = old.select("project", "index", F.concat(F.lit("s"), "index").alias("rel_path"), "script")
    new = old.select("project").distinct().select("project", F.when(F.col("project") % 2 == 0, "s1").otherwise("new").alias("rel_path"), F.lit("fresh").alias("script"))
    return R.scripts_added(old, new)


@query(TRACK + "SELECT video_id, 'basic' AS type, video_id AS title, '' AS creator, round(CAST(round_even(max(frame) / 30.0::DOUBLE * 1000, 0) AS BIGINT) / 1000.0::DOUBLE, 3) AS duration, 0 AS active FROM track GROUP BY 1")
def new_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new project's record: its title and the time of its last action."""
    t = tracks(spark, sf_dir)
    last = F.max_by(X.at_ms(F.col(FRAME) / FPS), F.col(FRAME)) / 1000.0
    return t.groupBy(KEY).agg(F.round(last, 3).alias("duration")).select(KEY, F.lit("basic").alias("type"), F.col(KEY).alias("title"), F.lit("").alias("creator"), "duration", F.lit(0).alias("active"))


@query("SELECT count(*) FILTER (value < 300) AS done, count(*) FILTER (value >= 300) AS failed FROM events")
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outcomes(table(spark, sf_dir, "events"), F.col("value") >= 300)
