"""The registered queries of the track operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import distribution as D
from trackloom.functions import scalars as X
from trackloom.operators import cycles as Y
from trackloom.operators import per_track as K
from trackloom.operators import relational as R
from trackloom.operators import sequences as S
from trackloom.schema import FRAME, KEY, frame_scores, in_order, table, tracks
from trackloom.sources import scripts

FPS = 30.0
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TRACK = """WITH ev AS (SELECT event_type AS video_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame,
  least(value / 100, 1.0::DOUBLE) AS pos, epoch_us(ts) / 1e6::DOUBLE AS s FROM events),
track AS (SELECT video_id, frame, pos, s - min(s) OVER (PARTITION BY video_id) AS pts FROM ev) """
SCORES = """WITH sc AS (SELECT CAST(label AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
  list_transform(embedding, lambda x: x::DOUBLE * 20) AS l FROM embeddings),
mx AS (SELECT video_id, frame, list_max(l) AS m, l FROM sc),
ex AS (SELECT video_id, frame, list_transform(l, lambda x: exp(x - m)) AS e FROM mx),
pr AS (SELECT video_id, frame, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex),
bins AS (SELECT video_id, frame, unnest(p) AS p, unnest(range(0, 64)) AS k FROM pr),
mo AS (SELECT video_id, frame, sum(p * (k + 0.5) / 64) AS mean, sum(p * ((k + 0.5) / 64) * ((k + 0.5) / 64)) AS sq, min(k) FILTER (p = top) AS mode FROM
  (SELECT *, max(p) OVER (PARTITION BY video_id, frame) AS top FROM bins) GROUP BY 1, 2),
lo AS (SELECT b.video_id, b.frame, sum(p * (k + 0.5) / 64) / greatest(sum(p), 1e-12) AS near FROM bins b JOIN mo USING (video_id, frame) WHERE k BETWEEN mode - 2 AND mode + 2 GROUP BY 1, 2) """
W = "(PARTITION BY video_id ORDER BY frame)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, places: int = 5):
    return F.round(c, places)


# distributions


@query(SCORES + "SELECT video_id, frame, round(mean, 5) AS pos FROM mo")
def decode_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_scores(spark, sf_dir).select(KEY, FRAME, _r(D.expectation(D.softmax(F.col("logits")))).alias("pos"))


@query(SCORES + "SELECT video_id, frame, round(near, 5) AS pos, mode FROM lo JOIN mo USING (video_id, frame)")
def decode_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame_scores(spark, sf_dir).select(KEY, FRAME, D.softmax(F.col("logits")).alias("p"))
    return p.select(KEY, FRAME, _r(D.mode_expectation(F.col("p"))).alias("pos"), D.first_argmax(F.col("p")).cast("long").alias("mode"))


@query(SCORES + "SELECT video_id, frame, round(sqrt(greatest(sq - mean * mean, 0)), 5) AS spread_std, round(abs(mean - near), 5) AS mode_gap FROM mo JOIN lo USING (video_id, frame)")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame_scores(spark, sf_dir).select(KEY, FRAME, D.softmax(F.col("logits")).alias("p"))
    return p.select(KEY, FRAME, _r(D.spread_std(F.col("p"))).alias("spread_std"), _r(D.mode_gap(F.col("p"))).alias("mode_gap"))


@query(SCORES + "SELECT video_id, frame, CAST(round_even(frame / 30.0::DOUBLE * 1000, 0) AS BIGINT) AS at, CAST(round_even(round(mean, 9) * 100, 0) AS INT) AS pos FROM mo")
def decode_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.round(D.expectation(D.softmax(F.col("logits"))), 9)
    return frame_scores(spark, sf_dir).select(KEY, FRAME, X.at_ms(F.col(FRAME) / FPS).alias("at"), X.quantised(pos).alias("pos"))


@query("SELECT video_id, frame, round(1 / (1 + exp(-first)), 6) AS act FROM (SELECT CAST(label AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding[1]::DOUBLE * 20 AS first FROM embeddings)")
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_scores(spark, sf_dir).select(KEY, FRAME, _r(D.sigmoid(F.get("logits", F.lit(0))), 6).alias("act"))


# sequences


@query(TRACK + f"SELECT video_id, frame, round(avg(pos) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 5) AS value FROM track")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_length(tracks(spark, sf_dir), S.SMOOTH, lambda t, short: t.select(KEY, FRAME, _r(S.moving_average(F.col("pos"), short=short)).alias("value")))


GRAD = f"CASE WHEN lag(pos) OVER {W} IS NULL THEN lead(pos) OVER {W} - pos WHEN lead(pos) OVER {W} IS NULL THEN pos - lag(pos) OVER {W} ELSE (lead(pos) OVER {W} - lag(pos) OVER {W}) / 2 END"


@query(TRACK + f"SELECT video_id, frame, round({GRAD}, 5) AS value FROM track")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select(KEY, FRAME, _r(S.gradient(F.col("pos"))).alias("value"))


@query(TRACK + "SELECT video_id, frame, round(median(pos) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 22 PRECEDING AND CURRENT ROW), 5) AS value FROM track")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select(KEY, FRAME, _r(S.running_median(F.col("pos"), 23)).alias("value"))


RUNS = """, fl AS (SELECT *, {flag} AS f FROM track), g AS (SELECT *, frame - sum(f::INT) OVER (PARTITION BY video_id ORDER BY frame) AS k FROM fl),
runs AS (SELECT video_id, min(frame) AS start, max(frame) + 1 AS "end" FROM g WHERE f GROUP BY video_id, k) """


@query(TRACK + ", m AS (SELECT *, median(pos) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS md FROM track), g AS (SELECT *, frame - sum((pos < 0.35)::INT) OVER (PARTITION BY video_id ORDER BY frame) AS k FROM m), h AS (SELECT *, count(*) FILTER (pos < 0.35) OVER (PARTITION BY video_id, k) AS n, first_value(md) OVER (PARTITION BY video_id, k, pos < 0.35 ORDER BY frame) AS held FROM g) SELECT video_id, frame, round(CASE WHEN pos < 0.35 AND n >= 3 THEN held ELSE pos END, 5) AS gated FROM h")
def hold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At four frames a second the shortest held run is three frames."""
    return S.hold_gate(tracks(spark, sf_dir), 4.0, act="pos").select(KEY, FRAME, _r(F.col("gated")).alias("gated"))


@query(TRACK + RUNS.format(flag="pos < 0.35") + 'SELECT video_id, start, "end" FROM runs')
def true_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.runs(tracks(spark, sf_dir), F.col("pos") < 0.35)


@query(TRACK + RUNS.format(flag="pos < 0.35") + ', o AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY video_id ORDER BY start) <= 2 THEN 0 ELSE 1 END AS new FROM runs), j AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY start) AS k FROM o) SELECT video_id, min(start) AS start, max("end") AS "end" FROM j GROUP BY video_id, k HAVING max("end") - min(start) >= 5')
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merged(S.runs(tracks(spark, sf_dir), F.col("pos") < 0.35), 2, 5)


@query(TRACK + """, x AS (SELECT video_id, frame, CASE WHEN frame % 7 IN (0, 3, 4) THEN NULL ELSE pos END AS v FROM track),
y AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0, first_value(v IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
 last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f0, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f1 FROM x)
SELECT video_id, frame, round(coalesce(v, v0 + (v1 - v0) * (frame - f0) / nullif(f1 - f0, 0)::DOUBLE, v0, v1, 0), 5) AS value FROM y""")
def linear_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.when(F.col(FRAME) % 7 == 0, F.lit(float("nan"))).when(F.col(FRAME) % 7 == 3, F.lit(float("inf"))).when(F.col(FRAME) % 7 == 4, F.lit(None)).otherwise(F.col("pos"))
    return S.linear_fill(tracks(spark, sf_dir).select(KEY, FRAME, gone.alias("pos")), "pos").select(KEY, FRAME, _r(F.col("pos")).alias("value"))


@query(TRACK + f", n AS (SELECT *, coalesce(lead(pos) OVER {W}, pos) AS nxt FROM track) SELECT video_id, 2 * frame AS frame, pos FROM n UNION ALL SELECT video_id, 2 * frame + 1, nxt FROM n")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interleave(tracks(spark, sf_dir), "pos")


@query(TRACK + "SELECT video_id, frame, round((pos - min(pos) OVER v) / (max(pos) OVER v - min(pos) OVER v), 5) AS value FROM track WINDOW v AS (PARTITION BY video_id)")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select(KEY, FRAME, _r(S.min_max(F.col("pos"))).alias("value"))


@query(TRACK + """, n AS (SELECT video_id, count(*) AS n FROM track GROUP BY 1),
st AS (SELECT video_id, unnest(list_distinct(list_append(range(0, greatest(n - 256, 0) + 1, 128), greatest(n - 256, 0)))) AS start FROM n),
j AS (SELECT t.video_id, t.frame, t.pos + 0.01 * (start % 3) AS v, 1 - abs(2 * (frame - start)::DOUBLE / 255 - 1) + 0.01 AS w FROM track t JOIN st ON t.video_id = st.video_id AND t.frame >= start AND t.frame < start + 256)
SELECT video_id, frame, round(sum(w * v) / greatest(sum(w), 1e-8), 5) AS v FROM j GROUP BY 1, 2""")
def blend_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = S.hopping_windows(tracks(spark, sf_dir)).withColumn("v", F.col("pos") + 0.01 * (F.col("start") % 3))
    return S.blended(windows, "v").select(KEY, FRAME, _r(F.col("v")).alias("v"))


# turning points: maxima of both signs with plateaus, thinned by height in a recursion over their order, then by prominence
TURNS = """, sd AS (SELECT video_id, 1 AS sign, frame, pos::FLOAT::DOUBLE AS x FROM track UNION ALL SELECT video_id, -1, frame, -(pos::FLOAT::DOUBLE) FROM track),
ne AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY video_id, sign ORDER BY frame) THEN 0 ELSE 1 END AS new FROM sd),
pl AS (SELECT *, sum(new) OVER (PARTITION BY video_id, sign ORDER BY frame) AS run FROM ne),
ru AS (SELECT video_id, sign, run, min(frame) AS lo, max(frame) AS hi, any_value(x) AS x FROM pl GROUP BY 1, 2, 3),
nb AS (SELECT *, lag(x) OVER (PARTITION BY video_id, sign ORDER BY run) AS b, lead(x) OVER (PARTITION BY video_id, sign ORDER BY run) AS a FROM ru),
mx AS (SELECT video_id, sign, (lo + hi) // 2 AS frame, x, row_number() OVER (PARTITION BY video_id, sign ORDER BY x DESC, lo DESC) AS k FROM nb WHERE x > b AND x > a),
th AS (SELECT video_id, sign, 0::BIGINT AS k, []::BIGINT[] AS kept FROM mx GROUP BY 1, 2 UNION ALL
  SELECT th.video_id, th.sign, mx.k, CASE WHEN len(list_filter(th.kept, lambda f: abs(f - mx.frame) < {distance})) = 0 THEN list_append(th.kept, mx.frame) ELSE th.kept END
  FROM th JOIN mx ON th.video_id = mx.video_id AND th.sign = mx.sign AND mx.k = th.k + 1),
ke AS (SELECT video_id, sign, unnest(kept) AS frame FROM (SELECT *, max(k) OVER (PARTITION BY video_id, sign) AS top FROM th) WHERE k = top),
kx AS (SELECT ke.*, mx.x FROM ke JOIN mx USING (video_id, sign, frame)),
hi AS (SELECT k.video_id, k.sign, k.frame, k.x, coalesce(max(b.frame) FILTER (b.frame < k.frame AND b.x > k.x), -1) AS l, coalesce(min(b.frame) FILTER (b.frame > k.frame AND b.x > k.x), 1000000000) AS r
  FROM kx k JOIN sd b USING (video_id, sign) GROUP BY ALL),
ba AS (SELECT h.video_id, h.sign, h.frame, h.x, min(b.x) FILTER (b.frame > h.l AND b.frame <= h.frame) AS ml, min(b.x) FILTER (b.frame >= h.frame AND b.frame < h.r) AS mr FROM hi h JOIN sd b USING (video_id, sign) GROUP BY ALL),
turn AS (SELECT DISTINCT video_id, frame FROM ba WHERE {where}) """
RECURSIVE = TRACK.replace("WITH ev", "WITH RECURSIVE ev")
PROMINENT = TURNS.format(distance=4, where="x - greatest(ml, mr) >= 0.035::DOUBLE")
SPANS = PROMINENT + ", sp AS (SELECT c.*, count(t.frame) OVER (PARTITION BY c.video_id ORDER BY c.frame) AS span FROM {source} c LEFT JOIN turn t ON t.video_id = c.video_id AND t.frame = c.frame) "


def _spans(track: DataFrame) -> DataFrame:
    return K.turning_spans(track, FPS)


@query(RECURSIVE + SPANS.format(source="track") + "SELECT video_id, CAST(span AS BIGINT) AS span, min(frame) AS start, max(frame) + 1 AS stop, round(median(pos), 5) AS mid FROM sp GROUP BY 1, 2")
def stroke_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(tracks(spark, sf_dir)).groupBy(KEY, "span").agg(F.min(FRAME).alias("start"), (F.max(FRAME) + 1).alias("stop"), _r(F.percentile("pos", F.lit(0.5))).alias("mid"))


CONF = TRACK + f""", g AS (SELECT *, pos * pos AS spread, abs(pos - 0.5) / 4 AS gap, abs({GRAD}) AS raw FROM track),
s AS (SELECT *, avg(raw) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS speed FROM g),
r AS (SELECT *, spread - (regr_slope(spread, speed) OVER v * speed + regr_intercept(spread, speed) OVER v) AS residual FROM s WINDOW v AS (PARTITION BY video_id)) """


@query(CONF + "SELECT video_id, frame, round(residual, 5) AS residual FROM r")
def speed_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("spread", F.col("pos") * F.col("pos"))
    return S.by_length(t, S.SMOOTH, lambda rows, short: S.speed_residual(rows, short=short).select(KEY, FRAME, _r(F.col("residual")).alias("residual")))


@query(CONF.replace("WITH ev", "WITH RECURSIVE ev") + """, c AS (SELECT *, least(greatest(0.5 - avg(residual) OVER m / 0.17, 0), 1) AS c1, least(greatest(1 - avg(gap) OVER m / 0.25, 0), 1) AS c2 FROM r WINDOW m AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) """
 + SPANS.format(source="c") + """SELECT video_id, frame, round(c1, 6) AS c1, round(c2, 6) AS c2, round(least(median(c1) OVER (PARTITION BY video_id, span), median(c2) OVER (PARTITION BY video_id, span)), 6) AS c3 FROM sp""")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumns({"spread": F.col("pos") * F.col("pos"), "gap": F.abs(F.col("pos") - 0.5) / 4})
    return S.confidence(t, _spans).select(KEY, FRAME, *(_r(F.col(c), 6).alias(c) for c in ("c1", "c2", "c3")))


@query(TRACK + "SELECT video_id, frame, round(0.5 * (tanh(4 * (pos - avg(pos) OVER v) / CASE WHEN stddev_pop(pos) OVER v > 1e-6 THEN stddev_pop(pos) OVER v ELSE greatest((max(pos) OVER v - min(pos) OVER v) / 6, 1e-6) END) + 1), 5) AS value FROM track WINDOW v AS (PARTITION BY video_id, frame // 50)")
def stretch_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("seg", F.floor(F.col(FRAME) / 50))
    return t.select(KEY, FRAME, _r(S.stretched(t, "seg")).alias("value"))


@query(TRACK + f", g AS (SELECT *, abs({GRAD}) AS g FROM track), q AS (SELECT video_id, greatest(0.00075::DOUBLE, quantile_cont(g, 0.25)) AS lo, quantile_cont(g, 0.9) AS hi FROM g WHERE g > 0 GROUP BY 1) SELECT video_id, frame, round(g, 5) AS speed FROM g JOIN q USING (video_id) WHERE g >= lo AND g <= greatest(hi, lo)")
def gradient_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("speed", F.abs(S.gradient(F.col("pos"))))
    band = t.where("speed > 0").groupBy(KEY).agg(F.greatest(F.lit(0.00075), F.percentile("speed", F.lit(0.25))).alias("lo"), F.percentile("speed", F.lit(0.9)).alias("hi"))
    return t.join(band, KEY).where("speed >= lo and speed <= greatest(hi, lo)").select(KEY, FRAME, _r(F.col("speed")).alias("speed"))


@query(TRACK + "SELECT video_id, frame // 16 AS slot, count(*) AS n, round((sum(pos) + (16 - count(*)) * max_by(pos, frame)) / 16, 9) AS value FROM track GROUP BY 1, 2")
def tumbling_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 16 frames; the last is padded with its final frame."""
    padded = (F.sum("pos") + (16 - F.count("*")) * F.max_by("pos", FRAME)) / 16
    return tracks(spark, sf_dir).groupBy(KEY, F.floor(F.col(FRAME) / 16).alias("slot")).agg(F.count("*").alias("n"), _r(padded, 9).alias("value"))


# aggregates


@query(TRACK + "SELECT video_id, count(*) AS n, round(min(pos), 5) AS low, round(max(pos), 5) AS high, round(avg(pos), 5) AS mean, round(stddev_pop(pos), 5) AS std, round((count(*) - 1) / (max(pts) - min(pts)), 5) AS fps, count(*) FILTER (pos >= 1) AS clipped FROM track GROUP BY 1")
def track_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = (F.count("*") - 1) / (F.max("pts") - F.min("pts"))
    return tracks(spark, sf_dir).groupBy(KEY).agg(F.count("*").alias("n"), _r(F.min("pos")).alias("low"), _r(F.max("pos")).alias("high"), _r(F.avg("pos")).alias("mean"), _r(F.stddev_pop("pos")).alias("std"), _r(fps).alias("fps"), F.count_if(F.col("pos") >= 1).alias("clipped"))


@query(TRACK + "SELECT video_id, round(quantile_cont(pos, 0.05), 5) AS p05, round(quantile_cont(pos, 0.5), 5) AS p50, round(quantile_cont(pos, 0.95), 5) AS p95 FROM track GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).groupBy(KEY).agg(*(_r(F.percentile("pos", F.lit(p))).alias(f"p{round(100 * p):02d}") for p in (0.05, 0.5, 0.95)))


@query(TRACK + f", g AS (SELECT *, {GRAD} AS g FROM track) SELECT video_id, frame // 50 AS seg, round(abs(avg(sign(g)) FILTER (abs(g) >= 0.01)), 5) AS balance FROM g GROUP BY 1, 2")
def sign_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("g", S.gradient(F.col("pos")))
    return t.groupBy(KEY, F.floor(F.col(FRAME) / 50).alias("seg")).agg(_r(F.abs(F.avg(F.when(F.abs("g") >= 0.01, F.signum("g"))))).alias("balance"))


@query(TRACK + ", e AS (SELECT *, abs(pos - avg(pos) OVER (PARTITION BY video_id, frame // 50)) AS e FROM track), k AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame // 50 ORDER BY round(e, 9) DESC, frame) AS k FROM e) SELECT video_id, frame // 50 AS seg, frame, round(e, 5) AS error FROM k WHERE k = 1")
def worst_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.floor(F.col(FRAME) / 50)
    t = tracks(spark, sf_dir).withColumn("seg", seg).withColumn("e", F.abs(F.col("pos") - F.avg("pos").over(Window.partitionBy(KEY, "seg"))))
    worst = F.max(F.struct(F.round("e", 9).alias("e"), (-F.col(FRAME)).alias("f"))).alias("w")
    return t.groupBy(KEY, "seg").agg(worst).select(KEY, "seg", (-F.col("w.f")).alias(FRAME), _r(F.col("w.e")).alias("error"))


@query("WITH e AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id, (value / 10)::FLOAT AS t, value FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY video_id, t ORDER BY event_id DESC) AS k FROM e) SELECT video_id, event_id, t::DOUBLE AS t, value FROM k WHERE k = 1 AND t >= 0")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias(KEY), "event_id", (F.col("value") / 10).cast("float").alias("t"), "value")
    return R.last_per(e.where("t >= 0"), [KEY, "t"], F.col("event_id")).withColumn("t", F.col("t").cast("double"))


# joins and updates


@query("SELECT source || '/' || doc_id || '.mp4' AS path, n_chars AS size FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)")
def unscripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.concat("doc_id", F.lit(".mp4"))).alias("path"), F.col("n_chars").alias("size"))
    return R.without(videos, table(spark, sf_dir, "labels"), "doc_id").select("path", "size")


@query("SELECT doc_id, source || '/' || doc_id || '.mp4' AS path FROM documents WHERE NOT starts_with(source || '/', 'src1/') AND NOT starts_with(source || '/', 'src2/')")
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.concat("doc_id", F.lit(".mp4"))).alias("path"))
    return R.not_under(videos, ["src1", "src2/"])


@query("""WITH c AS (SELECT o_custkey % 10 AS id, o_orderkey::VARCHAR AS path, o_orderkey AS clip_lo, o_orderkey + 1 + CAST(floor(o_totalprice / 2000) AS BIGINT) AS clip_hi FROM orders),
q AS (SELECT l_orderkey, l_linenumber, l_suppkey % 10 AS id, l_orderkey AS lo, l_orderkey + l_linenumber AS hi FROM lineitem),
j AS (SELECT q.*, path, clip_hi - clip_lo AS span, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, q.id ORDER BY clip_hi - clip_lo, path) AS k FROM q JOIN c ON q.id = c.id AND clip_lo <= lo AND clip_hi >= hi AND clip_lo > lo - 1000)
SELECT l_orderkey, l_linenumber, id, lo, hi, path, span FROM j WHERE k = 1""")
def covering_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("id"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("clip_lo"), (F.col("o_orderkey") + 1 + F.floor(F.col("o_totalprice") / 2000)).alias("clip_hi"))
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 10).alias("id"), F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("hi"))
    return R.smallest_cover(asked, clips, "id")


@query(TRACK + ", t AS (SELECT a.video_id, a.frame, b.pts, count(b.pts) OVER (PARTITION BY a.video_id) AS got, count(*) OVER (PARTITION BY a.video_id) AS n FROM track a LEFT JOIN (FROM track WHERE video_id <> 'click' OR frame <> 5) b USING (video_id, frame)) SELECT video_id, frame, round(CASE WHEN got = n THEN pts ELSE frame / 30.0::DOUBLE END, 3) AS t FROM t")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track's time table has a gap, so that whole track takes nominal times."""
    t = tracks(spark, sf_dir)
    return R.with_times(t.select(KEY, FRAME), t.where((F.col(KEY) != "click") | (F.col(FRAME) != 5)), FPS).select(KEY, FRAME, _r(F.col("t"), 3).alias("t"))


@query(TRACK + "SELECT video_id, count(*) AS main_rows, count(*) FILTER (pos < 2 AND (video_id <> 'click' OR frame <> 5)) AS axis_rows, video_id <> 'click' AS complete FROM track GROUP BY video_id")
def aligned_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    return R.aligned_axes(t, t.where((F.col(KEY) != "click") | (F.col(FRAME) != 5)))


@query(RECURSIVE + PROMINENT + "SELECT video_id, frame, pos FROM track k WHERE frame = 0 OR frame = (SELECT max(frame) FROM track t WHERE t.video_id = k.video_id) OR EXISTS (FROM turn t WHERE t.video_id = k.video_id AND t.frame = k.frame)")
def kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames at which strokes turn, and both ends."""
    t = _spans(tracks(spark, sf_dir))
    ends = t.groupBy(KEY).agg(F.max(FRAME).alias(FRAME))
    return t.join(t.groupBy(KEY, "span").agg(F.min(FRAME).alias(FRAME)).select(KEY, FRAME).union(ends).distinct(), [KEY, FRAME], "left_semi").select(KEY, FRAME, "pos")


@query("""WITH e AS (SELECT CAST(label AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.video_id, a.frame, CAST(a.frame - b.frame AS INT) AS lag, round(list_cosine_similarity(a.v, b.v), 5) AS similarity FROM e a JOIN e b ON a.video_id = b.video_id AND a.frame - b.frame BETWEEN -64 AND 63""")
def lagged_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frame_scores(spark, sf_dir).withColumnRenamed("logits", "e")
    return R.lagged_similarity(e, -64, 63).withColumn("similarity", _r(F.col("similarity")))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return R.upserted(old, old.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("WITH t AS (SELECT DISTINCT c_nationkey AS stem, CAST(c_custkey % 40 AS INT) AS number FROM customer), n AS (SELECT stem, unnest(range(1, 42)) AS number FROM (SELECT DISTINCT stem FROM t)) SELECT stem, CAST(min(number) AS INT) AS number FROM n WHERE NOT EXISTS (FROM t WHERE t.stem = n.stem AND t.number = n.number) GROUP BY stem")
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("stem"), (F.col("c_custkey") % 40).cast("int").alias("number"))
    return R.first_free(taken, taken)


@query("WITH s AS (SELECT CAST(user_id AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events), k AS (SELECT video_id, frame FROM s WHERE frame <> 7 OR video_id NOT LIKE '%5'), d AS (SELECT video_id, count(*) AS n, max(frame) AS top FROM k GROUP BY 1), e AS (SELECT video_id, count(*) AS expected FROM s GROUP BY 1) SELECT video_id, CASE WHEN n = top + 1 THEN n ELSE 0 END AS completed, expected, CASE WHEN n = top + 1 THEN n ELSE 0 END AS resume_at FROM e LEFT JOIN d USING (video_id)")
def store_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    slots = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias(KEY), (F.row_number().over(order) - 1).cast("long").alias(FRAME))
    return scripts.progress(slots.where((F.col(FRAME) != 7) | ~F.col(KEY).endswith("5")), slots.groupBy(KEY).agg(F.count("*").alias("expected")))


# scalars


@query("""WITH v AS (SELECT p_partkey, (p_size % 40) / 100.0::DOUBLE AS x1, 0.1::DOUBLE AS y1, (50 + p_size) / 100.0::DOUBLE AS x2, 1.0::DOUBLE AS y2 FROM part), b AS (SELECT *, x2 <= 1 AS ok FROM v)
SELECT p_partkey, CASE WHEN ok THEN 'box' || lpad(CAST(CAST(round_even(x1 * 10000, 0) AS BIGINT) AS VARCHAR), 5, '0') || '-01000-' || lpad(CAST(CAST(round_even(x2 * 10000, 0) AS BIGINT) AS VARCHAR), 5, '0') || '-10000' ELSE 'crop' END AS tag,
CASE WHEN ok THEN CAST(round_even(x1 * 1921, 0) AS BIGINT) // 2 * 2 END AS "left", CASE WHEN ok THEN least(CAST(round_even(x2 * 1921, 0) AS BIGINT) // 2 * 2, 1921) END AS "right", CASE WHEN ok THEN 1080 END::BIGINT AS bottom FROM b""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(",", (F.col("p_size") % 40 / 100.0).cast("string"), F.lit("0.1"), ((F.col("p_size") + 50) / 100.0).cast("string"), F.lit("1"))
    box = X.crop_box(text)
    made = table(spark, sf_dir, "part").select("p_partkey", box.alias("box")).withColumn("px", X.crop_pixels(F.col("box"), F.lit(1921), F.lit(1080)))
    return made.select("p_partkey", X.crop_tag(F.col("box")).alias("tag"), "px.left", "px.right", "px.bottom")


@query("SELECT doc_id, substr(sha256(source || '|' || n_chars || '|' || doc_id), 1, 16) AS print, substr(regexp_replace(source || ' é/' || doc_id, '[^\\p{L}\\p{N}_-]', '_', 'g'), 1, 80) AS name FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.fingerprint(F.col("source"), F.col("n_chars"), F.col("doc_id")).alias("print"), X.safe_name(F.concat("source", F.lit(" é/"), "doc_id")).alias("name"))


@query("""WITH e AS (SELECT event_id, value FROM events) SELECT event_id, CAST(round_even(value * 29.97, 0) AS BIGINT) AS start, least(9000, CAST(round_even(value * 29.97, 0) AS BIGINT) + 300)::BIGINT AS stop,
CASE WHEN round_even(value * 20, 0) < 60 THEN CAST(round_even(value * 20, 0) AS BIGINT) || 's' WHEN round_even(value * 20, 0) < 3600 THEN CAST(round_even(value * 20, 0) AS BIGINT) // 60 || 'm ' || lpad(CAST(CAST(round_even(value * 20, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 's'
ELSE CAST(round_even(value * 20, 0) AS BIGINT) // 3600 || 'h ' || lpad(CAST(CAST(round_even(value * 20, 0) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || 'm' END AS lasted FROM e""")
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.frame_window(F.col("value"), F.lit(300 / 29.97), F.lit(29.97), F.lit(9000).cast("long"))
    return table(spark, sf_dir, "events").select("event_id", w.alias("w"), X.duration_text(F.col("value") * 20).alias("lasted")).select("event_id", "w.start", F.col("w.end").alias("stop"), "lasted")


@query("SELECT p_partkey, 5 AS coarse, 54 AS fine, greatest(1, CAST(round_even(128.0::DOUBLE / (1 + p_size) * 50176 / (224.0::DOUBLE * 384), 0) AS INT)) AS batch, CAST(least(greatest(2147483648 // (p_size * 1000000), 1), 64) AS INT) AS frames, CASE WHEN p_size % 3 = 0 THEN 128 ELSE least(p_size, 256) END AS stride FROM part")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    pooled = lambda *k: X.pooled_tokens(F.array(*map(F.lit, k)))
    return table(spark, sf_dir, "part").select("p_partkey", pooled(1, 2).alias("coarse"), pooled(1, 2, 7).alias("fine"), X.batch_windows(1 + size, F.lit(224), F.lit(384)).alias("batch"), X.decode_batch(size.cast("long") * 1_000_000).alias("frames"), X.window_stride(F.when(size % 3 == 0, 0).otherwise(size), F.lit(256)).alias("stride"))


# order-bound kernels: checked in tests against plain versions


# cycles between the strict minima under 0.2, their carried value in a recursion over the cycles
CYCLES = RECURSIVE + """, nb AS (SELECT *, lag(pos) OVER w AS b, lead(pos) OVER w AS a FROM track WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
tr AS (SELECT video_id, frame AS s, lead(frame) OVER (PARTITION BY video_id ORDER BY frame) AS e FROM nb WHERE pos < b AND pos < a AND pos < 0.2),
ow AS (SELECT tr.video_id, s, e, any_value(x.pos) FILTER (frame = s) AS xs, any_value(x.pos) FILTER (frame = e) AS xe, min(x.pos) FILTER (frame > s) AS lo, max(x.pos) FILTER (frame > s) AS hi, max(x.pos) - min(x.pos) AS reach
  FROM tr JOIN track x ON x.video_id = tr.video_id AND x.frame BETWEEN s AND e WHERE e - s BETWEEN 2 AND 60 GROUP BY 1, 2, 3),
cy AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s) AS k FROM ow WHERE reach >= 0.3),
st AS (SELECT video_id, 0::BIGINT AS k, -1::BIGINT AS s, -1::BIGINT AS e, 0::DOUBLE AS first, 0::DOUBLE AS low, 1::DOUBLE AS high, false AS made, 0::DOUBLE AS carried FROM cy GROUP BY 1 UNION ALL
  SELECT video_id, k, s, e, first, low, high, high - low > 1e-6, CASE WHEN high - low > 1e-6 THEN (xe - low) / (high - low) ELSE xe END FROM (
    SELECT cy.video_id, cy.k, cy.s, cy.e, cy.xe, CASE WHEN st.e = cy.s THEN st.carried ELSE cy.xs END AS first, least(lo, CASE WHEN st.e = cy.s THEN st.carried ELSE cy.xs END) AS low, greatest(hi, CASE WHEN st.e = cy.s THEN st.carried ELSE cy.xs END) AS high
    FROM st JOIN cy ON cy.video_id = st.video_id AND cy.k = st.k + 1))
SELECT t.video_id, t.frame, round(CASE WHEN n.made THEN (n.first - n.low) / (n.high - n.low) WHEN o.made THEN (t.pos - o.low) / (o.high - o.low) ELSE t.pos END, 6) AS value, coalesce(n.made, false) OR coalesce(o.made, false) AS inside
FROM track t LEFT JOIN st o ON o.video_id = t.video_id AND o.k > 0 AND t.frame > o.s AND t.frame <= o.e LEFT JOIN st n ON n.video_id = t.video_id AND n.k > 0 AND n.s = t.frame"""


@query(CYCLES)
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles between the strict minima under 0.2."""
    t = tracks(spark, sf_dir).select(KEY, FRAME, "pos")
    near = t.withColumns({"b": F.lag("pos").over(in_order()), "a": F.lead("pos").over(in_order())})
    return Y.normalised(t, near.where("pos < b and pos < a and pos < 0.2"), FPS).withColumn("value", _r(F.col("value"), 6))


# keyframes: turning points of the smoothed track, then rounds in which every part between stretches without inner frames gets the knot it would get next, then the device's rules
KEYED = RECURSIVE + """, d AS (SELECT video_id, frame, least(greatest(round_even(pos * 100, 0), 0), 100) AS y FROM track),
nn AS (SELECT video_id, count(*) AS n, max(frame) - 4 AS last, 0.1::DOUBLE * greatest(quantile_cont(y, 0.95) - quantile_cont(y, 0.05), 1e-6) AS least FROM d GROUP BY 1),
ss AS (SELECT d.video_id, d.frame, greatest(0, least(nn.last, d.frame - 2)) AS start FROM d JOIN nn USING (video_id)),
sp AS (SELECT ss.video_id, ss.frame, ss.frame - ss.start - 2 AS o, d.frame - ss.start - 2 AS k, d.y FROM ss JOIN d ON d.video_id = ss.video_id AND d.frame BETWEEN ss.start AND ss.start + 4),
sm AS (SELECT video_id, frame, round(avg(y) + o * sum(k * y) / sum(k * k) + (o * o - 2) * sum((k * k - 2) * y) / sum((k * k - 2) * (k * k - 2)), 9) AS x FROM sp GROUP BY video_id, frame, o)""" + TURNS.format(distance=6, where="x - greatest(ml, mr) >= (SELECT least FROM nn WHERE nn.video_id = ba.video_id)").replace("pos::FLOAT::DOUBLE AS x FROM track", "x FROM sm").replace("-(pos::FLOAT::DOUBLE) FROM track", "-x FROM sm") + """, g AS (SELECT d.video_id, 0 AS step, list_sort(list_distinct(list(t.frame) FILTER (t.frame IS NOT NULL) || [0::BIGINT, max(d.frame)])) AS knots, false AS done FROM d LEFT JOIN turn t ON t.video_id = d.video_id AND t.frame = d.frame GROUP BY 1
UNION ALL
SELECT video_id, step, CASE WHEN frames IS NULL THEN knots ELSE list_sort(knots || frames) END, frames IS NULL FROM (
 WITH kn AS (SELECT video_id, unnest(knots) AS x FROM g WHERE NOT done),
 k AS (SELECT kn.video_id, x, y AS v, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d FROM kn JOIN d ON d.video_id = kn.video_id AND d.frame = kn.x WINDOW w AS (PARTITION BY kn.video_id ORDER BY x)),
 n AS (SELECT *, lag(h) OVER w AS g0, lag(d) OVER w AS c, lag(h, 2) OVER w AS gg, lag(d, 2) OVER w AS cc, lead(h) OVER w AS hh, lead(d) OVER w AS dd, lead(v) OVER w AS v1, sum((h = 1)::INT) OVER w AS part FROM k WINDOW w AS (PARTITION BY video_id ORDER BY x)),
 r AS (SELECT *, CASE WHEN c IS NULL THEN ((2 * h + hh) * d - h * dd) / (h + hh) ELSE ((2 * g0 + gg) * c - g0 * cc) / (g0 + gg) END AS s, CASE WHEN c IS NULL THEN d ELSE c END AS d0, CASE WHEN c IS NULL THEN dd ELSE cc END AS d1 FROM n),
 m AS (SELECT *, CASE WHEN c IS NOT NULL AND d IS NOT NULL THEN CASE WHEN c * d > 0 THEN (g0 + 2 * h + (2 * g0 + h)) / ((2 * g0 + h) / d + (g0 + 2 * h) / c) ELSE 0 END WHEN d1 IS NULL THEN d0 WHEN s * d0 <= 0 THEN 0 WHEN d0 * d1 <= 0 AND abs(s) > 3 * abs(d0) THEN 3 * d0 ELSE s END AS m FROM r),
 z AS (SELECT *, lead(m) OVER (PARTITION BY video_id ORDER BY x) AS m1 FROM m),
 f AS (SELECT z.video_id, z.part, d.frame, d.y, z.v, z.v1, z.m, z.m1, z.h, (d.frame - x) / h::DOUBLE AS t, 1 - (d.frame - x) / h::DOUBLE AS r FROM z JOIN d ON d.video_id = z.video_id AND d.frame > z.x AND d.frame < z.x + z.h),
 w AS (SELECT video_id, part, frame, abs(v * (1 + 2 * t) * r * r + m * h * t * r * r + v1 * t * t * (3 - 2 * t) - m1 * h * t * t * r - y) AS e FROM f),
 b AS (SELECT video_id, part, max(e) AS e FROM w GROUP BY 1, 2 HAVING max(e) > 3),
 o AS (SELECT w.video_id, w.part, min(frame) AS frame FROM w JOIN b ON b.video_id = w.video_id AND b.part = w.part AND b.e = w.e GROUP BY 1, 2),
 p AS (SELECT video_id, list(frame) AS frames FROM o GROUP BY 1)
 SELECT g.video_id, g.step + 1 AS step, g.knots, p.frames FROM g LEFT JOIN p USING (video_id) WHERE NOT g.done) q),
a0 AS (SELECT video_id, 0 AS step, knots AS pts, false AS still FROM g WHERE done UNION ALL
  SELECT video_id, step + 1, CASE WHEN gone IS NULL THEN pts ELSE list_filter(pts, lambda p: p <> gone) END, gone IS NULL FROM (
    WITH u AS (SELECT a0.video_id, unnest(pts) AS p FROM a0 WHERE NOT still),
    v AS (SELECT u.video_id, p, y, lag(y) OVER w AS b, lead(y) OVER w AS a FROM u JOIN d ON d.video_id = u.video_id AND d.frame = u.p WINDOW w AS (PARTITION BY u.video_id ORDER BY p)),
    f AS (SELECT video_id, min(p) AS gone FROM v WHERE abs(y - b) < 5 AND abs(y - a) < 5 GROUP BY 1)
    SELECT a0.video_id, a0.step, a0.pts, f.gone FROM a0 LEFT JOIN f USING (video_id) WHERE NOT a0.still) q),
pt AS (SELECT a.video_id, a.p, d.y, row_number() OVER (PARTITION BY a.video_id ORDER BY p) AS k, count(*) OVER (PARTITION BY a.video_id) AS n FROM (SELECT video_id, unnest(pts) AS p FROM a0 WHERE still) a JOIN d ON d.video_id = a.video_id AND d.frame = a.p),
sg AS (SELECT x.video_id, 2::BIGINT AS k, x.p AS p0, x.y AS y0, z.p AS p1, z.y AS y1, [x.p] AS kept, x.n FROM pt x JOIN pt z ON z.video_id = x.video_id AND x.k = 1 AND z.k = 2 UNION ALL
  SELECT sg.video_id, pt.k, CASE WHEN pt.p - p1 >= 1.65 THEN p1 ELSE p0 END, CASE WHEN pt.p - p1 >= 1.65 THEN y1 ELSE y0 END, CASE WHEN pt.p - p1 >= 1.65 OR abs(pt.y - y0) >= abs(y1 - y0) THEN pt.p ELSE p1 END,
    CASE WHEN pt.p - p1 >= 1.65 OR abs(pt.y - y0) >= abs(y1 - y0) THEN pt.y ELSE y1 END, CASE WHEN pt.p - p1 >= 1.65 THEN list_append(kept, p1) ELSE kept END, sg.n FROM sg JOIN pt ON pt.video_id = sg.video_id AND pt.k = sg.k + 1)
SELECT e.video_id, e.frame, d.y AS dense FROM (SELECT DISTINCT sg.video_id, unnest(kept || [p1, (SELECT max(frame) FROM d WHERE d.video_id = sg.video_id)]) AS frame FROM sg WHERE k = n) e JOIN d ON d.video_id = e.video_id AND d.frame = e.frame"""


@query(KEYED)
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.keyframes(tracks(spark, sf_dir), FPS)


KNOTS = TRACK + """, d AS (SELECT video_id, frame, least(greatest(round_even(pos * 100, 0), 0), 100) AS y, max(frame) OVER (PARTITION BY video_id) AS top FROM track),
k AS (SELECT video_id, frame AS x, y AS v, lead(frame) OVER w - frame AS h, (lead(y) OVER w - y) / (lead(frame) OVER w - frame) AS d FROM d WHERE frame % 10 = 0 OR frame = top WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
n AS (SELECT *, lag(h) OVER w AS g, lag(d) OVER w AS c, lag(h, 2) OVER w AS gg, lag(d, 2) OVER w AS cc, lead(h) OVER w AS hh, lead(d) OVER w AS dd, lead(v) OVER w AS v1 FROM k WINDOW w AS (PARTITION BY video_id ORDER BY x)),
e AS (SELECT *, CASE WHEN c IS NULL THEN ((2 * h + hh) * d - h * dd) / (h + hh) WHEN d IS NULL THEN ((2 * g + gg) * c - g * cc) / (g + gg) END AS r, coalesce(c, d) * 0 + CASE WHEN c IS NULL THEN d ELSE c END AS d0, CASE WHEN c IS NULL THEN dd ELSE cc END AS d1 FROM n),
m AS (SELECT *, CASE WHEN c IS NOT NULL AND d IS NOT NULL THEN CASE WHEN c * d > 0 THEN 3 * (g + h) / ((2 * h + g) / c + (h + 2 * g) / d) ELSE 0 END WHEN r * d0 <= 0 THEN 0 WHEN d0 * d1 <= 0 AND abs(r) > 3 * abs(d0) THEN 3 * d0 ELSE r END AS m FROM e),
z AS (SELECT *, lead(m) OVER (PARTITION BY video_id ORDER BY x) AS m1 FROM m),
f AS (SELECT d.video_id, d.frame, d.y, z.*, (d.frame - x) / h::DOUBLE AS t FROM d ASOF JOIN z ON d.video_id = z.video_id AND d.frame >= z.x),
q AS (SELECT video_id, frame, abs(y - CASE WHEN frame = x THEN v ELSE v + (v1 - v) * t END) AS li, frame = x AS kept,
 abs(y - CASE WHEN frame = x THEN v ELSE v * (1 + 2 * t) * (1 - t) * (1 - t) + m * h * t * (1 - t) * (1 - t) + v1 * t * t * (3 - 2 * t) + m1 * h * t * t * (t - 1) END) AS cu FROM f)
SELECT video_id, count(*) AS raw, count(*) FILTER (kept) AS kept, round_even(count(*) FILTER (kept) / count(*), 5) AS kept_share,
 round_even(avg(cu), 3) AS cubic_mean, round_even(quantile_cont(cu, 0.95), 3) AS cubic_p95, round_even(max(cu), 3) AS cubic_max, round_even(avg(li), 3) AS linear_mean, round_even(quantile_cont(li, 0.95), 3) AS linear_p95, round_even(max(li), 3) AS linear_max FROM q GROUP BY 1"""


@query(KNOTS)
def reconstruction_of_tenths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of the curves through every tenth frame and the last."""
    t = tracks(spark, sf_dir)
    last = F.max(FRAME).over(Window.partitionBy(KEY))
    return K.reconstruction(t, t.withColumn("top", last).where((F.col(FRAME) % 10 == 0) | (F.col(FRAME) == F.col("top"))))


@query()
def postprocess_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.postprocessed(tracks(spark, sf_dir), FPS, stats=True)


@query(TRACK + """, w AS (SELECT unnest(range(-14, 15)) AS k), g AS (SELECT k, exp(-0.5::DOUBLE * (k / 3.6::DOUBLE) * (k / 3.6::DOUBLE)) AS w FROM w), n AS (SELECT video_id, max(frame) AS top FROM track GROUP BY 1),
s AS (SELECT t.video_id, t.frame, greatest(0, least(n.top, t.frame + g.k)) AS at, g.w / (SELECT sum(w) FROM g) AS w FROM track t JOIN n USING (video_id), g)
SELECT s.video_id, s.frame, round(sum(s.w * t.pos), 6) AS value FROM s JOIN track t ON t.video_id = s.video_id AND t.frame = s.at GROUP BY 1, 2""")
def gaussian_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.filtered(tracks(spark, sf_dir), "gaussian", FPS).withColumn("value", _r(F.col("value"), 6))


@query(KNOTS.replace(", d AS (", ", kf AS (" + KEYED + "), d AS (", 1).replace("WHERE frame % 10 = 0 OR frame = top", "WHERE EXISTS (FROM kf WHERE kf.video_id = d.video_id AND kf.frame = d.frame)"))
def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    return K.reconstruction(t, K.keyframes(t, FPS))


@query()
def postprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.postprocessed(tracks(spark, sf_dir), FPS)


# the filter sample by sample, forwards and backwards over the extended track
LOWPASS = RECURSIVE + """, co AS (SELECT tan(pi() * 8 / 30) AS k), c2 AS (SELECT k * k / (1 + sqrt(2) * k + k * k) AS b0, 2 * (k * k - 1) / (1 + sqrt(2) * k + k * k) AS a1, (1 - sqrt(2) * k + k * k) / (1 + sqrt(2) * k + k * k) AS a2 FROM co),
c AS (SELECT *, 2 * b0 AS b1, b0 AS b2, b0 - a2 AS z2, 2 * b0 - a1 + b0 - a2 AS z1 FROM c2),
e AS (SELECT video_id, count(*) AS n, max_by(pos, frame) AS x1, min_by(pos, frame) AS x0 FROM track GROUP BY 1),
wi AS (SELECT video_id, frame + 9 AS i, pos AS u FROM track UNION ALL SELECT video_id, 9 - frame, 2 * x0 - pos FROM track JOIN e USING (video_id) WHERE frame BETWEEN 1 AND 9
  UNION ALL SELECT video_id, 2 * n - 2 - frame + 9, 2 * x1 - pos FROM track JOIN e USING (video_id) WHERE frame BETWEEN n - 10 AND n - 2),
fw AS (SELECT wi.video_id, 0::BIGINT AS i, b0 * u + z1 * u AS y, b1 * u - a1 * (b0 * u + z1 * u) + z2 * u AS s1, b2 * u - a2 * (b0 * u + z1 * u) AS s2 FROM wi, c WHERE i = 0
  UNION ALL SELECT fw.video_id, wi.i, b0 * u + s1, b1 * u - a1 * (b0 * u + s1) + s2, b2 * u - a2 * (b0 * u + s1) FROM fw JOIN wi ON wi.video_id = fw.video_id AND wi.i = fw.i + 1, c),
rv AS (SELECT fw.video_id, n + 17 - i AS i, y AS u FROM fw JOIN e USING (video_id)),
bw AS (SELECT rv.video_id, 0::BIGINT AS i, b0 * u + z1 * u AS y, b1 * u - a1 * (b0 * u + z1 * u) + z2 * u AS s1, b2 * u - a2 * (b0 * u + z1 * u) AS s2 FROM rv, c WHERE i = 0
  UNION ALL SELECT bw.video_id, rv.i, b0 * u + s1, b1 * u - a1 * (b0 * u + s1) + s2, b2 * u - a2 * (b0 * u + s1) FROM bw JOIN rv ON rv.video_id = bw.video_id AND rv.i = bw.i + 1, c)
SELECT bw.video_id, n + 8 - i AS frame, round(y, 6) AS value FROM bw JOIN e USING (video_id) WHERE n + 8 - i BETWEEN 0 AND n - 1"""


@query(LOWPASS)
def lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.filtered(tracks(spark, sf_dir), "lowpass", FPS).withColumn("value", _r(F.col("value"), 6))


@query(TRACK + """, n AS (SELECT video_id, count(*) AS n, max(frame) - 14 AS last FROM track GROUP BY 1),
s AS (SELECT t.video_id, t.frame, greatest(0, least(n.last, t.frame - 7)) AS start FROM track t JOIN n USING (video_id)),
p AS (SELECT s.video_id, s.frame, s.frame - s.start - 7 AS o, t.frame - s.start - 7 AS k, t.pos AS x FROM s JOIN track t ON t.video_id = s.video_id AND t.frame BETWEEN s.start AND s.start + 14)
SELECT video_id, frame, round(avg(x) + o * sum(k * x) / sum(k * k) + (o * o - 56.0::DOUBLE / 3) * sum((k * k - 56.0::DOUBLE / 3) * x) / sum((k * k - 56.0::DOUBLE / 3) * (k * k - 56.0::DOUBLE / 3)), 6) AS value FROM p GROUP BY video_id, frame, o""")
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quadratic of the 15 frames around each, as sums of orthogonal polynomials in the SQL."""
    return K.filtered(tracks(spark, sf_dir), "savgol", FPS).withColumn("value", _r(F.col("value"), 6))


@query(RECURSIVE + PROMINENT.replace("::FLOAT", "") + "SELECT video_id, frame FROM turn UNION SELECT video_id, min(frame) FROM track GROUP BY 1 UNION SELECT video_id, max(frame) FROM track GROUP BY 1")
def turning_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.turning_points(tracks(spark, sf_dir), FPS)


@query(RECURSIVE + TURNS.format(distance=4, where="sign = -1") + "FROM turn")
def troughs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.troughs(tracks(spark, sf_dir), FPS)


for _new, _old in (("turning_spans", stroke_spans), ("turning_confidence", confidence), ("turning_frames", kept_frames)):
    QUERIES[_new], ORACLES[_new] = _old, ORACLES[_old.__name__]


@query("SELECT video_id, '{\"version\":\"1.0\",\"inverted\":false,\"range\":100,\"actions\":[' || string_agg('{\"at\":' || CAST(round_even(frame / 30.0::DOUBLE * 1000, 0) AS BIGINT) || ',\"pos\":' || dense::INT || '}', ',' ORDER BY frame) || ']}' AS json FROM (" + KEYED + ") GROUP BY 1")
def script_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = K.keyframes(tracks(spark, sf_dir), FPS)
    return scripts.script_json(kept.select(KEY, X.at_ms(F.col(FRAME) / FPS).alias("at"), F.col("dense").cast("int").alias("pos")))


@query("SELECT video_id, (CAST(round_even(frame / 30.0::DOUBLE * 1000, 0) AS BIGINT) / 1000.0::DOUBLE)::FLOAT AS seconds, dense::INT AS pos FROM (" + KEYED + ")")
def packed_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = K.keyframes(tracks(spark, sf_dir), FPS)
    return scripts.unpacked_scripts(scripts.packed_scripts(kept.select(KEY, X.at_ms(F.col(FRAME) / FPS).alias("at"), F.col("dense").cast("int").alias("pos"))))
