"""The slot store and the state that a silent track gives up."""

import datetime

import pytest
from pyspark.sql import functions as F

from trackloom.operators import relational, sequences
from trackloom.sources.store import SlotStore
from trackloom.streaming import silent


def slots(spark, spec):
    """Rows of {track: (identity, expected, slots)}."""
    rows = [(key, identity, expected, s, s * 1.5) for key, (identity, expected, given) in spec.items() for s in given]
    return spark.createDataFrame(rows, "video_id string, identity string, expected long, slot long, e double")


def held(store):
    out = {}
    for r in store.read().orderBy("slot").collect():
        assert r.e == r.slot * 1.5
        out.setdefault(r.video_id, []).append(r.slot)
    return out


def done(store):
    return {r.video_id: r.completed for r in store.progress().collect()}


def test_store_keeps_whole_chunks_and_their_rest(spark, tmp_path):
    store = SlotStore(spark, str(tmp_path), "e double", chunk_slots=4)
    assert held(store) == {} and done(store) == {}
    assert store.append(slots(spark, {"a": ("x", 10, range(6)), "b": ("x", 3, range(2))}), "0")
    assert held(store) == {"a": [0, 1, 2, 3]} and done(store) == {"a": 4}
    assert not store.append(slots(spark, {"a": ("x", 10, range(10))}), "0")  # came again: nothing changes
    assert store.append(slots(spark, {"a": ("x", 10, [6, 7, 8, 8]), "b": ("x", 3, [2, 1])}), "1")
    assert held(store) == {"a": list(range(8)), "b": [0, 1, 2]} and done(store) == {"a": 8, "b": 3}
    wanted = spark.createDataFrame([("a", "x", 10), ("b", "x", 3), ("c", "x", 5)], "video_id string, identity string, expected long")
    assert sorted((r.video_id, r.start) for r in store.missing(wanted).collect()) == [("a", 8), ("c", 0)]
    store.append(slots(spark, {"a": ("x", 10, [9, 0, 3])}), "2")
    assert done(store) == {"a": 10, "b": 3} and held(store)["a"] == list(range(10))
    # made with something else: the track starts anew
    store.append(slots(spark, {"a": ("y", 10, range(5))}), "3")
    assert done(store)["a"] == 4 and held(store) == {"a": [0, 1, 2, 3], "b": [0, 1, 2]}


@pytest.mark.parametrize("dies", ["data", "tail", "manifest"])
def test_a_batch_that_dies_is_repeated(spark, tmp_path, monkeypatch, dies):
    batches = [{"a": ("x", 11, range(0, 5))}, {"a": ("x", 11, range(5, 9)), "b": ("x", 4, range(4))}, {"a": ("x", 11, range(9, 11))}]
    store = SlotStore(spark, str(tmp_path), "e double", chunk_slots=4)
    store.append(slots(spark, batches[0]), "0")
    before = held(store)
    if dies == "manifest":
        monkeypatch.setattr(SlotStore, "_commit", lambda *_: (_ for _ in ()).throw(KeyError("killed")))
        with pytest.raises(KeyError):
            store.append(slots(spark, batches[1]), "1")
        monkeypatch.undo()
    else:  # files of a batch that got no further
        slots(spark, {"a": ("x", 11, range(5, 7))}).write.parquet(f"{tmp_path}/{dies}/batch=1")
    again = SlotStore(spark, str(tmp_path), "e double", chunk_slots=4)
    assert held(again) == before and done(again) == {"a": 4}
    for i in (1, 2):
        again.append(slots(spark, batches[i]), str(i))
    assert held(again) == {"a": list(range(11)), "b": [0, 1, 2, 3]} and done(again) == {"a": 11, "b": 4}


@pytest.mark.parametrize("kind", ["means", "pairs"])
@pytest.mark.parametrize("cuts", [[30], [1, 7, 8, 30], [5, 10, 15, 20, 25, 30]])
def test_silent_tracks_are_flushed(spark, tmp_path, kind, cuts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime.datetime(2024, 1, 1)
    sizes = {"a": 30, "b": 13, "c": 16, "d": 1}
    rows = [(key, f, (f * 7 % 11) / 10, start + datetime.timedelta(seconds=f)) for key, n in sizes.items() for f in range(n)]
    t = spark.createDataFrame(rows, "video_id string, frame long, pos double, ts timestamp")
    low = 0
    for i, high in enumerate(cuts):
        t.where(f"frame >= {low} and frame < {high}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        low = high
    # much later frames of another track move event time on, and its own last one stays open
    spark.createDataFrame([("z", 0, 0.5, start + datetime.timedelta(hours=h)) for h in (1,)], t.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{len(cuts)}")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    made = silent.windowed_means(stream, 8, "ts", 60) if kind == "means" else silent.interleaved(stream, "ts", 60)
    q = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("video_id <> 'z'").collect()))
    if kind == "pairs":
        assert got == sorted(map(tuple, sequences.interleave(t, "pos").select("video_id", "frame", "pos").collect()))
    else:
        padded = (F.sum("pos") + (8 - F.count("*")) * F.max_by("pos", "frame")) / 8
        wanted = sorted(map(tuple, t.groupBy("video_id", F.floor(F.col("frame") / 8).alias("slot")).agg(padded.alias("value")).collect()))
        assert [r[:2] for r in got] == [r[:2] for r in wanted] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, wanted))


def test_cover_against_all_pairs(spark):
    import random

    r = random.Random(3)
    clips = [(r.randrange(2), f"p{i}", lo, lo + r.choice([0, 1, 2, 3, 8, 9, 50, 10**9])) for i in range(80) for lo in [r.randrange(-60, 60)]]
    asks = sorted({(r.randrange(2), lo, lo + r.randrange(1, 20)) for _ in range(150) for lo in [r.randrange(-60, 90)]})
    got = relational.smallest_cover(spark.createDataFrame(asks, "id int, lo long, hi long"), spark.createDataFrame(clips, "id int, path string, clip_lo long, clip_hi long"), "id")
    wanted = []
    for key, lo, hi in asks:
        best = min(((b - a, p) for k, p, a, b in clips if k == key and a <= lo and b >= hi), default=None)
        if best:
            wanted.append((key, lo, hi, best[1], best[0]))
    assert sorted(map(tuple, got.select("id", "lo", "hi", "path", "span").collect())) == wanted


def test_failures_stay_with_their_group(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -1.0), ("c", None), ("d", 5.0)], "video_id string, x double")

    def make(part):
        if (part["x"] < 0).any():
            raise ValueError("below zero " + "!" * 1000)
        return part.assign(y=part["x"] * 2, n=len(part))[["y", "n"]].dropna()

    groups = relational.isolated(rows, ["video_id"], make, "y double, n int").cache()
    assert {(r.video_id, r.status, len(r.rows)) for r in groups.collect()} == {("a", "done", 2), ("b", "failed", 0), ("c", "done", 0), ("d", "done", 1)}
    good, bad = relational.parted(groups, ["video_id"])
    assert sorted(map(tuple, good.collect())) == [("a", 2.0, 2), ("a", 4.0, 2), ("d", 10.0, 1)]
    letter = bad.first()
    assert letter.video_id == "b" and letter.error.startswith("ValueError: below zero !") and len(letter.error) == relational.MESSAGE
