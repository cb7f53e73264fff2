"""A stream in any batches gives what one batch gives."""

import pytest

from trackloom.schema import tracks
from trackloom.streaming import slots


@pytest.mark.parametrize("make", [lambda s: slots.windowed_means(s, 16), slots.interleaved])
def test_batches_do_not_matter(spark, tmp_path, make):
    t = tracks(spark, "/root/testdata/sf0.001").select("video_id", "frame", "pos")
    results = []
    for cuts in ([10_000], [7, 50, 51, 10_000]):
        folder = tmp_path / f"in{len(cuts)}"
        low = 0
        for i, high in enumerate(cuts):
            t.where(f"frame >= {low} and frame < {high}").coalesce(1).write.parquet(f"{folder}/{i}")
            low = high
        stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
        out = str(tmp_path / f"out{len(cuts)}")
        q = make(stream).writeStream.foreachBatch(slots.append_once(out)).option("checkpointLocation", str(tmp_path / f"c{len(cuts)}")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        results.append(sorted(tuple(r)[:3] for r in spark.read.parquet(out).drop("batch").collect()))
    assert results[0] == results[1] and results[0]


@pytest.mark.parametrize("kind", ["means", "pairs"])
def test_a_stream_that_ends_gives_what_the_whole_track_gives(spark, tmp_path, kind):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from trackloom.operators import sequences

    t = tracks(spark, "/root/testdata/sf0.001").select("video_id", "frame", "pos")
    t = t.withColumn("last", F.col("frame") == F.max("frame").over(Window.partitionBy("video_id")))
    for i, (low, high) in enumerate(((0, 7), (7, 51), (51, 10_000))):
        t.where(f"frame >= {low} and frame < {high}").repartition(3).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    made = slots.windowed_means(stream, 16, last="last") if kind == "means" else slots.interleaved(stream, last="last")
    # files of one batch are three shuffled parts of a range, so frames of a track come in any order
    q = made.writeStream.foreachBatch(slots.append_once(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted(tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/out").drop("batch").collect())
    if kind == "pairs":
        assert got == sorted(map(tuple, sequences.interleave(t, "pos").select("video_id", "frame", "pos").collect()))
    else:
        padded = (F.sum("pos") + (16 - F.count("*")) * F.max_by("pos", "frame")) / 16
        wanted = sorted(map(tuple, t.groupBy("video_id", F.floor(F.col("frame") / 16).alias("slot")).agg(padded.alias("value")).collect()))
        assert [r[:2] for r in got] == [r[:2] for r in wanted] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, wanted))


def test_listing_keeps_to_prefixes(spark, tmp_path):
    import os

    from trackloom.sources import scripts

    for name in ("a/x/b/one.mp4", "x/two.mp4", "x/two.funscript", "y/three.mp4", "y2/four.mp4"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    os.makedirs(tmp_path / "dotted.x1/deep")
    for name in ("deep/five.mp4", "six.mp4", "six.funscript"):
        (tmp_path / "dotted.x1" / name).write_bytes(b"1")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(scripts.list_videos(spark, str(tmp_path / "dotted.x1"))) == ["five.mp4"]
    assert names(scripts.list_videos(spark, str(tmp_path), [f"{tmp_path}/y", f"{tmp_path}/dotted.x1"])) == ["four.mp4", "one.mp4"]
    assert names(scripts.list_videos(spark, str(tmp_path), [f"{tmp_path}/x", f"{tmp_path}/dotted.x1/"], again=True)) == ["four.mp4", "one.mp4", "three.mp4"]
    assert names(scripts.list_videos(spark, str(tmp_path / "x/two.mp4"), [str(tmp_path)])) == ["two.mp4"]
