"""Joins, lookups and keyed updates around tracks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from trackloom.schema import FRAME, KEY


def without(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "left_anti")


def not_under(paths: DataFrame, excluded: list[str], path: str = "path") -> DataFrame:
    """Rows under none of the folders; `a/b` isn't under `a/bc`."""
    keep = F.lit(True)
    for folder in excluded:
        keep = keep & ~F.startswith(F.col(path), F.lit(folder.rstrip("/") + "/"))
    return paths.where(keep)


#: a cell has 2**CELL frames at least, and a clip stands in 2**SPREAD + 1 cells at most
CELL, SPREAD = 13, 3


def first_cover(lo: np.ndarray, hi: np.ndarray, clip_lo: np.ndarray, clip_hi: np.ndarray) -> np.ndarray:
    """For each request [lo, hi) the place of the first clip that covers it, -1 where none does.

    A request goes down a binary tree over the clips' places, to the first half where that holds a cover, else to the
    second. A half holds one if, of its clips that start early enough, the latest end is late enough: a search in its
    starts and a running maximum. So the work is near the number of requests and clips, without their pairs.
    """
    found = np.zeros(len(lo), np.int64)
    if not len(clip_lo) or not len(lo):
        return found - 1
    starts, start = np.unique(clip_lo, return_inverse=True)
    ends, end = np.unique(clip_hi, return_inverse=True)
    early, late = np.searchsorted(starts, lo, "right"), np.searchsorted(ends, hi)
    place = np.arange(len(clip_lo))

    def covered(node: np.ndarray, width: int) -> np.ndarray:
        own = place // width
        key = own * (len(starts) + 1) + start
        order = np.argsort(key, kind="stable")
        latest = np.append(-1, np.maximum.accumulate((own * (len(ends) + 1) + end)[order]))
        return latest[np.searchsorted(key[order], node * (len(starts) + 1) + early)] >= node * (len(ends) + 1) + late

    width = 1 << (len(place) - 1).bit_length()
    some = covered(found, width)
    while width > 1:
        width //= 2
        found = 2 * found + ~covered(2 * found, width)
    return np.where(some, found, -1)


def smallest_cover(requests: DataFrame, clips: DataFrame, identity: str) -> DataFrame:
    """For each distinct request [lo, hi) the shortest clip that covers it, of equals the first by path; none, no row.

    Requests and clips meet once, in cells of an identity's frames: a request lies in the cell of its start, a clip in
    all that it touches. Cells of 8,192 frames serve clips of up to 65,536; longer clips stand in larger cells, by
    powers of two, which requests look up as well only where there are such clips.
    """
    size = F.col("clip_hi") - F.col("clip_lo")
    level = F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))
    sized = clips.where(size > 0).select(F.col(identity).alias("_id"), F.greatest(F.lit(CELL), level - SPREAD).cast("int").alias("_unit"), "clip_lo", "clip_hi", size.alias("span"), "path").where("_id is not null")
    held = sized.withColumn("_cell", F.explode(F.sequence(F.expr("shiftright(clip_lo, _unit)"), F.expr("shiftright(clip_hi - 1, _unit)"))))
    units = sized.agg(F.collect_set("_unit").alias("_units"))
    asked = requests.where(F.col(identity).isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull()).crossJoin(F.broadcast(units))
    asked = asked.withColumn("_unit", F.explode("_units")).drop("_units").withColumn("_id", F.col(identity)).withColumn("_cell", F.expr("shiftright(lo, _unit)"))
    keys, own = ["_id", "_unit", "_cell"], requests.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("span", "ascending"), ("path", "ascending")], null_placement="at_start"))
        numbers = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        k = first_cover(numbers(left, "lo"), numbers(left, "hi"), numbers(right, "clip_lo"), numbers(right, "clip_hi"))
        hit = np.flatnonzero(k >= 0)
        of = right.take(pa.array(k[hit]))
        return left.select(own).take(pa.array(hit)).append_column("span", of.column("span")).append_column("path", of.column("path"))

    schema = StructType([*requests.schema.fields, *held.select("span", "path").schema.fields])
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, schema)
    return met.groupBy(*requests.columns).agg(F.min(F.struct("span", "path")).alias("best")).select(*requests.columns, F.col("best.path").alias("path"), F.col("best.span").alias("span"))


def with_times(track: DataFrame, times: DataFrame, fps: float, start: float = 0.0) -> DataFrame:
    """Adds t: the source's times if it has one for every frame of the track, else the nominal ones."""
    met = track.join(times.select(KEY, FRAME, F.col("pts")), [KEY, FRAME], "left")
    whole = F.count("pts").over(Window.partitionBy(KEY)) == F.count("*").over(Window.partitionBy(KEY))
    return met.withColumn("t", F.when(whole, F.col("pts")).otherwise(F.col(FRAME) / fps + start)).drop("pts")


def lagged_similarity(vectors: DataFrame, low: int, high: int, slot: str = FRAME, vector: str = "e", temperature: float | None = None, block: int = 64) -> DataFrame:
    """(video_id, slot, lag, similarity): cosine of each slot with the one `lag` before it, low <= lag <= high.

    Slots are dealt by blocks; a vector moves once as itself and once for each block whose slots may ask for it (three
    for the usual band), and the pairs arise within a block. With a temperature every slot has all lags: similarity is
    multiplied by it, and a lag that leaves the track gives 0 and valid = false.
    """
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(F.array(length(F.col(vector))), lambda n: F.transform(vector, lambda x: x / F.greatest(n, F.lit(1e-12))))[0]
    units = vectors.select(KEY, F.col(slot).alias("s"), unit.alias("u"))
    of = lambda c: F.floor(c / block)
    left = units.withColumn("b", of(F.col("s")))
    right = units.select(KEY, F.col("s").alias("o"), F.col("u").alias("v"), F.explode(F.sequence(of(F.col("s") + low), of(F.col("s") + high))).alias("b"))
    lag = F.col("s") - F.col("o")
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    met = left.join(right, [KEY, "b"]).where((lag >= low) & (lag <= high)).select(KEY, F.col("s").alias(slot), lag.cast("int").alias("lag"), dot.alias("similarity"))
    if temperature is None:
        return met
    every = vectors.select(KEY, slot, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag"))
    both = every.join(met, [KEY, slot, "lag"], "left")
    return both.select(KEY, slot, "lag", (F.coalesce("similarity", F.lit(0.0)) * temperature).alias("similarity"), F.col("similarity").isNotNull().alias("valid"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def last_per(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def aligned_axes(main: DataFrame, axis: DataFrame) -> DataFrame:
    """(video_id, main_rows, axis_rows, complete): whether an axis has the main track's frames, all and only."""
    both = main.select(KEY, FRAME, F.lit(1).alias("m")).join(axis.select(KEY, FRAME, F.lit(1).alias("a")), [KEY, FRAME], "full_outer")
    return both.groupBy(KEY).agg(F.count("m").alias("main_rows"), F.count("a").alias("axis_rows"), F.bool_and(F.col("m").isNotNull() & F.col("a").isNotNull()).alias("complete"))


def first_free(names: DataFrame, taken: DataFrame, stem: str = "stem", number: str = "number", companions: list[DataFrame] = (), most: int | None = None) -> DataFrame:
    """(stem, number): the smallest number from 1 that neither the name nor a companion has taken; null beyond `most`."""
    w = Window.partitionBy(stem).orderBy(number)
    held = taken.select(stem, number)
    for other in companions:
        held = held.union(other.select(stem, number))
    held = held.distinct().where(F.col(number) >= 1).withColumn("k", F.row_number().over(w)).where(F.col("k") == F.col(number))
    run = held.groupBy(stem).agg(F.max("k").alias("run"))
    free = F.coalesce("run", F.lit(0)) + 1
    return names.select(stem).distinct().join(run, stem, "left").select(stem, (free if most is None else F.when(free <= most, free)).alias(number))


def uncovered(requests: DataFrame, covered: DataFrame) -> DataFrame:
    """The requests that no clip covers, to be built."""
    return requests.join(covered.select(*requests.columns), requests.columns, "left_anti")


def scripts_added(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, index, rel_path, script, active): a new script takes the place of the one with its path, or comes last; it becomes the active one.

    old has (project, index, rel_path, script), new one row (project, rel_path, script) a project.
    """
    asked = new.select("project", "rel_path", F.col("script").alias("fresh"))
    size = old.groupBy("project").agg(F.count("*").alias("n"))
    met = old.join(asked, ["project", "rel_path"], "left").select("project", "index", "rel_path", F.coalesce("fresh", "script").alias("script"), F.col("fresh").isNotNull().alias("active"))
    more = asked.join(old, ["project", "rel_path"], "left_anti").join(size, "project", "left").select("project", F.coalesce("n", F.lit(0)).cast("int").alias("index"), "rel_path", F.col("fresh").alias("script"), F.lit(True).alias("active"))
    return met.unionByName(more)


def pooled_grid(cells: DataFrame, levels: list[int], dims: int, halves: bool = False) -> DataFrame:
    """(video_id, slot, token, e): means over the parts of each level of a slot's grid, level by level and row by row.

    cells has (video_id, slot, y, x, height, width, e). A part's bounds are rounded outwards, so parts may overlap; with
    `halves` a level of two cuts at the integer half instead. A cell goes to its parts by its own place, without a join.
    """
    parts = []
    first = 0
    for k in levels:
        for i in range(k):
            for j in range(k):
                inside = F.lit(True)
                for at, size, n in (("y", "height", i), ("x", "width", j)):
                    low, high = (F.floor(F.col(size) * n / k), F.floor(F.col(size) * (n + 1) / k) if halves else F.ceil(F.col(size) * (n + 1) / k))
                    inside = inside & (F.col(at) >= low) & (F.col(at) < high)
                parts.append(F.when(inside, F.lit(first + i * k + j)))
        first += k * k
    dealt = cells.select(KEY, "slot", "e", F.explode(F.array_compact(F.array(*parts))).alias("token"))
    return dealt.groupBy(KEY, "slot", "token").agg(F.array(*(F.avg(F.get("e", F.lit(d))) for d in range(dims))).alias("e"))


def outcomes(rows: DataFrame, failed: Column) -> DataFrame:
    """(done, failed) of a batch whose rows carry their own status."""
    return rows.agg(F.count_if(~failed).alias("done"), F.count_if(failed).alias("failed"))


#: characters of a failure's message that are kept
MESSAGE = 500


def isolated(rows: DataFrame, keys: list[str], make: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """make on each group of rows, as a row (keys, status, error, rows) a group: a group that fails gives its error, not the job's end.

    status is done or failed, error the exception's type and message, rows an array of `schema` (empty where failed), all of
    it or nothing. Failures of Spark itself (a lost executor, no memory) are no group's and still retry.
    """
    names = [f.name for f in StructType.fromDDL(schema)]
    own = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        try:
            made, status, error = make(part)[names].to_dict("records"), "done", None
        except Exception as e:  # whatever a group's own data bring about
            made, status, error = [], "failed", f"{type(e).__name__}: {e}"[:MESSAGE]
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "status": [status], "error": [error], "rows": [made]})

    return rows.groupBy(*keys).applyInPandas(run, f"{own}, status string, error string, rows array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in StructType.fromDDL(schema))}>>")


def parted(groups: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of `isolated`: the rows of the groups that are done, and a dead letter (keys, error) for each other. Stage the groups first, or they run twice."""
    return groups.where("status = 'done'").select(*keys, F.inline("rows")), groups.where("status = 'failed'").select(*keys, "error")
