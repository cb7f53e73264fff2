"""Scans over long tracks, spread over tasks.

A track is packed into chunks, one row with arrays a chunk. What an order-bound operator carries from sample to sample
is summed up for a chunk in a few numbers; a track's summaries (a row for 65,536 samples) are folded in order, which
gives each chunk what enters it from both sides; then every chunk is finished by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.schema import FRAME, KEY

CHUNK_FRAMES = 65_536
#: bytes of an output batch
BATCH_BYTES = 8 << 20

_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}


def chunk_of(frame: Column | str, size: int = CHUNK_FRAMES) -> Column:
    return F.floor((F.col(frame) if isinstance(frame, str) else frame) / size)


def packed(track: DataFrame, columns: list[str], size: int = CHUNK_FRAMES) -> DataFrame:
    """(video_id, chunk, frame array, an array a column), in order of frame."""
    items = F.sort_array(F.collect_list(F.struct(F.col(FRAME).cast("long").alias(FRAME), *[F.col(c).cast("double").alias(c) for c in columns])))
    dealt = track.groupBy(KEY, chunk_of(FRAME, size).alias("chunk")).agg(items.alias("_s"))
    return dealt.select(KEY, "chunk", *[F.col(f"_s.{c}").alias(c) for c in (FRAME, *columns)])


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column as arrays; nulls within are NaN."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield flat[a:b]


def each(chunks: DataFrame, columns: list[str], make: Callable[..., dict], kinds: dict[str, str], rows: bool = True) -> DataFrame:
    """make(*arrays) for each chunk's columns gives its columns: a row a sample, or with rows=False one row (video_id, chunk, ...) of arrays."""
    fields = {KEY: pa.string()} | ({} if rows else {"chunk": pa.int64()}) | {c: _KINDS[k] for c, k in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, number, *arrays in zip(keys, numbers, *(_arrays(c) for c in batch.columns[2:]), strict=True):
                made = make(*arrays)
                if rows:
                    n = len(next(iter(made.values())))
                    step = max(1, BATCH_BYTES // (16 * len(fields)))
                    for at in range(0, n, step):
                        part = {c: v[at : at + step] for c, v in made.items()}
                        size = min(step, n - at)
                        yield pa.RecordBatch.from_arrays([pa.array([key] * size, pa.string()), *(pa.array(part[c], _KINDS[k], from_pandas=True) for c, k in kinds.items())], list(fields))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([number], pa.int64()), *(pa.array([made[c]], _KINDS[k]) for c, k in kinds.items())], list(fields))

    schema = ", ".join([f"{KEY} string"] + ([] if rows else ["chunk long"]) + [f"{c} {k}" for c, k in kinds.items()])
    return chunks.select(KEY, "chunk", *columns).mapInArrow(run, schema)


def folded(summaries: DataFrame, fold: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(video_id, chunk, carry) of summaries (video_id, chunk, summary): fold takes a track's summaries in order, a line a chunk, and gives as many lines."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk")
        return pd.DataFrame({KEY: part[KEY], "chunk": part["chunk"], "carry": list(fold(np.stack(part["summary"].to_list())))})

    return summaries.groupBy(KEY).applyInPandas(run, f"{KEY} string, chunk long, carry array<double>")


def scan(chunks: DataFrame, columns: list[str], summarise: Callable, fold: Callable, finish: Callable, kinds: dict[str, str], rows: bool = True) -> DataFrame:
    """finish(*arrays, carry) a chunk, where fold has made the carries of the chunks' summaries summarise(*arrays)."""
    summaries = each(chunks, columns, lambda *a: {"summary": summarise(*a)}, {"summary": "array<double>"}, rows=False)
    met = chunks.join(folded(summaries, fold), [KEY, "chunk"])
    return each(met, [*columns, "carry"], finish, kinds, rows)


def by_size(track: DataFrame, size: int, short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """short(rows) for the tracks that one chunk holds, which one call a track does, and long(rows), a scan, for the others. Both give the same."""
    keys = track.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") > size).select(KEY)
    if keys.isEmpty():
        return short(track)
    return short(track.join(keys, KEY, "left_anti")).unionByName(long(track.join(keys, KEY, "left_semi")))


def each_track(track: DataFrame, columns: list[str], schema: str, make: Callable[..., dict]) -> DataFrame:
    """make(frames, *arrays) -> columns, for each whole track in order of frame: for tracks of at most a chunk."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(FRAME)
        out = pd.DataFrame(make(part[FRAME].to_numpy(), *(part[c].to_numpy(np.float64) for c in columns)))
        out.insert(0, KEY, part[KEY].iloc[0])
        return out

    return track.select(KEY, FRAME, *columns).groupBy(KEY).applyInPandas(run, f"{KEY} string, {schema}")
