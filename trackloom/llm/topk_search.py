"""Exact top-k search by inner product: columnar branch and bound.

Vectors are quantised to integers. Queries come in slabs of bounded size; each slab is broadcast and meets every row in
one scan without a shuffle of rows. In a task rows stand in blocks in vertical layout, a dimension a line, the slab's
heaviest dimensions first. A query adds up a block's scores some dimensions at a time; what the remaining dimensions can
still add is at most the product of the remaining masses (lengths) of both vectors, so rows that can no longer reach the
k-th best score leave, and the block is compacted to the survivors. The first bounds come from the slab's own queries,
which are rows too. Only a task's best k rows a query move on to the final ranking.

Edge cases: vectors that are null, hold null or non-finite components (or such as are not finite times the scale) take
no part; shorter vectors count as filled up with zeros; scores are exact, by Python integers where doubles would not be,
and beyond 64 bits they count as the largest or smallest long; rows that repeat are rows of their own, so a query
whose id repeats is answered for each of its rows and only its own row is left out; ties go to the smaller vec_id, a
null vec_id last; a query row's null id is no query; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm import shared

SCALE, TOP, QUERY_MODULUS = 1024, 10, 100
#: bytes of the queries that are broadcast at once, rows of a block in vertical layout, dimensions that are added at once
SLAB_BYTES, BLOCK_ROWS, STEP = 16_000_000, 8_192, 8
#: products and sums of integers below this are exact in doubles
EXACT = float(1 << 52)
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v): a number a row and the integers floor(scale * x) as doubles, of the vectors that take part."""
    v = F.transform("embedding", lambda x: _floor(x.cast("double") * scale))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & whole).select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v"))


def _floor(x: Column) -> Column:
    """floor as a double; doubles from 2^52 on are whole, and as longs they could overflow."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists as lines of `dims` numbers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    starts = np.cumsum(sizes) - sizes
    for i, (at, n) in enumerate(zip(starts, sizes, strict=True)):
        n = min(int(n), dims)  # what lies beyond the queries' dimensions meets zeros only
        out[i, :n] = flat[at : at + n]
    return out


class Best:
    """The best k of the rows seen, by score and then by smaller id; null ids last."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor, self.held = k, floor, []

    def add(self, scores: list, ids: list) -> None:
        self.held += [(-s, i is None, i or 0) for s, i in zip(scores, ids, strict=True)]
        self.held = sorted(self.held)[: self.k]
        if len(self.held) == self.k:
            self.floor = max(self.floor, -self.held[-1][0])


class Slab:
    """Queries with their dimensions in order of mass, and what they have found."""

    def __init__(self, rows: np.ndarray, matrix: np.ndarray, k: int):
        self.rows, self.k = rows, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.order = np.argsort(-(matrix**2).sum(0), kind="stable")
        self.matrix = np.ascontiguousarray(matrix[:, self.order])
        self.largest = float(np.abs(matrix).max(initial=0))
        self.cuts = [*range(0, matrix.shape[1], STEP), matrix.shape[1]]
        self.left = self._masses(self.matrix.T).T
        self.found = [Best(k, -np.inf) for _ in rows]
        if self.largest**2 * max(1, matrix.shape[1]) < EXACT:
            self._first_bounds()

    def _masses(self, columns: np.ndarray) -> np.ndarray:
        """For each cut the length of what the dimensions from it on hold, a line a cut."""
        squares = [(columns[a:b] ** 2).sum(0) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        sums = np.cumsum(np.stack([*squares[::-1]]), 0)[::-1] if squares else np.zeros((0, columns.shape[1]))
        return np.sqrt(np.vstack([sums, np.zeros((1, columns.shape[1]))]))

    def _first_bounds(self) -> None:
        if len(self.rows) <= self.k:
            return
        for at in range(0, len(self.rows), 512):
            scores = self.matrix[at : at + 512] @ self.matrix.T
            scores[np.arange(len(scores)), at + np.arange(len(scores))] = -np.inf  # its own row
            for query, line in zip(self.found[at : at + 512], np.partition(scores, -self.k, 1)[:, -self.k], strict=True):
                query.floor = float(line)

    def meet(self, rows: np.ndarray, ids: list, matrix: np.ndarray) -> None:
        """One block of rows against every query."""
        largest = float(np.abs(matrix).max(initial=0))
        if self.largest * largest * max(1, matrix.shape[1]) >= EXACT:
            self._meet_exactly(rows, ids, matrix)
            return
        columns = np.ascontiguousarray(matrix.T[self.order])
        masses = self._masses(columns)
        for q, query in enumerate(self.found):
            left, score, floor = np.arange(len(rows)), np.zeros(len(rows)), query.floor
            block, reach = columns, masses
            for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
                score = score + self.matrix[q, a:b] @ block[a:b]
                # bounds are doubles: the half outweighs their rounding, as scores are whole
                stay = score + self.left[q, i + 1] * reach[i + 1] * (1 + 1e-9) + 0.5 >= floor
                if 2 * np.count_nonzero(stay) < len(stay) or b == self.cuts[-1]:
                    left, score = left[stay], score[stay]
                    block, reach = block[:, stay] if b < self.cuts[-1] else block, reach[:, stay]
                if not len(left):
                    break
            keep = np.flatnonzero((score >= floor) & (rows[left] != self.rows[q]))
            if len(keep) > 4 * self.k:  # ties of the k-th score stay in
                keep = keep[score[keep] >= np.partition(score[keep], -self.k)[-self.k]]
            if len(keep):
                query.add([int(s) for s in score[keep]], [ids[j] for j in left[keep]])

    def _meet_exactly(self, rows: np.ndarray, ids: list, matrix: np.ndarray) -> None:
        """The same for numbers too large for doubles: whole sums of Python integers."""
        whole = [[int(x) for x in line] for line in matrix[:, self.order]]
        for q, query in enumerate(self.found):
            asked = [int(x) for x in self.matrix[q]]
            others = [j for j, row in enumerate(rows) if row != self.rows[q]]
            query.add([max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(asked, whole[j], strict=True)))) for j in others], [ids[j] for j in others])


def _slabs(queries: DataFrame, slab_bytes: int) -> Iterator[DataFrame]:
    """Queries dealt by hash into as many slabs as give each about this many bytes."""
    most = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not most[0]:
        return
    dims = max(1, most[1])
    slabs = -(-most[0] * dims * 8 // slab_bytes)
    for i in range(slabs):
        yield queries.where(F.pmod(F.xxhash64("row"), F.lit(slabs)) == i) if slabs > 1 else queries


def top_k(vectors: DataFrame, queries: Column, k: int = TOP, scale: int = SCALE, slab_bytes: int = SLAB_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of vectors (vec_id, embedding) for which `queries` holds, against all rows."""
    spark = vectors.sparkSession
    kind = shared.kind_of(vectors, "vec_id")
    held = shared.staged(quantised(vectors, scale), "quantised")
    asked = shared.staged(held.where(F.col("vec_id").isNotNull() & queries), "queries")
    found = []
    for slab in _slabs(asked, slab_bytes):
        arrow = slab.select("row", "v").toArrow().combine_chunks()
        lists = arrow.column(1).combine_chunks() if arrow.num_rows else pa.array([], pa.list_(pa.float64()))
        dims = max(1, int(np.diff(lists.offsets.to_numpy()).max(initial=1)))
        sent = spark.sparkContext.broadcast((arrow.column(0).to_numpy(), _matrix(lists, dims)))

        @shared.trimming
        def run(batches: Iterator[pa.RecordBatch], sent=sent, dims=dims) -> Iterator[pa.RecordBatch]:
            slab, waiting, n = None, [], 0

            def block() -> None:
                nonlocal slab, waiting, n
                slab = slab or Slab(*sent.value, k)
                slab.meet(np.concatenate([w[0] for w in waiting]), [i for w in waiting for i in w[1]], np.concatenate([w[2] for w in waiting]))
                waiting, n = [], 0

            id_kind = None
            for batch in batches:
                id_kind = batch.schema.field(1).type
                waiting.append((batch.column(0).to_numpy(), batch.column(1).to_pylist(), _matrix(batch.column(2), dims)))
                n += batch.num_rows
                if n >= block_rows:
                    block()
            if n:
                block()
            if slab:
                rows = ((int(row), None if none else i, -s) for row, query in zip(slab.rows, slab.found, strict=True) for s, none, i in query.held)
                yield from shared.arrow_rows(rows, {"row": pa.int64(), "vec_id": id_kind, "score": pa.int64()})

        found.append(held.select("row", "vec_id", "v").mapInArrow(run, f"row long, vec_id {kind}, score long"))
    if not found:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    if len(found) > 1:
        found = [shared.staged(x, "slab_best") for x in found]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % QUERY_MODULUS == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.row AS q, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.row <> x.row),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
