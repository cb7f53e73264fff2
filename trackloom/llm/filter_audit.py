"""Audit of how filters overlap: what each filter removes, alone and behind others, in every order of application.

A document's failures are a mask of five bits. Four filters look at the text alone; the fifth fails copies of a text
with a smaller doc_id. Copies are found by a fingerprint-routed RDD: rows whose fingerprint more than one doc_id has
are partitioned by it, each partition keeps chains of (full text, least id) by fingerprint, and ids above the least are
emitted. A task gives only its own least id of a text onward, so a hot text moves once a task. All counts follow from
the number of documents a mask, so `combineByKey` merges vectors of mask counts a part, and orders are never run one by
one.

Edge cases: null text and null source count as empty; a document without a label is neither good nor toxic, and one with
several labels has each that any of them gives; a null doc_id neither fails as a copy nor makes one; rows that share
their doc_id and text are no copies of one another, but each counts; an empty table gives no rows; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import shared

# The filters' bounds and the characters that the fourth one looks for.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
MASKS = 1 << len(FILTERS)
#: bytes of text that a partition of the routed RDD is sized for, and parts a task counts before it gives them on
CHAIN_BYTES, HELD_PARTS = 32_000_000, 10_000


def _of_text(values: pa.Array) -> np.ndarray:
    """The bits of the four filters that look at one text. Words are split as bytes, whose white space is the contract's."""
    points = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    bits = 8 * pc.match_substring_regex(values, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.uint8)
    for i, value in enumerate(values):
        data = value.as_buffer()
        words = bytes(data).split()
        bits[i] += (len(words) < MIN_WORDS) + 2 * (100 * len(set(words)) < MIN_DISTINCT * len(words))
        capitals = int(np.count_nonzero(np.frombuffer(data, np.uint8) - np.uint8(65) < 26))
        bits[i] += 4 * (100 * capitals > MAX_CAPITALS * points[i])
    return bits


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, print, mask): a row a document, with the bits of all filters but the one for copies."""
    kind = shared.kind_of(docs, "doc_id")

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_of_text(batch.column(3)), pa.int8())], ["doc_id", "part", "print", "mask"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("print"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, part string, print long, mask byte")


def _chained(pairs: Iterator[tuple[int, str, object]], chains: dict) -> Iterator[object]:
    """Adds (print, text, id) to chains of [text, least id] by fingerprint; gives the ids that are not the least, with their fingerprint."""
    for key, text, doc_id in pairs:
        chain = chains.setdefault(key, [])
        link = next((x for x in chain if x[0] == text), None)
        if link is None:
            chain.append([text, doc_id])
        elif doc_id != link[1]:
            yield max(doc_id, link[1]), key
            link[1] = min(doc_id, link[1])


def _own_chains(rows: Iterator) -> Iterator[tuple]:
    """A task's own chains: ids above the least keep their id as the key, so that they spread; the least go by fingerprint with their text."""
    chains: dict = {}
    for lost, key in _chained(((r[0], r[2], r[1]) for r in rows), chains):
        yield (hash(lost), False), (lost, key, None)
    for key, chain in chains.items():
        for text, least in chain:
            yield (key, True), (least, key, text)


def _met_chains(pairs: Iterator[tuple]) -> Iterator[tuple]:
    chains: dict = {}

    def routed() -> Iterator[tuple]:
        for (_, least), (doc_id, key, text) in pairs:
            if least:
                yield from _chained([(key, text, doc_id)], chains)
            else:
                yield doc_id, key

    return routed()


def _route(key: tuple[int, bool]) -> int:
    return key[0]


def copies(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, print) of the documents whose text a smaller doc_id has; `prints` is the staged table of text_masks."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    shared_prints = prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("print")
    met = shared.staged(shared_prints, "shared_prints")
    hashed = docs.where("doc_id is not null").select(F.xxhash64(text).alias("print"), "doc_id", text.alias("text"))
    rows = hashed.join(shared.sized(met), "print", "left_semi").select("print", "doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // CHAIN_BYTES)
    lost: RDD = rows.rdd.mapPartitions(_own_chains).partitionBy(parts, _route).mapPartitions(_met_chains)
    return spark.createDataFrame(lost, f"doc_id {shared.kind_of(docs, 'doc_id')}, print long", verifySchema=False).distinct()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, vector): documents, good and toxic ones a mask, as 64-bit integers."""
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["part", "vector"])
        held.clear()
        return found

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        mask, good, toxic = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
        where = parts.indices.to_numpy(zero_copy_only=False) * MASKS + mask
        size = len(parts.dictionary) * MASKS
        counts = np.stack([np.bincount(where, w, size).astype(np.int64).reshape(-1, MASKS) for w in (None, good, toxic)], 1) if batch.num_rows else []
        for part, vector in zip(parts.dictionary.to_pylist(), counts, strict=True):
            held[part] = held[part] + vector if part in held else vector
        if len(held) >= HELD_PARTS:
            yield out()
    if held:
        yield out()


def _reports(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """A row for each order of the filters and step in it."""
    masks = np.arange(MASKS)
    every, good, toxic = vector
    steps = {}
    for bit in range(len(FILTERS)):
        for before in (b for b in range(MASKS) if not b >> bit & 1):
            fails, earlier = masks >> bit & 1 == 1, masks & before != 0
            here = fails & ~earlier
            steps[bit, before] = [int(x) for x in (every[~fails & ~earlier].sum(), every[here].sum(), every[fails & earlier].sum(), every[1 << bit], good[here].sum(), toxic[here].sum())]
    orders = [(order, [(bit, sum(1 << b for b in order[:k])) for k, bit in enumerate(order)]) for order in permutations(range(len(FILTERS)))]
    shapley = {bit: sum(steps[at][1] for _, walk in orders for at in walk if at[0] == bit) for bit in range(len(FILTERS))}
    for order, walk in orders:
        name = "".join(FILTERS[b] for b in order)
        for step, at in enumerate(walk, 1):
            yield part, name, step, *steps[at], shapley[at[0]]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of docs (doc_id, text, source) with labels (doc_id, quality, toxic): a row a part, order and step."""
    spark = docs.sparkSession
    prints = shared.staged(text_masks(docs), "text_masks")
    lost = shared.staged(copies(docs, prints), "copies")
    flags = labels.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    mask = (F.col("mask") + F.when(F.col("copy"), 16).otherwise(0)).cast("int")
    marked = prints.join(lost.withColumn("copy", F.lit(True)), ["doc_id", "print"], "left").join(flags, "doc_id", "left")
    counted = marked.select("part", mask.alias("mask"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")]).mapInArrow(_vectors, "part string, vector binary")

    def vector(row) -> tuple[str, np.ndarray]:
        return row[0], np.frombuffer(bytes(row[1]), np.int64).reshape(3, MASKS)

    add = np.add
    merged = counted.rdd.map(vector).combineByKey(lambda v: v, lambda a, b: add(a, b), lambda a, b: add(a, b), int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return spark.createDataFrame(merged.flatMap(lambda x: _reports(*x)), schema, verifySchema=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(docs, shared.table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
          w.doc_id > min(w.doc_id) OVER (PARTITION BY text)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c1.i, d1.i, e.i] AS o FROM k a, k b, k c1, k d1, k e
  WHERE len(list_distinct([a.i, b.i, c1.i, d1.i, e.i])) = 5),
r AS (
  SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, k.i AS step, o[k.i] AS f,
         n, good, toxic, fails[o[k.i]] AS here, len(list_filter(o[1:k.i - 1], lambda x: fails[x])) > 0 AS earlier,
         len(list_filter(fails, lambda x: x)) AS total
  FROM c, o, k),
s AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (here AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (here AND earlier), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (here AND total = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (here AND NOT earlier), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (here AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM s
"""
