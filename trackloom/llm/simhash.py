"""SimHash fingerprints, and a search by block tables.

A text's terms are its words and pairs of neighbouring words, weighted by 1 + log(count); each term's hash votes on
64 signed bits. The 64 bits are cut into b blocks, each the key of a table: two fingerprints within radius r differ by
at most r / b bits in one of them, so a query that looks up every key within r / b bits of its own finds every pair. A
pair that several tables would give is given by the first alone. Each query gets the distinct fingerprints found, each with its distance, its smallest doc_id and how many rows have it.

Edge cases: null or empty text has no terms and the fingerprint of zeros; equal texts share a fingerprint and are
searched once, and any number of copies is one entry of a list; texts of any length are fingerprinted whole; equal doc_ids
are ordered by text; a null doc_id comes last; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm import shared

RADIUS, SEARCH_RADIUS, BLOCKS, QUERY_MODULUS = 3, 11, 4, 100
HOT_KEY = 1000
CACHE_WORDS = 200_000


class Fingerprinter:
    """Words' 64-bit hashes are cached; the bits' votes are summed in numpy."""

    def __init__(self):
        import xxhash

        self.digest, self.known = xxhash.xxh3_64_intdigest, {}

    def _hash(self, word: str) -> int:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        h = self.known[word] = self.digest(word)
        return h

    def words(self, text: str) -> np.ndarray:
        known, make = self.known, self._hash
        words = text.split()
        return np.fromiter((known[w] if w in known else make(w) for w in words), np.uint64, len(words))

    @staticmethod
    def fingerprint(words: np.ndarray) -> int:
        if not len(words):
            return 0
        mixed = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + (words[1:] ^ (words[1:] >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        terms, counts = np.unique(np.concatenate([words, mixed * np.uint64(0xBF58476D1CE4E5B9)]), return_counts=True)
        weights = (1 + np.log(counts)).astype(np.float32)
        votes = np.zeros(64, np.float64)
        for at in range(0, len(terms), 65_536):
            bits = np.unpackbits(terms[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += weights[at : at + 65_536] @ bits
        return int.from_bytes(np.packbits(2 * votes > weights.sum(dtype=np.float64), bitorder="little").tobytes(), "little")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = {"kind": pa.int8(), "part": pa.int32(), "doc_id": None, "text": pa.string(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next document, in descending doc_id.

    Documents are dealt by ranges of doc_id, so each but a range's last meets its successor in its own task; the
    ranges' last and first rows are joined afterwards, two rows a range.
    """
    kind = shared.kind_of(docs, "doc_id")

    def rows_of(pairs, print_of: Fingerprinter):
        for doc_id, text, words, nxt, nxt_words in pairs:
            edited = _edited(text, nxt)
            a, b, c = (print_of.fingerprint(w) for w in (words, print_of.words(edited), nxt_words))
            yield 0, None, doc_id, None, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", likeness(a, b), likeness(a, c)

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, print_of = TaskContext.get().partitionId(), Fingerprinter()
        kinds = None

        def rows():
            nonlocal kinds
            before = None
            for batch in batches:
                kinds = kinds or (_ROW | {"doc_id": batch.schema.field(0).type})
                for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = value.as_py() or ""
                    here = (doc_id, text, print_of.words(text))
                    if before is None:
                        yield 1, part, doc_id, text, *[None] * 6
                    else:
                        yield from rows_of([(*before, text, here[2])], print_of)
                    before = here
            if before is not None:
                yield 2, part, before[0], before[1], *[None] * 6

        source = rows()
        first = next(source, None)
        if first is not None:
            from itertools import chain

            yield from shared.arrow_rows(chain([first], source), kinds)

    schema = f"kind byte, part int, doc_id {kind}, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    order = [F.col("doc_id").desc_nulls_last()]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").desc_nulls_last())
    done = shared.staged(dealt.mapInArrow(run, schema), "prints")

    # two rows a range: its last document follows on to the next range's first, the last range's to the first one's
    heads, tails = (done.where(F.col("kind") == k).select("part", "doc_id", "text") for k in (1, 2))
    ring = Window.orderBy("part")
    parts = heads.select("part").withColumn("next", F.coalesce(F.lead("part").over(ring), F.first("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ends = tails.join(parts, "part").select(F.col("next").alias("part"), "doc_id", "text").join(heads.select("part", F.col("text").alias("following")), "part")

    @shared.trimming
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        print_of = Fingerprinter()
        for batch in batches:
            ids, texts, nexts = (batch.column(i).to_pylist() for i in range(3))
            pairs = [(i, a, print_of.words(a), b, print_of.words(b)) for i, a, b in zip(ids, texts, nexts, strict=True)]
            yield from shared.arrow_rows(rows_of(pairs, print_of), _ROW | {"doc_id": batch.schema.field(0).type})

    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    last = ends.select("doc_id", "text", "following").mapInArrow(finish, schema)
    return done.where("kind = 0").select(*columns).unionByName(last.select(*columns))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probes(width: int, bits: int) -> list[int]:
    """What turns a block's value into each value at most `bits` bits away."""
    return [sum(1 << i for i in c) for n in range(bits + 1) for c in combinations(range(width), n)]


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(q, p, distance): for each fingerprint of `queries` (q long) all of `prints` (p long) within the radius; both distinct."""
    width, bits = 64 // blocks, radius // blocks
    ones = (1 << width) - 1

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.shiftrightunsigned(name, i * width).bitwiseAND(F.lit(ones)).alias("key")) for i in range(blocks)])
        return df.select(name, F.explode(keys).alias("k")).select(name, "k.*")

    held = keyed(prints, "p")
    # a key that many fingerprints share is dealt over parts, and its queries are repeated for each
    hot = shared.staged(held.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY).select("t", "key", F.ceil(F.col("n") / HOT_KEY).cast("int").alias("parts")), "hot_keys")
    few = shared.sized(hot)
    parts = F.coalesce("parts", F.lit(1))
    b = held.join(few, ["t", "key"], "left").select("p", "t", "key", F.pmod(F.xxhash64("p"), parts).cast("int").alias("part"))
    probes = F.explode(F.array(*map(F.lit, map(_signed, _probes(width, bits)))))
    asked = keyed(queries, "q").withColumn("probe", probes).select("q", "t", F.col("key").bitwiseXOR(F.col("probe").cast("long")).alias("key"))
    a = asked.join(few, ["t", "key"], "left").select("q", "t", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

    apart = F.col("q").bitwiseXOR(F.col("p"))
    first: Column = F.lit(blocks)
    for i in reversed(range(blocks)):
        first = F.when(F.bit_count(apart.bitwiseAND(F.lit(_signed(ones << i * width)))) <= bits, i).otherwise(first)
    a, b = a.alias("a"), b.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("t", "key", "part")]
    # a table is many times its fingerprints' size, which Spark's estimate leaves out: so never broadcast
    met = a.hint("merge").join(b, same[0] & same[1] & same[2] & (F.bit_count(apart) <= radius) & (first == F.col("a.t")))
    return met.select("q", "p", F.bit_count(apart).alias("distance"))


def near_prints(rows: DataFrame, queries: Column, radius: int = SEARCH_RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, near): for the fingerprints of the rows that are queries, those of all rows within the radius, the nearest first.

    An entry stands for all rows that share a fingerprint: its distance, their smallest doc_id, their number and the
    fingerprint, by which the rows themselves tell who belongs to it. So copies add to a number, not to a list.
    """
    as_long = F.conv(F.col("fingerprint"), 16, -10).cast("long").alias("p")
    counted = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"), F.max(queries).alias("asked"))
    prints = shared.staged(counted.select(as_long, "doc_id", "n_rows", "asked", "fingerprint"), "distinct_prints")
    found = within(prints.select("p"), prints.where("asked").select(F.col("p").alias("q")), radius, blocks)
    entry = F.struct("distance", "doc_id", "n_rows", "fingerprint")
    lists = found.join(prints.drop("asked"), "p").groupBy("q").agg(F.sort_array(F.collect_list(entry)).alias("near"))
    return lists.select(F.lower(F.lpad(F.hex("q"), 16, "0")).alias("fingerprint"), "near")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.staged(fingerprints(shared.table(spark, sf_dir, "documents").select("doc_id", "text")), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % QUERY_MODULUS == 0, F.lit(False))
    close = F.aggregate(F.filter("near", lambda x: x["distance"] <= RADIUS), F.lit(0).cast("long"), lambda n, x: n + x["n_rows"])
    met = rows.where(asked).join(near_prints(rows, asked), "fingerprint").select(*rows.columns, close.alias("n_within_3"), "near")
    nothing = [F.lit(None).cast(met.schema[c].dataType).alias(c) for c in ("n_within_3", "near")]
    return met.unionByName(rows.where(~asked).select(*rows.columns, *nothing))
