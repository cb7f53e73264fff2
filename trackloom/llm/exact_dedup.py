"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after each run of white space became one space. Rows whose length is unique leave
first, rows whose (length, prefix hash) is unique next; only the surviving groups' full content is hashed.

Edge cases: null counts as empty; of equal texts the smallest doc_id stays, a null doc_id only if there is no other;
rows that tie on it all stand as kept in `groups` (they cannot be told apart), while `deduplicate` leaves one;
a text of any length is hashed whole; an empty table gives no rows; columns of the input may have any names but those beginning with `_xd_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import shared

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{shared.SPACE_CLASS}+", " ")


def hash_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _shape(docs: DataFrame, prefix_chars: int) -> DataFrame:
    """Adds the length and the prefix hash of the normalised text."""
    norm = normalised(F.col("text"))
    return docs.withColumns({"_xd_n": F.length(norm), "_xd_p": F.xxhash64(F.substring(norm, 1, prefix_chars))})


def _surviving(shapes: DataFrame) -> DataFrame:
    """The (length, prefix hash) keys that more than one row has, lengths first; both counts are combined before they move."""
    by_length = shapes.groupBy("_xd_n").agg(F.count("*").alias("_xd_c")).where("_xd_c > 1").select("_xd_n")
    left = shapes.join(shared.sized(shared.staged(by_length, "lengths")), "_xd_n", "left_semi")
    return left.groupBy("_xd_n", "_xd_p").agg(F.count("*").alias("_xd_c")).where("_xd_c > 1").select("_xd_n", "_xd_p")


def _hashed(shaped: DataFrame, keys: DataFrame, full_hash: Column) -> DataFrame:
    """The surviving rows with the full hash of their text."""
    return shaped.join(shared.sized(keys), ["_xd_n", "_xd_p"], "left_semi").withColumn("_xd_h", full_hash)


def _elected(hashed: DataFrame) -> DataFrame:
    """A row a full hash: size, the smallest doc_id and how many rows have it. Counted by id first, so copies of one text never meet in one task."""
    by_id = hashed.groupBy("_xd_n", "_xd_h", "doc_id").agg(F.count("*").alias("_xd_c"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_xd_c").alias("c")))
    return by_id.groupBy("_xd_n", "_xd_h").agg(best.alias("_xd_best"), F.sum("_xd_c").alias("_xd_size"))


def groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, full_hash: str | None = None) -> DataFrame:
    """Every row's columns but the text, with keep_id, group_size and kept.

    `full_hash` names a column that has the hash of the whole normalised text already; without it the surviving rows'
    texts are read again. Both sides of the last join are staged tables, so adaptive execution can split a hot text.
    """
    shaped = _shape(docs, prefix_chars)
    narrow = shared.staged(shaped.drop("text"), "shapes")
    keys = shared.staged(_surviving(narrow), "survivors")
    found = _hashed(narrow, keys, F.col(full_hash)) if full_hash else _hashed(shaped, keys, hash_of(F.col("text"))).drop("text")
    hashed = shared.staged(found, "hashed")
    elected = shared.staged(_elected(hashed), "elected")
    out = [c for c in docs.columns if c != "text"]
    alone = narrow.join(shared.sized(keys), ["_xd_n", "_xd_p"], "left_anti").select(*out, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    met = hashed.join(elected.hint("merge"), ["_xd_n", "_xd_h"]).select(*out, F.col("_xd_best.i").alias("keep_id"), F.col("_xd_size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("_xd_best.i")).alias("kept"))
    return alone.unionByName(met)


def deduplicate(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows that stay, with the input's columns: one of each set of equal texts."""
    shaped = _shape(docs, prefix_chars)
    narrow = shared.staged(shaped.select("_xd_n", "_xd_p"), "shapes")
    keys = shared.staged(_surviving(narrow), "survivors")
    shared.released(narrow)
    hashed = _hashed(shaped, keys, hash_of(F.col("text")))
    elected = shared.staged(_elected(hashed.select("_xd_n", "_xd_h", "doc_id")), "elected")
    # the texts of the elected rows alone move: a row that isn't elected leaves at the semi-join of (hash, doc_id) pairs
    chosen = shared.staged(elected.select("_xd_n", "_xd_h", F.col("_xd_best.i").alias("_xd_i"), (F.col("_xd_best.c") > 1).alias("_xd_tied")), "chosen")
    same = hashed.withColumn("_xd_i", F.col("doc_id"))
    by = ["_xd_n", "_xd_h"]
    stay = same.alias("a").join(shared.sized(chosen, shared.BROADCAST_ROWS // 2).alias("b"), [*(F.col(f"a.{c}") == F.col(f"b.{c}") for c in by), F.col("a._xd_i").eqNullSafe(F.col("b._xd_i"))]).select("a.*", "b._xd_tied")
    sole = stay.where(~F.col("_xd_tied"))
    alone = shaped.join(shared.sized(keys), ["_xd_n", "_xd_p"], "left_anti")
    kept = alone.select(*docs.columns).unionByName(sole.select(*docs.columns))
    if chosen.where("_xd_tied").isEmpty():
        return kept
    return kept.unionByName(stay.where("_xd_tied").dropDuplicates(by).select(*docs.columns))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs.withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256)), full_hash="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
