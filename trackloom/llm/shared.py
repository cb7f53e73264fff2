"""Small helpers the training-data operators share: table reading, staging and fixed text rules."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the text contracts (space and U+0009 to U+000D).
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


#: most rows and bytes of an Arrow batch between the JVM and Python; a batch stands in memory on both sides
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size, unless it is as low already: texts are long rows."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trimming(run: Callable) -> Callable:
    """A function of Arrow batches that gives freed memory back when its task ends; Python workers outlive tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in a single JVM (tests), where a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/trackloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def released(*tables: DataFrame) -> None:
    """Removes tables of `staged` that no later result reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: rows of a narrow table (some 16 to 40 bytes each) that may be broadcast
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow staged table for the small side of a join: broadcast if its counted rows are few, else never, whatever Spark estimates."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def crc_remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of a value's text, modulo `modulus`; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def arrow_rows(rows: Iterator[tuple], kinds: dict[str, pa.DataType], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about `most` bytes from tuples in the order of `kinds`."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    for row in rows:
        held.append(row)
        size += 24 + sum(len(x) if isinstance(x, (bytes, str)) else getattr(x, "nbytes", 0) for x in row)
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected table (a, b): label is the smallest node reachable.

    Alternates the large-star and small-star steps, each round staged, until every node stands on one side only: as a
    leaf with one root, or as a root. As edges lead to smaller nodes, that root is the smallest node of its component.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        met = near.join(low, "u")
        if large:  # repeated edges go in the next step, which is no larger for them than twice the edges
            return met.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return met.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.where("u <> m").select("u", "m")).distinct()

    def roots(e: DataFrame) -> DataFrame:
        ends = e.select(F.col("a").alias("node"), F.col("b").alias("v")).union(e.select("b", "b"))  # a root is its own
        return ends.groupBy("node").agg(F.min("v").alias("label"), F.max("v").alias("other"))

    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    while not roots(now).where("label <> other").isEmpty():
        old, now = now, staged(star(star(now, True), False), "edges")
        released(old)
    return roots(now).select("node", "label")
