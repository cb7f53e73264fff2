"""An append-only store of slots that are worked out bit by bit: whole chunks, a manifest that commits, restart without loss or repetition.

A batch's new slots join what was left over from the last one. Chunks that are whole now (a track's last may be shorter)
go into the batch's folder, what is left over into its tail, and then its manifest is written. Nothing counts before
that: a batch that dies on the way leaves files that nobody reads and that its repetition overwrites, and a batch whose
manifest is there changes nothing when it comes again. Progress never claims more than has been committed, and it ends
at a chunk's border or at the track's end.

Batches of one store come one after the other, as a stream's do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from trackloom.schema import KEY

CHUNK_SLOTS = 128


class SlotStore:
    """Rows (video_id, identity, expected, slot, ...): expected is the track's number of slots, identity what they were made with."""

    def __init__(self, spark: SparkSession, path: str, schema: str, chunk_slots: int = CHUNK_SLOTS):
        self.spark, self.path, self.size = spark, path.rstrip("/"), chunk_slots
        self.schema = StructType.fromDDL(f"{KEY} string, identity string, expected long, slot long, {schema}")
        self.manifest_schema = StructType.fromDDL(f"number long, batch string, {KEY} string, identity string, expected long, chunk long")

    def _read(self, folder: str, schema: StructType) -> DataFrame:
        files = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if not files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(files.toString())

    def _manifest(self) -> DataFrame:
        """A row without a track for each batch that is committed, and one for each of its chunks."""
        return self._read("manifest", self.manifest_schema)

    def progress(self) -> DataFrame:
        """(video_id, identity, expected, completed): the slots that are there without a gap from 0. A track whose latest batch has another identity or length has started anew."""
        chunks = self._manifest().where(F.col(KEY).isNotNull())
        last = Window.partitionBy(KEY).orderBy(F.col("number").desc())
        made_as = F.first(F.struct("identity", "expected")).over(last)
        current = chunks.withColumn("_now", made_as).where("identity <=> _now.identity and expected <=> _now.expected")
        distinct = current.select(KEY, "identity", "expected", "chunk").distinct()
        unbroken = distinct.withColumn("k", F.row_number().over(Window.partitionBy(KEY).orderBy("chunk")) - 1).where("k = chunk")
        return unbroken.groupBy(KEY, "identity", "expected").agg(F.least(F.count("*") * self.size, F.col("expected")).alias("completed"))

    def missing(self, wanted: DataFrame) -> DataFrame:
        """(video_id, identity, expected, start): from where each wanted track (video_id, identity, expected) has to be worked out; none for those that are complete."""
        start = F.coalesce("completed", F.lit(0)).cast("long")
        return wanted.join(self.progress(), [KEY, "identity", "expected"], "left").select(KEY, "identity", "expected", start.alias("start")).where("start < expected")

    def read(self) -> DataFrame:
        """The slots that count."""
        current = self.progress().where("completed > 0")
        committed = self._manifest().where(F.col(KEY).isNotNull()).select(KEY, "identity", "expected", "chunk", "batch")
        first = committed.groupBy(KEY, "identity", "expected", "chunk").agg(F.min("batch").alias("batch"))
        held = self._read("data", StructType(self.schema.fields + StructType.fromDDL("batch string").fields)).withColumn("chunk", F.floor(F.col("slot") / self.size))
        return held.join(first, [KEY, "identity", "expected", "chunk", "batch"], "left_semi").join(current, [KEY, "identity", "expected"]).where("slot < completed").select(*self.schema.fieldNames())

    def append(self, slots: DataFrame, batch: str) -> bool:
        """Adds a batch; whether it was new. Slots that are complete or left over already are passed over, of equal ones the new one counts."""
        log = self._manifest().where(F.col(KEY).isNull())
        if not log.where(F.col("batch") == batch).isEmpty():
            return False
        last = log.orderBy(F.col("number").desc()).select("number", "batch").first()
        number, before = (last[0] + 1, last[1]) if last else (0, None)
        columns = self.schema.fieldNames()
        given = slots.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).where("slot >= 0 and slot < expected")
        open_ = self._read(f"tail/batch={before}", self.schema) if before is not None else self.spark.createDataFrame([], self.schema)
        # a track whose slots are made otherwise now leaves what is open behind
        now = given.select(KEY, "identity", "expected").distinct().withColumnsRenamed({"identity": "_i", "expected": "_e"})
        open_ = open_.join(now, KEY, "left").where("_i is null or (identity <=> _i and expected <=> _e)").select(*columns)
        both = given.withColumn("_new", F.lit(1)).unionByName(open_.withColumn("_new", F.lit(0)))
        order = Window.partitionBy(KEY, "slot").orderBy(F.col("_new").desc())
        one = both.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*columns)
        todo = one.join(self.progress(), [KEY, "identity", "expected"], "left").where("completed is null or slot >= completed").drop("completed")
        chunk = F.floor(F.col("slot") / self.size)
        counted = todo.withColumn("chunk", chunk).withColumn("_n", F.count("*").over(Window.partitionBy(KEY, "chunk")))
        whole = F.col("_n") == F.least(F.lit(self.size), F.col("expected") - F.col("chunk") * self.size)
        counted.where(whole).select(*columns).repartition(KEY, chunk).sortWithinPartitions(KEY, "slot").write.mode("overwrite").parquet(f"{self.path}/data/batch={batch}")
        counted.where(~whole).select(*columns).write.mode("overwrite").parquet(f"{self.path}/tail/batch={batch}")
        self._commit(number, batch)
        return True

    def _commit(self, number: int, batch: str) -> None:
        """The manifest is one file, so it is there or not."""
        made = self._read(f"data/batch={batch}", self.schema).select(KEY, "identity", "expected", F.floor(F.col("slot") / self.size).alias("chunk")).distinct()
        fields = [F.col(f.name) for f in self.manifest_schema if f.name != "batch"]
        log = self.spark.range(1).select(F.lit(number).cast("long").alias("number"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.manifest_schema.fields[2:]])
        rows = made.withColumn("number", F.lit(number).cast("long")).select(*fields).unionByName(log.select(*fields))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")


def appended_by_stream(store: SlotStore):
    """A foreachBatch sink into the store."""

    def write(batch: DataFrame, number: int) -> None:
        store.append(batch, f"stream-{number:012d}")

    return write
