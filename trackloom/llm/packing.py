"""Best-fit packing of tokenised documents into fixed-length training sequences.

Bounded-space online best-fit: each lane keeps a fixed number of open bins in a bitset keyed by free space, puts a
piece into the tightest bin that holds it and, when one bin too many is open, closes the fullest.

Edge cases: null or empty text gives the end id alone; repeated rows are packed once each; a null doc_id is kept;
a text of any length is encoded whole and cut only into pieces of full length; an empty table gives no rows; further
input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import byte_models, shared, tokenizer

SEQUENCE_TOKENS, END_ID, OPEN_BINS, PIECES_A_LANE = 2048, 0, 4096, 200_000
#: bytes of text that become Python values at a time, and of pieces that leave in one batch
SLICE_BYTES = 2_000_000


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut every `capacity` ids."""
    end = end_id.to_bytes(4, "little")

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids that stay with the pieces take memory of their own, so there the word cache is smaller
        encode = tokenizer.loaded(tokenizer_path, tokenizer.CACHE_WORDS // 3 if keep_ids else tokenizer.CACHE_WORDS).encode_bytes

        def pieces(batch: pa.RecordBatch):
            for part in byte_models.slices(batch, SLICE_BYTES):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = encode(text.as_py()) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        yield doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut), *([cut] if keep_ids else [])

        for batch in batches:
            kinds = {"doc_id": batch.schema.field(0).type, "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
            yield from shared.arrow_rows(pieces(batch), kinds | ({"ids": pa.binary()} if keep_ids else {}), SLICE_BYTES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class OpenBins:
    """A fixed number of open bins; bit k of the set tells that some open bin has k free places."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.count, self.opened = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _pop(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._pop(free)
        else:
            free, bin_id = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)
        return bin_id, self.capacity - free


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, pieces_a_lane: int = PIECES_A_LANE) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `capacity`.

    Pieces are dealt by hash over lanes of about `pieces_a_lane`, each packed by one task that streams its rows in
    hash order; a lane holds its open bins only. Its last bins stay partly empty, under one in a thousand sequences.
    """
    lanes = max(1, round(pieces.count() / pieces_a_lane))
    fields = pieces.schema.fields

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, lane = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            columns = [pa.array([lane + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return pieces.repartition(lanes, order).sortWithinPartitions(order, "doc_id", "piece", "ids_crc32").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; the pieces are staged, so texts are encoded once.

    With ids, only what packing needs goes through the lanes; the places come back to the pieces by a row number.
    """
    pieces = token_pieces(docs, tokenizer_path or tokenizer.default_path(), keep_ids=keep_ids)
    if not keep_ids:
        return pack(shared.staged(pieces, "pieces"))
    held = shared.staged(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    places = shared.staged(pack(held.drop("ids")).select("row", "sequence_id", "offset"), "places")
    return held.join(places.hint("merge"), "row").drop("row")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(shared.table(spark, sf_dir, "documents"))
