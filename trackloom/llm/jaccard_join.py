"""Grouped prefix join: all pairs of documents whose 5-word shingle sets reach a Jaccard similarity.

The shingles of a set stand in one global order: those that a corpus-wide count sketch calls frequent come last, the
rarer first, the others by hash. Two sets that reach the threshold then share a shingle of their prefixes. Documents with the same
prefix and size are one group; groups that share a prefix shingle are candidates. Groups are first compared with one
pivot at each shingle: the group with the least share of rare shingles in its prefix, as a near copy with few edits is
within reach of those with many, while two of many edits are not. So a large family around such a copy becomes one
component in a linear number of checks; then every pair of groups whose components differ is expanded to its members and
verified. A group's id has 60 bits of hash, so two prefixes would be taken for one with a chance of 2^-60.
The sketch only sets the order and the pivots, so its fixed size bounds the broadcast and never changes a result. Components of open shingles are told apart by 64-bit hashes of
their labels, so that two that still have to link would be taken for one with a chance of 2^-64; texts likewise are told
apart by a 64-bit hash where they share a doc_id. Verification is exact: a parity bitmap's bound first,
then the sets themselves.

Edge cases: null or empty text has no shingles and links with nothing; under `width` words the whole sequence is one
shingle; a text of any length is one row's work; equal texts share a set; rows that share a doc_id are told apart by
their texts; a null doc_id takes part and its component is the smallest doc_id there is, or null; an empty table gives
no rows; other columns may have any names but `_jj_id` and `_jj_hash`, and `deduplicate` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import byte_models, shared

WIDTH, PERCENT = 5, 75
SKETCH_BITS, BLOCK_BITS, LIGHT = 24, 16, 4
LARGE, ROUNDS, TABLE_BITS, TOKEN_BITS = 32, 2, 22, 26
#: comparisons a row that cost about as much as a pivot turn, which joins and exchanges every row some ten times
PAIRS = 256
_BLOCK_BYTES = 1 << 17
_RNG = np.random.default_rng(51_966)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: bytes of texts or tokens that are worked on at a time; their hashes take some twenty times as much
SLICE_BYTES = 500_000
#: partitions in which the tasks' blocks are summed, each block there with 8 bytes a bucket
MERGES = 16
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, _BLOCK_BYTES + 1)
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that lie at `offsets` in `data`, and where each text's words begin."""
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK_BYTES, "right")))
        base = starts[at]
        part = data[base : ends[stop - 1]]
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = _mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out, np.searchsorted(starts, offsets)


def shingle_hashes(batch: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text its shingles' hashes in text order, repeats and all."""
    if batch.null_count:
        batch = batch.fill_null("")
    offset_type = np.int64 if pa.types.is_large_string(batch.type) else np.int32
    buffers = batch.buffers()
    offsets = np.frombuffer(buffers[1], offset_type, len(batch) + 1, batch.offset * np.dtype(offset_type).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    words, firsts = word_hashes(data, offsets - offsets[0])
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _PLACE[k]
    rolled = _mixed(rolled)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            yield rolled[a : b - width + 1]
        elif b > a:
            yield _mixed((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACE[40 + b - a])
        else:
            yield np.empty(0, np.uint64)


def _counted(parts: DataFrame, bits: int) -> np.ndarray:
    """Sums the tasks' sketch blocks; a fixed 2**bits levels (uint8: twice the binary logarithm) reach the driver."""

    @shared.trimming
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                part = np.frombuffer(unpack.decompress(counts), np.uint32)
                sums[block] = sums.get(block, 0) + part.astype(np.float64)
        levels = ((b, pack.compress(np.minimum(255, np.rint(4 * np.log2(s + 1))).astype(np.uint8).tobytes())) for b, s in sums.items())
        yield from shared.arrow_rows(levels, {"block": pa.int32(), "counts": pa.binary()})

    import zstandard

    out = np.zeros(1 << bits, np.uint8)
    size = 1 << min(bits, BLOCK_BITS)
    for row in parts.repartition(MERGES, F.col("block")).mapInArrow(merge, "block int, counts binary").collect():
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.counts)), np.uint8)
    return out


def _tallied(hashes: Iterator[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """Packed blocks of how many hashes fall into each bucket; a block whose 16-bit counts fill up goes out early and begins anew."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    counts = np.zeros(1 << bits, np.uint16)
    blocks = counts.reshape(-1, 1 << min(bits, BLOCK_BITS))
    half = 1 << 15

    def packed(part: np.ndarray) -> bytes:
        return memoryview(pack.compress(part.astype(np.uint32).tobytes())).tobytes()  # what compress gives keeps the room of the worst case

    for found in hashes:
        for k in range(0, len(found), half):  # no count grows by more than a half at a time
            at = (found[k : k + half] >> np.uint64(64 - bits)).astype(np.int64)
            np.add.at(counts, at, np.uint16(1))
            full = at[counts[at] >= half]
            for block in np.unique(full // blocks.shape[1]).tolist() if len(full) else ():
                yield block, packed(blocks[block])
                blocks[block] = 0
    for block, part in enumerate(blocks):
        if part.any():
            yield block, packed(part)


_BLOCK_KINDS = {"block": pa.int32(), "counts": pa.binary()}


def sketch(texts: DataFrame, width: int = WIDTH, bits: int = SKETCH_BITS) -> np.ndarray:
    """Levels of how often the shingles of each bucket occur in all texts."""

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = (found for batch in batches for piece in byte_models.slices(batch, SLICE_BYTES) for found in shingle_hashes(piece.column(0), width))
        yield from shared.arrow_rows(_tallied(hashes, bits), _BLOCK_KINDS)

    return _counted(texts.select("text").mapInArrow(run, "block int, counts binary"), bits)


def ranked(levels: np.ndarray, light: int = LIGHT) -> np.ndarray:
    """The levels of buckets well above the mean load, which hold shingles of more than about `light` texts; 0 for all others."""
    mean = float((2.0 ** (levels.astype(np.float32) / 4) - 1).mean())
    return np.where(levels >= 4 * np.log2(mean + 3 * mean**0.5 + light + 1), levels, 0).astype(np.uint8)


def prefix(tokens: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n - ceil(n * percent / 100) + 1 of the sorted tokens in the global order: by rank, within a rank by hash."""
    n = len(tokens)
    size = n - -(-n * percent // 100) + 1
    rank = ranks[(tokens >> np.uint64(64 - (len(ranks).bit_length() - 1))).astype(np.int64)]
    light = tokens[rank == 0]
    return light[:size] if len(light) >= size else tokens[np.argsort(rank, kind="stable")[:size]]


def group_id(first: np.ndarray, n: int, ranks: np.ndarray) -> int:
    """A signed 64-bit hash of a prefix and its set's size; groups with a larger share of frequent shingles in it have larger ids, in 16 steps."""
    import xxhash

    rank = ranks[(first >> np.uint64(64 - (len(ranks).bit_length() - 1))).astype(np.int64)]
    share = 15 * int(np.count_nonzero(rank)) // len(first)
    return ((share << 60) | (xxhash.xxh3_64_intdigest(first, seed=n) >> 4)) - (1 << 63)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the number of tokens in each of about 2n buckets."""
    bits = 1 << int(np.clip((2 * len(tokens) - 1).bit_length(), 9, 16))
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def bitmap_distance(a: bytes, b: bytes) -> int:
    """At most the size of the two sets' symmetric difference."""
    x, y, n, m = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a), len(b)
    while n > m:
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    while m > n:
        m //= 2
        y = (y >> (8 * m)) ^ (y & ((1 << (8 * m)) - 1))
    return (x ^ y).bit_count()


def _set_key(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens)


def shapes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, gid, prefix, bits) of each row; prefix and bits where a task first meets them.

    text_hash tells rows of one doc_id apart, gid stands for the group of texts with that prefix and size, set_key for the whole set.
    """
    import zstandard

    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast(zstandard.ZstdCompressor().compress(ranked(sketch(docs, width)).tobytes()))
    field = docs.schema["doc_id"]

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.value), np.uint8)
        seen: set[bytes] = set()

        def rows(batch: pa.RecordBatch):
            for doc_id, text_hash, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_hashes(batch.column(2), width), strict=True):
                tokens = np.unique(found)
                if not len(tokens):
                    yield doc_id, text_hash, 0, None, None, None, None
                    continue
                key = _set_key(tokens)
                first = prefix(tokens, ranks, percent)
                gid = group_id(first, len(tokens), ranks)
                if len(seen) > 100_000:
                    seen.clear()
                new_set, new_group = key not in seen, gid not in seen
                seen.update((key, gid))
                yield doc_id, text_hash, len(tokens), key, gid, first.view(np.int64) if new_group else None, bitmap(tokens) if new_set else None

        for batch in batches:
            kinds = {"doc_id": batch.schema.field(0).type, "text_hash": pa.int64(), "n_shingles": pa.int64(), "set_key": pa.binary(), "gid": pa.int64(), "prefix": pa.list_(pa.int64()), "bits": pa.binary()}
            for piece in byte_models.slices(batch, SLICE_BYTES):
                yield from shared.arrow_rows(rows(piece), kinds)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {field.dataType.simpleString()}, text_hash long, n_shingles long, set_key binary, gid long, prefix array<long>, bits binary")


def _places(column: pa.Array, bits: int) -> np.ndarray:
    """The buckets of hashes: longs by their first bits, 16-byte keys by those of their first half."""
    values = np.frombuffer(b"".join(column.to_pylist()), np.uint64)[::2] if pa.types.is_binary(column.type) else column.to_numpy().view(np.uint64)
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def _hit(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places of a packed bit table are set."""
    return (table[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).view(bool)


def bit_table(hashes: DataFrame, bits: int):
    """A broadcast table of fixed size, packed: which buckets the hashes of a one-column table fall into. It only thins what an exact join follows."""
    size = 1 << min(bits - 3, BLOCK_BITS - 3)

    @shared.trimming
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            places = _places(batch.column(0), bits)
            for k in range(8):  # the places of one bit set the same bit, so repeated bytes do no harm
                there[places[places & 7 == k] >> 3] |= np.uint8(128 >> k)
        table = there.reshape(-1, size)
        yield from shared.arrow_rows(((int(k), table[k].tobytes()) for k in np.flatnonzero(table.any(axis=1))), _BLOCK_KINDS)

    @shared.trimming
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                found[block] = found.get(block, 0) | np.frombuffer(part, np.uint8)
        yield from shared.arrow_rows(((k, v.tobytes()) for k, v in found.items()), _BLOCK_KINDS)

    kind = "block int, counts binary"
    out = np.zeros((1 << bits - 3) // size * size, np.uint8)
    for row in hashes.mapInArrow(mark, kind).repartition(F.col("block")).mapInArrow(merge, kind).collect():
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(bytes(row.counts), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def live_tokens(texts: DataFrame, live: DataFrame, width: int, bits: int = TABLE_BITS) -> DataFrame:
    """(set_key, tokens) of the sets of `live` and of few others; a set may come once a task."""
    some = bit_table(live, bits)

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = some.value
        seen: set[bytes] = set()

        def rows(piece: pa.RecordBatch):
            for found in shingle_hashes(piece.column(0), width):
                if len(found):
                    tokens = np.unique(found)
                    key = _set_key(tokens)
                    if key not in seen and _hit(there, np.array([int.from_bytes(key[:8], "little") >> (64 - bits)]))[0]:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(key)
                        yield key, tokens.tobytes()

        for batch in batches:
            for piece in byte_models.slices(batch, SLICE_BYTES):
                yield from shared.arrow_rows(rows(piece), {"set_key": pa.binary(), "tokens": pa.binary()})

    return texts.select("text").mapInArrow(run, "set_key binary, tokens binary")


def _tokens_of(tokens: DataFrame, wanted: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """The rows of `tokens` whose set is in `wanted`, each set once; the bit table drops most others before the exchange."""
    some = bit_table(wanted, bits)

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_hit(some.value, _places(batch.column(0), bits))))

    return tokens.mapInArrow(run, "set_key binary, tokens binary").join(wanted.hint("merge"), "set_key", "left_semi").dropDuplicates(["set_key"])


def _prefix_rows(rows: DataFrame, met: DataFrame, bits: int = TOKEN_BITS) -> DataFrame:
    """(token, pos, gid, n) of the prefix tokens that may be in `met`, each at most once a task."""
    some = bit_table(met, bits)

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_models.slices(batch, SLICE_BYTES):
                lists = piece.column(2)
                tokens, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                keep = _hit(some.value, _places(tokens, bits))
                at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                gid, n = (np.repeat(piece.column(i).to_numpy(), sizes)[keep] for i in range(2))
                yield pa.RecordBatch.from_arrays([tokens.filter(pa.array(keep)), pa.array(at[keep].astype(np.int32)), pa.array(gid), pa.array(n.astype(np.int32))], ["token", "pos", "gid", "n"])

    return rows.where("prefix is not null").select("gid", "n_shingles", "prefix").mapInArrow(run, "token long, pos int, gid long, n int")


def _with_both(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    for side in ("a", "b"):
        named = facts.select(F.col("set_key").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        pairs = pairs.join(named.hint("merge"), side)
    return pairs


def verify(pairs: DataFrame, sets: DataFrame, tokens: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) of set keys that reach the similarity, staged."""
    held = shared.staged(pairs, "pairs")

    @shared.trimming
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, x, m, y = (batch.column(i).to_pylist() for i in range(6))
            keep = [(percent + 100) * bitmap_distance(p, q) <= (100 - percent) * (j + k) for j, p, k, q in zip(n, x, m, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    @shared.trimming
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):  # one pair's tokens at a time
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    rough = _with_both(held, sets, ["n_shingles", "bits"]).select("a", "b", "n_shingles_a", "bits_a", "n_shingles_b", "bits_b")
    left = shared.staged(rough.mapInArrow(bound, "a binary, b binary"), "bounded")
    wanted = shared.staged(left.select(F.col("a").alias("set_key")).union(left.select("b")).distinct(), "wanted")
    some = shared.staged(_tokens_of(tokens, wanted), "some_tokens")
    linked = shared.staged(_with_both(left, some, ["tokens"]).select("a", "b", "tokens_a", "tokens_b").mapInArrow(exact, "a binary, b binary"), "linked")
    shared.released(held, left, wanted, some)
    return linked


def _sizes_fit(n: str, m: str, percent: int) -> Column:
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def size_class(n: Column, percent: int, shift: int = 0) -> Column:
    """Sizes in steps of 100 / percent: two sets that link differ by at most one step. With `shift`, the class of the least (-1) or largest (1) size that a set of n can link with."""
    if percent >= 100:
        return n.cast("long")
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + shift * (1 + 1e-9))


def _open(sets: DataFrame, met: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets with their labels, and the rows of tokens whose groups have more than one, with the count of such rows; a group of several labels has a null one. Labels stand there as 64-bit hashes, as groups do."""
    named = sets.select("gid", "set_key", F.col("n_shingles").alias("n")).join(labels.withColumnRenamed("node", "set_key").hint("merge"), "set_key", "left").withColumn("label", F.xxhash64(F.coalesce("label", "set_key")))
    named = shared.staged(named, "named")
    group_label = named.groupBy("gid").agg(F.min("label").alias("one"), F.max("label").alias("two"))
    group_label = group_label.select("gid", F.when(F.col("one") == F.col("two"), F.col("one")).alias("label"))
    # tasks that met the same group gave its tokens each: they stand together once dealt by group
    rows = met.select("token", "pos", "gid", "n").join(group_label.hint("merge"), "gid").dropDuplicates(["gid", "token"])
    rows = shared.staged(rows.select("token", "pos", "gid", "n", "label"), "labelled")
    several = F.max(F.col("label").isNull()) | (F.min("label") != F.max("label"))
    tokens = shared.staged(rows.groupBy("token").agg(several.alias("open"), F.count("*").alias("c")).where("open").select("token", "c"), "open_tokens")
    found = shared.staged(rows.join(tokens.hint("merge"), "token"), "open")
    shared.released(rows, tokens)
    return named, found


def _open_pairs(rows: DataFrame) -> tuple[int, int]:
    """How many rows `_open` left, and how many pairs of groups of different labels meet at their tokens of many groups."""
    by_label = rows.groupBy("token", "label").agg(F.count("*").alias("k"), F.max("c").alias("c"))
    met = F.when(F.col("c") >= LARGE, F.col("k").cast("double") * (F.col("c") - F.when(F.col("label").isNull(), 1).otherwise(F.col("k"))) / 2)
    found = by_label.agg(F.sum("k"), F.sum(met)).first()
    return found[0] or 0, int(found[1] or 0)


def set_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The staged rows of `shapes`, and (node, label) of the sets that link with another set, staged.

    Tables by token are joined with one aggregated row a token, both sides staged, so that adaptive execution can
    split a hot token; none of them is broadcast, as all grow with the corpus.
    """
    rows = shared.staged(shapes(docs, width, percent), "shapes")
    pairs = rows.where("prefix is not null").select(F.explode("prefix").alias("token"), "gid")
    bounds = pairs.groupBy("token").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).where("lo <> hi")
    bounds = shared.staged(bounds.select("token", "hi"), "bounds")
    met = shared.staged(_prefix_rows(rows, bounds.select("token")).join(bounds.hint("merge"), "token"), "met")
    # groups that matter: those that meet another one, and those of more than one set
    several = rows.where("gid is not null").groupBy("gid").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("gid")
    several = shared.staged(several, "several")
    live = met.select("gid").union(several).distinct()
    sets = rows.where("bits is not null").select("gid", "set_key", "n_shingles", "bits").join(live.hint("merge"), "gid", "left_semi").dropDuplicates(["set_key", "gid"])
    sets = shared.staged(sets, "sets")
    reps = shared.staged(sets.groupBy("gid").agg(F.min("set_key").alias("rep"), F.min("n_shingles").alias("n")), "reps")

    # each group with the highest group at its shingles (by `group_id` the one of most frequent shingles), each set with its group's first
    pivots = met.select(F.col("hi").alias("p"), "gid").where("p <> gid").distinct()
    pivot_reps = reps.select(F.col("gid").alias("p"), F.col("rep").alias("a"), F.col("n").alias("m"))
    chosen = pivots.join(pivot_reps.hint("merge"), "p").join(reps.hint("merge"), "gid").where(_sizes_fit("n", "m", percent)).select("a", F.col("rep").alias("b"))
    inside = sets.join(reps.select("gid", "rep").hint("merge"), "gid").where("set_key <> rep").select(F.col("rep").alias("a"), F.col("set_key").alias("b"))
    tokens = shared.staged(live_tokens(docs, sets.select("set_key"), width), "tokens")
    edges = verify(chosen.union(inside).distinct(), sets, tokens, percent)
    labels = shared.staged(shared.components(edges), "labels")
    shared.released(bounds, edges)

    # tokens that many groups still hold under different labels: compared with a pivot of the token's own, again and again
    # labels only ever merge, so a token that is closed once stays so, and each turn reads the rows the last one left
    # a turn is a pass over all that is open: it is only worth it where more pairs are left, and while it halves them
    named = open_tokens = None
    before = math.inf
    for turn in range(ROUNDS):
        named, open_tokens = _open(sets, met, labels)
        shared.released(met)
        n, pairs_left = _open_pairs(open_tokens)
        if pairs_left <= PAIRS * n or 2 * pairs_left > before:
            break
        before = pairs_left
        large = open_tokens.where(f"c >= {LARGE}")
        pivot = large.groupBy("token").agg(F.max(F.struct(F.shiftright("gid", 60).alias("share"), F.xxhash64("gid", "token", F.lit(turn)).alias("h"), "gid", "label", "n")).alias("p"))
        pivot = shared.staged(pivot, "token_pivots")
        asked = large.join(pivot.hint("merge"), "token").where("p.gid <> gid and (p.label is null or label is null or p.label <> label)")
        asked = asked.where(_sizes_fit("n", "p.n", percent)).select(F.col("p.gid").alias("p"), "gid").distinct()
        asked = asked.join(pivot_reps.select("p", "a").hint("merge"), "p").join(reps.select("gid", F.col("rep").alias("b")).hint("merge"), "gid").select("a", "b")
        asked = shared.staged(asked, "asked")
        shared.released(pivot)
        if asked.isEmpty():
            break
        more = verify(asked, sets, tokens, percent)
        if more.isEmpty():  # the labels stay, and so does what is open
            shared.released(asked, more)
            break
        old, labels = labels, shared.staged(shared.components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)), "labels")
        shared.released(asked, more, old, named)
        named, met = None, open_tokens

    # every pair of groups of different components
    if named is None:
        named, open_tokens = _open(sets, met, labels)
        shared.released(met)
    x, y = (open_tokens.select("token", "c", *(F.col(c).alias(f"{c}_{s}") for c in ("pos", "gid", "n", "label"))) for s in "xy")
    differ = F.col("label_x").isNull() | F.col("label_y").isNull() | (F.col("label_x") != F.col("label_y"))
    # at their first common token two sets that link have enough of both left
    left = (100 + percent) * F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= percent * (F.col("n_x") + F.col("n_y"))
    # for tokens of many groups the join's key has the size too, so those are compared within sizes that fit
    many, none = F.col("c") >= LARGE, F.lit(-1).cast("long")
    x = x.withColumn("class", F.when(many, size_class(F.col("n_x"), percent)).otherwise(none)).drop("c")
    fits = F.sequence(size_class(F.col("n_y"), percent, -1), size_class(F.col("n_y"), percent, 1))
    y = y.withColumn("class", F.explode(F.when(many, fits).otherwise(F.array(none)))).drop("c")
    met_pairs = x.hint("merge").join(y, (x.token == y.token) & (x["class"] == y["class"]) & (F.col("gid_x") < F.col("gid_y")) & _sizes_fit("n_x", "n_y", percent) & left & differ)
    met_pairs = met_pairs.select("gid_x", "gid_y").distinct()
    group_pairs = met_pairs.union(several.select("gid", F.col("gid")))
    p, q = (named.select(*(F.col(c).alias(f"{c}_{s}") for c in ("gid", "set_key", "label"))) for s in "xy")
    expanded = group_pairs.join(p.hint("merge"), "gid_x").join(q.hint("merge"), "gid_y").where((F.col("label_x") != F.col("label_y")) & ((F.col("gid_x") < F.col("gid_y")) | (F.col("set_key_x") < F.col("set_key_y"))))
    rest = expanded.select(F.col("set_key_x").alias("a"), F.col("set_key_y").alias("b")).distinct()
    more = verify(rest, sets, tokens, percent)
    linked = shared.staged(shared.components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)), "components")
    shared.released(several, sets, reps, tokens, labels, named, open_tokens, more)
    return rows, linked


def _classed(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two staged tables and, read from them, (doc_id, text_hash, n_shingles, first) of every row; first is its component's smallest (doc_id, text_hash), ids that are null last; null without a link or an equal set."""
    rows, linked = set_components(docs, width, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    least = rows.where("set_key is not null").groupBy("set_key").agg(first.alias("least"), F.count("*").alias("c"))
    least = shared.staged(least.join(linked.withColumnRenamed("node", "set_key").hint("merge"), "set_key", "left"), "least")
    by_label = shared.staged(least.where("label is not null").groupBy("label").agg(F.min("least").alias("lowest")), "by_label")
    placed = least.where("c > 1 or label is not null").join(by_label.hint("merge"), "label", "left").select("set_key", F.coalesce("lowest", "least").alias("first"))
    placed = shared.staged(placed, "placed")
    shared.released(least, linked, by_label)
    return rows, placed, rows.join(placed.hint("merge"), "set_key", "left").select("doc_id", "text_hash", "n_shingles", "first")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    return _classed(docs, width, percent)[2].select("doc_id", "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("component_id"))


def deduplicate(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that are the first of their component by doc_id, then by text; repeated rows (equal doc_id and text) stay together."""
    rows, placed, found = _classed(docs, width, percent)
    here = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash"))
    gone = shared.staged(found.where(F.col("first").isNotNull() & ~here).select(F.col("doc_id").alias("_jj_id"), F.col("text_hash").alias("_jj_hash")).distinct(), "gone")
    shared.released(rows, placed)
    return docs.join(shared.sized(gone), F.col("doc_id").eqNullSafe(F.col("_jj_id")) & (F.xxhash64("text") == F.col("_jj_hash")), "left_anti")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS sh FROM d),
t AS MATERIALIZED (SELECT r, unnest(list_transform(sh, lambda x: hash(x))) AS h, len(sh) AS n FROM s),
p AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM t a JOIN t b ON a.h = b.h AND a.r <> b.r AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
c AS (SELECT r, r AS x FROM s UNION SELECT c.r, p.b FROM c JOIN p ON p.a = c.x)
SELECT s.doc_id, CAST(any_value(len(s.sh)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM c JOIN s ON s.r = c.r JOIN s o ON o.r = c.x GROUP BY c.r, s.doc_id
"""
