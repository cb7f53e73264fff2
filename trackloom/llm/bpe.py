"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over each text's bytes sets chunk ends where its content says so, so a passage that documents share
falls into the same chunks wherever it stands. Spark counts the chunk hashes; a chunk that two different texts hold
is encoded once, by its first holder, and its ids are joined to the others. A text's chunk ids are then stitched:
around each join a window of words is re-encoded, and widened until its ends agree exactly with what stands there.

Edge cases: null counts as empty (no ids); equal texts are encoded together; null or repeated doc_id rows keep a row
each; a run of chunks with hardly any white space is encoded once, together; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import shared, tokenizer

MASK_BITS, LEAST_BYTES, MOST_BYTES = 10, 256, 8192
_GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there: five doublings of the window."""
    h = _GEAR[data]
    for k in range(5):
        w = 1 << k
        h[w:] += h[:-w] << np.uint32(w) if len(h) > w else 0
    return h


def chunk_ends(text: bytes, mask_bits: int = MASK_BITS, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> list[int]:
    """Ends of the chunks, always between UTF-8 characters."""
    n = len(text)
    if n <= least:
        return [n]
    data = np.frombuffer(text, np.uint8)
    found = np.flatnonzero(rolling_hash(data) >> np.uint32(32 - mask_bits) == 0) + 1
    ends, last = [], 0
    for at in [*found.tolist(), n]:
        while at - last > most:
            last = _whole(text, last + most)
            ends.append(last)
        if at - last >= least or at == n:
            at = _whole(text, at)
            if at > last:
                ends.append(at)
                last = at
    return ends


def _whole(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(text: bytes) -> list[bytes]:
    ends = [0, *chunk_ends(text)]
    return [text[a:b] for a, b in pairwise(ends)]


def _key(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(data)


def _last_words(text: str, count: int) -> int:
    """Where the last `count` white-space separated words of the text begin."""
    at = len(text)
    for _ in range(count):
        while at and text[at - 1].isspace():
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
    return at


def _first_words(text: str, count: int) -> int:
    at = 0
    for _ in range(count):
        while at < len(text) and text[at].isspace():
            at += 1
        while at < len(text) and not text[at].isspace():
            at += 1
    return at


#: words a chunk must hold so that the joins at its two ends stay apart
LEAST_WORDS = 8


def _has_words(text: str) -> bool:
    return len(text.split(None, LEAST_WORDS)) >= LEAST_WORDS


def _merged(parts: list[tuple[str, bytes | None]], encode) -> list[tuple[str, bytes]]:
    """Runs of parts with too few words to be joined at both ends become one part each, encoded once as a whole."""
    runs: list[list[tuple[str, bytes | None]]] = []
    open_end = False
    for part in parts:
        wide = _has_words(part[0])
        if runs and not (wide and open_end):
            runs[-1].append(part)
        else:
            runs.append([part])
        open_end = wide
    out = []
    for run in runs:
        text = "".join(t for t, _ in run)
        out.append((text, run[0][1] if len(run) == 1 and run[0][1] is not None else encode(text)))
    return out


def stitch(parts: list[tuple[str, bytes | None]], encode) -> bytes:
    """The ids of the joined parts, from each part's own ids (None: not yet encoded).

    At every join the last words of the left and the first words of the right are encoded together; the outer words
    of that window must come out as they stood, else the window is widened. Where no width agrees, the text is
    encoded whole, once. What stands left of a join's window is final, so the work is linear in the text.
    """
    joined = _merged(parts, encode)
    text, ids = joined[0]
    out = []
    for right, right_ids in joined[1:]:
        words = 2
        while True:
            a, b = _last_words(text, words), _first_words(right, words)
            guard_a, guard_b = _last_words(text, 1), _first_words(right, 1)
            left_ids, end_ids = encode(text[a:]), encode(right[:b])
            window = encode(text[a:] + right[:b])
            agrees = window.startswith(encode(text[a:guard_a])) and window.endswith(encode(right[guard_b:b])) and ids.endswith(left_ids) and right_ids.startswith(end_ids)
            if agrees and a < guard_a and b > guard_b:
                break
            if a == 0 or b == len(right):
                return encode("".join(t for t, _ in parts))
            words *= 2
        out.append(ids[: len(ids) - len(left_ids)])
        text, ids = text[a:] + right, window + right_ids[len(end_ids) :]
    return b"".join(out) + ids


def _text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, str]]:
    """Key and text of the task's different texts; bounded memory, so a text may come again later."""
    seen: set[bytes] = set()
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py() or ""
            key = hashlib.sha256(text.encode()).digest()[:16]
            if key not in seen:
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                yield key, text


def _unpacked(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[tuple]:
    """The batches' rows as Python values, converted about `most` bytes at a time."""
    for batch in batches:
        step = max(1, len(batch) * most // max(most, batch.nbytes))
        for at in range(0, len(batch), step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)


def chunk_table(texts: DataFrame) -> DataFrame:
    """(text_key, pos, chunk_key) of all different texts with more than nothing in them."""

    @shared.trimming
    def run(batches):
        rows = ((key, i, _key(c)) for key, text in _distinct(batches) if text for i, c in enumerate(chunks(text.encode())))
        yield from shared.arrow_rows(rows, {"text_key": pa.binary(), "pos": pa.int32(), "chunk_key": pa.binary()})

    return texts.mapInArrow(run, "text_key binary, pos int, chunk_key binary")


def _packed(texts: DataFrame) -> DataFrame:
    """(text_key, packed): different texts, compressed for the one exchange that moves them."""

    @shared.trimming
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        yield from shared.arrow_rows(((key, pack.compress(text.encode())) for key, text in _distinct(batches)), {"text_key": pa.binary(), "packed": pa.binary()})

    return texts.mapInArrow(run, "text_key binary, packed binary")


def encode_texts(texts: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """(text_key, n_tokens, ids_sha256, decoded_sha256[, ids]) of each different text in the one-column table `texts`."""
    # both sides of a join by a hot key are read from tables, so that adaptive execution can split that key; all of
    # them grow with the corpus, so none is broadcast at any size
    table = shared.staged(chunk_table(texts), "chunk_table")
    place = F.struct("text_key", "pos")
    owners = table.groupBy("chunk_key").agg(F.min(place).alias("owner"), F.max("text_key").alias("last")).where("owner.text_key <> last")
    held = shared.staged(owners.select("chunk_key", "owner"), "chunk_owners")
    shared_chunks = shared.staged(table.hint("merge").join(held, "chunk_key").select("text_key", "pos", "chunk_key", (F.col("owner") == place).alias("owned")), "chunks")
    roles = shared_chunks.groupBy("text_key").agg(F.collect_set(F.struct("pos", "chunk_key", "owned")).alias("roles"))
    kinds = {"kind": pa.int8(), "key": pa.binary(), "data": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def result(encoder, key: bytes, ids: bytes) -> tuple:
        decoded = encoder.decode_bytes(ids).encode()
        return 0, key, ids if keep_ids else None, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    @shared.trimming
    def first(batches):
        """Texts that share nothing are encoded and done; owners of shared chunks encode those; others wait."""
        import zstandard

        encoder, unpack = tokenizer.loaded(tokenizer_path), zstandard.ZstdDecompressor()

        def rows():
            seen: set[bytes] = set()
            for key, packed, mine in _unpacked(batches):
                if key in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                text = unpack.decompress(packed)
                if not mine:
                    yield result(encoder, key, encoder.encode_bytes(text.decode()))
                    continue
                yield 2, key, packed, None, None, None
                parts = chunks(text)
                for role in mine:
                    if role["owned"]:
                        yield 1, role["chunk_key"], encoder.encode_bytes(parts[role["pos"]].decode()), None, None, None

        yield from shared.arrow_rows(rows(), kinds)

    @shared.trimming
    def second(batches):
        """The waiting texts: shared chunks come with ids, the others are encoded here, the joins are stitched."""
        import zstandard

        encoder, unpack = tokenizer.loaded(tokenizer_path), zstandard.ZstdDecompressor()

        def rows():
            for key, packed, given in _unpacked(batches):
                known = {g["pos"]: g["data"] for g in given or ()}
                parts = [c.decode() for c in chunks(unpack.decompress(packed))]
                yield result(encoder, key, stitch([(c, known.get(i)) for i, c in enumerate(parts)], encoder.encode_bytes))

        yield from shared.arrow_rows(rows(), kinds)

    schema = "kind byte, key binary, data binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
    step = shared.staged(_packed(texts).hint("merge").join(roles, "text_key", "left").select("text_key", "packed", "roles").mapInArrow(first, schema), "encoded")
    ids_of = shared.staged(step.where("kind = 1").select(F.col("key").alias("chunk_key"), "data").dropDuplicates(["chunk_key"]), "chunk_ids")
    given = shared_chunks.select("text_key", "pos", "chunk_key").distinct().hint("merge").join(ids_of, "chunk_key").groupBy("text_key").agg(F.collect_list(F.struct("pos", "data")).alias("given"))
    waiting = step.where("kind = 2").select(F.col("key").alias("text_key"), "data").hint("merge").join(given, "text_key", "left").select("text_key", "data", "given").mapInArrow(second, schema)
    columns = [F.col("key").alias("text_key"), "n_tokens", "ids_sha256", "decoded_sha256", *(["data"] if keep_ids else [])]
    done = step.where("kind = 0").select(*columns).unionByName(waiting.select(*columns)).dropDuplicates(["text_key"])
    return done.withColumnRenamed("data", "ids") if keep_ids else done


def op7_bpe_chunk_reuse(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    done = shared.staged(encode_texts(docs.select("text"), tokenizer_path or tokenizer.default_path()), "encoded_texts")
    rows = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"))
    return rows.hint("merge").join(done, "text_key").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
