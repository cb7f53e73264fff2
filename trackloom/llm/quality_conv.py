"""Quality classifier: a byte-level convolutional network in numpy.

Overlapping chunks cover the whole document. In each chunk a bank of learned filters runs over byte embeddings and is
max-pooled. The chunks' features are pooled again over the document, by maximum and mean, and combined into one
probability.

Edge cases: repeated rows are scored once each and alike; a text of any length is read in slices of its chunks; null or empty text has all-zero features and gets the bias' probability; without rows of both label
values there is nothing to learn, and every score is the share of label 1 (1 without labels); a label of null is no label; an
empty table gives no rows; other columns are ignored by the score and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import byte_models, shared

CHUNK, STRIDE, EMBED, KERNEL, STEP, FILTERS = 512, 480, 6, 16, 4, 24
#: bounds of the training sample: rows a label, windows a row
PER_LABEL, WINDOWS, EPOCHS, LEAST_STEPS = 1500, 3, 12, 360
THRESHOLD, HELD_MODULUS, HELD_REMAINDER = 0.7, 4, 2


class ConvNet:
    def __init__(self, seed: int = 8):
        r = np.random.default_rng(seed)
        n = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        self.params = {
            "embed": n(256, EMBED, by=0.5), "conv": n(KERNEL * EMBED, FILTERS, by=0.25), "conv_b": np.zeros(FILTERS, np.float32),
            "out": n(2 * FILTERS, by=0.1), "out_b": np.zeros(1, np.float32),
        }

    def _columns(self, chunks: np.ndarray) -> np.ndarray:
        """The unrolled byte windows."""
        e = self.params["embed"][chunks]
        steps = (CHUNK - KERNEL) // STEP + 1
        s = e.strides
        wide = np.lib.stride_tricks.as_strided(e, (len(chunks), steps, KERNEL * EMBED), (s[0], STEP * s[1], s[2]))
        return np.ascontiguousarray(wide).reshape(-1, KERNEL * EMBED)

    def features(self, chunks: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Max-pooled filter outputs of each chunk."""
        p = self.params
        wide = self._columns(chunks)
        a = (wide @ p["conv"]).reshape(len(chunks), -1, FILTERS) + p["conv_b"]
        if kept is None:
            return np.maximum(a.max(1), 0)
        i = a.argmax(1)
        out = a[np.arange(len(chunks))[:, None], i, np.arange(FILTERS)]
        kept.update(wide=wide.reshape(len(chunks), -1, KERNEL * EMBED), i=i, pre=out)
        return np.maximum(out, 0)

    @staticmethod
    def pooled(features: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best, total, count = np.zeros((n, features.shape[1]), np.float32), np.zeros((n, features.shape[1]), np.float32), np.bincount(owner, minlength=n)
        np.maximum.at(best, owner, features)
        np.add.at(total, owner, features)
        return best, total, count

    def probability(self, best: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.concatenate([best, total / np.maximum(count, 1)[:, None]], 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.params["out"] + self.params["out_b"], -30, 30)))

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, kept, n = self.params, {}, len(y)
        f = self.features(chunks, kept)
        best, total, count = self.pooled(f, owner, n)
        x = np.concatenate([best, total / np.maximum(count, 1)[:, None]], 1)
        d = ((self.probability(best, total, count) - y) / n).astype(np.float32)
        dx = d[:, None] * p["out"]
        k = f.shape[1]
        df = (dx[:, :k][owner] * (f == best[owner]) + dx[:, k:][owner] / count[owner, None]) * (kept["pre"] > 0)
        rows = np.arange(len(chunks))[:, None]
        wide = kept["wide"][rows, kept["i"]]  # chunk, filter, window
        at = chunks[rows[:, :, None], kept["i"][:, :, None] * STEP + np.arange(KERNEL)]
        de = np.zeros_like(p["embed"])
        np.add.at(de, at, (df[:, :, None] * p["conv"].T[None]).reshape(*at.shape, EMBED))
        return {"embed": de, "conv": np.einsum("cf,cfw->wf", df, wide), "conv_b": df.sum(0), "out": x.T @ d + 1e-4 * p["out"], "out_b": d.sum(keepdims=True)}


def fit(sample: list[tuple[int, list[str]]], epochs: int = EPOCHS, seed: int = 8) -> ConvNet | float:
    """The network, or a constant score if only one label value is there."""
    ones = sum(1 for y, _ in sample if y)
    if ones in (0, len(sample)):
        return ones / len(sample) if sample else 1.0
    r, net = np.random.default_rng(seed), ConvNet(seed)
    matrix, _ = byte_models.window_matrix([w for _, ws in sample for w in ws], CHUNK)
    doc = np.repeat(np.arange(len(sample)), [len(ws) for _, ws in sample])
    y = np.array([y for y, _ in sample], np.float32)
    firsts = np.searchsorted(doc, np.arange(len(sample) + 1))
    adam, size = byte_models.Adam(net.params, 0.01), 64
    a_pass = -(-len(sample) // size)
    epochs = max(epochs, -(-LEAST_STEPS // a_pass))
    steps = epochs * a_pass
    for epoch in range(epochs):
        order = r.permutation(len(sample))
        for at in range(0, len(order), size):
            docs = order[at : at + size]
            rows = np.concatenate([np.arange(firsts[d], firsts[d + 1]) for d in docs])
            owner = np.repeat(np.arange(len(docs)), firsts[docs + 1] - firsts[docs])
            adam.step(net.gradients(matrix[rows], owner, y[docs]), max(0.05, 1 - adam.t / steps))
    return net


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> list[tuple[int, list[str]]]:
    """A bounded sample of labelled rows whose crc32 remainder is not held out."""
    known = labels.where(F.col("quality").isNotNull() & (shared.crc_remainder("doc_id", HELD_MODULUS) != HELD_REMAINDER))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, per_label / c))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(81)), F.lit(1_000_003)) / 1_000_003.0 < share[F.col("quality")])
    # about per_label rows a label, counted before they are broadcast
    rows = docs.select("doc_id", "text").join(shared.sized(shared.staged(chosen, "chosen"), 8 * per_label), "doc_id")
    return byte_models.sampled_windows(rows, "quality", 2 * per_label, WINDOWS, CHUNK, 82)


def scores(docs: DataFrame, net: ConvNet | float, keep_text: bool = False) -> DataFrame:
    """The columns of `docs`, the text only if asked for, with score."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    # by position, so any names may stand beside the text and the score
    names = [f"c{i}" for i in range(len(fields))]

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for piece in byte_models.slices(batch):
                n = len(piece)
                if isinstance(model, float):
                    found = np.full(n, model)
                else:
                    best = np.zeros((n, FILTERS), np.float32)
                    total, count = np.zeros_like(best), np.zeros(n, np.int64)
                    for chunks, _, owner, _ in byte_models.chunked(piece.column(at), CHUNK, STRIDE, 256):
                        low, high = owner[0], owner[-1] + 1
                        b, t, c = model.pooled(model.features(chunks), owner - low, high - low)
                        best[low:high] = np.maximum(best[low:high], b)
                        total[low:high] += t
                        count[low:high] += c
                    found = model.probability(best, total, count)
                kept = [c for i, c in enumerate(piece.columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.float64())], [*names, "score"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True))
    scored = docs.mapInArrow(run, f"{schema}, score double")
    return scored.select(*(F.col(n).alias(f.name) for n, f in zip(names, fields, strict=True)), "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns of `docs`; texts go to Python once and come back."""
    net = fit(training_sample(docs, labels))
    numbered = docs.toDF(*("text" if c == "text" else f"in{i}" for i, c in enumerate(docs.columns)))
    scored = scores(numbered, net, keep_text=True)
    return scored.where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)


def op8_quality_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(training_sample(docs, shared.table(spark, sf_dir, "labels")))
    held_out = F.coalesce(shared.crc_remainder("doc_id", HELD_MODULUS) == HELD_REMAINDER, F.lit(False))
    return scores(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
