"""What the byte-level models share: bounded training samples, chunk matrices over whole texts, and the Adam step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: label values that are learned at most
MOST_LABELS = 256


def sampled_windows(rows: DataFrame, label: str, per_label: int, windows: int, chars: int, seed: int, most_labels: int = MOST_LABELS) -> list[tuple[object, list[str]]]:
    """About `per_label` rows of each label value, chosen by hash, each as up to `windows` windows of its text.

    This bounds what the driver trains on: per_label * windows * chars characters a label, for the `most_labels` most
    frequent labels. `rows` has doc_id, text and the label column.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, per_label / c))])
    place = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0)
    text = F.coalesce(F.col("text"), F.lit(""))
    free = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    parts = F.array_distinct(F.array(*[F.substring(text, (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + k)), free) + 1).cast("int"), F.lit(chars)) for k in range(windows)]))
    return [(r[0], list(r[1])) for r in rows.where(place < share[F.col(label)]).select(label, parts).collect()]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes and their len + 1 offsets; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunked(texts: pa.Array, width: int, stride: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Matrices of at most `most` overlapping chunks: (bytes, valid length, text index, chunk number). Covers all bytes."""
    data, offsets = text_bytes(texts)
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - width) // stride)), 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + number * stride
    lengths = np.minimum(width, offsets[owner + 1] - starts)
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    for at in range(0, len(owner), most):
        part = slice(at, at + most)
        matrix = view[starts[part]]
        matrix[np.arange(width) >= lengths[part, None]] = 0
        yield matrix, lengths[part], owner[part], number[part]


def slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded size."""
    rows = max(1, int(len(batch) * most / max(most, batch.nbytes)))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def window_matrix(windows: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    out, lengths = np.zeros((len(windows), width), np.uint8), np.zeros(len(windows), np.int64)
    for i, w in enumerate(windows):
        raw = np.frombuffer(w.encode()[:width], np.uint8)
        out[i, : len(raw)] = raw
        lengths[i] = len(raw)
    return out, lengths


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.params[k] -= (self.rate * scale * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
