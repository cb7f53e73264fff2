"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Trained by backpropagation through time on windows of a bounded sample. Whole texts are cut into chunks that overlap
by a warm-up margin on both sides; every byte position gets label probabilities from the forward and the backward
state, and a document's are the mean over its positions.

Edge cases: null text, or text without a letter, is `und` with score 0; without any learned label all are `und`;
rows of null lang are never learned from; of more than 256 label values the most frequent are learned, so rarer ones are
never predicted; repeated rows are predicted alike; a text of any length is read whole, chunk by chunk; ties go to the
label that sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import byte_models, shared

HIDDEN, CHUNK, MARGIN = 8, 128, 16
CORE = CHUNK - 2 * MARGIN
#: bounds of the training sample: rows a language, windows a row
PER_LABEL, WINDOWS, WIDTH, STEPS, BATCH = 700, 2, 96, 240, 192
UNKNOWN, HELD_MODULUS, HELD_REMAINDER = "und", 3, 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class BiGru:
    """Gates stand in rows (update, reset, candidate), sequences in columns; sigmoids are half-angle tanh."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 3):
        r = np.random.default_rng(seed)
        n = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.params = {}
        for side in ("f", "b"):
            self.params |= {f"x{side}": n(256, 3 * hidden, by=0.3), f"u{side}": n(3 * hidden, hidden, by=hidden**-0.5), f"o{side}": n(len(labels), hidden, by=0.3)}
        self.params["bias"] = np.zeros(len(labels), np.float32)

    def states(self, data: np.ndarray, side: str, kept: list | None = None) -> np.ndarray:
        """[T, hidden, B] states of bytes [T, B]; the backward side reads from the end."""
        h, u, x = self.hidden, self.params[f"u{side}"], self.params[f"x{side}"]
        steps = range(len(data)) if side == "f" else range(len(data) - 1, -1, -1)
        out = np.empty((len(data), h, data.shape[1]), np.float32)
        s = np.zeros((h, data.shape[1]), np.float32)
        table = np.ascontiguousarray(x.T)
        for t in steps:
            g = table[:, data[t]]
            r = u @ s
            gates = np.tanh(0.5 * (g[: 2 * h] + r[: 2 * h]))
            gates *= 0.5
            gates += 0.5
            z, q = gates[:h], gates[h:]
            c = np.tanh(g[2 * h :] + q * r[2 * h :])
            if kept is not None:
                kept.append((t, s, z, q, c, r[2 * h :]))
            s = c + z * (s - c)
            out[t] = s
        return out

    def logits(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """[T, labels, B]."""
        p = self.params
        return np.matmul(p["of"], forward) + np.matmul(p["ob"], backward) + p["bias"][:, None]

    def gradients(self, data: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy over all valid positions [T, B], and its gradients through time."""
        p, h = self.params, self.hidden
        kept = {"f": [], "b": []}
        state = {s: self.states(data, s, kept[s]) for s in "fb"}
        logit = self.logits(state["f"], state["b"])
        logit -= logit.max(1, keepdims=True)
        e = np.exp(logit)
        prob = e / e.sum(1, keepdims=True)
        n = max(1, int(valid.sum()))
        hot = np.eye(len(self.labels), dtype=np.float32)[:, y]
        loss = float(-(np.log((prob * hot).sum(1) + 1e-9) * valid).sum() / n)
        d = (prob - hot) * (valid[:, None, :] / n).astype(np.float32)
        grads = {"bias": d.sum((0, 2))}
        for side in "fb":
            grads[f"o{side}"] = np.einsum("tcb,thb->ch", d, state[side])
            u = p[f"u{side}"]
            du, dx, back = np.zeros_like(u), np.zeros((256, 3 * h), np.float32), np.zeros_like(state[side][0])
            for t, before, z, q, c, r in reversed(kept[side]):
                ds = back + p[f"o{side}"].T @ d[t]
                dc = ds * (1 - z) * (1 - c * c)
                dz = ds * (before - c) * z * (1 - z)
                dq = dc * r * q * (1 - q)
                rec = np.concatenate([dz, dq, dc * q])
                du += rec @ before.T
                np.add.at(dx, data[t], np.concatenate([dz, dq, dc]).T)
                back = ds * z + u.T @ rec
            grads[f"u{side}"], grads[f"x{side}"] = du, dx
        return loss, grads

    def position_probabilities(self, data: np.ndarray) -> np.ndarray:
        logit = self.logits(self.states(data, "f"), self.states(data, "b"))
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        return logit


def fit(sample: list[tuple[str, list[str]]], steps: int = STEPS, seed: int = 3) -> BiGru | None:
    labels = sorted({k for k, _ in sample})
    rows = [(labels.index(k), w) for k, ws in sample for w in ws if w]
    if not rows:
        return None
    data, lengths = byte_models.window_matrix([w for _, w in rows], WIDTH)
    y = np.array([k for k, _ in rows])
    by_label = [np.flatnonzero(y == k) for k in range(len(labels))]
    by_label = [x for x in by_label if len(x)]
    net, r = BiGru(labels, seed=seed), np.random.default_rng(seed)
    adam = byte_models.Adam(net.params, 0.02)
    data = _FOLD[data]
    for step in range(steps):
        chosen = np.concatenate([r.choice(x, -(-BATCH // len(by_label))) for x in by_label])
        valid = np.arange(WIDTH)[:, None] < lengths[chosen]
        _, grads = net.gradients(np.ascontiguousarray(data[chosen].T), valid, y[chosen])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        adam.step({k: g * np.float32(min(1, 1 / (norm + 1e-9))) for k, g in grads.items()}, max(0.1, 1 - step / steps))
    return net


def training_sample(docs: DataFrame, per_label: int = PER_LABEL) -> list[tuple[str, list[str]]]:
    """Windows of a bounded number of rows a language, of those that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (shared.crc_remainder("doc_id", HELD_MODULUS) != HELD_REMAINDER))
    return byte_models.sampled_windows(rows.select("doc_id", "text", "lang"), "lang", per_label, WINDOWS, WIDTH, 31)


def own_positions(lengths: np.ndarray, number: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which positions of each chunk count: without the margins, but for a text's start and end; each byte counts once."""
    at, last = np.arange(CHUNK), number * CORE + lengths == sizes
    return (at >= np.where(number == 0, 0, MARGIN)[:, None]) & (at < np.where(last, lengths, CHUNK - MARGIN)[:, None])


def predict(docs: DataFrame, net: BiGru | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    kind = shared.kind_of(docs, "doc_id")

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for piece in byte_models.slices(batch):
                total = np.zeros((len(piece), len(model.labels) if model else 1))
                if model:
                    sizes = np.diff(byte_models.text_bytes(piece.column(1))[1])
                    for chunks, lengths, owner, number in byte_models.chunked(piece.column(1), CHUNK, CORE, 1024):
                        prob = model.position_probabilities(np.ascontiguousarray(_FOLD[chunks].T))
                        counts = own_positions(lengths, number, sizes[owner])
                        np.add.at(total, owner, np.einsum("tcb,bt->bc", prob, counts.astype(np.float32)))
                sums = total.sum(1)
                shares = total / np.maximum(sums, 1e-9)[:, None]
                best = shares.argmax(1)
                known = np.array(piece.column(2).to_pylist(), bool) & (sums > 0)
                names = [model.labels[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(shares[np.arange(len(piece)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select("doc_id", "text", letter).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op3_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    net = fit(training_sample(docs.select("doc_id", "text", "lang")))
    held_out = F.coalesce(shared.crc_remainder("doc_id", HELD_MODULUS) == HELD_REMAINDER, F.lit(False))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
