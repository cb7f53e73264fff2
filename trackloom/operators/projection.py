"""The slot projector: a slot's pooled tokens less their constant part, through a linear map, normalised, and gated by the normal distribution."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.schema import FRAME, KEY

#: added to a slot's variance before it is normalised
LEAST_VARIANCE = 1e-5
_erf = np.frompyfunc(math.erf, 1, 1)


class Projector(NamedTuple):
    """weight (model x tokens * width), bias, scale and shift (model), and the constant part of the tokens (tokens x width); a few MB, sent with the task."""

    weight: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    constant: np.ndarray

    def apply(self, slots: np.ndarray) -> np.ndarray:
        """Lines of tokens one after the other to lines of the model's width."""
        x = (slots - self.constant.ravel()) @ self.weight.T + self.bias
        x = x - x.mean(1, keepdims=True)
        x = x / np.sqrt((x * x).mean(1, keepdims=True) + LEAST_VARIANCE) * self.scale + self.shift
        return 0.5 * x * (1 + _erf(x / math.sqrt(2)).astype(np.float64))


def projected(tokens: DataFrame, projector: Projector, column: str = "e") -> DataFrame:
    """(video_id, slot, e) of pooled tokens (video_id, slot, token, e), all of a slot's tokens in order; a slot that lacks one, or has one too many, is an error."""
    count, width = projector.constant.shape
    slots = tokens.groupBy(KEY, FRAME).agg(F.sort_array(F.collect_list(F.struct("token", column))).alias("_s"))
    whole = (F.size("_s") == count) & F.forall("_s", lambda t: F.size(t[column]) == width)
    flat = F.flatten(F.transform("_s", lambda t: t[column]))
    checked = slots.select(KEY, FRAME, F.when(whole, flat).otherwise(F.raise_error(F.concat(F.lit("a slot of "), KEY, F.lit(f" has not {count} tokens of {width}")))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = projector.apply(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(made), pa.list_(pa.float64()))], [KEY, FRAME, "e"])

    return checked.mapInArrow(run, f"{KEY} string, {FRAME} long, e array<double>")
