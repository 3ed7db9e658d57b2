"""Streams of sound at another rate as they come: what each stream's next samples need of the last ones is its state.

A sample is made of `reach` samples on either side. So a batch gives what can be made of the samples so far, and the state
keeps, in RocksDB, the last few samples and how many were made; a stream's end flushes the rest. The result is, at any size of
batch, that of resampling the stream whole.

Defined results: samples of a batch come in any order, batches in order; a gap, samples twice or after the end are errors
of the source; a stream may end without further samples; channels may not change.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkreel.operators import payload
from sparkreel.workers import importable

MADE = "stream_index long, pos long, data array<array<float>>"


class Resampling(StatefulProcessor):
    def __init__(self, rate: int, wanted: int):
        self.rate, self.wanted, self.reach = rate, wanted, payload.reach_of(rate, wanted)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "first long, total long, made long, channels long, held array<double>, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        first, total, made, channels, held, ended = self.state.get() if self.state.exists() else (0, 0, 0, 0, [], False)
        batch = pd.concat(list(rows)).sort_values(["pos", "is_last"], kind="stable")
        parts = [np.array(held, np.float64).reshape(channels, -1)] if channels else []
        for pos, data, is_last in zip(batch.pos, batch.data, batch.is_last, strict=True):
            own = np.array([np.asarray(c, np.float64) for c in data] if data is not None else [], np.float64)
            if own.size:
                if ended or pos != total or (channels and len(own) != channels):
                    raise ValueError(f"stream {key[0]}: {len(own)} channels at {pos}, where {channels or 'any'} at {total} are next" + " after its end" * ended)
                channels, total = len(own), total + own.shape[1]
                parts.append(own)
            ended = ended or bool(is_last)
        part, ratio = np.concatenate(parts, 1) if parts else np.zeros((0, 0)), self.rate / self.wanted
        end = payload.resampled_size(total, self.rate, self.wanted) if ended else max(made, math.ceil((total - self.reach) / ratio))
        if end > made and channels:
            out = payload.resample_span(part, first, self.rate, self.wanted, made, end)
            yield pd.DataFrame({"stream_index": [key[0]], "pos": [made], "data": [out.tolist()]})
            made = end
        # the next sample reaches back so far
        keep = max(first, min(total, math.floor(made * ratio) - self.reach + 1))
        self.state.update((keep, total, made, channels, [] if ended else part[:, keep - first :].ravel().tolist(), ended))

    def close(self) -> None:
        pass


def resample_stream(parts: DataFrame, rate: int, wanted: int) -> DataFrame:
    """parts: a streaming frame of stream_index, pos (of the first sample), data (channels of samples), is_last. stream_index, pos, data at the wanted rate."""
    if rate <= 0 or wanted <= 0:
        raise ValueError(f"sample rates are above zero, not {rate} and {wanted}")
    importable(parts.sparkSession)
    own = parts.select(F.col("stream_index").cast("long").alias("stream_index"), "pos", F.col("data").cast("array<array<double>>").alias("data"), "is_last")
    return own.groupBy("stream_index").transformWithStateInPandas(statefulProcessor=Resampling(rate, wanted), outputStructType=MADE, outputMode="Append", timeMode="None")
