"""Streams of packets that arrive over time: the index as it grows, cursors that read on frame by frame, samples cut to frames.

State is kept by stream in RocksDB, so it may outgrow memory. Packets of a stream must arrive in order of pts up to
`allowed` ticks; what is older than that is an error of the source and is counted, not guessed at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkreel.workers import importable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INDEXED = "stream_index long, frame_index long, pts long, is_key boolean, gop_id long"


def use_rocksdb(spark) -> None:
    """State that lives on disk; small state partitions take no space in advance."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")


class FrameNumbering(StatefulProcessor):
    """Numbers each stream's frames as they come, and counts its key frames."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "frames long, keys long, last_pts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frames, keys, last = self.seen.get() if self.seen.exists() else (0, 0, -(2**63))
        batch = pd.concat(list(rows)).sort_values(["pts", "seq"], kind="stable")
        if batch.pts.iloc[0] < last:
            raise ValueError(f"stream {key[0]}: a packet at {batch.pts.iloc[0]} came after one at {last}")
        flags = batch.is_key.astype("int64").cumsum()
        yield pd.DataFrame({"stream_index": key[0], "frame_index": range(frames, frames + len(batch)), "pts": batch.pts.to_numpy(), "is_key": batch.is_key.to_numpy(), "gop_id": (keys + flags - 1).to_numpy()})
        self.seen.update((frames + len(batch), keys + int(flags.iloc[-1]), int(batch.pts.iloc[-1])))

    def close(self) -> None:
        pass


def frame_index_stream(packets: DataFrame) -> DataFrame:
    """packets: a streaming frame of stream_index, seq, pts, is_key, is_discard. Each frame once, numbered."""
    importable(packets.sparkSession)
    live = packets.filter(~F.col("is_discard")).select(F.col("stream_index").cast("long").alias("stream_index"), "seq", "pts", "is_key")
    return live.groupBy("stream_index").transformWithStateInPandas(statefulProcessor=FrameNumbering(), outputStructType=INDEXED, outputMode="Append", timeMode="None")


class Reading(StatefulProcessor):
    """Hands out each stream's frames at or after its cursor, in order."""

    def __init__(self, cursors: dict[int, int]):
        self.cursors = cursors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        at = self.cursor.get()[0] if self.cursor.exists() else self.cursors.get(key[0], -(2**63))
        batch = pd.concat(list(rows)).sort_values(["pts", "seq"], kind="stable")
        found = batch[batch.pts >= at]
        if len(found):
            self.cursor.update((int(found.pts.iloc[-1]) + 1,))
            yield pd.DataFrame({"stream_index": key[0], "pts": found.pts.to_numpy()})

    def close(self) -> None:
        pass


def read_on(packets: DataFrame, cursors: dict[int, int] | None = None) -> DataFrame:
    """Frames from each stream's cursor on (from its start where none is given), none of them twice: stream_index, pts. cursors: the streams someone has sought in, few."""
    importable(packets.sparkSession)
    live = packets.filter(~F.col("is_discard")).select(F.col("stream_index").cast("long").alias("stream_index"), "seq", "pts")
    return live.groupBy("stream_index").transformWithStateInPandas(statefulProcessor=Reading(cursors or {}), outputStructType="stream_index long, pts long", outputMode="Append", timeMode="None")


class Rechunking(StatefulProcessor):
    """Frames of one size from samples that come as they come; what is left over waits for more, and goes out short when its stream ends."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "frames long, samples array<double>, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frames, samples, ended = self.held.get() if self.held.exists() else (0, [], False)
        if ended:
            raise ValueError(f"stream {key[0]}: samples came after its end")
        batch = pd.concat(list(rows)).sort_values("pos", kind="stable")
        left = [*samples, *(x for part in batch.samples for x in part)]
        ended = bool(batch.is_last.any())
        whole = len(left) // self.size * self.size
        cuts = [left[at : at + self.size] for at in range(0, len(left) if ended else whole, self.size)]
        self.held.update((frames + len(cuts), [] if ended else left[whole:], ended))
        if cuts:
            yield pd.DataFrame({"stream_index": key[0], "frame": range(frames, frames + len(cuts)), "samples": cuts})

    def close(self) -> None:
        pass


def rechunk_stream(parts: DataFrame, size: int) -> DataFrame:
    """parts: a streaming frame of stream_index, pos, samples (array<double>), is_last. Frames of size samples; the last one of a stream may be short."""
    importable(parts.sparkSession)
    own = parts.select(F.col("stream_index").cast("long").alias("stream_index"), "pos", "samples", "is_last")
    return own.groupBy("stream_index").transformWithStateInPandas(statefulProcessor=Rechunking(size), outputStructType="stream_index long, frame long, samples array<double>", outputMode="Append", timeMode="None")


def stream_bounds_stream(packets: DataFrame) -> DataFrame:
    """Begin, end and number of frames of each stream so far: built-in state, update mode."""
    from sparkreel.operators.index import stream_bounds

    return stream_bounds(packets)
