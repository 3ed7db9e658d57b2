"""Data sources and backends."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Makes the formats 'wav', 'y4m', 'rawframes' and 'packets' known to a session."""
    from sparkreel.sources import raw, sink, wav, y4m
    from sparkreel.workers import importable

    importable(spark)
    for source in (wav.WavSource, y4m.Y4mSource, raw.RawFramesSource, sink.PacketSink):
        spark.dataSource.register(source)
