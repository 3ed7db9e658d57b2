"""Packets written as container files while they come: a task holds what a file needs at its end, never its samples.

    sink.write(packets, "/dir", "mp4")

packets: the columns of PACKETS and data. There is a file for each source; Spark brings a source's packets together and
sorts them by time, so streams are interleaved, and each format's writer lays them down one after the other.
"""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from sparkreel.schema import PACKETS
from sparkreel.sources import files
from sparkreel.sources.wav import FileWriter, _Written, part_path
from sparkreel.workers import importable

#: By format: the suffix and the class that writes a file; the modules below add theirs.
FORMATS: dict[str, tuple[str, type]] = {}
MODULES = {"mp4": "mp4", "matroska": "matroska", "mpegts": "mpegts", "adts": "elementary"}


class OpenFile:
    """A file under way: made of an open file, takes rows by add(), ends with close()."""

    def __init__(self, file):
        self.file = file

    def add(self, row) -> None:
        raise NotImplementedError

    def close(self) -> None:
        """What the file needs at its end."""


class PacketWriter(FileWriter):
    """Rows of a source stand together, in the order in which they are stored."""

    def __init__(self, options: dict):
        self.path, self.format = files.local(options["path"]), options["container"]

    def write(self, iterator):
        importlib.import_module(f"sparkreel.sources.{MODULES[self.format]}")
        suffix, kind = FORMATS[self.format]
        os.makedirs(self.path, exist_ok=True)
        made, source, file, own, seen = [], None, None, None, set()

        def end():
            if own is not None:
                own.close()
                file.close()

        for row in iterator:
            if own is None or source != row.source:
                end()
                if row.source in seen:
                    raise ValueError(f"packets of {row.source} don't stand together: write what interleaved() gives")
                source, path = row.source, os.path.join(self.path, os.path.basename(row.source) + suffix)
                seen.add(source)
                made.append((part_path(path), path))
                file = open(made[-1][0], "wb")
                own = kind(file)
            own.add(row)
        end()
        return _Written(made)


class PacketSink(DataSource):
    @classmethod
    def name(cls):
        return "packets"

    def schema(self):
        return PACKETS + ", data binary"

    def writer(self, schema, overwrite):
        return PacketWriter(self.options)


def interleaved(packets: DataFrame) -> DataFrame:
    """packets as PacketWriter wants them: a file's together, streams interleaved by time."""
    at = F.col("dts").cast("double") * F.col("tb_num") / F.col("tb_den")
    return packets.repartition("source").withColumn("at", at).sortWithinPartitions("source", "at", "stream_index", "dts", "seq").drop("at")


def write(packets: DataFrame, path: str, container: str) -> None:
    if container not in MODULES:
        raise ValueError(f"{container} is none of {', '.join(MODULES)}")
    spark = packets.sparkSession
    spark.dataSource.register(PacketSink)
    importable(spark)
    columns = [c.split(" ")[0] for c in f"{PACKETS}, data binary".split(", ")]
    interleaved(packets.select(*columns)).write.format("packets").option("container", container).mode("append").save(path)
