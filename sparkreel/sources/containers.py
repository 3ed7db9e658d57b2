"""Packets of media files of any known kind, side by side, and what kind a file is by its first bytes.

    containers.packets(spark, "/dir")       # MP4, Matroska, MPEG-TS and bare audio streams side by side
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.sources import elementary, files, matroska, mp4, mpegts

#: By kind: the module that reads it.
READERS = {"mp4": mp4, "matroska": matroska, "mpegts": mpegts, "audio": elementary}
#: What every reader's packets have.
COLUMNS = ("source", "stream_index", "media_type", "seq", "pts", "dts", "duration", "is_key", "is_discard", "tb_num", "tb_den")


def kind_of(head: bytes) -> str | None:
    """The kind of file that begins with these bytes; None where nothing here reads it."""
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip", b"styp"):
        return "mp4"
    if head[:4] == matroska.EBML.to_bytes(4, "big"):
        return "matroska"
    if len(head) > mpegts.SIZE and head[0] == mpegts.SYNC and head[mpegts.SIZE] == mpegts.SYNC:
        return "mpegts"
    if head[:3] == b"ID3" or head[:4] == b"fLaC" or elementary.adts(head, 0) or elementary.mpeg(head, 0):
        return "audio"
    return None


def probed_rows(file, path: str) -> Iterator[tuple]:
    yield path, kind_of(file.read(4 * mpegts.SIZE))


def probed(spark: SparkSession, path) -> DataFrame:
    """source, kind of every file, by its first bytes; kind is null where nothing here reads it."""
    return files.scanned(files.listed(spark, path), probed_rows, "source string, kind string", ())


def packets(spark: SparkSession, path) -> DataFrame:
    """Packets of all files, in their own time bases, with kind. Files go by their names' suffixes; probed() tells which ones bear a wrong one."""
    found = None
    for kind, reader in READERS.items():
        own = reader.packets(spark, path).select(*COLUMNS, F.lit(kind).alias("kind"))
        found = own if found is None else found.unionByName(own)
    return found
