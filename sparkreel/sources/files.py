"""Files wherever they lie: listed by Spark, opened and read by range in tasks.

Spark's file index lists paths, globs and folders of any store that it reads, a row a file, without their content. Tasks
open local and mounted paths themselves and other stores by pyarrow's file systems (s3, gs, hdfs); a store that neither
knows takes an opener of its own by `register`.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fnmatch import fnmatch
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.workers import mapped

#: Other names of schemes that pyarrow knows.
SAME = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
_OPENERS: dict[str, Callable] = {}


def register(scheme: str, opener: Callable) -> None:
    """opener(path) gives an object with read, seek and close; it must be known in the workers too."""
    _OPENERS[scheme] = opener


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def local(path: str) -> str:
    """The path of a local file, with or without file: before it."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def opened(path: str):
    """A file to read and seek in."""
    scheme = urlparse(path).scheme
    if scheme in _OPENERS:
        return _OPENERS[scheme](path)
    if is_local(path):
        return open(local(path), "rb")
    store, name = fs.FileSystem.from_uri(path.replace(scheme, SAME.get(scheme, scheme), 1))
    return store.open_input_file(name)


@contextmanager
def opening(path: str) -> Iterator:
    file = opened(path)
    try:
        yield file
    finally:
        file.close()


def matching(path: str, suffix: str = "") -> list[str]:
    """Files that a path, folder (those with the suffix) or glob names, where no Spark session is at hand; globs in file names alone, in other stores."""
    if is_local(path):
        own = local(path)
        return sorted(glob.glob(os.path.join(glob.escape(own), f"*{suffix}")) if os.path.isdir(own) else glob.glob(own))
    scheme = urlparse(path).scheme
    store, name = fs.FileSystem.from_uri(path.replace(scheme, SAME.get(scheme, scheme), 1))
    folder, _, last = name.rpartition("/")
    if store.get_file_info(name).type == fs.FileType.Directory:
        folder, last = name, f"*{suffix}"
    lead = path[: path.index(name)] if name in path else f"{scheme}://"
    found = store.get_file_info(fs.FileSelector(folder)) if any(c in last for c in "*?[") else [store.get_file_info(name)]
    return sorted(lead + x.path for x in found if x.type == fs.FileType.File and fnmatch(x.base_name, last))


def length_of(file) -> int:
    file.seek(0, os.SEEK_END)
    return file.tell()


def listed(spark: SparkSession, path: str | list[str], suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path, length of every file that a path, folder, glob or list of them names. Spark lists no empty ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return found.filter(" or ".join(f"endswith(lower(path), '{s.lower()}')" for s in suffixes)) if suffixes else found


def dealt(rows: DataFrame) -> int:
    """Into how many partitions small rows go that stand for much work each."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def splits(files: DataFrame, size: int) -> DataFrame:
    """files in ranges of size bytes, dealt out: path, length, start, end. An empty file has none.

    The number of partitions is told: rows are a few bytes each, and where Spark may choose it brings them all to one task.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))
    cut = files.filter("length > 0").select("path", "length", F.explode(starts).alias("start"))
    return cut.withColumn("end", F.least(F.col("start") + size, F.col("length"))).repartition(dealt(files), "path", "start")


def scanned(rows: DataFrame, each: Callable[..., Iterator[tuple]], schema: str, columns: tuple[str, ...], held: int = 4096) -> DataFrame:
    """each(file, *columns) gives tuples of the schema, for every row; the file is open at the row's path."""
    kinds = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, made = to_arrow_schema(kinds), []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), arrow, strict=True)], names=arrow.names)
            made.clear()
            return batch

        for batch in batches:
            for path, *own in zip(*(batch.column(c).to_pylist() for c in ("path", *columns)), strict=True):
                with opening(path) as file:
                    for row in each(file, path, *own):
                        made.append(row)
                        if len(made) >= held:
                            yield out()
        if made:
            yield out()

    return mapped(rows.select("path", *columns), run, kinds)
