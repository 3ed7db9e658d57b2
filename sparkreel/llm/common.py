"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of the operators' own columns, so that a caller's columns never clash with them.
OWN = "__llm_"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names that folder. Only where it is unset (tests in local mode, one
    machine) a temporary folder is taken.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkreel-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


#: Paths handed out inside scratch(), innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored in the shared folder inside goes at the end: for callers who have stored the result under a path taken before."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.pop()
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark's file systems hold it; nothing if it isn't there."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet at path and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends, lost executors cost no recomputation."""
    return stored(df, shared_dir(df.sparkSession, name))


def text_of(name: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(docs: DataFrame, text: str, *results: str) -> list[str]:
    """docs' columns but for the text and those that bear the name of a result, which give way to it. Spark's names know no case."""
    taken = {c.lower() for c in (text, *results)}
    return [c for c in docs.columns if c.lower() not in taken]


#: joined_by() splits keys of over one in PIECES of all rows: so many keys at most. Below LEAST_PIECE rows nothing is split.
PIECES, LEAST_PIECE = 10_000, 100


def joined_by(rows: DataFrame, groups: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined to groups, a stored table with one row a key and n, its rows on the left side.

    A key that holds many of the rows is split: its rows are dealt out by a hash of themselves over as many salts as it
    fills pieces, and its group stands once for each. Keys that are split are few whatever the size (sum of n over the
    size of a piece, PIECES at most), so they alone are broadcast.
    """
    total = groups.agg(F.sum(n).alias("total")).head().total or 0
    salts = F.ceil(F.col(n) / max(total // PIECES, LEAST_PIECE)).cast("int")
    hot = groups.withColumn(f"{OWN}salts", salts).filter(f"{OWN}salts > 1").select(key, f"{OWN}salts")
    place = F.pmod(F.xxhash64(*rows.columns), F.coalesce(F.col(f"{OWN}salts"), F.lit(1))).cast("int")
    left = rows.join(F.broadcast(hot), key, "left").withColumn(f"{OWN}salt", place).drop(f"{OWN}salts")
    right = groups.withColumn(f"{OWN}salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [key, f"{OWN}salt"]).drop(f"{OWN}salt")


def is_plain_scan(df: DataFrame) -> bool:
    """Whether df is a file relation itself, so that (file, row index) names a row, and no column of its own hides them."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and bool(df.inputFiles()) and not hides_place(df)


def hides_place(df: DataFrame) -> bool:
    """Whether a column bears the name under which Spark gives a row's place."""
    return "_metadata" in (c.lower() for c in df.columns)


def located(df: DataFrame) -> DataFrame:
    """df with the columns __llm_file and __llm_row, which together name one row of stored content.

    A frame that isn't a plain file scan is stored first: the place of a row must not change between passes. So is one
    with a column _metadata, which bears another name meanwhile.
    """
    names = df.columns
    own = [f"{OWN}own_{i}" if c.lower() == "_metadata" else c for i, c in enumerate(names)]
    base = df if is_plain_scan(df) else saved(df.toDF(*own), "content")
    if not is_plain_scan(base):  # an empty table has no files
        placed = base.withColumns({f"{OWN}file": F.lit(""), f"{OWN}row": F.lit(0).cast("long")})
    else:
        placed = base.select("*", F.col("_metadata.file_path").alias(f"{OWN}file"), F.col("_metadata.row_index").alias(f"{OWN}row"))
    return placed if own == names or base is df else placed.toDF(*names, f"{OWN}file", f"{OWN}row")
