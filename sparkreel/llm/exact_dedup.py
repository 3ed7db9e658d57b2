"""Exact dedup by stateful streaming: DataFrame operations only.

Documents are equal when their texts agree after the characters of ``[\\x20\\x09-\\x0D]`` are deleted; a null text
counts as empty. A slim table (digest, identifier, length, content locator) is read as a stream. RocksDB state, keyed
by digest, without watermark or expiry, retains for each digest how many rows were seen, the identifier of the row
that stays and the locator (file, row index) of its content. Where a digest was hit more than once, the full bytes
behind it are compared: those rows are grouped by (digest, normalised bytes), where map-side combining folds a group of
copies, however large, to a row per task. A digest with two different byte strings is regrouped by its bytes. Rows meet
the state by a join that splits digests of very many rows.

Defined results: an empty table gives an empty result; empty texts are one group; rows that repeat an identifier are
rows of their own, told apart by locator; a null identifier sorts last; extra columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import OWN, joined_by, located, saved, shared_dir, text_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # one bound for the native memory of all state partitions of an executor
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # no space set aside in advance: state partitions are many and may be small
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests with more than one row are broadcast up to so many (32 bytes each), counted before; beyond that their texts are shuffled.
MOST_BROADCAST = 2_000_000


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def rank_of(length: Column, doc_id: Column, *place: Column) -> Column:
    """The smallest stays: most code points, then the smallest identifier, then the first place."""
    return F.struct((-length).alias("n"), doc_id.isNull().alias("no_id"), doc_id.alias("id"), *(p.alias(k) for p, k in zip(place, ("file", "row"), strict=True)))


def run_state(spark: SparkSession, source: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """The state after the stream of the table at source (digest, best) has ended: digest, n, best."""
    out = shared_dir(spark, "state")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        keyed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        state = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("best"))

        def upsert(batch: DataFrame, number: int) -> None:
            # a batch that is run again after a failure replaces its own folder
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = state.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", shared_dir(spark, "stream")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if query.lastProgress is None:
        return spark.createDataFrame([], state.schema)
    changes = spark.read.schema(state.schema).parquet(f"{out}/*")
    return changes.groupBy("digest").agg(F.max("n").alias("n"), F.max_by("best", "n").alias("best"))


def classify(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, and the row's locator (__llm_file, __llm_row)."""
    return classify_located(located(docs), **options)


def classify_located(rows: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int = 1000, text: str = "text", doc_id: str = "doc_id", most: int = MOST_BROADCAST) -> DataFrame:
    file, row = F.col(f"{OWN}file"), F.col(f"{OWN}row")
    own = rank_of(F.length(text_of(text)), F.col(doc_id), file, row)
    spark, source = rows.sparkSession, shared_dir(rows.sparkSession, "digests")
    digests = rows.select(digest(normalised(text)).alias("digest"), own.alias("best"))
    digests.write.parquet(source)
    slim = spark.read.schema(digests.schema).parquet(source)
    state = saved(run_state(spark, source, slim.schema, files_per_trigger), "state")
    found = joined_by(slim.withColumnRenamed("best", "own"), state, "digest")

    hits = state.filter("n > 1").select("digest")
    if hits.limit(most + 1).count() <= most:
        hits = F.broadcast(hits)
    whole = rows.select(digest(normalised(text)).alias("digest"), normalised(text).alias("whole")).join(hits, "digest", "left_semi")
    texts = whole.groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    clashes = saved(texts.filter("texts > 1").select("digest"), "clashes")
    if not clashes.isEmpty():
        exact = rows.select(digest(normalised(text)).alias("digest"), normalised(text).alias("whole"), own.alias("own")).join(clashes, "digest", "left_semi")
        groups = saved(exact.groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("best")), "clashing")
        again = joined_by(exact, groups, "whole").select("digest", "own", "n", "best")
        found = found.join(clashes, "digest", "left_anti").select("digest", "own", "n", "best").unionByName(again)
    stays = (F.col("own.file") == F.col("best.file")) & (F.col("own.row") == F.col("best.row"))
    return found.select(
        F.col("own.id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"),
        "digest", F.col("own.file").alias(f"{OWN}file"), F.col("own.row").alias(f"{OWN}row"),
    )


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with docs' own columns."""
    rows = located(docs)
    dropped = classify_located(rows, **options).filter(~F.col("kept")).select(f"{OWN}file", f"{OWN}row")
    return rows.join(dropped, [f"{OWN}file", f"{OWN}row"], "left_anti").select(*docs.columns)
