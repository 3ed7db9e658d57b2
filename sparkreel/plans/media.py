"""The driver's tables as media: events are packets of a stream per user, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.operators import index
from sparkreel.sources import sink
from sparkreel.workers import shared_dir

#: Ticks are microseconds from here on.
EPOCH = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_index"), F.col("event_id").alias("seq"), (F.unix_micros(ts) - EPOCH).alias("pts"), F.col("event_id").alias("dts"),
        F.round(F.col("value") * 1e9).cast("long").alias("duration"), (F.col("event_type") == "signup").alias("is_key"), (F.col("event_type") == "error").alias("is_discard"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.frame_index(packets(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str, count: int = 7, beyond: int = 0) -> DataFrame:
    """For each stream, count instants spread over its content: stream_index, request_id, t (ticks)."""
    bounds = packets(spark, sf_dir).filter("not is_discard").groupBy("stream_index").agg(F.min("pts").alias("b"), F.max("pts").alias("e"))
    each = bounds.select("stream_index", "b", "e", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("request_id"))
    return each.select("stream_index", "request_id", F.expr(f"b + ((e - b) * request_id) div {count} + {beyond}").alias("t"))


def index_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices asked of each stream, unordered, repeated and from the end: stream_index, pos, idx."""
    streams = packets(spark, sf_dir).filter("not is_discard").select("stream_index").distinct()
    wanted = F.array(*[F.lit(x).cast("long") for x in (5, 2, -1, 2, 0, -2)])
    return streams.select("stream_index", F.posexplode(wanted).alias("pos", "idx"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as streams of containers, with header fields that are missing now and then."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    k = F.col("l_partkey")
    gap = lambda x, m: F.when(k % m != 0, x)
    return li.select(
        F.col("l_orderkey").alias("source"), n.alias("stream_index"), F.when(n % 3 == 0, "audio").when(n % 3 == 1, "video").otherwise("other").alias("media_type"), F.col("l_returnflag").alias("codec"), gap(F.col("l_quantity") * 100, 7).alias("bit_rate"),
        gap(F.col("l_quantity"), 3).alias("duration_seconds_from_header"), gap(F.col("l_tax"), 4).alias("begin_stream_seconds_from_header"), gap(F.col("l_tax"), 5).alias("begin_stream_seconds_from_content"),
        gap(F.col("l_quantity") + F.col("l_tax"), 6).alias("end_stream_seconds_from_content"), gap((F.col("l_quantity") * 30).cast("long"), 7).alias("num_frames_from_header"), gap((F.col("l_quantity") * 29).cast("long"), 8).alias("num_frames_from_content"),
        gap(F.lit(24.0) + F.col("l_discount"), 9).alias("average_fps_from_header"), F.when(n % 3 == 1, (k % 640).cast("int")).alias("width"), F.when(n % 3 == 1, (k % 360).cast("int")).alias("height"),
        F.when((n % 3 == 1) & (k % 10 != 0), F.struct((k % 4 + 1).cast("int").alias("num"), (k % 3 + 1).cast("int").alias("den"))).alias("pixel_aspect_ratio"),
        F.when(n % 3 == 0, F.lit(16000)).alias("sample_rate"), F.when(n % 3 == 0, (k % 8 + 1).cast("int")).alias("num_channels"), F.when(n % 3 == 0, F.lit("s16")).alias("sample_format"),
    )


def container_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as containers: source, duration and bit rate from the header, missing now and then."""
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source"), F.when(k % 3 != 0, F.col("o_orderkey") % 100 + 0.5).alias("duration_seconds_from_header"), F.when(k % 5 != 0, F.floor("o_totalprice").cast("double")).alias("bit_rate_from_header")
    )


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with their headers, best streams and number of streams."""
    from sparkreel.operators import metadata

    return container_headers(spark, sf_dir).join(metadata.containers(streams(spark, sf_dir)), "source")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num_frames, begin and end in seconds and the average rate of each stream of events."""
    bounds = index.stream_bounds(packets(spark, sf_dir))
    out = bounds.select("stream_index", "num_frames", (F.col("begin_pts") / 1e6).alias("begin_stream_seconds"), (F.col("end_pts") / 1e6).alias("end_stream_seconds"))
    return out.withColumn("average_fps", F.col("num_frames") / (F.col("end_stream_seconds") - F.col("begin_stream_seconds")))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as audio: streams of ten vectors each, two channels of 32 samples at 1000 Hz."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("stream_index"), (F.col("vec_id") % 10 * 32000).alias("pts"), F.lit(32000).cast("long").alias("duration"), F.array(F.slice(e, 1, 32), F.slice(e, 33, 32)).alias("data"),
    )


def container_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets of container files, eight users a file, in milliseconds: stored by time, shown a little later."""
    e = table(spark, sf_dir, "events")
    dts = F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH}) div 1000")
    rows = e.select(F.expr("user_id div 8").cast("string").alias("source"), (F.col("user_id") % 8).cast("int").alias("stream_index"), F.when(F.col("user_id") % 2 == 0, "video").otherwise("audio").alias("media_type"),
        F.col("event_id").alias("seq"), (dts + F.col("event_id") % 4 * 40).alias("pts"), dts.alias("dts"), F.lit(40).cast("long").alias("duration"), (F.col("event_type") == "signup").alias("is_key"), F.lit(False).alias("is_discard"),
        F.lit(1).alias("tb_num"), F.lit(1000).alias("tb_den"), F.col("event_type").cast("binary").alias("data"))
    return rows


def container_files(spark: SparkSession, sf_dir: str, container: str) -> str:
    """Where container_packets() stand as files."""
    path = shared_dir(spark, container)
    sink.write(container_packets(spark, sf_dir), path, container)
    return path
