"""Stream and container metadata: fallbacks from content to header, best streams, JSON forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duration_seconds(header: Column, begin: Column, end: Column, n_header: Column, fps_header: Column) -> Column:
    """Content's end - begin, else the header's duration, else its frames over its rate."""
    return F.coalesce(end - begin, header, F.when(fps_header != 0, n_header.cast("double") / F.when(fps_header != 0, fps_header)))


def begin_seconds(begin_content: Column) -> Column:
    return F.coalesce(begin_content, F.lit(0.0))


def end_seconds(end_content: Column, duration: Column) -> Column:
    return F.coalesce(end_content, duration)


def num_frames(content: Column, header: Column, fps_header: Column, duration: Column) -> Column:
    """Content's count, else the header's, else rate times duration cut to a whole number."""
    return F.coalesce(content, header, (fps_header * duration).cast("long"))


def average_fps(content_begin: Column, content_end: Column, frames: Column, fps_header: Column) -> Column:
    """Frames over the content's length where that is known and not zero, else the header's rate."""
    span = content_end - content_begin
    return F.when(span.isNotNull() & (span != 0) & frames.isNotNull(), frames / F.when(span != 0, span)).otherwise(fps_header)


def pixel_aspect_ratio(num: Column, den: Column) -> Column:
    """A reduced fraction, null where a half is missing or the denominator is zero."""
    return F.when(num.isNotNull() & den.isNotNull() & (den != 0), F.struct((num / gcd(num, den)).cast("int").alias("num"), (den / gcd(num, den)).cast("int").alias("den")))


def gcd(a: Column, b: Column, bits: int = 48) -> Column:
    """Greatest common divisor of integers, by Euclid's steps over an array."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), start, step, lambda s: F.greatest(s["x"], F.lit(1)))


def derived(streams: DataFrame) -> DataFrame:
    """streams (schema STREAMS) with duration_seconds, begin_stream_seconds, end_stream_seconds, num_frames and average_fps."""
    c = F.col
    with_duration = streams.withColumn("duration_seconds", duration_seconds(c("duration_seconds_from_header"), c("begin_stream_seconds_from_content"), c("end_stream_seconds_from_content"), c("num_frames_from_header"), c("average_fps_from_header")))
    counted = with_duration.withColumn("num_frames", num_frames(c("num_frames_from_content"), c("num_frames_from_header"), c("average_fps_from_header"), c("duration_seconds")))
    return counted.withColumns({
        "begin_stream_seconds": begin_seconds(c("begin_stream_seconds_from_content")),
        "end_stream_seconds": end_seconds(c("end_stream_seconds_from_content"), c("duration_seconds")),
        "average_fps": average_fps(c("begin_stream_seconds_from_content"), c("end_stream_seconds_from_content"), c("num_frames"), c("average_fps_from_header")),
    })


def checked(streams: DataFrame) -> DataFrame:
    """Only streams of which begin, end and number of frames are known, as a decoder needs them."""
    return derived(streams).filter("begin_stream_seconds is not null and end_stream_seconds is not null and num_frames is not null")


def best_streams(streams: DataFrame, container: str = "source") -> DataFrame:
    """The best stream of each media type: most pixels or channels, then the lowest index."""
    size = F.coalesce(F.col("width").cast("long") * F.col("height"), F.col("num_channels").cast("long"), F.lit(0).cast("long"))
    w = Window.partitionBy(container, "media_type").orderBy(F.desc(size), "stream_index")
    return streams.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def containers(streams: DataFrame, container: str = "source") -> DataFrame:
    """Best stream indices and streams per media type of each container."""
    best = best_streams(streams, container).groupBy(container).agg(*[F.max(F.when(F.col("media_type") == t, F.col("stream_index"))).alias(f"best_{t}_stream_index") for t in ("video", "audio")])
    counts = streams.groupBy(container).agg(F.count(F.lit(1)).alias("num_streams"), *[F.sum((F.col("media_type") == t).cast("long")).alias(f"num_{t}_streams") for t in ("video", "audio", "other")])
    return counts.join(best, container)


def _json(names: dict[str, str | Column]) -> Column:
    """An object of these members, in order of their names; null ones are left out."""
    members = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in sorted(names.items())]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "true"})


def stream_json() -> Column:
    """A stream's fields as JSON; unknown ones are left out."""
    return _json({
        "durationSecondsFromHeader": "duration_seconds_from_header", "bitRate": "bit_rate", "numFramesFromContent": "num_frames_from_content",
        "numFramesFromHeader": "num_frames_from_header", "beginStreamSecondsFromHeader": "begin_stream_seconds_from_header",
        "beginStreamSecondsFromContent": "begin_stream_seconds_from_content", "endStreamSecondsFromContent": "end_stream_seconds_from_content",
        "codec": "codec", "width": "width", "height": "height", "averageFpsFromHeader": "average_fps_from_header",
        "sampleAspectRatioNum": "pixel_aspect_ratio.num", "sampleAspectRatioDen": "pixel_aspect_ratio.den",
        "sampleRate": "sample_rate", "numChannels": "num_channels", "sampleFormat": "sample_format", "mediaType": "media_type",
    })


def stream_json_at(streams: DataFrame, requests: DataFrame, container: str = "source") -> DataFrame:
    """requests: container, stream_index. json of each; a stream that isn't there fails the query."""
    met = requests.join(streams.withColumn("_json", stream_json()), [container, "stream_index"], "left")
    missing = F.raise_error(F.concat(F.lit("no stream has the index "), F.col("stream_index").cast("string")))
    return met.select(container, "stream_index", F.when(F.col("_json").isNotNull(), F.col("_json")).otherwise(missing.cast("string")).alias("json"))


def container_json() -> Column:
    """A container's fields as JSON."""
    return _json({"durationSecondsFromHeader": "duration_seconds_from_header", "bitRate": "bit_rate_from_header", "bestVideoStreamIndex": "best_video_stream_index", "bestAudioStreamIndex": "best_audio_stream_index", "numStreams": "num_streams"})


def legacy_json(containers: DataFrame, streams: DataFrame, container: str = "source") -> DataFrame:
    """container, json: the flat form of old, of a container and its best video stream.

    containers: schema CONTAINERS. The duration is the stream's, else the container's, else 0; the bit rate is the
    container's; content's count of frames bears the header's name.
    """
    c = F.col
    of = ("duration_seconds_from_header", "num_frames_from_content", "num_frames_from_header", "begin_stream_seconds_from_content", "end_stream_seconds_from_content", "codec", "width", "height", "average_fps_from_header")
    best = streams.select(F.col(container), F.col("stream_index").alias("best_video_stream_index"), F.struct(*of).alias("v"))
    joined = containers.join(best, [container, "best_video_stream_index"], "left")
    return joined.select(container, _json({
        "durationSecondsFromHeader": F.coalesce(c("v.duration_seconds_from_header"), c("duration_seconds_from_header"), F.lit(0.0)), "bitRate": "bit_rate_from_header",
        "numFramesFromHeader": F.coalesce(c("v.num_frames_from_content"), c("v.num_frames_from_header")), "beginStreamSecondsFromContent": "v.begin_stream_seconds_from_content",
        "endStreamSecondsFromContent": "v.end_stream_seconds_from_content", "codec": "v.codec", "width": "v.width", "height": "v.height", "averageFpsFromHeader": "v.average_fps_from_header",
        "bestVideoStreamIndex": "best_video_stream_index", "bestAudioStreamIndex": "best_audio_stream_index",
    }).alias("json"))


PARSED = (
    "durationSecondsFromHeader double, bitRate double, numFramesFromContent long, numFramesFromHeader long, beginStreamSecondsFromHeader double, beginStreamSecondsFromContent double, "
    "endStreamSecondsFromContent double, codec string, width int, height int, averageFpsFromHeader double, sampleAspectRatioNum int, sampleAspectRatioDen int, sampleRate int, numChannels int, "
    "sampleFormat string, mediaType string"
)


def parse_json(frame: DataFrame, column: str = "json") -> DataFrame:
    """Typed metadata from stream_json()."""
    return frame.withColumn("parsed", F.from_json(column, PARSED)).select(*frame.columns, "parsed.*")


def parse_containers(frame: DataFrame, streams: DataFrame, container: str = "source") -> DataFrame:
    """A container's typed metadata with its streams: frame has container, json of container_json(); streams container, stream_index, json of stream_json()."""
    own = "durationSecondsFromHeader double, bitRate double, bestVideoStreamIndex int, bestAudioStreamIndex int, numStreams long"
    each = parse_json(streams).withColumn("entry", F.struct("stream_index", *[x.split()[0] for x in PARSED.split(", ")]))
    lists = each.groupBy(container).agg(F.array_sort(F.collect_list("entry")).alias("streams"))  # a container has few
    return frame.withColumn("parsed", F.from_json("json", own)).select(container, "parsed.*").join(lists, container, "left")


def checked_int(value: Column, name: str) -> Column:
    """A long as an int; one that is out of an int's range fails the query."""
    wide = F.raise_error(F.concat(F.lit(f"{name} is out of an int's range: "), value.cast("string")))
    return F.when(value.isNull() | value.between(-(2**31), 2**31 - 1), value).otherwise(wide.cast("long")).cast("int")


def frame_size(wanted_width: Column, wanted_height: Column, width: Column, height: Column) -> Column:
    """struct(w, h): the size asked for, else the stream's, side by side."""
    return F.struct(F.coalesce(wanted_width, width).alias("w"), F.coalesce(wanted_height, height).alias("h"))


def versions() -> dict[str, str]:
    """What decodes and runs here."""
    import pyspark

    from sparkreel.sources import backends

    return {"spark": pyspark.__version__, **{name: "available" for name in backends.names()}}
