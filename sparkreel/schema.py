"""Schemas of the model's tables, and the values that stand for 'missing' in it."""

from __future__ import annotations

#: A packet without a presentation time, and the next time after a stream's last frame.
NO_PTS = -(2**63)
LAST_PTS = 2**63 - 1

PACKETS = "source string, stream_index int, media_type string, seq long, pts long, dts long, duration long, is_key boolean, is_discard boolean, tb_num int, tb_den int"
FRAME_INDEX = (
    "source string, stream_index int, frame_index long, pts long, next_pts long, duration long, is_key boolean, gop_id long, "
    "tb_num int, tb_den int, pts_seconds double, next_pts_seconds double, duration_seconds double"
)
STREAMS = (
    "source string, stream_index int, media_type string, codec string, bit_rate double, duration_seconds_from_header double, "
    "begin_stream_seconds_from_header double, begin_stream_seconds_from_content double, end_stream_seconds_from_content double, "
    "num_frames_from_header long, num_frames_from_content long, average_fps_from_header double, width int, height int, "
    "pixel_aspect_ratio struct<num:int,den:int>, sample_rate int, num_channels int, sample_format string"
)
CONTAINERS = "source string, duration_seconds_from_header double, bit_rate_from_header double, best_video_stream_index int, best_audio_stream_index int"
FRAMES = "source string, stream_index int, frame_index long, pts_seconds double, duration_seconds double, shape struct<h:int,w:int,c:int>, data binary"
AUDIO_FRAMES = "source string, stream_index int, pts long, duration long, sample_rate int, data array<array<float>>"

#: What options may be.
SEEK_MODES = ("exact", "approximate", "custom_frame_mappings")
DIMENSION_ORDERS = ("NCHW", "NHWC")
POLICIES = ("repeat_last", "wrap", "error")
MEDIA_TYPES = ("video", "audio", "other")
