"""Audio frames written as WAV files while they come; sizes are patched into the header at the end."""

from __future__ import annotations

import numpy as np

from sparkreel.sources.files import local
from sparkreel.sources.spool import StreamWriter
from sparkreel.sources.wav import build, pcm

#: What 32 bits of size leave for samples.
MOST = (1 << 32) - 64


class WavWriter(StreamWriter):
    """Each task writes the streams it is dealt: repartition by (source, stream_index) so that a stream has one file."""

    suffix = "wav"

    def __init__(self, options: dict):
        self.path, self.bits = local(options["path"]), int(options.get("bits", 16))

    def head(self, row) -> bytes:
        return build(np.zeros((len(row.data), 0), np.float32), row.sample_rate, self.bits)

    def frame(self, row) -> tuple[float, bytes]:
        return row.pts, pcm(np.array(row.data, np.float32), self.bits)

    def patches(self, n: int) -> list[tuple[int, bytes]]:
        if n > MOST:
            raise ValueError(f"the file would pass {MOST} bytes of samples")
        return [(4, (36 + n + n % 2).to_bytes(4, "little")), (40, n.to_bytes(4, "little"))]
