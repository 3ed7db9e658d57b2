"""What can open media here. Codecs that need a native library are backends of their own; without one, opening fails clearly."""

from __future__ import annotations

from collections.abc import Callable

_OPENERS: dict[str, Callable[[bytes], dict]] = {}


class NoBackend(RuntimeError):
    """Nothing here decodes this."""


def register(name: str, opener: Callable[[bytes], dict]) -> None:
    """opener: bytes to a dict with media_type, codec, and packets or samples; raises ValueError for bytes of another kind."""
    _OPENERS[name] = opener


def names() -> list[str]:
    return sorted(_OPENERS)


def open_bytes(data: bytes) -> dict:
    """The first backend that knows the bytes opens them."""
    for opener in _OPENERS.values():
        try:
            return opener(data)
        except ValueError:
            continue
    raise NoBackend(f"no registered backend ({', '.join(names()) or 'none'}) can open these {len(data)} bytes; compressed codecs need a backend of their own")


#: What the formats that are written here can hold.
FORMATS = {
    "wav": {"media_type": "audio", "channels": (1, 8), "bits": (8, 16, 24, 32), "rates": None},
    "y4m": {"media_type": "video", "pixel": ("420",), "bits": (8,)},
    "raw": {"media_type": "video", "pixel": ("rgb24", "yuv420p"), "bits": (8,)},
}


def check_audio(format: str, channels: int, rate: int, bits: int = 16) -> None:
    """Fails where a format can't hold such audio, and says what it can."""
    known = FORMATS.get(format)
    if known is None or known["media_type"] != "audio":
        raise NoBackend(f"only {', '.join(k for k, v in FORMATS.items() if v['media_type'] == 'audio')} can be encoded here, not {format}; compressed codecs need a backend of their own")
    low, high = known["channels"]
    if not low <= channels <= high:
        raise ValueError(f"{format} holds {low} to {high} channels, not {channels}")
    if rate <= 0 or (known["rates"] and rate not in known["rates"]):
        raise ValueError(f"{format} has no sample rate of {rate}")
    if bits not in known["bits"]:
        raise ValueError(f"{format} has samples of {', '.join(map(str, known['bits']))} bits, not {bits}")
