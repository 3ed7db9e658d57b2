"""Channel layouts and how one is mixed to another.

A layout is a mask of speakers, whose channels stand in the order of their bits. A speaker that the target has keeps its sound.
One that it lacks is dealt to the nearest that it has, a pair at -3 dB each, surrounds in front at -3 dB; low frequencies
(LFE) go nowhere else. Where a target channel could then pass full scale, all are scaled down alike.
"""

from __future__ import annotations

import math
from functools import cache

#: Bits of the speakers.
FL, FR, FC, LFE, BL, BR, FLC, FRC, BC, SL, SR = (1 << i for i in range(11))
#: Layouts by name.
LAYOUTS = {
    "mono": FC, "stereo": FL | FR, "2.1": FL | FR | LFE, "3.0": FL | FR | FC, "quad": FL | FR | BL | BR, "4.0": FL | FR | FC | BC, "5.0": FL | FR | FC | BL | BR, "5.0(side)": FL | FR | FC | SL | SR,
    "5.1": FL | FR | FC | LFE | BL | BR, "5.1(side)": FL | FR | FC | LFE | SL | SR, "6.1": FL | FR | FC | LFE | BC | SL | SR, "7.1": FL | FR | FC | LFE | BL | BR | SL | SR,
}
#: The layout that so many channels have where none is told.
DEFAULT = {1: "mono", 2: "stereo", 3: "2.1", 4: "4.0", 5: "5.0", 6: "5.1", 7: "6.1", 8: "7.1"}
HALF = math.sqrt(0.5)
#: Where a speaker's sound goes that the target lacks: the first speakers that it has all of, and how loud.
INSTEAD = {
    FL: (((FC,), HALF),), FR: (((FC,), HALF),), FC: (((FL, FR), HALF),), FLC: (((FL,), 1.0), ((FC,), HALF)), FRC: (((FR,), 1.0), ((FC,), HALF)),
    BL: (((SL,), 1.0), ((FL,), HALF), ((FC,), 0.5)), BR: (((SR,), 1.0), ((FR,), HALF), ((FC,), 0.5)), SL: (((BL,), 1.0), ((FL,), HALF), ((FC,), 0.5)), SR: (((BR,), 1.0), ((FR,), HALF), ((FC,), 0.5)),
    BC: (((BL, BR), HALF), ((SL, SR), HALF), ((FL, FR), 0.5), ((FC,), HALF)),
}


def mask_of(layout: str | int) -> int:
    """A layout by name, mask or number of channels (1 to 8)."""
    if isinstance(layout, str) and layout in LAYOUTS:
        return LAYOUTS[layout]
    if isinstance(layout, int) and not isinstance(layout, bool):
        if layout in DEFAULT:
            return LAYOUTS[DEFAULT[layout]]
        if 0 < layout < 1 << 11:
            return layout
    raise ValueError(f"{layout!r} is no layout: a name ({', '.join(LAYOUTS)}), 1 to 8 channels, or a mask of speakers above 8")


def speakers(layout: str | int) -> list[int]:
    mask = mask_of(layout)
    return [1 << i for i in range(mask.bit_length()) if mask >> i & 1]


@cache
def levels(source: str | int, target: str | int) -> tuple[tuple[tuple[float, ...], ...], float]:
    """For each target channel, how loud each source channel would be in it, and what all are divided by so that none passes full scale."""
    have, want = speakers(source), speakers(target)
    rows = {t: dict.fromkeys(have, 0.0) for t in want}
    for s in have:
        if s in rows:
            rows[s][s] += 1.0
            continue
        for others, level in INSTEAD.get(s, ()):
            if all(o in rows for o in others):
                for o in others:
                    rows[o][s] += level
                break
    loudest = max(1.0, *(math.fsum(r.values()) for r in rows.values()))
    return tuple(tuple(rows[t][s] for s in have) for t in want), loudest


@cache
def matrix(source: str | int, target: str | int) -> tuple[tuple[float, ...], ...]:
    """For each target channel, how loud each source channel is in it."""
    rows, loudest = levels(source, target)
    return tuple(tuple(x / loudest for x in row) for row in rows)
