"""Files of streams that are written as their frames come: a task holds places, not frames."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

from sparkreel.sources.wav import FileWriter, _Written, part_path


class Spool:
    """A file under way. Frames that come in order stay where they are; else they are brought into order from the disk at the end."""

    def __init__(self, path: str, head: bytes = b""):
        self.path, self.own, self.size = path, part_path(path), len(head)
        self.keys, self.at, self.ordered, self.end = array("d"), array("q"), True, len(head)
        with open(self.own, "wb") as f:
            f.write(head)

    def add(self, file, key: float, data: bytes) -> None:
        self.ordered = self.ordered and (not self.keys or key >= self.keys[-1])
        self.keys.append(key)
        self.at.append(self.end)
        file.write(data)
        self.end += len(data)

    def close(self, patches: Callable[[int], list[tuple[int, bytes]]] = lambda n: []) -> tuple[str, str]:
        """patches: of the number of bytes behind the head, (place, bytes) to be written over it."""
        if not self.ordered:
            own, ends = part_path(self.path), [*self.at[1:], self.end]
            with open(self.own, "rb") as old, open(own, "wb") as new:
                new.write(old.read(self.size))
                for i in sorted(range(len(self.keys)), key=self.keys.__getitem__):
                    old.seek(self.at[i])
                    new.write(old.read(ends[i] - self.at[i]))
            os.remove(self.own)
            self.own = own
        with open(self.own, "r+b") as f:
            for place, data in patches(self.end - self.size):
                f.seek(place)
                f.write(data)
        return self.own, self.path


class StreamWriter(FileWriter):
    """Each (source, stream) a task is dealt becomes one file. Subclasses tell its name, head and frames."""

    path: str
    suffix: str

    def head(self, row) -> bytes:
        return b""

    def frame(self, row) -> tuple[float, bytes]:
        """Where a row stands in its stream, and its bytes."""
        raise NotImplementedError

    def patches(self, n: int) -> list[tuple[int, bytes]]:
        return []

    def write(self, iterator):
        spools, current, file = {}, None, None
        os.makedirs(self.path, exist_ok=True)
        try:
            for row in iterator:
                key = row.source, row.stream_index
                if key not in spools:
                    spools[key] = Spool(os.path.join(self.path, f"{os.path.splitext(row.source)[0]}.{row.stream_index}.{self.suffix}"), self.head(row))
                if key != current:  # one file is open at a time, whatever the number of streams
                    if file:
                        file.close()
                    current, file = key, open(spools[key].own, "ab", 1 << 20)
                spools[key].add(file, *self.frame(row))
        finally:
            if file:
                file.close()
        return _Written([s.close(self.patches) for s in spools.values()])
