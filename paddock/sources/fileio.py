"""Ranges of bytes of a file in any store that Arrow opens, so that tasks needn't hold whole files."""

from __future__ import annotations

import re

import pyarrow.fs as pafs


class Ranged:
    """A file read by ranges; ``taken`` counts the bytes that were read."""

    def __init__(self, path: str):
        system, place = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path.split("/")[0] else f"file://{path}")
        self._file = system.open_input_file(place)
        self.size, self.taken = self._file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        self.taken += n
        return self._file.read_at(n, at) if n else b""

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()


class Held:
    """The same over bytes that are there already."""

    def __init__(self, data: bytes):
        self._data, self.size, self.taken = data, len(data), 0

    def read(self, at: int, n: int) -> bytes:
        return self._data[at : at + max(0, n)]
