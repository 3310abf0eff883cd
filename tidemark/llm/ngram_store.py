"""Files of an n-gram model: sorted hash arrays of a part's key ranges, written once and memory-mapped.

A part's file holds the arrays of its ranges one after the other, then a table of their lengths, then
what the part tells about itself (sums for the whole model), so a model has one file per level and
part, however many ranges there are. A file gets its final name only when complete, so a task that runs
again replaces it by an equal one. Readers keep the ``MOST_MAPS`` parts that they used last.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict

import numpy as np

#: Parts that a worker keeps mapped.
MOST_MAPS = 96

#: Per level: the arrays of a range and their kinds. Counts beyond a byte are 255 there and stand in a list beside.
NGRAMS = (("keys", "<u8"), ("counts", "u1"), ("big_at", "<u8"), ("big", "<u8"), ("lone", "<u8"), ("contexts", "<u8"), ("stats", "u1"), ("big_context_at", "<u8"), ("big_stats", "<u8"))
WORDS = (("keys", "<u8"), ("before", "<u8"), ("n", "<u8"))


def fields(level: int) -> tuple:
    return WORDS if level == 1 else NGRAMS


def plain(folder: str) -> str:
    return folder.removeprefix("file:").replace("//", "/")


class PartWriter:
    def __init__(self, folder: str, level: int, part: int):
        self.part, self._level, self._at, self._table, self.told = part, level, 0, [], []
        self._name = f"level{level}-part{part}"
        if folder.startswith("file:"):
            self._store, self._root = None, plain(folder)
            self._temporary = f"{self._root}/{self._name}.{uuid.uuid4().hex}"
            self._out = open(self._temporary, "wb")
        else:
            from pyarrow import fs

            self._store, self._root = fs.FileSystem.from_uri(folder)
            self._temporary = f"{self._root}/{self._name}.{uuid.uuid4().hex}"
            self._out = self._store.open_output_stream(self._temporary)

    def _put(self, array: np.ndarray) -> None:
        body = array.tobytes()
        self._out.write(body + bytes(-len(body) % 8))

    def add(self, number: int, arrays: dict[str, np.ndarray]) -> None:
        """The arrays of one range."""
        self._table.append([number])
        for name, kind in fields(self._level):
            own = arrays[name].astype(kind)
            self._table[-1].append(own.size)
            self._put(own)

    def close(self) -> None:
        told = np.concatenate(self.told) if self.told else np.zeros((0, 7), np.int64)
        table = np.array(self._table, np.int64)
        for array in (table, told.astype(np.int64), np.array([table.size, told.size], np.int64)):
            self._put(array)
        self._out.close()
        if self._store is None:
            os.replace(self._temporary, f"{self._root}/{self._name}")
        else:
            self._store.move(self._temporary, f"{self._root}/{self._name}")


class Part:
    """One part's file, mapped; a store that isn't mounted is copied to the worker's temporary folder first."""

    def __init__(self, folder: str, level: int, part: int):
        self._copy, name = None, f"level{level}-part{part}"
        if folder.startswith("file:"):
            path = f"{plain(folder)}/{name}"
        else:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(f"{folder}/{name}")
            handle, path = tempfile.mkstemp(prefix="ngram-part-")
            os.close(handle)
            self._copy = path
            if store.get_file_info(root).type != fs.FileType.NotFound:
                fs.copy_files(root, path, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        there = os.path.exists(path) and os.path.getsize(path)
        self._data = np.memmap(path, "u1", "r") if there else np.zeros(0, "u1")
        self._at: dict[int, tuple[int, list[int]]] = {}
        self._level, self.told = level, np.zeros((0, 7), np.int64)
        if there:
            n_table, n_told = self._data[-16:].view("<i8").tolist()
            end = len(self._data) - 16
            self.told = self._data[end - 8 * n_told : end].view("<i8").reshape(-1, 7)
            end -= 8 * n_told
            at = 0
            for number, *sizes in self._data[end - 8 * n_table : end].view("<i8").reshape(-1, 1 + len(fields(level))).tolist():
                self._at[number] = at, sizes
                at += sum(-(-n * np.dtype(kind).itemsize // 8) * 8 for n, (_, kind) in zip(sizes, fields(level), strict=True))

    def arrays(self, number: int) -> dict[str, np.ndarray] | None:
        """The arrays of a range, or nothing if no entry is in it."""
        if number not in self._at:
            return None
        at, sizes = self._at[number]
        out = {}
        for n, (name, kind) in zip(sizes, fields(self._level), strict=True):
            width = n * np.dtype(kind).itemsize
            out[name] = self._data[at : at + width].view(kind)
            at += -(-width // 8) * 8
        return out

    def __del__(self):
        if self._copy:
            os.unlink(self._copy)


_MAPS: OrderedDict[tuple[str, int, int], Part] = OrderedDict()


def part_of(folder: str, level: int, part: int) -> Part:
    """The part, mapped by this worker; the one that was not used for longest goes."""
    key = (folder, level, part)
    if key in _MAPS:
        _MAPS.move_to_end(key)
    else:
        while len(_MAPS) >= MOST_MAPS:
            _MAPS.popitem(last=False)
        _MAPS[key] = Part(folder, level, part)
    return _MAPS[key]
