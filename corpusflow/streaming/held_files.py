"""Documents that wait for their turn, in files: of each only its place and where it ends are in memory.

A file holds documents sorted by source and place: token ids, one ``INDEX`` row a document, the names of the sources, and
the sizes of index and names. It is written once by the task that holds the documents and never changed. Files are opened where
the tasks run, by ``pyarrow.fs``, so the folder must be one that executors reach by its URI.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import numpy as np

from ..sources.arrow_files import filesystem

INDEX = np.dtype([("of", "<i4"), ("at", "<i8"), ("size", "<i8")])
WRITE_TOKENS = 1 << 20  # gathered before they are written
READ_TOKENS = 1 << 23   # read ahead by all parts of a lane together


class Part:
    """Documents of one source in one file from place ``first`` on; ``at`` and ``ends`` are their places and where their tokens end."""

    def __init__(self, path: str, at: np.ndarray, ends: np.ndarray, start: int, first: int):
        k = int(np.searchsorted(at, first))
        self.path, self.at, self.ends = path, at[k:], ends[k:]
        self.start = int(ends[k - 1]) if k else start
        self.i, self.block, self.block_at = 0, np.zeros(0, np.int32), self.start

    def __len__(self) -> int:
        return len(self.at) - self.i

    def place(self) -> int:
        return int(self.at[self.i])

    def take(self, ahead: int) -> np.ndarray:
        """Ids of the next document; where it is not at hand, it is read with others behind it, ``ahead`` tokens if it is shorter."""
        first, end = self.start, int(self.ends[self.i])
        if end > self.block_at + len(self.block):
            to = max(end, min(first + ahead, int(self.ends[-1])))
            system, path = filesystem(self.path)
            with system.open_input_file(path) as f:
                self.block, self.block_at = np.frombuffer(f.read_at(4 * (to - first), 4 * first), "<i4"), first
        ids = self.block[first - self.block_at:end - self.block_at].copy()
        self.start, self.i = end, self.i + 1
        if not len(self):
            self.block = self.block[:0].copy()
        return ids


def write_held(folder: str, rows: Iterable[tuple[str, int, np.ndarray]]) -> str:
    """Path of a new file of ``rows``: source, place, ids; by source, then place."""
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    name, names, index, part, n = uuid.uuid4().hex, {}, [], [], 0
    with system.open_output_stream(f"{root}/{name}") as f:
        for source, at, ids in rows:
            index.append((names.setdefault(source, len(names)), at, len(ids)))
            part.append(ids)
            n += len(ids)
            if n >= WRITE_TOKENS:
                f.write(np.concatenate(part).astype("<i4").tobytes())
                part, n = [], 0
        f.write(np.concatenate([np.zeros(0, "<i4"), *part]).astype("<i4").tobytes())
        f.write(np.array(index, INDEX).tobytes())
        told = json.dumps(list(names)).encode()
        f.write(told + np.array([len(index), len(told)], "<i8").tobytes())
    return f"{folder}/{name}"


def read_held(path: str, first: dict[str, int]) -> dict[str, Part]:
    """By source the documents in the file, without those before place ``first`` of their source."""
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        end = f.size() - 16
        n, told = np.frombuffer(f.read_at(16, end), "<i8").tolist()
        names = json.loads(f.read_at(told, end - told))
        index = np.frombuffer(f.read_at(n * INDEX.itemsize, end - told - n * INDEX.itemsize), INDEX)
    ends = np.cumsum(index["size"])
    cuts = np.searchsorted(index["of"], np.arange(len(names) + 1)).tolist()
    return {s: Part(path, index["at"][a:b].copy(), ends[a:b], int(ends[a - 1]) if a else 0, first.get(s, 0))
            for s, a, b in zip(names, cuts, cuts[1:])}


def remove_held(path: str) -> None:
    system, at = filesystem(path)
    try:
        system.delete_file(at)
    except FileNotFoundError:  # a repeated task
        pass
