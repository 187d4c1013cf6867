"""Sorted arrays of a model: packed for a shuffle, written to the shared folder, memory-mapped by workers."""

from __future__ import annotations

import io
import mmap
import os
import sys
import uuid

import numpy as np
import pyarrow.fs as pafs
import zstandard

#: Entries that a task gathers before it emits them; bounds its memory (16 bytes each, a few copies).
TASK_ENTRIES = 3_000_000
#: Bytes of files that a worker holds in memory where it can't map them.
OPEN_BYTES = 256 << 20


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys with counts: differences by byte place, compressed."""
    deltas = np.diff(keys, prepend=np.uint64(0))
    planes = np.concatenate([deltas.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=12 * n or 1), np.uint8)
    deltas = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    counts = np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(deltas, dtype=np.uint64), counts.astype(np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added; keys sorted."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[first], np.add.reduceat(counts, first)) if len(keys) else (keys, counts)


class Gathered:
    """Counts of keys in a task; ``full`` says when to emit."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c.astype(np.int64)))
        self.n += len(k)
        if self.n > TASK_ENTRIES and len(self.parts) > 1:
            self.parts = [merged(self.parts)]
            self.n = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.n > TASK_ENTRIES

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merged(self.parts)
        self.parts, self.n = [], 0
        return out


def slices(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray):
    """(part, packed) for each part that has keys; part i has keys from bounds[i] up to bounds[i + 1]."""
    at = np.searchsorted(keys, bounds)
    at[0], ends = 0, np.append(at[1:], len(keys))
    for i, (a, b) in enumerate(zip(at.tolist(), ends.tolist(), strict=True)):
        if b > a:
            yield i, pack(keys[a:b], counts[a:b])


def put(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file. A whole file takes its name at once, so a task that runs twice does no harm."""
    body, head = io.BytesIO(), []
    for name, a in arrays.items():
        body.write(b"\0" * (-body.tell() % 64))
        head.append(f"{name} {a.dtype.str} {len(a)} {body.tell()}")
        body.write(np.ascontiguousarray(a).tobytes())
    top = "\n".join(head).encode()
    data = len(top).to_bytes(8, "little") + top
    data += b"\0" * (-len(data) % 64) + body.getvalue()
    if uri.startswith("file:"):
        path = local(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(part, path)
    else:
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
            f.write(data)
        fs.move(part, path)


def local(uri: str) -> str:
    return "/" + uri.removeprefix("file:").lstrip("/")


def mapped(uri: str) -> dict[str, np.ndarray]:
    """A file of ``put`` as memory-mapped arrays. From a store that is no mounted folder, it is read into memory (see ``Opened``)."""
    if uri.startswith("file:"):
        with open(local(uri), "rb") as f:
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    else:
        fs, source = pafs.FileSystem.from_uri(uri)
        with fs.open_input_stream(source) as f:
            m = f.read()
    n = int.from_bytes(m[:8], "little")
    start = 8 + n + -(8 + n) % 64
    out = {}
    for line in m[8 : 8 + n].decode().split("\n"):
        name, kind, length, at = line.split(" ")
        out[name] = np.frombuffer(m, np.dtype(kind), int(length), start + int(at)) if int(length) else np.empty(0, np.dtype(kind))
    return out


class Opened:
    """Files of a folder, opened once; when they take more than OPEN_BYTES, all are closed and opened anew as they are wanted."""

    def __init__(self, root: str):
        self.root, self.files, self.bytes = root, {}, 0

    def __call__(self, name: str) -> dict[str, np.ndarray]:
        if (f := self.files.get(name)) is None:
            if self.bytes > OPEN_BYTES:
                self.files, self.bytes = {}, 0
            f = self.files[name] = mapped(f"{self.root}/{name}")
            self.bytes += 0 if self.root.startswith("file:") else sum(a.nbytes for a in f.values())
        return f
