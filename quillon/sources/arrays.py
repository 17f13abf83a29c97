"""Number arrays in the shared folder: written by tasks, memory-mapped by others.

An array is written under another name and renamed, and holds what its task's
input gives, so a task that runs again leaves the same file.  From a store that
is no local file system an array is copied once to a machine-wide cache and
mapped there by all workers of the machine.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from io import BytesIO
from pathlib import Path
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a file on a local file system; None for other stores."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme == "file" else uri if not u.scheme else None


def _write(path: str, array: np.ndarray) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def save(uri: str, array: np.ndarray) -> None:
    """Writes one array as .npy."""
    if (path := local_path(uri)) is not None:
        _write(path, array)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(part) as f:
        np.save(f, array)
    store.move(part, path)


def load(uri: str) -> np.ndarray:
    """Opens an array, memory-mapped."""
    if (path := local_path(uri)) is None:
        from pyarrow import fs

        path = os.path.join(tempfile.gettempdir(), "quillon-arrays", hashlib.sha256(uri.encode()).hexdigest() + ".npy")
        if not os.path.exists(path):
            store, far = fs.FileSystem.from_uri(uri)
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            part = f"{path}.{uuid.uuid4().hex[:8]}.part"
            with open(part, "wb") as out, store.open_input_stream(far) as f:
                shutil.copyfileobj(f, out, 1 << 20)
            os.replace(part, path)
    a = np.load(path, mmap_mode="r") if os.path.getsize(path) > 4096 else np.load(path)
    return a.view(np.ndarray)


def read(uri: str) -> np.ndarray:
    """Reads an array into memory; nothing of it is kept on the machine."""
    if (path := local_path(uri)) is not None:
        return np.load(path)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return np.load(BytesIO(f.read()))


def exists(uri: str) -> bool:
    if (path := local_path(uri)) is not None:
        return os.path.exists(path)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.get_file_info(path).type == fs.FileType.File


def remove(uri: str) -> None:
    """Removes one array; it may be gone already."""
    if (path := local_path(uri)) is not None:
        Path(path).unlink(missing_ok=True)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        store.delete_file(path)


def appended(uri: str) -> BinaryIO:
    """A new file to which bytes are added."""
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path, buffer_size=1 << 20)


def opened(uri: str) -> Callable[[int, int], bytes]:
    """Reads a number of bytes at a place of a file; nothing of it stays in memory, as a mapped file's pages do."""
    from pyarrow import fs

    store, path = (fs.LocalFileSystem(), p) if (p := local_path(uri)) is not None else fs.FileSystem.from_uri(uri)
    return store.open_input_file(path).read_at


class Rows:
    """A stored array of which slices of rows are read, as copies."""

    def __init__(self, uri: str):
        self._read = opened(uri)
        head = BytesIO(self._read(4096, 0))
        np.lib.format.read_magic(head)
        self.shape, _, self.dtype = np.lib.format.read_array_header_1_0(head)
        self._first, self._size = head.tell(), int(np.prod(self.shape[1:])) * self.dtype.itemsize

    def __getitem__(self, rows: slice) -> np.ndarray:
        a, b, _ = rows.indices(self.shape[0])
        return np.frombuffer(self._read((b - a) * self._size, self._first + a * self._size), self.dtype).reshape(b - a, *self.shape[1:])
