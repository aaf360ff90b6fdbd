"""Arrays in files of the shared folder: written once by a task, memory-mapped by workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all; a task that runs again writes the same bytes over it."""
    path = _local(folder)
    if path is None:
        system, root = _remote(folder)
        system.create_dir(root)
        data = io.BytesIO()
        np.save(data, array)
        with system.open_output_stream(f"{root}/{name}.npy") as out:
            out.write(data.getvalue())
        return
    os.makedirs(path, exist_ok=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(part, array)
    os.replace(part, f"{path}/{name}.npy")


@lru_cache(maxsize=4096)
def load(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped: in place where the folder is a local path, else from a copy made once."""
    path = _local(folder)
    if path is not None:
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    system, root = _remote(folder)
    with tempfile.NamedTemporaryFile(suffix=".npy", delete=False) as out, system.open_input_stream(f"{root}/{name}.npy") as data:
        while block := data.read(1 << 22):
            out.write(block)
    try:
        return np.load(out.name, mmap_mode="r")
    finally:
        os.unlink(out.name)  # the mapping keeps it


@lru_cache(maxsize=64)
def _opened(folder: str, name: str):
    """An open file of the shared folder and where its array begins."""
    system, root = _remote(folder)
    handle = system.open_input_file(f"{root}/{name}.npy")
    np.lib.format.read_magic(handle)
    np.lib.format.read_array_header_1_0(handle)
    return handle, handle.tell()


def read(folder: str, name: str, low: int, size: int) -> np.ndarray:
    """Some bytes of an array of bytes; of a remote file only these are fetched."""
    if _local(folder) is not None:
        return np.array(load(folder, name)[low : low + size])
    handle, begins = _opened(folder, name)
    return np.frombuffer(handle.read_at(size, begins + low), np.uint8)
