"""Numpy arrays as files in the cluster's shared folder, written once by tasks and memory-mapped by others."""

from __future__ import annotations

import shutil
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array; a task that runs again leaves the same file, and a half-written one is never seen."""

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    target = f"{path}/{name}"
    if isinstance(store, fs.LocalFileSystem) or store.get_file_info(target).type == fs.FileType.NotFound:
        store.move(part, target)
    else:
        store.delete_file(part)


class Arrays:
    """Memory maps of the arrays of a folder, opened when first used.

    A store that is no file system of this machine is copied to an unnamed local file first.
    """

    def __init__(self, folder: str) -> None:
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.local = isinstance(self.store, fs.LocalFileSystem)
        self.maps: dict[str, np.ndarray] = {}

    def get(self, name: str, dtype: str) -> np.ndarray:
        if name not in self.maps:
            path = f"{self.path}/{name}"
            info = self.store.get_file_info(path)
            if info.type == fs.FileType.NotFound or not info.size:
                self.maps[name] = np.zeros(0, dtype=dtype)
            elif self.local:
                self.maps[name] = np.memmap(path, dtype=dtype, mode="r")
            else:
                copy = tempfile.TemporaryFile()
                with self.store.open_input_stream(path) as source:
                    shutil.copyfileobj(source, copy, 1 << 20)
                copy.flush()
                self.maps[name] = np.memmap(copy, dtype=dtype, mode="r")
        return self.maps[name]
