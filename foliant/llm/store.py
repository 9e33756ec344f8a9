"""Plain files in the shared folder, for what workers address by offset.

A task's attempt writes a file of its own under a fresh name; the name counts only once it stands in a table that Spark
has committed, so a lost executor or a repeated attempt leaves no file that anyone reads half-written. Local folders are
mapped into memory; other stores (s3a:// is read as s3://) are read by ranges.
"""

from __future__ import annotations

import re
import uuid

import numpy as np


def _at(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def save(folder: str, name: str, parts: list[bytes]) -> str:
    """Writes the parts one after the other to a new file of the folder; returns the file's name."""
    store, path = _at(folder)
    store.create_dir(path)
    name = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{path}/{name}") as out:
        for p in parts:
            out.write(p)
    return name


def load(folder: str, name: str) -> np.ndarray:
    """A file's bytes; mapped into memory where the folder is local."""
    from pyarrow import fs

    store, path = _at(folder)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", np.uint8, "r")
    with store.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), np.uint8)


def ranges(folder: str, name: str):
    """A function (offset, size) that reads a range of a file."""
    store, path = _at(folder)
    f = store.open_input_file(f"{path}/{name}")
    return lambda at, n: f.read_at(n, at)
