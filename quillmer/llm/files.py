"""Binary files in the folder that driver and executors share, by path or URI."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


@contextlib.contextmanager
def publishing(path: str) -> Iterator:
    """A stream to a new file that appears at ``path`` when complete: attempts that die or run twice do no harm."""
    store, at = resolve(path)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        yield out
    store.move(part, at)


@contextlib.contextmanager
def reading(path: str) -> Iterator:
    store, at = resolve(path)
    with store.open_input_stream(at, compression=None) as src:
        yield src
