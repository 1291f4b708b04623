"""Files opened in tasks, where a part of a file is read or a format of its own is written."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a file as Spark names it (``file:/x`` or any scheme)."""
    uri = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def open_file(uri: str):
    """The file for reading at any place."""
    store, path = resolve(uri)
    return store.open_input_file(path)


def create_file(uri: str) -> tuple[object, Callable[[], None]]:
    """A stream to a temporary name, and what gives the closed file its own name.

    A task that runs twice replaces its file by an equal one.
    """
    store, path = resolve(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    stream = store.open_output_stream(hidden := f"{folder}/.{name}.{uuid.uuid4().hex}.tmp")

    def finish() -> None:
        stream.close()
        store.move(hidden, path)

    return stream, finish
