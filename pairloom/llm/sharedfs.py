"""Files in the shared folder, written by tasks under temporary names."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it (``file:/x`` or any scheme)."""
    uri = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def temporary(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"


def write_file(uri: str, data: bytes) -> None:
    """Write the whole file under a temporary name, then give it its own.

    A task that runs twice writes the same bytes to the same name.
    """
    store, path = resolve(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(hidden := temporary(path)) as out:
        out.write(data)
    store.move(hidden, path)


def read_file(uri: str) -> bytes:
    store, path = resolve(uri)
    with store.open_input_file(path) as source:
        return source.read()
