"""Files that tasks write and read under the shared folder, with a table of what counts.

A task writes under a name of its own attempt and returns a row about the file.
The table of these rows is stored; a file without a row in it, left by a lost or
repeated attempt, is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs

#: Hadoop's names of stores that Arrow has under another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    scheme, found, rest = uri.partition("://")
    if not found:
        scheme, found, rest = uri.partition(":")
        if scheme != "file":
            return fs.LocalFileSystem(), uri
        return fs.LocalFileSystem(), rest
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def new_name(folder: str, kind: str) -> str:
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def create(uri: str, compression: str | None = None):
    store, path = locate(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=compression)


def read(uri: str, start: int = 0, size: int | None = None) -> bytes:
    store, path = locate(uri)
    with store.open_input_file(path) as file:
        return file.read_at(file.size() - start if size is None else size, start)
