"""Opening files from tasks on the file systems that Spark names."""

from __future__ import annotations

from pyarrow import fs

# Stores that Hadoop and Arrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is one of the local disk."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
