"""Files of any store, opened in tasks by the same URI everywhere."""

from __future__ import annotations

from urllib.parse import urlparse


def opened(uri: str):
    """(file system, path) of a URI or a local path: local files, and the stores that Arrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
