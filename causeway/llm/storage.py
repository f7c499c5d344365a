"""Files in the shared folder, by whatever store its URI names."""

from __future__ import annotations

from pyarrow import fs as pafs


def reader(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path within it."""
    return pafs.FileSystem.from_uri(uri)


def folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The same for a folder, made where it is missing."""
    fs, path = reader(uri)
    fs.create_dir(path, recursive=True)
    return fs, path
