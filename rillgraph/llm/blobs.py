"""Binary files in a folder that all executors share."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of file:, viewfs-less Hadoop or object-store URIs and plain paths."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(u.path)
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> str:
    f, path = filesystem(uri)
    f.create_dir(path, recursive=True)
    return uri


class Writer:
    """A file under a name of its own for each attempt: written aside, moved when closed. Readers go by a committed
    manifest of names, so what a lost or repeated attempt leaves is never read."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
        self.fs, self.path = filesystem(self.uri)
        self.aside = os.path.join(os.path.dirname(self.path), "_" + os.path.basename(self.path))
        self.out, self.size = self.fs.open_output_stream(self.aside), 0

    def write(self, data: bytes) -> int:
        at, self.size = self.size, self.size + len(data)
        self.out.write(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.aside, self.path)
        return self.uri


def read(uri: str) -> bytes:
    f, path = filesystem(uri)
    with f.open_input_stream(path) as s:
        return s.read()


def rename(source: str, target: str) -> None:
    """Give a file its final name. Where that exists (an earlier attempt wrote the same bytes) this copy is removed."""
    f, a = filesystem(source)
    b = filesystem(target)[1]
    try:
        f.move(a, b)
    except OSError:
        if f.get_file_info(b).type != fs.FileType.File:
            raise
        f.delete_file(a)
