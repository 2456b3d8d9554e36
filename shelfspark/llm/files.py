"""Files in the shared folder, opened by Python tasks through Arrow's file systems (local, HDFS, S3 and others by URI)."""

from __future__ import annotations

import uuid


def file_system(uri: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


class Replacing:
    """Writes a file under another name and renames it at the end: a task that is run again leaves one whole file."""

    def __init__(self, uri: str):
        self.system, self.path = file_system(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.system.open_output_stream(self.own)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.system.move(self.own, self.path)
        else:
            self.system.delete_file(self.own)


def read_file(uri: str) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        return f.read()
