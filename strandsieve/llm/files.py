"""Binary files in the shared folder, written and read inside tasks.

Tasks reach the folder by its URI through Arrow's file systems (local or mounted folders, HDFS, S3, GCS). A file is
written under a name of its own attempt and moved into place when it is whole, so a task that runs again, or twice at
once, leaves one whole file.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs


@contextlib.contextmanager
def writing(uri: str) -> Iterator:
    """An output stream whose bytes stand at uri once the block ends without an error."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as out:
        yield out
    fs.move(own, path)


@contextlib.contextmanager
def reading(uri: str) -> Iterator:
    """A seekable input file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        yield f
