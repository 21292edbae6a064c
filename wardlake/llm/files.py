"""Binary files in the shared folder, written and read inside tasks.

``pyarrow.fs`` opens the folder by its URI, so the same code serves a mounted
folder (``file:``), HDFS and object stores. A file gets its final name only
when it is whole: a lost or repeated task leaves nothing half written, and a
second attempt puts the same bytes in the same place.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager


def open_folder(uri: str):
    """(filesystem, path) of a folder given as URI or plain path."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


@contextmanager
def whole_file(uri: str, name: str) -> Iterator:
    """A stream to a file that appears as ``uri/name`` when the block ends well."""
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(draft) as out:
            yield out
        system.move(draft, f"{folder}/{name}")
    except BaseException:
        try:
            system.delete_file(draft)
        except OSError:
            pass
        raise


def open_file(uri: str, name: str):
    """Random-access reader of ``uri/name``."""
    system, folder = open_folder(uri)
    return system.open_input_file(f"{folder}/{name}")
