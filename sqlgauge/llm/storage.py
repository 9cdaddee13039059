"""Files in the shared folder, read and written inside tasks through ``pyarrow.fs``.

``base_folder`` lies under the session's checkpoint folder, which the driver and
all executors share. Paths are URIs (``file:``, ``hdfs:``, ``s3:``, ...).
A task writes under a name of its own attempt; only names that its committed
result lists are ever read, so a retried or doubled task leaves no mixture.
"""

from __future__ import annotations

import uuid

from pyarrow import fs

from sqlgauge.session import work_path


def base_folder(spark, kind: str) -> str:
    return work_path(spark, kind)


def split(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def task_file(folder: str, stem: str, suffix: str) -> str:
    """A name that no other attempt of any task uses."""
    return f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"


def open_output(uri: str):
    system, path = split(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def open_input(uri: str):
    """A seekable handle with ``read_at`` and ``size``."""
    system, path = split(uri)
    return system.open_input_file(path)


def write_bytes(uri: str, data: bytes) -> None:
    with open_output(uri) as f:
        f.write(data)


def read_bytes(uri: str) -> bytes:
    with open_input(uri) as f:
        return f.read()
