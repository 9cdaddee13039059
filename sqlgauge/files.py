"""Small text files of a shared folder, read and written inside tasks through ``pyarrow.fs``."""

from __future__ import annotations

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def write_text(uri: str, text: str) -> None:
    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(text.encode())


def read_texts(folder: str) -> list[str]:
    """The texts of all files directly under ``folder`` (none if it is absent)."""
    system, path = filesystem(folder)
    found = []
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.type == fs.FileType.File:
            with system.open_input_stream(info.path) as f:
                found.append(f.read().decode())
    return found
