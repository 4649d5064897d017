"""Files as byte streams on whatever file system their address names; nothing is held whole."""

from __future__ import annotations

import re

from pyarrow import fs


def _located(address: str) -> tuple[fs.FileSystem, str]:
    # Hadoop writes local files with one slash, Arrow wants three or none
    address = re.sub(r"^file:/*", "/", address)
    return (fs.LocalFileSystem(), address) if address.startswith("/") else fs.FileSystem.from_uri(address)


def open_input(address: str, seekable: bool = False):
    """A file to read, as a stream or with places to go to."""
    system, path = _located(address)
    return system.open_input_file(path) if seekable else system.open_input_stream(path, compression=None)


def open_output(address: str):
    """A file to write; its folder is made."""
    system, path = _located(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def move(source: str, target: str) -> None:
    """Give a file its name; its folder is made, and a file of that name is replaced."""
    system, path = _located(source)
    _, end = _located(target)
    system.create_dir(end.rpartition("/")[0], recursive=True)
    if system.get_file_info(end).type != fs.FileType.NotFound:
        system.delete_file(end)
    system.move(path, end)


def size_of(address: str) -> int | None:
    """The bytes of a file; None if there is none."""
    system, path = _located(address)
    info = system.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None
