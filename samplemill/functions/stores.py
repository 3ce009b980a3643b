"""Files of a task, by path or by the URI of a store (file, hdfs, s3, gs)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager


def file_system(path: str):
    """(pyarrow file system, path there); Spark's file:/x is a path like /x."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_folder(folder: str, page: int) -> Iterator[tuple[list[str], list[str]]]:
    """(files, folders) of a folder, so many entries at once; folders whose name starts with a dot are left out."""
    from pyarrow import fs

    system, at = file_system(folder)
    prefix = folder.removesuffix(at) if folder.endswith(at) else folder[: len(folder) - len(at)]

    def entries() -> Iterator[tuple[str, str, bool, bool]]:
        if isinstance(system, fs.LocalFileSystem):  # read as it goes: a folder can hold more than memory does
            with os.scandir(at) as found:
                for e in found:
                    yield os.path.join(at, e.name), e.name, e.is_file(), e.is_dir()
        else:
            for e in system.get_file_info(fs.FileSelector(at)):
                yield e.path, e.base_name, e.type == fs.FileType.File, e.type == fs.FileType.Directory

    files, folders = [], []
    for path, name, is_file, is_folder in entries():
        if is_file:
            files.append(prefix + path)
        elif is_folder and not name.startswith("."):
            folders.append(prefix + path)
        if len(files) + len(folders) >= page:
            yield files, folders
            files, folders = [], []
    if files or folders:
        yield files, folders


@contextmanager
def opened(path: str):
    """A file to read from any place in it; FileNotFoundError where there is none."""
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        yield f


def read_file(path: str | None) -> bytes | None:
    """A file's bytes; None for no path and for one where there is no file."""
    from pyarrow import fs

    if path is None:
        return None
    system, at = file_system(path)
    if system.get_file_info(at).type != fs.FileType.File:
        return None
    with system.open_input_stream(at) as f:
        return f.read()


def write_file(path: str, data: bytes) -> None:
    """Write a file under a temporary name and move it in place."""
    system, at = file_system(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    temporary = f"{at}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as f:
        f.write(data)
    system.move(temporary, at)
