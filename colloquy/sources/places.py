"""Files that Python data sources list, read and write: any store that Arrow knows (local or mounted folders, HDFS, S3, GCS)."""

from __future__ import annotations

import os

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def listed(uri: str, ending: str, deep: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of a folder's files with an ending, by path; none where there is no folder. What begins with _ or . is no data."""
    store, path = place(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=deep))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(ending) and f.base_name[0] not in "_.")


def read(uri: str, path: str, start: int = 0, end: int | None = None) -> bytes:
    """Bytes of a file under uri."""
    with place(uri)[0].open_input_file(path) as file:
        return file.read_at((file.size() if end is None else end) - start, start)


def write(uri: str, path: str, data: bytes) -> None:
    """A whole file under uri; its folder is made."""
    store = place(uri)[0]
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as file:
        file.write(data)


def exists(uri: str, path: str) -> bool:
    return place(uri)[0].get_file_info(path).type != fs.FileType.NotFound


def drop(uri: str, path: str) -> None:
    """A file or folder, if it is there."""
    store = place(uri)[0]
    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind == fs.FileType.File:
        store.delete_file(path)


def deal(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs [first, last) of consecutive items whose sizes add up to most at most, or that are one larger item."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            out.append((first, i))
            first, held = i, 0
        held += size
    return [*out, (first, len(sizes))] if len(sizes) > first else out
