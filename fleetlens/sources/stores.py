"""Files by path or URI, as the tasks see them.

A path without a scheme is a mounted folder or file. A URI (``file:``, ``s3:``, ``gs:``,
``hdfs:`` and whatever else Arrow's file systems know) is read through its file system. Names are
taken as they are: nothing is hidden, and no percent signs are decoded.
"""

from __future__ import annotations

import errno
import os
import re
import stat
from collections.abc import Iterator
from functools import lru_cache
from typing import BinaryIO

from pyarrow import fs

#: path, is_dir, is_symlink, size; an entry that cannot be looked at has no size.
Entry = tuple[str, bool, bool, int | None]

# Fixed value: errors that a scan goes on after.
SCAN_TOLERATES = (errno.EACCES, errno.ENOENT)

_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*:)(?://([^/]*))?(/.*|$)", re.DOTALL)


def is_uri(path: str) -> bool:
    return bool(_URI.fullmatch(path)) and ("://" in path or path.startswith("file:"))


@lru_cache
def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a scheme and host, and what its own paths begin with."""
    found, base = fs.FileSystem.from_uri(root)
    return found, base.rstrip("/")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """A URI's file system and its path there."""
    scheme, host, rest = _URI.fullmatch(uri).groups()
    found, base = _file_system(f"{scheme}//{host or ''}/")
    return found, (base + rest) or "/"


def code(e: OSError) -> int | None:
    """The error's number; file systems that give none are known by their words."""
    if e.errno is not None:
        return e.errno
    said = str(e).lower()
    for words, number in (("is a directory", errno.EISDIR), ("not found", errno.ENOENT), ("does not exist", errno.ENOENT)):
        if words in said:
            return number
    return errno.EACCES if "denied" in said or "forbidden" in said else None


def entry(path: str) -> Entry:
    """One inventory row."""
    if is_uri(path):
        store, inner = located(path)
        try:
            return _entry(store, path, store.get_file_info(inner))
        except OSError as e:
            if code(e) not in SCAN_TOLERATES:
                raise
            return path, False, False, None
    try:
        info = os.lstat(path)
    except OSError as e:
        if e.errno not in SCAN_TOLERATES:
            raise
        return path, False, False, None
    return path, stat.S_ISDIR(info.st_mode), stat.S_ISLNK(info.st_mode), info.st_size


def _entry(store: fs.FileSystem, path: str, info: fs.FileInfo) -> Entry:
    link = isinstance(store, fs.LocalFileSystem) and os.path.islink(info.path)
    folder = info.type == fs.FileType.Directory and not link
    return path, folder, link, 0 if folder or link else info.size


def children(folder: str) -> Iterator[Entry]:
    """Rows of what a folder holds; of one that cannot be listed nothing."""
    if is_uri(folder):
        store, inner = located(folder)
        if isinstance(store, fs.LocalFileSystem):
            yield from _local_children(folder.rstrip("/"), inner)
            return
        try:
            found = store.get_file_info(fs.FileSelector(inner, recursive=False))
        except OSError as e:
            if code(e) not in SCAN_TOLERATES:
                raise
            return
        for info in found:
            yield _entry(store, f"{folder.rstrip('/')}/{info.base_name}", info)
        return
    try:
        names = os.scandir(folder)
    except OSError as e:
        if e.errno not in SCAN_TOLERATES:
            raise
        return
    with names:
        for child in names:
            yield entry(os.path.join(folder, child.name))


def _local_children(folder: str, inner: str) -> Iterator[Entry]:
    """The same of a local folder, name by name: its list is never held whole."""
    try:
        names = os.scandir(inner)
    except OSError as e:
        if e.errno not in SCAN_TOLERATES:
            raise
        return
    with names:
        for child in names:
            path, link = f"{folder}/{child.name}", child.is_symlink()
            try:
                info = child.stat()
            except OSError as e:
                if e.errno not in (*SCAN_TOLERATES, errno.ELOOP):
                    raise
                if e.errno == errno.EACCES:
                    yield path, False, link, 0 if link else None
                continue  # gone, or a link to nowhere
            folders = stat.S_ISDIR(info.st_mode) and not link
            yield path, folders, link, 0 if folders or link else info.st_size if stat.S_ISREG(info.st_mode) else None


def opened(path: str) -> BinaryIO | fs.NativeFile:
    """A file to be read from its start, in blocks."""
    if is_uri(path):
        store, inner = located(path)
        return store.open_input_stream(inner)
    return open(path, "rb")
