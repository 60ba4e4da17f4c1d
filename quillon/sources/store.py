"""Files of the shared store as tasks and the driver see them: local, HDFS and object stores, by their URI."""

from __future__ import annotations

import re
import time
from functools import cache
from typing import IO, NamedTuple


class Found(NamedTuple):
    uri: str
    name: str
    size: int
    modified: int  # seconds


#: Local files whose URI is their path.
PLAIN = re.compile(r"file:///[^%?#]*[^%?#/]")


@cache
def local():
    from pyarrow import fs

    return fs.LocalFileSystem()


def opened(uri: str):
    """(file system, path in it)"""
    from pyarrow import fs

    if PLAIN.fullmatch(uri):  # nothing to decode; millions of files are opened one by one
        return local(), uri[7:]
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def files(uri: str, recursive: bool = True) -> list[Found]:
    """The file, or the files below a folder in the order of their paths; a folder that isn't there has none."""
    from pyarrow import fs

    store, path = opened(uri.rstrip("/"))
    scheme = uri[: len(uri) - len(path)] if uri.rstrip("/").endswith(path) else ""
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return []
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=recursive))
    return [Found(scheme + f.path, f.base_name, f.size, f.mtime_ns // 10**9) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File]


def children(uri: str) -> list[tuple[str, int | None]]:
    """What stands in a folder, by its URI: a file with its size, a folder without; a folder that isn't there has nothing."""
    from pyarrow import fs

    base = uri.rstrip("/")
    store, path = opened(base)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [(f"{base}/{f.base_name}", f.size if f.type == fs.FileType.File else None) for f in found if f.type != fs.FileType.NotFound]


def read(uri: str) -> IO[bytes]:
    store, path = opened(uri)
    return store.open_input_file(path)


def write(uri: str, folders: bool = True) -> IO[bytes]:
    """A new file; folders above it are made if asked for."""
    store, path = opened(uri)
    if folders:
        store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def put(uri: str, content: bytes) -> None:
    """A whole file, in place of what is there."""
    with write(uri) as f:
        f.write(content)


def make(uri: str, above: bool = True) -> None:
    """A folder; without `above` the folder above it must be there."""
    store, path = opened(uri)
    store.create_dir(path, recursive=above)


def exists(uri: str) -> bool:
    from pyarrow import fs

    store, path = opened(uri)
    return store.get_file_info(path).type != fs.FileType.NotFound


def there(uris: list[str]) -> list[str]:
    """Those that exist, of one store."""
    from pyarrow import fs

    store, paths = opened(uris[0])[0], [opened(u)[1] for u in uris]
    return [u for u, f in zip(uris, store.get_file_info(paths), strict=True) if f.type != fs.FileType.NotFound]


def move(source: str, target: str) -> None:
    """Within one store; folders above the target are made if they are missing.  Object stores copy and delete."""
    store, path = opened(target)
    own = opened(source)[1]
    try:
        store.move(own, path)
    except OSError:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        store.move(own, path)


def delete(uri: str, tries: int = 5) -> None:
    """A file or a folder with all that it holds, if it is there; tried again while others still write into the folder."""
    from pyarrow import fs

    store, path = opened(uri)
    kind = store.get_file_info(path).type
    for left in reversed(range(tries)):
        try:
            if kind == fs.FileType.Directory:
                store.delete_dir(path)
            elif kind == fs.FileType.File:
                store.delete_file(path)
            return
        except FileNotFoundError:
            return
        except OSError:
            if not left:
                raise
            time.sleep(0.2)
