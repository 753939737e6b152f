"""Byte access to files from tasks, through the file systems that Arrow knows."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

from pyarrow import fs


def opened(path: str):
    """(file system, path within it) of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def size(path: str) -> int:
    system, own = opened(path)
    return system.get_file_info(own).size


def read(path: str, start: int, n: int) -> bytes:
    system, own = opened(path)
    with system.open_input_file(own) as f:
        return f.read_at(n, start)


def write(path: str, body: bytes, append: bool = False) -> None:
    system, own = opened(path)
    if append:
        with system.open_append_stream(own) as f:
            f.write(body)
        return
    with system.open_output_stream(own) as f:
        f.write(body)


def listed(paths: str | list[str]) -> Iterator[tuple[str, int]]:
    """Data files below the paths, in order of name, with their sizes."""
    for path in [paths] if isinstance(paths, str) else paths:
        system, own = opened(path)
        prefix = path[: len(path) - len(own)] if path.endswith(own) else ""
        info = system.get_file_info(own)
        if info.type == fs.FileType.File:
            yield path, info.size
            continue
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        for f in sorted(system.get_file_info(fs.FileSelector(own, recursive=True)), key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                yield prefix + f.path, f.size


def shared_folder(spark) -> str:
    """A folder that all executors share: the one in ``spark.checkpoint.dir`` (or that the context has).

    Only a session whose tasks all run in this process may go without: it gets a local one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="quillrow-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(_remove, folder)
    return folder.rstrip("/")


def _remove(folder: str) -> None:
    system, own = opened(folder)
    try:
        system.delete_dir(own)
    except OSError:  # another has deleted it, or nothing was written
        return


_own: dict[str, str] = {}


def temporary(spark, label: str) -> str:
    """A new place in the shared folder, which this process deletes when it ends."""
    base = shared_folder(spark)
    if base not in _own:
        _own[base] = f"{base}/quillrow-files/{uuid.uuid4().hex}"
        system, own = opened(_own[base])
        system.create_dir(own, recursive=True)
        atexit.register(_remove, _own[base])
    return f"{_own[base]}/{label}-{uuid.uuid4().hex}"
