"""Opening and listing files from Python tasks, on any file system pyarrow knows."""

from __future__ import annotations

import fnmatch
import posixpath

import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain local path."""
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri.split("://", 1)[1]
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), posixpath.abspath(uri)


def list_files(uri: str, pattern: str) -> list[tuple[str, int]]:
    """(uri, bytes) of a file, or of those files of a folder or glob that fit `pattern`.

    A name is a glob only if no such file exists. A glob that no file fits raises.
    """
    fs, path = locate(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(uri, info.size)]
    head, tail = posixpath.split(uri)
    is_glob = info.type == pafs.FileType.NotFound and any(c in tail for c in "*?[")
    if is_glob:
        uri = head
        fs, path = locate(uri)
        info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {uri}")
    files = [f for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File]
    if is_glob:
        files = [f for f in files if fnmatch.fnmatchcase(f.base_name, tail)]
        if not files:
            raise FileNotFoundError(f"no file fits: {posixpath.join(uri, tail)}")
    return sorted((posixpath.join(uri, f.base_name), f.size) for f in files if fnmatch.fnmatchcase(f.base_name, pattern))


def remove_folder(folder: str) -> None:
    """Remove a folder that nothing reads any more, if it is there."""
    fs, path = locate(folder)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)
