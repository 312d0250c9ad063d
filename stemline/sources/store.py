"""Files on a file system that driver and executors share: local paths, file://, hdfs://, s3:// and what else pyarrow knows."""

from __future__ import annotations

import fnmatch
import posixpath


def store(uri: str):
    """(pyarrow file system, path)."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.LocalFileSystem(), uri


def listing(uri: str, pattern: str) -> list[str]:
    """Sorted paths (on the file system of store()) of a file, of the files of a folder whose names match the pattern, or of those that a name with wild cards matches."""
    from pyarrow import fs

    system, path = store(uri)
    if any(c in path for c in "*?["):
        folder, pattern = posixpath.split(path)
    else:
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [path]
        folder = path
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))
