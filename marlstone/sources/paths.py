"""Files for data sources that run in Python: any file system that pyarrow opens, by URI; plain paths are local."""

from __future__ import annotations

import fnmatch

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path within it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def found(path: str) -> list[str]:
    """The files at ``path``: the file itself, those below a folder, or those that a pattern names; as URIs where ``path`` is one."""
    system, at = opened(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    base = at
    while any(c in base for c in "*?["):
        base = base.rpartition("/")[0]
    info = system.get_file_info(base or "/")
    if info.type == fs.FileType.File:
        return [scheme + at]
    files = system.get_file_info(fs.FileSelector(base or "/", allow_not_found=True, recursive=True)) if info.type == fs.FileType.Directory else []
    pattern = at if base != at else f"{at.rstrip('/')}/*"
    return sorted(scheme + f.path for f in files if f.type == fs.FileType.File and (fnmatch.fnmatch(f.path, pattern) or fnmatch.fnmatch(f.path, pattern.replace("/**/", "/"))))
