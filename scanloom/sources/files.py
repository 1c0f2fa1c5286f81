"""File access for the binary formats, on any file system Arrow can open."""

from __future__ import annotations

import fnmatch
import glob
import os

import pyarrow.fs as pafs

CHUNK_BYTES = 8 << 20
SPLIT_BYTES = 128 << 20


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it. Plain paths are local or mounted."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def list_inputs(path: str, suffix: str, recursive: bool = True) -> list[tuple[str, int]]:
    """Data files below a folder, matching a pattern, or the one file named, with sizes, sorted by name."""
    found: list[tuple[str, int]] = []
    for one in path.split(","):
        fs, inner = resolve(one)
        if any(ch in inner for ch in "*?["):
            root = inner[: min(inner.index(ch) for ch in "*?[" if ch in inner)].rsplit("/", 1)[0]
            if isinstance(fs, pafs.LocalFileSystem):
                names = [p for p in glob.glob(inner, recursive=True) if os.path.isfile(p)]
                infos = fs.get_file_info(names) if names else []
            else:
                infos = fs.get_file_info(pafs.FileSelector(root, recursive=True))
                infos = [i for i in infos if fnmatch.fnmatch(i.path, inner)]
        else:
            info = fs.get_file_info(inner)
            if info.type == pafs.FileType.Directory:
                infos = fs.get_file_info(pafs.FileSelector(inner, recursive=recursive))
                infos = [i for i in infos if i.path.endswith(suffix)]
            elif info.type == pafs.FileType.File:
                infos = [info]
            else:
                raise FileNotFoundError(one)
        prefix = one.split("://", 1)[0] + "://" if "://" in one and not one.startswith("file:") else ""
        for i in infos:
            hidden = any(part.startswith(("_", ".")) for part in i.path[len(inner) :].split("/") if part)
            if i.type == pafs.FileType.File and not hidden:
                found.append((prefix + i.path, i.size))
    return sorted(found)


def open_input(path: str):
    fs, inner = resolve(path)
    return fs.open_input_file(inner)
