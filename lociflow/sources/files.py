"""Files on any file system that all executors see: local and mounted folders by path, others by address."""

from __future__ import annotations

import fnmatch
import glob
import os
from typing import BinaryIO

from pyarrow import fs


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(pattern: str) -> list[str]:
    """Files of a comma-separated list of paths, folders and patterns, in order; addresses keep their form."""
    out = []
    for part in pattern.split(","):
        system, inner = _system(part)
        if isinstance(system, fs.LocalFileSystem):
            out += glob.glob(f"{inner}/*" if os.path.isdir(inner) else inner)
            continue
        head = part[: len(part) - len(inner)]
        whole = system.get_file_info(inner).type == fs.FileType.Directory if "*" not in inner else False
        folder = inner if whole else inner.rpartition("/")[0]
        names = [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File]
        out += [head + n for n in names if whole or fnmatch.fnmatch(n, inner)]
    return sorted(out)


def opened(path: str) -> BinaryIO:
    """A file to read, from any place in it."""
    system, inner = _system(path)
    return system.open_input_file(inner)


def size(path: str) -> int:
    system, inner = _system(path)
    return system.get_file_info(inner).size


def created(path: str) -> BinaryIO:
    """A file to write, with the folders above it."""
    system, inner = _system(path)
    system.create_dir(inner.rpartition("/")[0] or "/", recursive=True)
    return system.open_output_stream(inner)


def moved(path: str, to: str) -> None:
    system, inner = _system(path)
    system.move(inner, _system(to)[1])
