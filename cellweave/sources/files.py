"""Files that tasks open themselves, by path or address, on any file system that pyarrow knows; reads are by range."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), posixpath.abspath(path)


def modified(paths: str) -> list[tuple[str, int, int]]:
    """(path, size, time of the last change in nanoseconds) of the files at or under comma-separated paths, by path; names that begin with
    a dot or an underscore are left out."""
    out = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        fs, inner = resolve(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        some = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
        for x in some:
            below = x.path[len(inner) :].split("/")
            if x.type == pafs.FileType.File and not any(name.startswith((".", "_")) for name in below):
                out.append((prefix + x.path, x.size, x.mtime_ns or 0))
    return sorted(out)


def listed(paths: str) -> list[tuple[str, int]]:
    """(path, size) of modified."""
    return [x[:2] for x in modified(paths)]


def opened(path: str):
    """A file for random reads."""
    fs, inner = resolve(path)
    return fs.open_input_file(inner)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which all machines share. Unset, it is a temporary folder in local mode (tests) and an error
    on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = posixpath.join(tempfile.gettempdir(), "cellweave-files")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
