"""Byte files in the shared folder, written and read by tasks through Hadoop-style URIs."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` (file:, hdfs:, s3:, gs: or a plain path) and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def attempt_name(folder: str, stem: str, suffix: str) -> str:
    """A file name that no other attempt of the task uses; the manifest names the one that counts."""
    return os.path.join(folder, f"{stem}-{uuid.uuid4().hex[:12]}{suffix}")
