"""Files that tasks read and write themselves: any file system that pyarrow opens by its address."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def at(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it; a plain path is a local (or mounted) one."""
    if folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:").removeprefix("//")
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; local sessions without it get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "maskframe")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """A whole file at once: a reader sees all of it or none, and a task's second attempt replaces the first one's."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(part, compression=None) as f:
        f.write(data)
    system.move(part, path)


def get(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound
