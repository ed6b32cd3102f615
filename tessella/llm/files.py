"""Byte access to shared files from Python workers, and their care from the driver.

Workers open ``file:`` paths directly and other stores through pyarrow's file systems; the
driver lists and deletes through Hadoop's file systems, which Spark has at hand.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def local_path(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("file", "") else None


@contextmanager
def writing(uri: str):
    """A binary file that appears under its name only once it is whole, so a retried task never leaves half of one."""
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        try:
            with open(part, "wb") as f:
                yield f
            os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.remove(part)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(part) as f:
            yield f
        store.move(part, path)


def reading(uri: str):
    """A binary file for random access."""
    if (path := local_path(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def mapped(uri: str):
    """A memory map where the store is a local or mounted one, else an input file."""
    import pyarrow as pa

    if (path := local_path(uri)) is not None:
        return pa.memory_map(path)
    return reading(uri)


def listing(spark: SparkSession, folder: str, suffix: str) -> list[tuple[str, int]]:
    """(uri, size) of the files of a folder, by name; one row a file, never one a record."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    found = [(s.getPath().toString(), s.getLen()) for s in store.listStatus(path)]
    return sorted((p if "://" in p else p.replace("file:/", "file:///", 1), n) for p, n in found if p.endswith(suffix))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
