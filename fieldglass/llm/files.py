"""Files in the shared folder from inside tasks, through pyarrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str):
    """A file system and the path there."""
    if "://" not in uri:
        uri = "file://" + (uri.removeprefix("file:") if uri.startswith("file:") else uri)
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, ending: str) -> str:
    """A name that no other task or attempt uses; only files named in a finished task's rows count."""
    from pyspark import TaskContext

    at = TaskContext.get()
    return f"{folder}/{at.partitionId() if at else 0:06d}-{uuid.uuid4().hex}{ending}"


def writer(uri: str):
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def reader(uri: str):
    system, path = opened(uri)
    return system.open_input_file(path)
