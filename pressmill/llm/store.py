"""Plain files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import SparkSession

from pressmill.session import removed_at_end, shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that goes when the application ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    removed_at_end(spark, folder)
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    return folder


@contextmanager
def written(folder: str, name: str) -> Iterator:
    """A stream whose bytes become the file ``name`` once all are written.

    Each attempt writes under a name of its own and moves the file when it is
    whole: a task that is lost or runs twice leaves one complete file.
    """
    system, path = fs.FileSystem.from_uri(folder)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as stream:
        yield stream
    system.move(own, f"{path}/{name}")


@contextmanager
def opened(folder: str, name: str) -> Iterator:
    """A file for reading at any place."""
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}") as found:
        yield found


def read(folder: str, name: str) -> bytes:
    with opened(folder, name) as found:
        return found.read()


def names(folder: str, end: str) -> list[tuple[str, int]]:
    """Names and sizes of the files in a folder that end in ``end``, in order of names."""
    system, path = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(path))
    return sorted((one.base_name, one.size) for one in found if one.base_name.endswith(end) and one.base_name[0] != ".")
