"""Article texts as Markdown files in ``issue-*`` folders."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_article_files(articles: DataFrame, folder: str) -> int:
    """Writes ``text`` to ``path`` below a folder that all executors reach; the number of files.

    A file is written under a name of its own and then moved, so an attempt that
    is lost or runs twice leaves whole files. Of rows with one path one is
    written, rows with a NULL path are left out, a NULL text is an empty file.
    """
    from pressmill.operators.incremental import first_by_key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        written = 0
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{top}/{path}"
                system.create_dir(posixpath.dirname(place))
                own = f"{posixpath.dirname(place)}/.{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write((text or "").encode())
                system.move(own, place)
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written])], names=["written"])

    rows = first_by_key(articles.select("path", "text").filter("path is not null"), ["path"])
    return rows.mapInArrow(run, "written long").agg(F.sum("written")).first()[0] or 0
