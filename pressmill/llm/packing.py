"""Packs token ids of documents into windows of one length, by bounded-space online best fit.

Every task keeps at most ``windows`` open windows. What is longer than a window
fills windows of its own; the rest goes to the open window that it leaves the
least room in. Where none has room and no more may be opened, the fullest is
filled up with the first ids of the document and emitted, and the rest of the
document is placed anew. So a window is emitted full or not at all.

What is open when a task ends is left over: at most ``windows`` windows a task,
with their ids. Leftovers of ``MERGED`` tasks are packed together by the same rule
with whole windows as items, in rounds, until one task holds the last of them.
These become full windows and, for the rest, windows whose lengths are powers of
two, so that nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm import encoding
from pressmill.llm.common import frozen, only, record_batch

LENGTH = 1024
WINDOWS = 16
MERGED = 32
#: Sequence numbers of a task begin at its number times this.
TASK_SEQUENCES = 1 << 36
ROUND_TASKS = 1 << 22

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, task long, open_window int, ids binary"
SCHEMA = pa.schema(
    [
        *[(name, pa.int64()) for name in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "task")],
        ("open_window", pa.int32()),
        ("ids", pa.binary()),
    ]
)


@dataclass(eq=False)
class Piece:
    """Some consecutive ids of a document."""

    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:at]), Piece(self.doc_id, self.start + at, self.doc_tokens, self.ids[at:])


@dataclass(eq=False)
class Window:
    pieces: list[Piece] = field(default_factory=list)
    filled: int = 0

    def put(self, pieces: list[Piece]) -> None:
        self.pieces += pieces
        self.filled += sum(len(piece.ids) for piece in pieces)


def taken(pieces: list[Piece], count: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``count`` ids of pieces, and what is left of them."""
    head, rest = [], list(pieces)
    while count and rest:
        piece = rest.pop(0)
        if len(piece.ids) > count:
            piece, after = piece.cut(count)
            rest.insert(0, after)
        count -= len(piece.ids)
        head.append(piece)
    return head, rest


class Packer:
    """The open windows of a task; ``put`` gives the windows that an item makes full."""

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS):
        self.length, self.most, self.open = length, windows, []

    def put(self, item: list[Piece]) -> Iterator[list[Piece]]:
        size = sum(len(piece.ids) for piece in item)
        while size >= self.length:
            full, item = taken(item, self.length)
            size -= self.length
            yield full
        while size:
            roomy = [window for window in self.open if window.filled + size <= self.length]
            if roomy or len(self.open) < self.most:
                if not roomy:
                    roomy = [Window()]
                    self.open += roomy
                best = max(roomy, key=lambda window: window.filled)
                best.put(item)
                size = 0
            else:
                best = max(self.open, key=lambda window: window.filled)
                head, item = taken(item, self.length - best.filled)
                size -= self.length - best.filled
                best.put(head)
            if best.filled == self.length:
                self.open.remove(best)
                yield best.pieces

    def closed(self) -> Iterator[list[Piece]]:
        """What is open, as full windows and windows whose lengths are powers of two."""
        rest = [piece for window in sorted(self.open, key=lambda window: -window.filled) for piece in window.pieces]
        self.open = []
        size = sum(len(piece.ids) for piece in rest)
        while size:
            count = self.length if size >= self.length else 1 << (size.bit_length() - 1)
            window, rest = taken(rest, count)
            size -= count
            yield window


class Rows:
    """Pieces on their way to Arrow batches, numbered as sequences of one task."""

    def __init__(self, task: int):
        self.task, self.sequences = task, 0
        self.columns: list[list] = [[] for _ in SCHEMA]

    def add(self, pieces: list[Piece], open_window: int | None = None) -> None:
        sequence = None
        if open_window is None:
            sequence = self.task * TASK_SEQUENCES + self.sequences
            self.sequences += 1
        offset = 0
        for piece in pieces:
            row = (piece.doc_id, piece.start, len(piece.ids), piece.doc_tokens, sequence, offset, self.task, open_window, piece.ids.astype("<u4").tobytes())
            for column, value in zip(self.columns, row, strict=True):
                column.append(value)
            offset += len(piece.ids)

    def batch(self) -> pa.RecordBatch:
        made = record_batch(SCHEMA, self.columns)
        self.columns = [[] for _ in SCHEMA]
        return made


def _packed(docs: DataFrame, tokenizer: str, end: int, length: int, windows: int, threads: int) -> DataFrame:
    """Pieces of full windows (with a sequence) and of those left open, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoding.byte_level_encoder(tokenizer, threads, special=True)
        packer, rows = Packer(length, windows), Rows(TaskContext.get().partitionId())
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for part in encoding.slices(batch.column(1)):
                ids, offsets, _ = encoder.ids(part, end)
                for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for window in packer.put([Piece(keys[at], 0, last - first, ids[first:last])]):
                        rows.add(window)
                    at += 1
                for window in packer.open:  # so that no open window holds on to the ids of a whole part
                    for piece in window.pieces:
                        piece.ids = piece.ids.copy()
                yield rows.batch()
        for number, window in enumerate(packer.open):
            rows.add(window.pieces, number)
        yield rows.batch()

    return docs.mapInArrow(run, PIECES)


def _merged(left: DataFrame, turn: int, tasks: int, length: int, windows: int) -> DataFrame:
    """Leftovers of ``MERGED`` tasks each, packed together; those of the last round are closed."""
    last = tasks <= MERGED

    def run(group: pa.Table) -> pa.Table:
        rows = Rows(turn * ROUND_TASKS + group.column("task")[0].as_py() % ROUND_TASKS // MERGED)
        packer = Packer(length, windows)
        items: dict[tuple[int, int], list] = {}
        for row in group.sort_by([("task", "ascending"), ("open_window", "ascending"), ("offset", "ascending")]).to_pylist():
            piece = Piece(row["doc_id"], row["start"], row["doc_tokens"], np.frombuffer(row["ids"], "<u4"))
            items.setdefault((row["task"], row["open_window"]), []).append(piece)
        for item in items.values():
            for window in packer.put(item):
                rows.add(window)
        if last:
            for window in packer.closed():
                rows.add(window)
        for number, window in enumerate(packer.open):
            rows.add(window.pieces, number)
        return pa.Table.from_batches([rows.batch()])

    key = F.floor(F.col("task") % ROUND_TASKS / MERGED).alias("merge")
    return left.groupBy(key).applyInArrow(run, PIECES)


def pack_documents(
    docs: DataFrame, tokenizer: str, end: int = 0, length: int = LENGTH, windows: int = WINDOWS, threads: int = 1
) -> DataFrame:
    """``docs`` as pieces of sequences of ``length`` ids: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``ids`` are
    little-endian unsigned 32-bit integers. A document is its text's ids and
    ``end``; a NULL text counts as empty and is ``end`` alone. Rows without an id
    and repeated rows are documents of their own. All sequences have ``length``
    ids but for fewer than its number of binary digits, whose lengths are powers of
    two. An empty table gives no rows. Sequences are numbered within the tasks
    that made them and the numbers have gaps. Tasks hold a slice of texts and the
    open windows; each is written once, so a lost executor costs a task.
    """
    rows = only(docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}), "doc_id", "text")
    made = frozen(_packed(rows, tokenizer, end, length, windows, threads))
    parts, turn = [made], 0
    while True:
        left = made.filter("sequence_id is null")
        most = left.agg(F.max(F.col("task") % ROUND_TASKS)).first()[0]
        if most is None:
            break
        turn += 1
        made = frozen(_merged(left, turn, most + 1, length, windows))
        parts.append(made)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.filter("sequence_id is not null").drop("task", "open_window")


def packed_documents(docs: DataFrame, tokenizer: str, end: int = 0, length: int = LENGTH, windows: int = WINDOWS) -> DataFrame:
    """The pieces of ``pack_documents`` with a checksum in the place of their ids."""
    return pack_documents(docs, tokenizer, end, length, windows).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
