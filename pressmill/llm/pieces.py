"""SentencePiece models on the tokenizers library: parsed, rebuilt, and held against the original.

The model file is read as protocol buffer fields. Its normaliser, white-space
marker, pieces with scores and byte fallback are set up as a tokenizer of the
tokenizers library: a unigram model from the scores, or, where the file says it is
one, a byte-pair model whose merges are the pairs of pieces that make a piece, in
the order of its score. Texts are encoded by words (see ``encoding``), which needs
that no piece goes on after a space; a model with such pieces encodes whole texts.

Every piece is also encoded by the sentencepiece library and decoded when it is first
met, and so is every text as a whole; a document is at par if all agree.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import record_batch
from pressmill.llm.encoding import REMEMBERED, PieceEncoder, Pool, marked_cuts, no_cuts, slices, use_threads

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)  # piece types of the format
UNIGRAM, BPE = 1, 2  # model types of the format
WHOLE_EVERY = 1  # one text in so many is encoded whole by the original too: all of them
THREADS = 2  # of either library within a task
BACK, PAR = 1, 2  # marks of a piece: it decodes to itself, the original gives its ids
TOGETHER, JOINED = 4096, 128  # pieces given to the libraries at once, words of a byte-pair model that are one text there
SPACED_WORD = re.compile(f" [^ {MARK}]+").fullmatch


def protobuf_fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size, code = (8, "<d") if kind == 1 else (4, "<f")
            yield number, struct.unpack_from(code, data, at)[0]
            at += size
        else:
            raise ValueError(f"not a SentencePiece model: field of wire type {kind}")


@dataclass
class Model:
    """What a SentencePiece model file says; defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unknown: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in protobuf_fields(data):
            if number == 1:
                piece = dict(protobuf_fields(value))
                model.pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(protobuf_fields(value))
                model.kind = trainer.get(3, UNIGRAM)
                model.unknown = trainer.get(40, 0)
                model.byte_fallback = bool(trainer.get(35, 0))
                model.suffix = bool(trainer.get(24, 0))
            elif number == 3:
                normalizer = dict(protobuf_fields(value))
                model.charsmap = normalizer.get(2, b"")
                model.dummy_prefix = bool(normalizer.get(3, 1))
                model.trim_spaces = bool(normalizer.get(4, 1))
        if model.kind not in (UNIGRAM, BPE) or model.suffix or any(t == USER_DEFINED for _, _, t in model.pieces):
            raise ValueError("only unigram and byte-pair models with prefix marks and no user-defined pieces are rebuilt")
        return model

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first, as a byte-pair model joins them."""
        ids = {piece: n for n, (piece, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        found = []
        for piece, n in ids.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    found.append((-self.pieces[n][1], n, ids[left], ids[right], left, right))
        return [(left, right) for *_, left, right in sorted(found)]

    def tokenizer(self):
        """The model as a tokenizer of the tokenizers library; the dummy prefix is put before by the caller."""
        from tokenizers import Tokenizer, decoders, models, normalizers

        if self.kind == BPE:
            vocabulary = {piece: n for n, (piece, _, _) in enumerate(self.pieces)}
            unknown = self.pieces[self.unknown][0]
            made = models.BPE(vocabulary, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            scores = [(piece, score) for piece, score, _ in self.pieces]
            made = models.Unigram(scores, self.unknown, self.byte_fallback)
        tokenizer = Tokenizer(made)
        tokenizer.normalizer = normalizers.Replace(" ", MARK)
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return tokenizer

    def normalizes(self) -> bool:
        return bool(self.charsmap) or self.trim_spaces

    def normalized(self, texts: list[str]) -> list[str]:
        """Texts as the model's normaliser leaves them, before spaces are marked."""
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim_spaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if not steps:
            return texts
        whole = normalizers.Sequence(steps)
        return [whole.normalize_str(text) for text in texts]

    def splits_at_spaces(self) -> bool:
        return not any(MARK in piece.lstrip(MARK) for piece, _, kind in self.pieces if kind == NORMAL)


class Codec:
    """Encodes and decodes whole texts by a model file, and knows where it differs from the original."""

    def __init__(self, path: str, threads: int = THREADS):
        use_threads(threads)
        import sentencepiece
        from tokenizers import decoders

        with open(path, "rb") as file:
            data = file.read()
        self.model = Model.parse(data)
        self.tokenizer = self.model.tokenizer()
        self.unstripped = self.model.tokenizer()
        self.unstripped.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        self.by_words = self.model.splits_at_spaces()
        self.marked = np.array([piece.startswith(MARK) and kind == NORMAL for piece, _, kind in self.model.pieces])
        self.encoder = PieceEncoder(
            self._encode_pieces,
            marked_cuts if self.by_words else no_cuts,
            lead=" " if self.model.dummy_prefix else "",
            id_type="<u2" if len(self.model.pieces) <= 1 << 16 else "<u4",
            remembered=REMEMBERED // 2,  # the original library remembers beside it
        )

    def _encode_pieces(self, pieces: list[str]) -> Pool:
        """Ids of pieces, and for each whether they decode to it and whether the original gives them.

        Where no piece of a byte-pair model goes on after a space, words with a space
        before them are taken together as one text, and told apart by the ids with a
        marker. A text that has another number of these than words, doesn't decode to
        itself or has other ids by the original is taken word by word.
        """
        size, begin, mark = (np.zeros(len(pieces), dtype=np.int64) for _ in range(3))
        words = [n for n, piece in enumerate(pieces) if SPACED_WORD(piece)] if self.by_words and self.model.kind == BPE else []
        alone = np.setdiff1d(np.arange(len(pieces)), words).tolist()
        flat, held = [], 0
        for start in range(0, len(words), TOGETHER):
            part = words[start : start + TOGETHER]
            groups = [part[at : at + JOINED] for at in range(0, len(part), JOINED)]
            texts = ["".join([pieces[n] for n in group]) for group in groups]
            for group, text, found, again, other in zip(groups, texts, *self._there_and_back(texts), self._original(texts), strict=True):
                begins = np.flatnonzero(self.marked[found])
                if len(begins) != len(group) or begins[0] or again != text or found != other:
                    alone += group
                    continue
                begin[group], size[group], mark[group] = begins + held, np.diff(begins, append=len(found)), BACK | PAR
                flat.append(np.array(found, dtype=self.encoder.id_type))
                held += len(found)
        out = Pool(np.concatenate([np.zeros(0, self.encoder.id_type), *flat]), begin, size, mark)
        ids, marks = [], []
        for start in range(0, len(alone), TOGETHER):
            part = [pieces[n] for n in alone[start : start + TOGETHER]]
            own, back = self._there_and_back(part)
            others = self._original(part)
            marks += [BACK * (text == piece) | PAR * (other == one) for piece, text, one, other in zip(part, back, own, others, strict=True)]
            ids += own
        return Pool.of(ids, self.encoder.id_type, marks).at(alone, out)

    def _there_and_back(self, texts: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids of texts, and what these decode to."""
        ids = [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return ids, self.unstripped.decode_batch(ids, skip_special_tokens=False)

    def _original(self, pieces: list[str]) -> list[list[int]]:
        """The original's ids of pieces, whose dummy prefix, where it has one, is the space they begin with."""
        if not self.model.dummy_prefix:
            return self.original.encode(pieces, num_threads=self.threads)
        found = self.original.encode([piece[1:] for piece in pieces], num_threads=self.threads)
        if " " in pieces:  # a lone space is the marker: without it the text is empty, and has no prefix
            found[pieces.index(" ")] = [self.original.piece_to_id(MARK)]
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's begin and end, and marks: ``BACK`` (they decode to the text), ``PAR``.

        The empty text has no ids and both marks.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        given, normal = texts, texts
        if self.model.normalizes():
            normal = pa.array(self.model.normalized(texts.to_pylist()), pa.large_string())
        ids, offsets, marks = self.encoder.ids(normal)
        empty = pc.equal(normal, "").to_numpy(zero_copy_only=False)
        if self.model.dummy_prefix and empty.any():
            dropped = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(dropped, offsets[:-1][empty], 1)
            np.add.at(dropped, offsets[1:][empty], -1)
            kept = np.cumsum(dropped[:-1]) == 0
            sizes = np.where(empty, 0, np.diff(offsets))
            ids, offsets = ids[kept], np.concatenate(([0], np.cumsum(sizes)))
        marks = np.where(empty, BACK | PAR, marks)
        same = pc.equal(given, normal).to_numpy(zero_copy_only=False)
        return ids, offsets, np.where(same, marks, marks & ~BACK)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian in the encoder's type; none for the empty text."""
        ids, offsets, _ = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[start:end].tobytes() for start, end in zip(offsets[:-1], offsets[1:], strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids that encoding gave.

        Of others, a first piece that is the byte of a space is lost, and a run of
        bytes that isn't UTF-8 is replaced as a whole.
        """
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def held_against_original(self, texts: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the original, given each text as a whole, gives its ids."""
        others = self.original.encode([text or "" for text in texts.to_pylist()], num_threads=self.threads, return_type="numpy")
        ends = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        return np.array([np.array_equal(ids[start:end], other) for (start, end), other in zip(ends, others, strict=True)], dtype=bool)


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int = THREADS) -> Codec:
    """The codec of a worker for a file; loaded once."""
    if (path, threads) not in _codecs:
        _codecs[path, threads] = Codec(path, threads)
    return _codecs[path, threads]


def _encoded(path: str, threads: int, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a column with ids and offsets, whether they decode to the texts, are the original's by piece and whole, and by whole alone.

    A text decodes to itself if all its pieces do; others are decoded whole.
    """
    own = codec(path, threads)
    for part in slices(texts):
        ids, offsets, marks = own.encode_column(part)
        back = marks & BACK > 0
        for place in np.flatnonzero(~back).tolist():
            back[place] = own.decode([ids[offsets[place] : offsets[place + 1]].tolist()])[0] == (part[place].as_py() or "")
        whole = own.held_against_original(part, ids, offsets)
        yield part, ids, offsets, back, (marks & PAR > 0) & whole, whole


def encoded_documents(docs: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids_crc32`` (as 4-byte integers), ``round_trip``, ``parity`` and ``whole_parity`` of every row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A NULL text
    counts as empty and has no pieces. ``round_trip`` tells whether the ids decode
    to the text; a text with the marker itself, or changed by the model's
    normaliser, does not. ``whole_parity`` tells whether the original gives the same
    ids for the text as a whole, ``parity`` whether it does so for every piece of the
    text between spaces too. Both hold for every row, none is left out. Repeated rows
    come out as often as they went in.
    """
    columns = {"doc_id": pa.int64(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "round_trip": pa.bool_(), "parity": pa.bool_(), "whole_parity": pa.bool_()}
    schema = pa.schema(list(columns.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part, ids, offsets, back, par, whole in _encoded(path, threads, batch.column(1)):
                wide = ids.astype("<u4").data
                sums = [zlib.crc32(wide[start:end]) for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield record_batch(schema, [batch.column(0).slice(at, len(part)), np.diff(offsets), sums, pa.array(back), pa.array(par), pa.array(whole)])
                at += len(part)

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, parity boolean, whole_parity boolean")


def with_pieces(docs: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """``doc_id``, ``ids`` (an array of integers) and ``round_trip`` of every row, for training.

    A NULL or empty text has an empty array; rows without an id and repeated rows
    come out as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part, ids, offsets, back, _, _ in _encoded(path, threads, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), lists, pa.array(back)], names=["doc_id", "ids", "round_trip"])
                at += len(part)

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``ids``; NULL ids decode to the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(schema, [batch.column(0), codec(path, threads).decode([ids or [] for ids in batch.column(1).to_pylist()])])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
