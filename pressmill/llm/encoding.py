"""Token ids of whole texts through the tokenizers and sentencepiece libraries, pieces encoded once.

The tokenizers used here never let a token reach from a word into the white space
behind it. So texts are cut where white space follows something else, as arrays of
bytes; an Arrow dictionary names the different pieces of a batch, the library encodes
those not met before, and the ids of the texts are gathered from those of their
pieces. Which places are safe to cut follows from the tokenizer and is said by each
cutter; all give the ids of the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces and ids a worker remembers, and of the longest piece that it does.
REMEMBERED = 64 << 20
LONGEST = 64
#: Bytes of text that are encoded together.
TOGETHER = 4 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Last bytes of characters that some pattern might take for white space.
DOUBTFUL = np.zeros(256, dtype=bool)
DOUBTFUL[[0x1C, 0x1D, 0x1E, 0x1F, *range(0x80, 0x90), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SIGN = np.zeros(256, dtype=bool)
SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: One match of byte-level patterns: letters (up to U+024F), digits or signs, after a space or none.
ONE_MATCH = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-/:-@\[-`{-~]+)").fullmatch
SPACED_WORD = re.compile(r" \S+").fullmatch


def _ends_white(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character that ends with each byte is white space beyond ASCII, or may be."""
    one, two, three = (data[np.maximum(ends - back, 0)] for back in range(3))
    found = one < 0x20
    found |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    found |= (three == 0xE1) & (((two == 0x9A) & (one == 0x80)) | ((two == 0xA0) & (one == 0x8E)))
    found |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8F) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    found |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    found |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    return found


def byte_level_cuts(data: np.ndarray) -> np.ndarray:
    """Places of ASCII white space behind something that is none.

    Byte-level patterns end a match there: no alternative goes on from a letter,
    digit or sign into white space, and what a run of white space becomes
    depends on what follows it alone.
    """
    white = WHITE[data]
    places = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    before = data[places - 1]
    doubtful = np.flatnonzero(DOUBTFUL[before])
    if len(doubtful):
        wrong = doubtful[_ends_white(data, places[doubtful] - 1)]
        places = np.delete(places, wrong)
    return places


def finer_cuts(data: np.ndarray) -> np.ndarray:
    """Those of ``byte_level_cuts`` and the places of ASCII signs behind ASCII letters.

    Letters go on with letters only; what begins with the sign, a contraction too,
    is a match of its own.
    """
    signs = np.flatnonzero(SIGN[data[1:]] & LETTER[data[:-1]]) + 1
    return np.concatenate([byte_level_cuts(data), signs])


def marked_cuts(data: np.ndarray) -> np.ndarray:
    """Places of spaces behind something that is neither a space nor the marker of SentencePiece."""
    space = data == 32
    places = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    marks = np.flatnonzero(data[places - 1] == 0x81)
    if len(marks):
        ends = places[marks] - 1
        mark = (data[np.maximum(ends - 1, 0)] == 0x96) & (data[np.maximum(ends - 2, 0)] == 0xE2)
        places = np.delete(places, marks[mark])
    return places


def no_cuts(data: np.ndarray) -> np.ndarray:
    return np.zeros(0, dtype=np.int64)


def slices(texts: pa.Array, size: int = TOGETHER) -> Iterator[pa.Array]:
    """Consecutive parts of a column of texts with about so many bytes, at least one text each."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start, before = 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(start, end - start)
        start, before = end, int(ends[end - 1])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without NULLs, and where each text begins and ends in them."""
    texts = texts.cast(pa.large_binary())
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.concat_arrays([texts, texts.slice(0, 0)])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Pool:
    """Ids of many pieces: where in ``flat`` each begins, how many it has, and a mark of each."""

    flat: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    mark: np.ndarray

    @classmethod
    def of(cls, found: list, kind: np.dtype, mark: list[int] | None = None) -> Pool:
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), kind, int(size.sum()))
        return cls(flat, np.cumsum(size) - size, size, np.array(mark or [0] * len(found), dtype=np.int64))

    def with_more(self, other: Pool) -> Pool:
        return Pool(
            np.concatenate([self.flat, other.flat]),
            np.concatenate([self.begin, other.begin + len(self.flat)]),
            np.concatenate([self.size, other.size]),
            np.concatenate([self.mark, other.mark]),
        )

    def at(self, places: list[int], out: Pool) -> Pool:
        """``out`` with these pieces put at the places, its own ids before them."""
        out.begin[places], out.size[places], out.mark[places] = self.begin + len(out.flat), self.size, self.mark
        out.flat = np.concatenate([out.flat, self.flat])
        return out


class PieceEncoder:
    """Encodes texts by pieces. ``lead`` is put before each text.

    Every text gets the bitwise and over the marks of its pieces. What is remembered
    between batches is bounded in bytes, and long pieces are not: scripts without
    spaces and encoded data make pieces that are met once.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], Pool],
        cuts: Callable[[np.ndarray], np.ndarray] = byte_level_cuts,
        lead: str = "",
        id_type: str = "<u2",
        remembered: int = REMEMBERED,
    ):
        self.encode, self.cuts, self.lead = encode, cuts, lead
        self.id_type, self.remembered = np.dtype(id_type), remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = Pool.of([], self.id_type)
        self.held = 0

    def _learned(self, words: list[bytes]) -> Pool:
        """A pool with the ids of the given words, in their order."""
        if self.held > self.remembered:
            self._forget()
        slots = np.fromiter((self.known.get(word, -1) for word in words), np.int64, len(words))
        new = np.flatnonzero(slots < 0).tolist()
        kept = [n for n in new if len(words[n]) <= LONGEST]
        if kept:
            slots[kept] = np.arange(len(kept)) + len(self.pool.size)
            self.known.update(zip([words[n] for n in kept], slots[kept].tolist(), strict=True))
            self.held += sum(len(words[n]) for n in kept) + 150 * len(kept)
            self.pool = self.pool.with_more(self.encode([words[n].decode("utf-8", "surrogatepass") for n in kept]))
        pool, long = self.pool, [n for n in new if len(words[n]) > LONGEST]
        if long:
            slots[long] = np.arange(len(long)) + len(pool.size)
            pool = pool.with_more(self.encode([words[n].decode("utf-8", "surrogatepass") for n in long]))
        return Pool(pool.flat, pool.begin[slots], pool.size[slots], pool.mark[slots])

    def ids(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, where each text's begin and end in them, and its mark.

        NULL counts as the empty text; ``end`` is put behind each text's ids.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.lead:
            texts = pc.binary_join_element_wise(pa.scalar(self.lead, pa.large_string()), texts, pa.scalar("", pa.large_string()))
        data, offsets = _bytes_of(texts)
        starts = np.zeros(len(data) + 1, dtype=bool)
        starts[self.cuts(data)] = True
        starts[offsets] = True
        starts[len(data)] = False
        places = np.flatnonzero(starts)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(places), [None, pa.py_buffer(np.append(places, len(data))), pa.py_buffer(data)]
        ).dictionary_encode()
        pool = self._learned(pieces.dictionary.to_pylist())
        code = pieces.indices.to_numpy(zero_copy_only=False)
        sizes = pool.size[code]
        ends = np.cumsum(sizes)
        shift = (pool.begin[code] - ends + sizes).astype(np.int32)
        flat = pool.flat[np.arange(int(sizes.sum()), dtype=np.int32) + np.repeat(shift, sizes)]
        of = np.searchsorted(places, offsets)
        found = np.concatenate(([0], ends))[of]
        marks = np.full(len(texts), -1, dtype=np.int64)
        full = of[1:] > of[:-1]
        if full.any():
            marks[full] = np.bitwise_and.reduceat(pool.mark[code], of[:-1][full])
        if end is not None:
            flat = np.insert(flat, found[1:], np.array(end, dtype=self.id_type))
            found = found + np.arange(len(found))
        return flat, found, marks

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of the id type."""
        flat, offsets, _ = self.ids(pa.array(texts, pa.large_string()))
        return [flat[start:end].tobytes() for start, end in zip(offsets[:-1], offsets[1:], strict=True)]


def batches_of(texts: list[str], characters: int = 4_000_000):
    """Consecutive runs of texts with about so many characters, at least one text each."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= characters:
            yield run
            run, held = [], 0
    if run:
        yield run


def use_threads(threads: int) -> None:
    """Threads of the tokenizers library in this process, as far as it hasn't started any."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)


_loaded: dict[tuple, PieceEncoder] = {}


def byte_level_encoder(path: str, threads: int = 1, special: bool = False) -> PieceEncoder:
    """Encoder for a byte-level BPE file of the tokenizers library; one per worker and file.

    Strings of special tokens in a text are ordinary text, or, with ``special``,
    those tokens, as the library has it by default. A tokenizer with more steps
    than the plain byte-level ones, or added tokens that look beyond themselves,
    encodes whole texts.
    """
    key = ("byte level", path, threads, special)
    if key not in _loaded:
        use_threads(threads)
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        wide = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        if _plain(tokenizer):
            pieces = ByteLevelPieces(tokenizer, np.dtype(wide))
            _loaded[key] = PieceEncoder(pieces, pieces.cuts(special), id_type=wide)
        else:
            _loaded[key] = PieceEncoder(lambda texts: Pool.of(_each(tokenizer, texts), np.dtype(wide)), no_cuts, id_type=wide)
    return _loaded[key]


def _each(tokenizer, texts: list[str]) -> list[list[int]]:
    return [found.ids for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class ByteLevelPieces:
    """Ids of pieces of a plain byte-level tokenizer, by the shortest way that the library offers.

    What is one match of the pattern is one word of the byte-pair model, which is
    asked for it directly, its bytes written as the model has them. Other pieces of
    a space and one word are encoded as one text and told apart by the tokens with a
    space; the rest one by one.
    """

    def __init__(self, tokenizer, kind: np.dtype):
        self.tokenizer, self.model, self.kind = tokenizer, tokenizer.model, kind
        own = tokenizer.get_vocab(with_added_tokens=False)
        self.spaced = np.zeros(1 << 16 if kind.itemsize == 2 else max(own.values()) + 1, dtype=bool)
        self.spaced[[n for token, n in own.items() if token.startswith("\u0120")]] = True
        self.added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level models write as they are
        hidden = [byte for byte in range(256) if byte not in shown]
        self.written = {byte: 256 + n for n, byte in enumerate(hidden)}

    def cuts(self, special: bool) -> Callable[[np.ndarray], np.ndarray]:
        """Where texts are cut; strings of added tokens must stay whole where they count as such."""
        words = any(re.fullmatch("[A-Za-z]+", content) for content in self.added)
        held = [content.encode() for content in self.added] if special or words else []

        def found(data: np.ndarray) -> np.ndarray:
            if held and any(one in memoryview(data).tobytes() for one in held):
                return byte_level_cuts(data)
            return finer_cuts(data)

        return found

    def _written(self, piece: str) -> str:
        if piece.isascii():
            return piece.replace(" ", "\u0120")
        return piece.encode().decode("latin-1").translate(self.written)

    def __call__(self, pieces: list[str]) -> Pool:
        none = np.zeros(len(pieces), dtype=np.int64)
        out = Pool(np.zeros(0, self.kind), none, none.copy(), none.copy())
        words, joined, alone = [], [], []
        for n, piece in enumerate(pieces):
            if ONE_MATCH(piece) and piece.strip() not in self.added:
                words.append(n)
            elif SPACED_WORD(piece):
                joined.append(n)
            else:
                alone.append(n)
        tokens = self.model.tokenize
        asked = [self._written(pieces[n]) for n in words]
        out = Pool.of([[token.id for token in tokens(word)] for word in asked], self.kind).at(words, out)
        for start in range(0, len(joined), 512):
            part = joined[start : start + 512]
            ids = np.array(_each(self.tokenizer, ["".join([pieces[n] for n in part])])[0], dtype=self.kind)
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) == len(part):
                size = np.diff(np.append(begins, len(ids)))
                out = Pool(ids, begins, size, np.zeros(len(part), dtype=np.int64)).at(part, out)
            else:
                alone += part
        return Pool.of(_each(self.tokenizer, [pieces[n] for n in alone]), self.kind).at(alone, out)


def _plain(tokenizer) -> bool:
    steps = json.loads(tokenizer.to_str())
    split = steps["pre_tokenizer"] or {}
    plain = steps["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    wide = any(
        token["lstrip"] or token["rstrip"] or token["single_word"] or any(c.isspace() for c in token["content"])
        for token in steps["added_tokens"]
    )
    return plain and not wide
