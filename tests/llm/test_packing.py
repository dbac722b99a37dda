"""Packed windows against the ids of whole documents, and the packer against its rule."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pressmill.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def item(size, doc_id=0):
    return [packing.Piece(doc_id, 0, size, np.arange(size))]


def sizes(windows):
    return [sum(len(piece.ids) for piece in window) for window in windows]


def test_best_fit_and_the_fullest_is_filled_up():
    packer = packing.Packer(10, 2)
    assert list(packer.put(item(6))) == [] and list(packer.put(item(7))) == []
    assert list(packer.put(item(2))) == []  # into the one with 7, which it leaves the least room in
    assert [window.filled for window in packer.open] == [6, 9]
    full = list(packer.put(item(5)))  # none has room: one id fills the fullest, four go to the other
    assert sizes(full) == [10, 10] and packer.open == []
    assert sizes(packer.put(item(23))) == [10, 10]
    assert [window.filled for window in packer.open] == [3]
    assert sizes(packer.closed()) == [2, 1]


def test_windows_are_bounded():
    rng = random.Random(1)
    packer, total, emitted = packing.Packer(64, 4), 0, []
    for _ in range(2000):
        size = rng.choice([1, 5, 30, 63, 64, 65, 200])
        total += size
        emitted += sizes(packer.put(item(size)))
        assert len(packer.open) <= 4
    assert set(emitted) == {64}
    last = sizes(packer.closed())
    assert sum(emitted) + sum(last) == total
    assert all(size & (size - 1) == 0 for size in last) and len([size for size in last if size < 64]) <= 6


def check(rows, given, length):
    tokenizer = Tokenizer.from_file(PATH)
    documents, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        assert len(row.ids) == 4 * row.length and row.length > 0
        documents[row.doc_id, row.doc_tokens, zlib.crc32(b"")].append(row)
        sequences[row.sequence_id].append(row)
    whole = defaultdict(list)
    for doc_id, text in given:
        whole[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    found = defaultdict(list)
    for (doc_id, tokens, _), pieces in documents.items():
        found[doc_id] += [(p.start, p.length, tokens, np.frombuffer(p.ids, "<u4").tolist()) for p in pieces]
    assert set(found) == set(whole)
    for doc_id, lists in whole.items():
        if len(lists) == 1:
            pieces = sorted(found[doc_id])
            assert [start for start, *_ in pieces] == np.cumsum([0, *[size for _, size, *_ in pieces]])[:-1].tolist()
            assert sum((ids for *_, ids in pieces), []) == lists[0] and {tokens for _, _, tokens, _ in pieces} == {len(lists[0])}
        else:  # copies: each of their ids as often as there are copies
            assert sorted(sum((ids for *_, ids in found[doc_id]), [])) == sorted(sum(lists, []))
    total = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
        size = sum(p.length for p in pieces)
        assert size <= length and (size == length or size & (size - 1) == 0)
        total += size
    assert total == sum(len(one) for lists in whole.values() for one in lists)
    short = [1 for pieces in sequences.values() if sum(p.length for p in pieces) < length]
    assert len(short) <= length.bit_length()


def test_documents(spark):
    rng = random.Random(2)
    given = [(n, " ".join(rng.choices(["alpha", "beta,", "γ", "delta\n"], k=rng.randint(0, 400)))) for n in range(300)]
    given += [(-1, None), (-2, ""), (None, "no id"), (7000, "long " * 30000), (7001, "x" * 50000), (5, "twice"), (5, "twice"), (7002, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in given], "doc_id long, text string, offset int, ids string")
    for parts, windows in ((1, 16), (70, 2)):
        rows = packing.pack_documents(docs.repartition(parts), PATH, windows=windows)
        check(rows.collect(), given, 1024)
    few = packing.packed_documents(docs.filter("doc_id = -1"), PATH).collect()
    assert list(map(tuple, few)) == [(-1, 0, 1, zlib.crc32(b"\0\0\0\0"), 1, few[0].sequence_id, 0)]
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []
    assert packing.packed_documents(docs.limit(0), PATH).dtypes == packing.packed_documents(docs, PATH).dtypes
