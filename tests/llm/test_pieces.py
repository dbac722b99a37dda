import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from pressmill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b1", " ", "  ", "\n", "\t", ".", "é", "\xa0", "'s", "　", "the", "ß", "▁", "🙂", "ation", "<s>", "<unk>", "<0x41>", "\x00"]


def texts():
    rng = random.Random(2)
    return ["", " ", "   ", " a", "a ", "a \nb", "x   ", "▁ x"] + ["".join(rng.choices(PARTS, k=40)) for _ in range(800)]


def test_parity_with_the_original():
    own, original = pieces.Codec(str(PATH)), sentencepiece.SentencePieceProcessor(model_file=str(PATH))
    given = texts()
    for remembered in (10**6, 20):
        own.encoder.remembered = remembered
        ids = [np.frombuffer(one, "<u2").tolist() for one in own.encode(given)]
        assert ids == original.encode(given)
    assert own.decode(ids) == original.decode(ids)
    assert (own.encode_column(pa.array(given))[2] & pieces.PAR).all()
    odd = [[n] for n in range(3, 300) if n != 3 + 0x20] + [[]]
    assert own.decode(odd) == [original.decode(one) for one in odd]


def message(*fields):
    """A protocol buffer message of (number, value) fields."""

    def varint(n):
        out = b""
        while n >= 128:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def unigram_model(path):
    """A small unigram model with byte fallback, written by hand."""
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{n:02X}>", 0.0, 6) for n in range(256)]
    words = ["▁", "▁the", "the", "▁a", "t", "h", "e", "a", "s", "▁as", "sea", "ea", "▁sea", "é", ".", "b", "he", "▁▁"]
    listed += [(word, -1.0 - 0.37 * n, 1) for n, word in enumerate(words)]
    body = [(1, message((1, p.encode()), (2, s), (3, t))) for p, s, t in listed]
    trainer = message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2), (43, 2))
    path.write_bytes(message(*body, (2, trainer), (3, message((1, b"identity"), (3, 1), (4, 0)))))
    return str(path)


def test_unigram_model(tmp_path):
    path = unigram_model(tmp_path / "small.model")
    own, original = pieces.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert own.model.kind == pieces.UNIGRAM and own.model.byte_fallback
    rng = random.Random(3)
    given = ["", "the sea", "as the", "é b"] + ["".join(rng.choices(["the", " ", "sea", "as", ".", "é", "ü", "a", "he"], k=20)) for _ in range(300)]
    ids = [np.frombuffer(one, "<u2").tolist() for one in own.encode(given)]
    assert ids == original.encode(given)
    assert own.decode(ids) == original.decode(ids)


def test_documents(spark):
    given = list(enumerate(texts())) + [(9000, None), (9001, "long word " * 30000), (None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in given], "doc_id long, text string, ids int")
    original = sentencepiece.SentencePieceProcessor(model_file=str(PATH))

    def row(doc_id, text):
        ids = original.encode(text or "")
        return doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), original.decode(ids) == (text or ""), True, True if zlib.crc32((text or "").encode()) % pieces.WHOLE_EVERY == 0 else None

    got = sorted(map(tuple, pieces.encoded_documents(docs, PATH).collect()), key=repr)
    assert got == sorted((row(*one) for one in given), key=repr)
    coded = pieces.with_pieces(docs, PATH)
    back = sorted(((r.doc_id, r.text) for r in pieces.decoded(coded, PATH).collect()), key=repr)
    assert back == sorted(((i, original.decode(original.encode(t or ""))) for i, t in given), key=repr)
    assert pieces.encoded_documents(docs.limit(0), PATH).collect() == []


def test_every_text_is_held_whole_against_the_original(spark):
    rows = [(n, f"text {n} of the sea") for n in range(200)] + [(None, None), (7, "")]
    got = pieces.encoded_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert [(r.parity, r.whole_parity) for r in got] == [(True, True)] * len(rows)
    own, given = pieces.Codec(str(PATH)), pa.array([text for _, text in rows[:200]], pa.large_string())
    ids, offsets, _ = own.encode_column(given)
    assert own.held_against_original(given, ids, offsets).all()
    for place in (0, 63, 199):
        wrong = ids.copy()
        wrong[offsets[place]] += 1
        assert np.flatnonzero(~own.held_against_original(given, wrong, offsets)).tolist() == [place]


def test_words_taken_together_have_the_ids_and_marks_of_each():
    own, rng = pieces.Codec(str(PATH)), random.Random(5)
    words = ["".join([" ", *rng.choices(PARTS, k=rng.randint(1, 6))]) for _ in range(6000)] + [" ", "a", " the", ""]
    pool = own._encode_pieces(words)
    alone = own.tokenizer.encode_batch_fast(words, add_special_tokens=False)
    back = own.unstripped.decode_batch([one.ids for one in alone], skip_special_tokens=False)
    assert [pool.flat[b : b + n].tolist() for b, n in zip(pool.begin, pool.size, strict=True)] == [one.ids for one in alone]
    assert [bool(mark & pieces.BACK) for mark in pool.mark] == [text == word for text, word in zip(back, words, strict=True)]
