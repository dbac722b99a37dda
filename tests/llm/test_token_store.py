import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pressmill.llm import encoding, token_store
from pressmill.llm.perfect_hash import PerfectHash

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text, special=True: encode(tokenizer, text, special)


def encode(tokenizer, text, special):
    tokenizer.encode_special_tokens = not special
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_whole_text(whole):
    rng = random.Random(1)
    parts = ["a", "b1", " ", "  ", "\n", "\t", ".", "!", "é", "\xa0", "'s", "　", "\x1c", "\x85", "don't", "<|endoftext|>", "🙂", "ß", "Ɂ", "12", "²", "t.", "\x0b", "\u180e"]
    texts = ["", " ", "  ", "x   ", " \n b"] + ["".join(rng.choices(parts, k=30)) for _ in range(1500)]
    for special in (False, True):
        encoder = encoding.byte_level_encoder(PATH, special=special)
        for remembered in (encoding.REMEMBERED, 50):
            encoder.remembered = remembered
            got = [np.frombuffer(ids, encoder.id_type).tolist() for ids in encoder(texts)]
            assert got == [whole(text, special) for text in texts]
        encoder.remembered = encoding.REMEMBERED


def test_special_strings_are_special(spark, whole):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "endoftext|>x<|endoftext|>")], "doc_id long, text string")
    manifest = token_store.write_store(docs, PATH, 2, shards=1)
    assert token_store.get(manifest.folder, 1)[0].tolist() == [64, 220, 50256, 275, 2]
    assert token_store.get(manifest.folder, 2)[0].tolist() == [*whole("endoftext|>x<|endoftext|>"), 2]


def test_long_pieces_are_not_remembered():
    encoder = encoding.PieceEncoder(encoding.byte_level_encoder(PATH).encode, encoding.byte_level_cuts)
    assert len(encoder(["x" * 3_000_000 + " word"])[0]) > 4 and list(encoder.known) == [b" word"]


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 70000):
        keys = np.random.default_rng(n).choice(1 << 40, n, replace=False) - (1 << 39)
        made = PerfectHash.build(keys)
        assert made.size == n and sorted(made.numbers(keys).tolist()) == list(range(n))
        data = made.to_bytes()
        for key in keys[:20].tolist():
            got = PerfectHash.number_at(lambda count, at: data[at : at + count], key)  # noqa: B023
            assert got == (made.numbers(np.array([key]))[0], n, len(data))
        back, size = PerfectHash.from_bytes(made.to_bytes() + b"more")
        assert (back.numbers(keys) == made.numbers(keys)).all() and size == len(made.to_bytes())


def test_store(spark, whole):
    rng = random.Random(4)
    given = [(7 * n - 90, " ".join(rng.choices(["alpha", "beta,", "γ", "delta\n"], k=rng.randint(0, 60)))) for n in range(200)]
    given += [(3, "one of three"), (3, "one of three"), (3, "another of three"), (None, "no id"), (5, None), (6, ""), (4, "long " * 40000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in given], "doc_id long, text string, ids int, rank int")
    got = sorted(map(tuple, token_store.stored_documents(docs, PATH, 2, shards=5).collect()), key=lambda r: r[1])
    want = sorted(((i, len(whole(t)) + 1, zlib.crc32(np.array([*whole(t), 2], "<u4").tobytes())) for i, t in given), key=repr)
    assert sorted(((i, n, c) for i, _, n, c in got), key=repr) == want
    ids = [r[0] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])[:-1])).tolist()


def test_keyed_access(spark, whole):
    docs = spark.createDataFrame([(n * n, f"text number {n}") for n in range(300)] + [(49, "second")], "doc_id long, text string")
    manifest = token_store.write_store(docs, PATH, 2, shards=4, keys_per_map=50)
    assert manifest.maps == 6
    assert token_store.get(manifest.folder, 81)[0].tolist() == [*whole("text number 9"), 2]
    assert sorted(ids.tolist() for ids in token_store.get(manifest.folder, 49)) == sorted([[*whole("text number 7"), 2], [*whole("second"), 2]])
    wrong = sum(bool(token_store.get(manifest.folder, key)) for key in range(2, 400) if round(key**0.5) ** 2 != key)
    assert wrong == 0
    asked = spark.createDataFrame([(16,), (16,), (17,), (None,)], "key long")
    assert [r.doc_id for r in token_store.find_keys(spark, manifest.folder, asked).collect()] == [16]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.stored_documents(docs, PATH, 2).collect() == []
