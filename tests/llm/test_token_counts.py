import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pressmill.llm import store, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = 50256


def test_blocks_of_any_size(spark):
    rng = random.Random(1)
    folder = store.new_folder(spark, "flat")
    want = []
    for n in range(6):
        sizes = [rng.choice([1, 2, 5, 40, 300]) for _ in range(rng.randint(0, 30))]
        ids = np.concatenate([np.zeros(0, "<u2"), *[np.array([7] * (s - 1) + [END], "<u2") for s in sizes]])
        if n == 2:
            ids, sizes = np.concatenate([ids, np.full(133, 7, "<u2")]), [*sizes, 133]
        if n == 3:
            ids, sizes = np.full(77, 7, "<u2"), [77]
        with store.written(folder, f"{n}.ids") as out:
            out.write(ids.tobytes())
        want += [(f"{n}.ids", at, size) for at, size in enumerate(sizes)]
    for block in (1, 7, 64, 10**6):
        got = token_counts.count_tokens(spark, folder, "<u2", END, block)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_documents(spark):
    tokenizer = Tokenizer.from_file(str(PATH))
    tokenizer.encode_special_tokens = True
    given = [(n, f"word{n} " * (n % 40)) for n in range(150)] + [(None, "no id"), (3, None), (4, ""), (5, "<|endoftext|>"), (6, "very long " * 40000), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id long, text string, file string").repartition(3)
    got = token_counts.counted_documents(docs, PATH, END, 1000).collect()
    want = [(i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in given]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    assert token_counts.counted_documents(docs.limit(0), PATH, END).collect() == []
