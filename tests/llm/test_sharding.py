import zlib
from collections import Counter

from pressmill.llm import sharding


def test_shards(spark):
    given = [(n, f"text {n % 50}" * (n % 7)) for n in range(900)] + [(5, "")] * 300 + [(None, "x"), (7, None), (7, None), (8, "é" * 90000)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in given], "doc_id long, text string, shard int")
    got = sharding.shard_documents(docs, [1.0] * 8, [1.0] * 9).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert set(slots) == set(range(8))
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    moved = [r for r in got if r.grown_shard == 8]
    assert 0 < len({r.doc_id for r in moved}) < 200
    assert sharding.shard_documents(docs.limit(0), [1.0] * 8).collect() == []


def test_blocks_do_not_change_the_numbers(spark):
    rows = spark.createDataFrame([(n % 3, n) for n in range(500)] + [(1, 4)] * 50, "shard int, n int")
    found = []
    for partitions in ("1", "5", "64"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append(sorted(map(tuple, sharding.numbered(rows, "shard", "slot").collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_weights(spark):
    """Shares follow the weights, and a removed shard's rows are all that move."""
    keys = spark.range(6000)
    of = lambda weights: {r.id: r.s for r in keys.select("id", sharding.rendezvous(keys.id, weights).alias("s")).collect()}
    heavy = of([1.0, 2.0, 3.0])
    shares = Counter(heavy.values())
    assert all(abs(shares[s] - 1000 * (s + 1)) < 200 for s in range(3))
    without = of([1.0, 2.0, 0.0])
    assert all(without[k] == s for k, s in heavy.items() if s != 2)
