"""Links between texts whose five-word shingles are alike, for what SimHash links can't reach.

Copies at a shingle similarity of 0.8 differ in about ten bits of a 64-bit SimHash,
beyond what Golay indices of its segments find. Here texts get ``BANDS`` keys of
``ROWS`` minima each of hashed shingles; two texts at 0.8 share a key with a
probability of 0.998. Of texts that share a key every two end up tested or in one
component already, so no link between components is lost; every link is decided by
the exact similarity of the shingles. Up to ``FEW`` texts under a key all pairs are
tested. A crowd is first held against its centre, the text whose other keys are the
most crowded too, which is linear work and ties copies of one text together. Then
growing shares of the crowd are held against those of other components, in blocks,
until one component or no untested text is left. Only a crowd of texts that are truly
unlike costs pairs, and of these marks of the shingles rule most out in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import frozen, record_batch, released
from pressmill.llm.components import connected_components
from pressmill.llm.decontamination import Words
from pressmill.llm.encoding import batches_of
from pressmill.llm.perfect_hash import mixed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
ODD = np.arange(1, BANDS * ROWS + 1, dtype=np.int64)
FACTORS = mixed(ODD, 1) | np.uint64(1)
FEW = 8
FIRST, GROWTH = 16, 16
BLOCK = 512
MARKS = [f"mark{n}" for n in range(8)]


def shingle_sets(texts: list[str], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted different shingle hashes of each text; fewer words: the whole sequence, none: nothing."""
    found = Words(texts)
    shingles = found.shingles(size)
    for n in range(len(texts)):
        first, last = int(found.first[n]), int(found.first[n + 1])
        if last - first >= size:
            yield np.unique(shingles[first : last - size + 1])
        elif last > first:
            yield np.array([hash_of_all(found.hashes[first:last])], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def hash_of_all(hashes: np.ndarray) -> int:
    value = np.zeros(1, dtype=np.uint64)
    for place in range(len(hashes)):
        value = mixed((value + hashes[place : place + 1]).view(np.int64), 50 + place)
    return int(value[0])


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A signed key per band: the minima of its rows under different multiplications, mixed."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 1 << 14):
        part = shingles[start : start + (1 << 14)]
        for place, factor in enumerate(FACTORS):
            product = part * factor
            least[place] = min(least[place], (product ^ (product >> np.uint64(29))).min())
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        keys = mixed((keys + least.reshape(BANDS, ROWS)[:, row]).view(np.int64), 20 + row)
    return keys.view(np.int64)


def _keyed(texts: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, values, start = batch.column(0).to_numpy(), [t or "" for t in batch.column(1).to_pylist()], 0
            for part in batches_of(values):
                own = nodes[start : start + len(part)]
                start += len(part)
                kept = [(node, band_keys(one)) for node, one in zip(own.tolist(), shingle_sets(part), strict=True) if len(one)]
                keys = np.concatenate([np.zeros(0, np.int64), *[k for _, k in kept]])
                yield record_batch(schema, [keys, np.repeat(np.array([n for n, _ in kept], dtype=np.int64), BANDS)])

    return texts.mapInArrow(run, "key long, node long").distinct()


def marks(shingles: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the shingles that fall on it.

    Of two sets at most as many bits differ as there are shingles in one of them only.
    """
    places = ((shingles * FACTORS[0]) >> np.uint64(55)).astype(np.int64)
    odd = np.bincount(places, minlength=512) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(texts: DataFrame) -> DataFrame:
    names = "node long, shingles binary, size long, " + ", ".join(f"{name} long" for name in MARKS)
    fields = [("node", pa.int64()), ("shingles", pa.binary()), ("size", pa.int64())]
    schema = pa.schema(fields + [(name, pa.int64()) for name in MARKS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, values, start = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], 0
            for part in batches_of(values):
                sets = list(shingle_sets(part))
                marked = np.array([marks(one) for one in sets], dtype=np.int64).reshape(-1, len(MARKS))
                own = nodes[start : start + len(part)]
                yield record_batch(schema, [own, [one.tobytes() for one in sets], [len(one) for one in sets], *marked.T.copy()])
                start += len(part)

    return texts.mapInArrow(run, names)


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs, each once, whose shingles are at least so much alike."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, left, right in zip(*[batch.column(n).to_pylist() for n in range(4)], strict=True):
                one, other = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                shared = len(np.intersect1d(one, other, assume_unique=True))
                if shared >= least * (len(one) + len(other) - shared):
                    kept.append((a, b))
            yield record_batch(schema, [[pair[n] for pair in kept] for n in range(2)])

    pairs = frozen(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    found = frozen(both.mapInArrow(run, "a long, b long"))
    released(pairs)
    return found


def _first_pairs(met: DataFrame) -> DataFrame:
    """All pairs under keys of few nodes; each crowd's nodes with its centre."""
    few, crowd = met.filter(F.col("held") <= FEW), met.filter(F.col("held") > FEW)
    other = few.select("key", F.col("node").alias("b"))
    pairs = few.select("key", F.col("node").alias("a")).join(other, "key").filter("a < b").select("a", "b")
    met_by = met.groupBy("node").agg(F.sum("held").alias("met_by"))
    centres = crowd.join(met_by, "node").groupBy("key").agg(F.max_by("node", F.struct("met_by", "node")).alias("a"))
    stars = crowd.join(centres, "key").filter("a <> node").select("a", F.col("node").alias("b"))
    return pairs.unionByName(stars)


def _across(crowd: DataFrame, start: int, end: int, least: float) -> DataFrame:
    """Pairs of different parts under a key, of which one has its turn from ``start`` up to ``end``.

    Both sides are cut into blocks, and each block of one meets each of the other.
    Pairs go by whose marks or sizes differ in more than the shingles may.
    """
    turns = F.ceil(F.least(F.lit(end), "held") / BLOCK)
    blocks = F.ceil(F.col("held") / BLOCK)
    place = F.xxhash64("node")
    one = crowd.filter((F.col("turn") >= start) & (F.col("turn") < end))
    one = one.withColumns({"row": F.pmod(place, turns), "column": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    other = crowd.withColumns({"column": F.pmod(place, blocks), "row": F.explode(F.sequence(F.lit(0).cast("long"), turns - 1))})
    names = ["node", "part", "size", *MARKS]
    one = one.select("key", "row", "column", *[F.col(name).alias(f"a_{name}") for name in names])
    other = other.select("key", "row", "column", *[F.col(name).alias(f"b_{name}") for name in names])
    allowed = (F.col("a_size") + F.col("b_size")) * ((1 - least) / (1 + least)) + 1e-6
    differing = sum((F.bit_count(F.col(f"a_{name}").bitwiseXOR(F.col(f"b_{name}"))) for name in MARKS), F.lit(0))
    near = (F.abs(F.col("a_size") - F.col("b_size")) <= allowed) & (differing <= allowed)
    met = one.join(other, ["key", "row", "column"]).filter((F.col("a_part") != F.col("b_part")) & near)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def similar_links(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``a`` and ``b``: links between nodes whose texts are alike.

    Alike texts that share a key are linked or in one component of the links.
    ``texts`` has a ``node`` (a number that equal texts share), a ``text`` and,
    where texts repeat, a ``place`` (a number that tells such rows apart); it is
    read twice. Of each text one row is sent to where its shingles
    are made, so copies of a text don't meet. Texts without words have no links.
    """
    if "place" not in texts.columns:
        texts = texts.withColumn("place", F.lit(0).cast("long"))
    keyed = frozen(_keyed(texts.select("node", "text")))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = frozen(keyed.join(counts, "key"))
    released(keyed)
    wanted = met.select("node").distinct()
    first = texts.groupBy("node").agg(F.min("place").alias("place")).join(wanted, "node", "left_semi")
    one = texts.join(first, ["node", "place"], "left_semi")
    sets = frozen(_sets(one.groupBy("node").agg(F.first("text").alias("text"))))
    links = _alike(_first_pairs(met), sets, least)
    crowd = met.filter(F.col("held") > FEW)
    most = crowd.agg(F.max("held").alias("held")).first()["held"] or 0
    # a place among the texts under a key, so that all have had their turn at the size of the crowd
    turn = F.pmod(F.xxhash64("key", "node"), F.lit(1 << 40)) / float(1 << 40) * F.col("held")
    start, end = 0, FIRST
    while start < most:
        components = connected_components(links)
        parts = components.withColumnRenamed("component", "part")
        parted = crowd.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
        several = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
        left = frozen(parted.join(several.select("key"), "key", "left_semi").withColumn("turn", turn))
        released(components)
        if left.isEmpty():
            break
        marked = frozen(left.join(sets.drop("shingles"), "node"))
        links = links.unionByName(_alike(_across(marked, start, end, least), sets, least))
        released(left, marked)
        start, end = end, end * GROWTH
    released(met, sets)
    return links
