"""SimHash near-duplicates, found through Golay indices of fingerprint segments.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Of two
fingerprints with at most two differing bits one segment is equal (two errors
can't reach three segments), and the next differs in at most two bits, so both
share one of its Golay indices. The pair (equal segment, index of the next)
gives each fingerprint 3 to 18 keys of 33 to 34 bits; fingerprints that meet
under a key are compared bit by bit.

Only distinct fingerprints are joined, so copies cost nothing. A key that holds
more than ``crowd`` of them isn't joined: there each fingerprint names the words
within one bit of it, and two are within two bits exactly if they name the same
word, so all that name it are tied to the least of them. That is linear in the
size of the crowd and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm import golay
from pressmill.llm.common import column_bytes, fresh, frozen, record_batch, released
from pressmill.llm.components import connected_components
from pressmill.llm.similar import similar_links

SHINGLE = 3
SEED = 42
REACH = 2
SEGMENTS = ((42, 22), (21, 21), (0, 21))
CROWD = 128


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles of the lower-cased words of a text, repeats included."""
    words = text.lower().split()
    joined = b" ".join(words)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(joined[start:end], SEED) for start, end in pairs], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; none: zero."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of one text; empty or without words: zero."""
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``digest`` (of the text) and ``fingerprint`` (a signed 64-bit value) per row."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text, size) for text in column_bytes(batch, "text")]
            signed = np.array(prints, dtype=np.uint64).view(np.int64)
            yield record_batch(schema, [batch.column(0), batch.column(1), signed])

    rows = docs.select(F.col("doc_id").cast("long"), text_digest(F.col("text")).alias("digest"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, digest long, fingerprint long")


def text_digest(text: Column) -> Column:
    """A number that tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the fingerprint and key, for all keys of the given fingerprints."""
    parts = [(words >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    at, keys = [], []
    for place, equal in enumerate(parts):
        near = golay.indices(parts[(place + 1) % len(parts)])
        key = (np.int64(place) << 34) | (equal[:, None] << 12) | near
        held = near >= 0
        at.append(np.nonzero(held)[0])
        keys.append(key[held])
    return np.concatenate(at), np.concatenate(keys)


def _keyed(prints: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy()
            at, keys = segment_keys(signed.view(np.uint64))
            yield record_batch(schema, [keys, signed[at]])

    return prints.select("fingerprint").mapInArrow(run, "key long, fingerprint long")


def _within_one(word: Column) -> Column:
    """A word and the 64 words that differ from it in one bit."""
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), bit) for bit in range(64)])
    return F.explode(F.transform(flips, lambda flip: word.bitwiseXOR(flip)))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a`` and ``b``: links that tie all distinct fingerprints within two bits together.

    Links of pairs under a key are those of the pairs themselves; links in a
    crowd go to the least fingerprint around each word, with the same components.
    """
    keyed = frozen(_keyed(prints))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > crowd)
    crowded = frozen(crowded.select("key"))
    sparse = keyed.join(crowded, "key", "left_anti")
    other = sparse.select("key", F.col("fingerprint").alias("b"))
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = (
        sparse.select("key", F.col("fingerprint").alias("a"))
        .join(other, "key")
        .filter((F.col("a") < F.col("b")) & (differing <= REACH))
        .select("a", "b")
    )
    stars = (
        keyed.join(crowded, "key", "left_semi")
        .select("fingerprint")
        .distinct()
        .select(F.col("fingerprint").alias("b"), _within_one(F.col("fingerprint")).alias("word"))
    )
    least = stars.groupBy("word").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    tied = stars.join(least.drop("held"), "word").filter("a <> b").select("a", "b")
    found = met.unionByName(tied).distinct()
    found._reads = (keyed, crowded)  # for ``released``
    return found


def _members(docs: DataFrame, size: int, crowd: int, wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints, and for each fingerprint the first row of its group."""
    rows = frozen(fingerprints(docs, size))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    prints = frozen(rows.groupBy("fingerprint").agg(first))
    linked = links(prints, crowd)
    components = connected_components(linked)
    released(*linked._reads)
    grouped = components.withColumnRenamed("node", "fingerprint")
    held = prints.join(grouped, "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    held = frozen(held)
    released(prints, components)
    if wide:
        close, held = held, frozen(_widened(docs, rows, held))
        released(close)
    firsts = held.groupBy("component").agg(F.min("first").alias("first"))
    return rows, held.select("fingerprint", "component").join(firsts, "component")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A NULL text
    counts as empty; empty texts and texts of white space have fingerprint zero and
    are linked like all others. Rows with a NULL id are grouped too, but name a
    group only if it has no other (then ``component_id`` is NULL). Repeated rows
    come out as often as they went in. An empty table gives no rows.
    """
    rows, groups = _members(docs, size, crowd)
    return rows.join(groups, "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def _widened(docs: DataFrame, rows: DataFrame, held: DataFrame) -> DataFrame:
    """The fingerprints with components that texts of alike shingles join."""
    text = F.col("text").cast("string")
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    texts = docs.select(text_digest(text).alias("node"), place.alias("place"), text.alias("text"))
    found = similar_links(texts)
    of = frozen(rows.select("digest", "fingerprint").distinct().join(held.select("fingerprint", "component"), "fingerprint").select("digest", "component"))
    ends = [of.select(F.col("digest").alias(end), F.col("component").alias(f"{end}_part")) for end in "ab"]
    edges = found.join(ends[0], "a").join(ends[1], "b").select("a_part", "b_part").distinct()
    joined = connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    wider = held.join(joined, "component", "left")
    return wider.withColumn("component", F.coalesce("wider", "component")).drop("wider")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays per near-duplicate group.

    Groups are those of fingerprints within two bits, joined where five-word
    shingles are 0.8 or more alike (see ``similar``).
    The row with the least ``doc_id`` stays; rows without an id stay only where
    the group has none with one; of equal ids the text with the least digest
    stays, of repeated rows one.
    """
    rows, groups = _members(docs, size, crowd, wide=True)
    kept_id, kept_digest, digest = fresh(docs, "kept_id", "kept_digest", "digest")
    copies = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    kept = groups.select("first.doc_id", "first.digest").distinct()
    same = F.col("k.digest") == F.col("c.digest")
    same = same & F.col("k.doc_id").eqNullSafe(F.col("c.doc_id"))
    kept = frozen(kept.alias("k").join(copies.alias("c"), same).select("k.*", "copies"))
    at = docs.withColumn(digest, text_digest(F.col("text").cast("string")))

    def staying(copies: Column) -> DataFrame:
        chosen = kept.filter(copies).select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest))
        same = F.col(digest) == F.col(kept_digest)
        return at.join(chosen, same & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)))

    repeated = staying(F.col("copies") > 1).dropDuplicates([kept_id, kept_digest])
    return staying(F.col("copies") == 1).unionByName(repeated).select(*[f"`{name}`" for name in docs.columns])
