"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact similarity.

Texts are case-folded; words are runs of letters and digits of ASCII and of all
other characters. A window has as many words as an item, and is like it if the
weighted Jaccard similarity of their five-word shingles, weighted by how often
they occur, is at least 0.8.

1. Positions of a document whose shingle an item has are looked up in the items'
   shingle hashes. A window without one has similarity 0 to every item, so only
   windows over such a position, of the sizes of the items that have the shingle,
   are fingerprinted; none that could be like an item is left out. Where a
   document has fewer words than the item, all of it is the one window.
2. Windows get 64-bit SimHashes, from running sums of the bits of their shingles.
   Eight blocks of eight bits find all items within ``RADIUS`` bits: 23 errors
   can't put three in every block, so one has two or fewer. The items are sorted by
   each block's value; a window looks up the values within two bits of its own.
   A similarity of 0.8 gives about 10 +- 3 differing bits, unrelated windows 32 +- 4.
3. What remains is compared word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import fresh, frozen, record_batch
from pressmill.llm.encoding import batches_of
from pressmill.llm.perfect_hash import mixed

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
BLOCK_ERRORS = RADIUS // BLOCKS
MOST_ITEM_BYTES = 32 << 20
PAIRS_TOGETHER = 1 << 20  # pairs of window and item that are looked at in one step
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: The values within ``BLOCK_ERRORS`` bits of zero; xor with them gives those around any value.
NEAR_VALUES = np.array([v for v in range(256) if v.bit_count() <= BLOCK_ERRORS], dtype=np.uint8)
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    """base ** 0 .. count - 1 modulo 2 ** 64, by doubling."""
    out = np.ones(max(1, count), dtype=np.uint64)
    done = 1
    while done < count:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, count - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


class Words:
    """The words of some texts as places in one buffer, with hashes; built by whole arrays."""

    def __init__(self, texts: list[str]):
        folded = [text.casefold().encode("utf-8", "surrogatepass") for text in texts]
        self.data = b" ".join(folded) + b" "
        buffer = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.concatenate(([False], WORD_BYTES[buffer], [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = turns[0::2], turns[1::2]
        limits = np.cumsum([len(text) + 1 for text in folded])
        self.text = np.searchsorted(limits, self.starts, "right")
        self.hashes = self._hash(buffer)
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def _hash(self, buffer: np.ndarray) -> np.ndarray:
        """A polynomial hash of each word's bytes, from one running sum over the buffer."""
        sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _powers(int(BASE), len(buffer)), out=sums[1:])
        back = _powers(_inverse(int(BASE)), len(buffer))[self.starts]
        value = (sums[self.ends] - sums[self.starts]) * back
        return mixed(value.view(np.int64), 7)

    def shingles(self, size: int) -> np.ndarray:
        """Hash of the shingle that starts at each word, 0 where its text ends before it does."""
        n = len(self.hashes)
        out = np.zeros(n, dtype=np.uint64)
        if n < size:
            return out
        value = np.zeros(n - size + 1, dtype=np.uint64)
        for place in range(size):
            value = mixed((value + self.hashes[place : n - size + 1 + place]).view(np.int64), place)
        whole = self.text[size - 1 :] == self.text[: n - size + 1]
        out[: n - size + 1] = np.where(whole, value | np.uint64(1), 0)
        return out

    def words(self, start: int, count: int) -> list[bytes]:
        places = zip(self.starts[start : start + count].tolist(), self.ends[start : start + count].tolist(), strict=True)
        return [self.data[a:b] for a, b in places]


def shingle_counts(words: list[bytes], size: int) -> Counter:
    return Counter(tuple(words[at : at + size]) for at in range(len(words) - size + 1))


def weighted_similarity(left: Counter, right: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    shared = sum(min(n, right[key]) for key, n in left.items())
    total = sum(left.values()) + sum(right.values()) - shared
    return shared / total if total else 0.0


def simhashes(bits: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each run of ``width`` rows of a table of shingle bits."""
    sums = np.zeros((len(bits) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    on = 2 * (sums[starts + width] - sums[starts]) > width
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]


def shingle_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class Sized:
    """Items of one number of words, found by the Hamming distance of their SimHashes."""

    def __init__(self, length: int, size: int, items: list[int], words: list[list[bytes]], hashes: list[np.ndarray]):
        self.length, self.size, self.items = length, size, np.array(items)
        self.counts = [shingle_counts(one, size) for one in words]
        width = length - size + 1
        self.prints = np.concatenate([simhashes(shingle_bits(h), np.array([0]), width) for h in hashes])
        blocks = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        self.sorted = np.argsort(blocks, axis=0, kind="stable")
        ends = [np.searchsorted(blocks[self.sorted[:, b], b], np.arange(257)) for b in range(BLOCKS)]
        self.ends = np.stack(ends).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Window, item and distance of all pairs within the radius, in parts; each pair comes with its first block."""
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        for b in range(BLOCKS):
            near = blocks[:, b, None] ^ NEAR_VALUES
            first, count = self.ends[b][near].ravel(), (self.ends[b][near.astype(np.int64) + 1] - self.ends[b][near]).ravel()
            upto = np.cumsum(count)
            total, start = int(upto[-1]) if len(upto) else 0, 0
            while start < total:
                # places start .. stop - 1 of the list of all pairs of this block
                stop = min(total, start + PAIRS_TOGETHER)
                place = np.arange(start, stop)
                cell = np.searchsorted(upto, place, "right")
                item = self.sorted[first[cell] + place - (upto[cell] - count[cell]), b]
                window = cell // len(NEAR_VALUES)
                differ = prints[window] ^ self.prints[item]
                close = np.flatnonzero(np.bitwise_count(differ) <= RADIUS)
                before = np.bitwise_count(differ[close].view(np.uint8).reshape(-1, BLOCKS)[:, :b])
                close = close[(before > BLOCK_ERRORS).all(axis=1)]
                if len(close):
                    yield window[close], item[close], np.bitwise_count(differ[close])
                start = stop


class Items:
    """Benchmark items ready for the search; ids may repeat, items without words match nothing."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int = SHINGLE):
        found = Words([text or "" for _, text in rows])
        lengths = np.diff(found.first)
        self.by_size: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        self.sized: list[Sized] = []
        owned: dict[int, list[tuple[np.ndarray, int]]] = {}
        for length in sorted(set(lengths.tolist()) - {0}):
            size = min(shingle, length)
            places = np.flatnonzero(lengths == length)
            hashes = found.shingles(size)
            own = [hashes[found.first[p] : found.first[p] + length - size + 1] for p in places]
            words = [found.words(found.first[p], length) for p in places]
            owned.setdefault(size, []).append((np.unique(np.concatenate(own)), len(self.sized)))
            self.sized.append(Sized(length, size, [rows[p][0] for p in places], words, own))
        for size, groups in owned.items():
            keys = np.unique(np.concatenate([k for k, _ in groups]))
            table = np.zeros(1 << 20, dtype=bool)
            table[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[size] = (keys, table, groups)

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, float, int, int]]:
        """Text, item, best similarity, and first word and length of the (first) best window."""
        if not self.sized:
            return
        found = Words(texts)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for size, (keys, table, groups) in self.by_size.items():
            hashes = found.shingles(size)
            maybe = np.flatnonzero(table[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
            hits = maybe[keys[at] == hashes[maybe]]
            for own, number in groups if len(hits) else []:
                place = np.minimum(np.searchsorted(own, hashes[hits]), len(own) - 1)
                self._windows(found, hashes, hits[own[place] == hashes[hits]], self.sized[number], best)
        for (text, item), (similarity, start, length) in sorted(best.items()):
            yield text, item, similarity, start, length

    def _windows(self, found: Words, hashes: np.ndarray, hits: np.ndarray, sized: Sized, best: dict) -> None:
        """Fingerprints all windows over the hits and keeps what is like an item."""
        words = np.diff(found.first)[found.text[hits]]
        self._spans(found, hashes, hits[words >= sized.length], sized, sized.length, best)
        # a text of fewer words is one window; with too few it can't be like the item whatever they are
        enough = (words - sized.size + 1) / (sized.length - sized.size + 1) >= SIMILARITY
        short = (words < sized.length) & enough
        for length in np.unique(words[short]).tolist():
            self._spans(found, hashes, hits[short & (words == length)], sized, length, best)

    def _spans(self, found: Words, hashes: np.ndarray, hits: np.ndarray, sized: Sized, length: int, best: dict) -> None:
        """The same for windows of ``length`` words."""
        width = length - sized.size + 1
        for part in np.array_split(hits, max(1, len(hits) * width // 200_000)) if len(hits) else []:
            text = found.text[part]
            low = np.maximum(part - width + 1, found.first[text])
            high = np.minimum(part, found.first[text + 1] - length)
            spans = [np.arange(a, b + 1) for a, b in zip(low.tolist(), high.tolist(), strict=True) if a <= b]
            if not spans:
                continue
            starts = np.unique(np.concatenate(spans))
            rows = np.unique((starts[:, None] + np.arange(width)[None, :]).ravel()) if len(starts) < 4096 else None
            if rows is None:
                mark = np.zeros(int(starts[-1]) + width - int(starts[0]) + 1, dtype=np.int64)
                np.add.at(mark, starts - starts[0], 1)
                np.add.at(mark, starts - starts[0] + width, -1)
                rows = np.flatnonzero(np.cumsum(mark) > 0) + starts[0]
            prints = simhashes(shingle_bits(hashes[rows]), np.searchsorted(rows, starts), width)
            for window, item, apart in sized.candidates(prints):
                self._verify(found, sized, length, starts[window], item, apart, best)

    def _verify(self, found: Words, sized: Sized, length: int, starts: np.ndarray, items: np.ndarray, apart: np.ndarray, best: dict) -> None:
        """Keeps the best window of each text and item, the first of equally good ones."""
        for at in np.argsort(apart, kind="stable").tolist():
            start, chosen = int(starts[at]), int(items[at])
            key = (int(found.text[start]), int(sized.items[chosen]))
            begin = start - int(found.first[key[0]])
            known = best.get(key)
            if known and known[0] == 1.0 and known[1] <= begin:
                continue
            score = weighted_similarity(shingle_counts(found.words(start, length), sized.size), sized.counts[chosen])
            if score >= SIMILARITY and (not known or (score, -begin) > (known[0], -known[1])):
                best[key] = (score, begin, length)


def item_groups(benchmark: DataFrame, most_bytes: int = MOST_ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in groups that each fit a task's memory, one at a time, those of one id together; one group may be empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).filter("item_id is not null").distinct()
    group, held = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if held and held + len(row.text) > most_bytes and row.item_id != group[-1][0]:
            yield group
            group, held = [], 0
        group.append((row.item_id, row.text))
        held += len(row.text)
    yield group


def contaminated(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``first_word`` and ``n_words`` of every document and item alike.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` needs ``item_id`` and
    ``text``; other columns are ignored. One row tells of the best window of an
    item in a document, the first of equally good ones; a document of fewer words
    than the item is one window. NULL and empty texts match nothing, items without
    an id are left out; items of fewer than five words are one shingle. Repeated
    documents come out as often as they went in, repeated items count once. Items are sent to the tasks in groups of about
    ``most_bytes``, with one pass over the documents each.
    """
    groups = item_groups(benchmark, most_bytes)
    rows, after = next(groups), next(groups, None)
    if after is None:
        return _pass(docs, rows)
    found = None
    while rows is not None:
        part = frozen(_pass(docs, rows))
        found = found.unionByName(part) if found is not None else part
        rows, after = after, next(groups, None)
    return found


def _pass(docs: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value)
        for batch in batches:
            ids, texts, start = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], 0
            for part in batches_of(texts):
                got = list(items.matches(part))
                if got:
                    yield record_batch(schema, [[ids[start + g[0]] for g in got], *[[g[n] for g in got] for n in range(1, 5)]])
                start += len(part)

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")


def is_contaminated(text: Column, rows: list[tuple[int, str]]) -> Column:
    """Whether a text has a window like one of the items."""
    held: list[Items] = []

    @F.arrow_udf("boolean")
    def told(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Items(rows))
        texts, out = [t or "" for t in column.to_pylist()], []
        for part in batches_of(texts):
            hit = {match[0] for match in held[0].matches(part)}
            out += [n in hit for n in range(len(part))]
        return pa.array(out, pa.bool_())

    return told(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has no window like an item; NULL texts stay.

    A benchmark of one group is a filter. Of a larger one each group leaves the
    digests of the texts that it meets, and the rows with those go.
    """
    groups = item_groups(benchmark, most_bytes)
    rows, after = next(groups), next(groups, None)
    text = F.col("text").cast("string")
    if after is None:
        return docs.filter(~is_contaminated(text, rows))
    (digest,) = fresh(docs, "digest")
    met = None
    while rows is not None:
        hit = docs.select(text.alias("text")).filter(is_contaminated(F.col("text"), rows))
        part = frozen(hit.select(F.sha2("text", 256).alias(digest)).distinct())
        met = met.unionByName(part) if met is not None else part
        rows, after = after, next(groups, None)
    marked = docs.withColumn(digest, F.sha2(text, 256))
    return marked.join(met, digest, "left_anti").select(*[F.col(f"`{name}`") for name in docs.columns])
