"""Token ids in flat shard files, with a minimal perfect hash from document keys to their place.

A store is a folder of
* ``NNNNNN.ids``: ids of consecutive documents, nothing else (2 or 4 bytes, little-endian);
* ``NNNNNN.ends``: for each of them the end of its ids in that file (8 bytes each);
* ``NNNNNN.map``: for the keys of one hash bucket the perfect hash, and by its numbers a
  fingerprint of the key (4 bytes), the rank of its first document and how many there are;
* ``manifest``: JSON with the first rank and first id of every shard.

A key is found by one hash bucket, one word each of few bit tables, its fingerprint
and the place of its documents, all read where they stand. Documents lie in ascending order of keys, over all shards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm import encoding, store
from pressmill.llm.common import frozen, record_batch
from pressmill.llm.perfect_hash import PerfectHash, mixed

KEYS_PER_MAP = 1 << 18
READ_IDS = 1 << 20
MAP_SALT, PRINT_SALT = 101, 102


@dataclass
class Manifest:
    """Shards in order, the rank and the number of the first id of each, and totals behind the last."""

    folder: str
    id_type: str
    maps: int
    shards: list[int]
    first_rank: list[int]
    first_id: list[int]
    unkeyed: int

    def save(self) -> None:
        with store.written(self.folder, "manifest") as out:
            out.write(json.dumps(asdict(self)).encode())

    @classmethod
    def load(cls, folder: str) -> Manifest:
        return cls(**json.loads(store.read(folder, "manifest")) | {"folder": folder})


def _bucket(maps: int):
    """Map number of keys, by whole arrays."""
    return lambda keys: (mixed(keys, MAP_SALT) % np.uint64(maps)).astype(np.int64)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, PRINT_SALT) >> np.uint64(32)).astype("<u4")


def _bucketed(keys: DataFrame, maps: int) -> DataFrame:
    """``keys`` (first column a long, the others kept) with their ``map`` number."""
    place = _bucket(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = pa.array(place(batch.column(0).to_numpy()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers], names=[*batch.schema.names, "map"])

    fields = ", ".join(f"{name} {kind}" for name, kind in keys.dtypes)
    return keys.mapInArrow(run, f"{fields}, map int")


def _write_shards(rows: DataFrame, folder: str, tokenizer: str, end: int, threads: int) -> DataFrame:
    """Writes the rows of each partition as a shard; ``shard``, ``at``, ``doc_id`` and ``ids`` (their number) of each."""
    schema = pa.schema([("shard", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = encoding.byte_level_encoder(tokenizer, threads, special=True)
        first = next((batch for batch in batches if batch.num_rows), None)
        if first is None:
            return
        held, total, ends = 0, 0, []
        with store.written(folder, f"{shard:06d}.ids") as out:
            for batch in _with(first, batches):
                at = 0
                for part in encoding.slices(batch.column(1)):
                    ids, offsets, _ = encoder.ids(part, end)
                    out.write(ids.tobytes())
                    ends.append(total + offsets[1:])
                    total += len(ids)
                    places, own = np.arange(held, held + len(part)), batch.column(0).slice(at, len(part))
                    yield record_batch(schema, [np.full(len(part), shard, dtype=np.int32), places, own, np.diff(offsets)])
                    held, at = held + len(part), at + len(part)
        with store.written(folder, f"{shard:06d}.ends") as out:
            out.write(np.concatenate(ends).astype("<i8").tobytes())

    return rows.mapInArrow(run, "shard int, at long, doc_id long, ids long")


def _with(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _write_maps(placed: DataFrame, folder: str) -> int:
    """Writes a map per bucket of ``doc_id``, ``first`` (rank) and ``held``; the number of keys."""

    def run(group: pa.Table) -> pa.Table:
        keys = group.column("doc_id").to_numpy()
        hashed = PerfectHash.build(keys)
        numbers = hashed.numbers(keys)
        columns = []
        for values, kind in ((_prints(keys), "<u4"), (group.column("first").to_numpy(), "<i8"), (group.column("held").to_numpy(), "<i8")):
            lined = np.zeros(len(keys), dtype=kind)
            lined[numbers] = values
            columns.append(lined.tobytes())
        number = group.column("map")[0].as_py()
        with store.written(folder, f"{number:06d}.map") as out:
            out.write(hashed.to_bytes() + b"".join(columns))
        return pa.table({"map": pa.array([number], pa.int32()), "keys": pa.array([len(keys)], pa.int64())})

    done = placed.groupBy("map").applyInArrow(run, "map int, keys long")
    return done.agg(F.sum("keys").alias("keys")).first()["keys"] or 0


def write_store(
    docs: DataFrame, tokenizer: str, end: int, folder: str | None = None, shards: int | None = None, threads: int = 1, keys_per_map: int = KEYS_PER_MAP
) -> Manifest:
    """Encodes every text of ``docs`` and writes a store; needs ``doc_id`` and ``text``, other columns are ignored.

    A NULL text counts as empty; every document gets the id ``end`` behind its
    own. Rows without an id come first and have no key. Rows of one id lie
    together, in the order of a hash of their text, and share a key. The text is
    shuffled once; the ids go from the encoder to the files.
    """
    spark = docs.sparkSession
    folder = folder or store.new_folder(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    order = ["doc_id", "digest"]
    sorted_ = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    entries = frozen(_write_shards(sorted_, folder, tokenizer, end, threads))
    none = F.col("doc_id").isNull().cast("long")
    held = entries.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("ids").alias("ids"), F.sum(none).alias("none"))
    totals = sorted(map(tuple, held.collect()))  # a row per shard
    ranks, ids = (np.concatenate(([0], np.cumsum([t[n] for t in totals], dtype=np.int64))).tolist() for n in (1, 2))
    keyed = entries.filter("doc_id is not null")
    starts = spark.createDataFrame([(t[0], rank) for t, rank in zip(totals, ranks, strict=False)], "shard int, start long")
    rank = (F.col("start") + F.col("at")).alias("rank")
    ranked = keyed.join(F.broadcast(starts), "shard").select("doc_id", rank)
    placed = frozen(ranked.groupBy("doc_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("held")))
    maps = max(1, -(-placed.count() // keys_per_map))
    _write_maps(_bucketed(placed, maps), folder)
    id_type = encoding.byte_level_encoder(tokenizer).id_type.str
    manifest = Manifest(folder, id_type, maps, [t[0] for t in totals], ranks, ids, sum(t[3] for t in totals))
    manifest.save()
    return manifest


class Maps:
    """The maps of a store that a task has opened; finds ranks of keys."""

    def __init__(self, manifest: Manifest):
        self.manifest, self.number, self.parts = manifest, -1, None

    def find(self, number: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank and number of documents of keys of one map; -1 and 0 for those not held."""
        if number != self.number:
            data = store.read(self.manifest.folder, f"{number:06d}.map")
            hashed, at = PerfectHash.from_bytes(data)
            n = hashed.size
            self.parts = (
                hashed,
                np.frombuffer(data, "<u4", n, at),
                np.frombuffer(data, "<i8", n, at + 4 * n),
                np.frombuffer(data, "<i8", n, at + 12 * n),
            )
            self.number = number
        hashed, prints, first, held = self.parts
        found = hashed.numbers(keys)
        right = found >= 0
        right[right] = prints[found[right]] == _prints(keys[right])
        return np.where(right, first[found], -1), np.where(right, held[found], 0)


def get(folder: str, key: int) -> list[np.ndarray]:
    """The ids of every document of one key, in order; none where the key isn't held.

    Reads the manifest, the few words of the map that the key points to, and what
    its documents take, whatever the size of the store.
    """
    manifest = Manifest.load(folder)
    first, held = _looked_up(manifest, key)
    ranks = np.arange(first, first + held)
    shard = np.searchsorted(manifest.first_rank, ranks, "right") - 1
    out = []
    for number in np.unique(shard).tolist():
        out += [ids for _, ids in _documents(manifest, number, ranks[shard == number] - manifest.first_rank[number])]
    return out


def _looked_up(manifest: Manifest, key: int) -> tuple[int, int]:
    """First rank and number of documents of a key, by reads of single words of its map; 0 and 0 if it isn't held."""
    keys = np.array([key], dtype=np.int64)
    number = int(_bucket(manifest.maps)(keys)[0])
    try:
        with store.opened(manifest.folder, f"{number:06d}.map") as file:
            place, size, at = PerfectHash.number_at(file.read_at, key)
            if place < 0 or np.frombuffer(file.read_at(4, at + 4 * place), "<u4")[0] != _prints(keys)[0]:
                return 0, 0
            first, held = (int(np.frombuffer(file.read_at(8, at + start * size + 8 * place), "<i8")[0]) for start in (4, 12))
            return first, held
    except FileNotFoundError:
        return 0, 0


def _documents(manifest: Manifest, number: int, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Start in the shard and ids of documents at ascending places of the ``number``-th shard.

    Places that follow each other are read together, up to ``READ_IDS`` ids.
    """
    name = f"{manifest.shards[number]:06d}"
    kind = np.dtype(manifest.id_type)
    if not len(places):
        return
    low, high = int(places[0]), int(places[-1])
    with store.opened(manifest.folder, f"{name}.ends") as file:  # the ends asked for and the one before them
        before = max(low - 1, 0)
        read = np.frombuffer(file.read_at(8 * (high + 1 - before), 8 * before), "<i8")
    borders = np.concatenate(([0], read)) if low == 0 else read
    starts, ends = borders[places - low], borders[places - low + 1]
    with store.opened(manifest.folder, f"{name}.ids") as file:
        at = 0
        while at < len(places):
            upto = at + 1
            while upto < len(places) and starts[upto] == ends[upto - 1] and ends[upto] - starts[at] <= READ_IDS:
                upto += 1
            size = int(ends[upto - 1] - starts[at])
            ids = np.frombuffer(file.read_at(size * kind.itemsize, int(starts[at]) * kind.itemsize), kind)
            for place in range(at, upto):
                yield int(starts[place]), ids[starts[place] - starts[at] : ends[place] - starts[at]]
            at = upto


def find_keys(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """``doc_id`` and ``rank`` of every document of the keys (first column, a long), through the maps.

    Keys that aren't held give no rows; repeated and NULL keys count for nothing.
    """
    manifest = Manifest.load(folder)
    asked = keys.select(F.col(keys.columns[0]).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()

    def run(group: pa.Table) -> pa.Table:
        wanted = group.column("doc_id").to_numpy()
        try:
            first, held = Maps(manifest).find(group.column("map")[0].as_py(), wanted)
        except FileNotFoundError:
            first, held = np.full(len(wanted), -1), np.zeros(len(wanted), dtype=np.int64)
        return pa.table({"doc_id": wanted, "first": first, "held": held})

    found = _bucketed(asked, manifest.maps).groupBy("map").applyInArrow(run, "doc_id long, first long, held long")
    ranks = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("held") - 1))
    return found.filter("held > 0").select("doc_id", ranks.alias("rank"))


def read_documents(spark: SparkSession, folder: str, ranks: DataFrame) -> DataFrame:
    """``start`` (ids before the document), ``n_tokens`` and ``ids_crc32`` of documents given by ``doc_id`` and ``rank``.

    Each shard is read by one task, in the order of its documents.
    """
    manifest = Manifest.load(folder)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(1).to_numpy()
            number = np.searchsorted(manifest.first_rank, rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number.astype(np.int32))], names=["doc_id", "rank", "number"])

    def run(group: pa.Table) -> pa.Table:
        number = group.column("number")[0].as_py()
        ranked = group.sort_by("rank")
        places = ranked.column("rank").to_numpy() - manifest.first_rank[number]
        rows = []
        for start, ids in _documents(manifest, number, places):
            rows.append((manifest.first_id[number] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table([ranked.column("doc_id").combine_chunks(), *[pa.array(c, pa.int64()) for c in columns]], schema=schema)

    placed = ranks.select("doc_id", "rank").mapInArrow(located, "doc_id long, rank long, number int")
    return placed.groupBy("number").applyInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_documents(docs: DataFrame, tokenizer: str, end: int, shards: int | None = None, threads: int = 1) -> DataFrame:
    """Writes ``docs`` as a store and reads every document back by its key.

    One row per row of ``docs``; those without an id are read by rank, as they
    come first. An empty table gives an empty store and no rows.
    """
    spark = docs.sparkSession
    manifest = write_store(docs, tokenizer, end, shards=shards, threads=threads)
    ranks = find_keys(spark, manifest.folder, docs.select("doc_id"))
    none: Column = F.lit(None).cast("long")
    if manifest.unkeyed:
        ranks = ranks.unionByName(spark.range(manifest.unkeyed).select(none.alias("doc_id"), F.col("id").alias("rank")))
    return read_documents(spark, manifest.folder, ranks)
