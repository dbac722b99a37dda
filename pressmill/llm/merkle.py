"""Merkle manifest of a table: a root over all rows, and for each row the proof that ties it to the root.

Rows become leaves, the leaves of a source a tree of runs of three, the roots of the
sources a tree of the same kind.

* Where a leaf stands is told by bitmaps, not by sorting: the ids of a source are cut
  into containers of 4,096, of which only words that hold an id are kept, under a word
  that tells which these are. With the counts before each word and container, the
  place of an id is two counts of bits. Tasks build partial bitmaps, which are merged
  by bitwise or. Words that hold an id twice have no such rank; their rows alone
  are put in order by id, leaf and row.
* Nodes then fill arrays by their place, 3**7 slots each, which tasks reduce seven
  levels at a time. On the way down the same arrays give the siblings of each node,
  joined to those of the block it belongs to, so that no table of proofs of all
  levels is ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import crc_remainder, frozen

ARITY = 3
#: Levels that a task reduces at a time.
LEVELS = 7
#: Nodes that a task's group of slot arrays holds about.
GROUP = 1 << 15
#: The container of rows without an id, before that of any number.
NO_ID = -(1 << 60)
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def framed(value: Column) -> Column:
    """Bytes and value with a colon between, or a minus sign for NULL."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    """The leaf of a row as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[framed(value) for value in values]).cast("binary"), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """``uid``, ``doc_id``, ``src``, ``leaf`` and ``tampered`` (the leaf after tampering) of every row.

    Rows whose id has an even ``crc32`` lose the line feeds of their text; rows
    without an id are left alone. ``src`` sorts as sources do, NULL first.
    """
    columns = [F.col(name) for name in FIELDS]
    cut = [*columns[:-1], F.replace(columns[-1].cast("string"), F.lit("\n"), F.lit(""))]
    leaf, altered = leaf_digest(columns), leaf_digest(cut)
    even = F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), 2) == 0)
    source = F.col("source").cast("string")
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source)).alias("src"),
        leaf.alias("leaf"),
        F.when(even, altered).otherwise(leaf).alias("tampered"),
    )


def running(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of its group.

    Rows are cut into ranges of (group, order), whatever a group holds. Sums within a
    range are a window's; groups that go over several ranges, fewer than there are
    ranges, bring on what the ranges before hold.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("own", value.cast("long")).repartitionByRange(parts, group, *order).withColumn("part", F.spark_partition_id())
    ranged = frozen(ranged)
    totals = ranged.groupBy(group, "part").agg(F.sum("own").alias("total"))
    spans = totals.groupBy(group).agg(F.count(F.lit(1)).alias("ranges")).filter("ranges > 1").select(group)
    across = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.join(spans, group, "left_semi").select(group, "part", F.sum("total").over(across).alias("carried"))
    within = Window.partitionBy("part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(name, F.sum("own").over(within))
    zero = F.lit(0).cast("long")
    joined = summed.join(F.broadcast(carried), [group, "part"], "left")
    return joined.withColumn(name, F.coalesce(name, zero) + F.coalesce("carried", zero)).drop("own", "part", "carried")


def _below(width: Column) -> Column:
    """A word whose lowest ``width`` bits are set, of up to 63."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), width.cast("int")))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def bitmaps(leaves: DataFrame) -> DataFrame:
    """Per ``src`` and ``container``: ``top``, ``words`` (bits, rows, rows before), ``base`` and ``total`` (rows of the source)."""
    words = leaves.groupBy("src", "container", "word").agg(F.bit_or(_bit(F.col("bit"))).alias("bits"), F.count(F.lit(1)).alias("held"))
    merged = words.groupBy("src", "container").agg(
        F.bit_or(_bit(F.col("word"))).alias("top"),
        F.sort_array(F.collect_list(F.struct("word", "bits", "held"))).alias("found"),  # 64 at most
        F.sum("held").alias("held"),
    )
    before = lambda at: F.aggregate(F.slice("found", F.lit(1), at), F.lit(0).cast("long"), lambda sum_, word: sum_ + word["held"])
    lined = F.transform("found", lambda word, at: F.struct(word["bits"].alias("bits"), word["held"].alias("held"), before(at).alias("before")))
    based = running(merged.select("src", "container", "top", lined.alias("words"), "held"), "src", ["container"], F.col("held"), "base")
    totals = based.groupBy("src").agg(F.sum("held").alias("total"))
    return based.join(totals, "src").select("src", "container", "top", "words", "base", "total")


def numbered(leaves: DataFrame) -> DataFrame:
    """Leaves with their place ``at`` among those of their source, by rank queries, and the source's ``total``.

    Leaves stand by id, those without one first; rows of one id by their leaf. The
    places of rows that are equal in all columns are given out in any order.
    """
    id_ = F.col("doc_id")
    container = F.coalesce(F.shiftright(id_, 12), F.lit(NO_ID).cast("long"))
    placed = leaves.withColumns(
        {
            "container": container,
            "word": F.coalesce(F.shiftright(id_, 6).bitwiseAND(63), F.lit(0).cast("long")),
            "bit": F.coalesce(id_.bitwiseAND(63), F.lit(0).cast("long")),
        }
    )
    found = placed.join(frozen(bitmaps(placed)), ["src", "container"])
    word = F.get("words", F.bit_count(F.col("top").bitwiseAND(_below(F.col("word")))))
    ranked = found.withColumn("slot", word).select(
        *leaves.columns,
        F.concat_ws("/", "src", "container", "word").alias("place"),
        (F.col("base") + F.col("slot.before")).alias("first"),
        F.bit_count(F.col("slot.bits").bitwiseAND(_below(F.col("bit")))).cast("long").alias("rank"),
        (F.col("slot.held") > F.bit_count("slot.bits")).alias("tied"),
        "total",
    )
    ranked = frozen(ranked)
    names = [*leaves.columns, (F.col("first") + F.col("rank")).alias("at"), "total"]
    single, tied = ranked.filter("not tied"), ranked.filter("tied")
    if tied.isEmpty():
        return single.select(*names)
    ordered = running(tied.drop("rank"), "place", ["doc_id", "leaf", "uid"], F.lit(1), "rank")
    return frozen(single.select(*names).unionByName(ordered.select(*names)))


def _dealt(nodes: DataFrame, block: Column, count: int) -> DataFrame:
    """Nodes with their ``block`` and the group of blocks it falls in."""
    groups = max(1, -(-count // GROUP))
    return nodes.withColumns({"block": block, "bucket": F.pmod(F.xxhash64("src", block), F.lit(groups))})


def _block(levels: int) -> Column:
    return F.expr(f"`at` div {ARITY**levels}")


def _joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def raised(nodes: list[str], total: int, most: int) -> list[list[str]]:
    """Levels over the nodes of a block, theirs first: up to its root, or for a block among others exactly ``most`` more."""
    levels = [nodes]
    while len(levels) <= most and (total > ARITY**most or len(levels[-1]) > 1):
        last = levels[-1]
        levels.append([_joined(last[at : at + ARITY]) for at in range(0, len(last), ARITY)])
    return levels


def _slots(group: pa.Table, levels: int) -> Iterator[tuple[str, int, int, np.ndarray]]:
    """Source, block, total and row numbers by slot of every block in a group of nodes."""
    src = group.column("src").combine_chunks().dictionary_encode()
    codes, names = src.indices.to_numpy(), src.dictionary.to_pylist()
    block, at = group.column("block").to_numpy(), group.column("at").to_numpy()
    _, first, inverse, counts = np.unique(np.stack([codes, block]), axis=1, return_index=True, return_inverse=True, return_counts=True)
    starts = np.cumsum(counts) - counts
    slots = np.empty(len(at), dtype=np.int64)
    slots[starts[inverse] + at % ARITY**levels] = np.arange(len(at))
    totals = group.column("total").to_numpy()
    for n, row in enumerate(first.tolist()):
        yield names[codes[row]], int(block[row]), int(totals[row]), slots[starts[n] : starts[n] + counts[n]]


def reduced(nodes: DataFrame, count: int, levels: int) -> DataFrame:
    """The blocks of nodes (``src``, ``at``, ``total``, ``digest``) as nodes themselves."""

    def run(group: pa.Table) -> pa.Table:
        digests = group.column("digest").to_pylist()
        rows = [
            (src, block, -(-total // ARITY**levels), bytes.fromhex(raised([digests[row].hex() for row in slots], total, levels)[-1][0]))
            for src, block, total, slots in _slots(group, levels)
        ]
        schema = pa.schema([("src", pa.string()), ("at", pa.int64()), ("total", pa.int64()), ("digest", pa.binary())])
        return pa.table([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    dealt = _dealt(nodes.select("src", "at", "total", "digest"), _block(levels), count)
    return dealt.groupBy("bucket").applyInArrow(run, "src string, at long, total long, digest binary")


@dataclass(frozen=True)
class Step:
    """The siblings of a node in its run, before and after it."""

    left: str
    right: str


Path = tuple[Step, ...]


def packed(path: Path) -> str:
    return ",".join(f"{step.left}.{step.right}" for step in path)


def unpacked(text: str) -> Path:
    return tuple(Step(*part.split(".")) for part in text.split(",")) if text else ()


def paths_in(levels: list[list[str]], above: Path) -> list[Path]:
    """For every node of the lowest level its steps up to the root of all, given those of the highest."""
    paths = [above]
    for level in reversed(levels[:-1]):
        found = []
        for at in range(len(level)):
            start = at - at % ARITY
            step = Step("".join(level[start:at]), "".join(level[at + 1 : start + ARITY]))
            found.append((step, *paths[at // ARITY]))
        paths = found
    return paths


def folded(digest: str, path: Path) -> str:
    """The root that a node and the siblings on its way up give."""
    for step in path:
        digest = _joined([step.left, digest, step.right])
    return digest


def proof(path: Path) -> str:
    return _joined([step.left + step.right for step in path])


def _with_blocks(group: pa.Table, above: pa.Table, levels: int) -> Iterator[tuple[np.ndarray, list[Path], str, list[str]]]:
    """Rows by slot, their paths, the subroot and the digests of every block of nodes whose blocks' paths are given."""
    known = {(r["src"], r["at"]): r for r in above.to_pylist()}
    digests = group.column("digest").to_pylist()
    for src, block, total, slots in _slots(group, levels):
        own = [digests[row].hex() for row in slots]
        upper = known[src, block]
        yield slots, paths_in(raised(own, total, levels), unpacked(upper["path"])), upper["subroot"], own


PATHS = "src string, at long, path string, subroot string"


def _down(nodes: DataFrame, above: DataFrame, count: int, levels: int, run, schema: str) -> DataFrame:
    """``run`` over groups of nodes and the paths of the blocks they are in."""
    one = _dealt(nodes, _block(levels), count).groupBy("bucket")
    other = _dealt(above, F.col("at"), count).groupBy("bucket")
    return one.cogroup(other).applyInArrow(run, schema)


def paths_below(nodes: DataFrame, above: DataFrame, count: int, levels: int) -> DataFrame:
    """``PATHS`` of nodes, from those of their blocks."""

    def run(group: pa.Table, blocks: pa.Table) -> pa.Table:
        src, at, rows = group.column("src").to_pylist(), group.column("at").to_pylist(), []
        for slots, paths, subroot, _ in _with_blocks(group, blocks, levels):
            rows += [(src[row], at[row], packed(path), subroot) for row, path in zip(slots.tolist(), paths, strict=True)]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.table(dict(zip(["src", "at", "path", "subroot"], [pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], strict=True)))

    return _down(nodes.select("src", "at", "total", "digest"), above, count, levels, run, PATHS)


PROVED = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def proved(leaves: DataFrame, above: DataFrame, count: int, levels: int) -> DataFrame:
    """``PROVED`` of every leaf: its proof, and the root that the tampered leaf and its siblings give."""

    def run(group: pa.Table, blocks: pa.Table) -> pa.Table:
        tampered = group.column("tampered").to_pylist()
        order, leaf, subroots, proofs, roots = [], [], [], [], []
        for slots, paths, subroot, own in _with_blocks(group, blocks, levels):
            order += slots.tolist()
            leaf += own
            subroots += [subroot] * len(own)
            proofs += [proof(path) for path in paths]
            roots += [folded(tampered[row].hex(), path) for row, path in zip(slots.tolist(), paths, strict=True)]
        ids = group.column("doc_id").combine_chunks().take(pa.array(order, pa.int64()))
        columns = [ids, *[pa.array(column, pa.string()) for column in (leaf, subroots, proofs, roots)]]
        return pa.table(columns, names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    nodes = leaves.select("src", "at", "total", F.col("leaf").alias("digest"), "doc_id", "tampered")
    return _down(nodes, above, count, levels, run, PROVED)


@dataclass
class Manifest:
    """The levels of a manifest as written tables, the lowest first, and its root."""

    sources: list[tuple[DataFrame, int]]
    ranks: DataFrame
    tops: list[tuple[DataFrame, int]]
    root: str
    levels: int

    def paths(self) -> DataFrame:
        """``PATHS`` of the blocks that the leaves are in."""
        spark = self.ranks.sparkSession
        found = spark.createDataFrame([("", 0, "", "")], PATHS)
        for nodes, count in reversed(self.tops[:-1]):
            found = frozen(paths_below(nodes, found, count, self.levels))
        found = self.ranks.select(F.col("src").alias("own"), F.col("at").alias("place"), F.lower(F.hex("digest")).alias("own_root")).join(
            found, F.col("place") == F.col("at")
        )
        found = frozen(found.select(F.col("own").alias("src"), F.lit(0).cast("long").alias("at"), "path", F.col("own_root").alias("subroot")))
        for nodes, count in reversed(self.sources[1:-1]):
            found = frozen(paths_below(nodes, found, count, self.levels))
        return found


def _towers(nodes: DataFrame, step: int) -> list[tuple[DataFrame, int]]:
    """Levels of blocks over nodes, theirs first, up to one node per source; with the number of nodes of each."""
    levels = []
    while True:
        counts = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.max("total").alias("most")).first()
        levels.append((nodes, counts["nodes"]))
        if (counts["most"] or 1) <= 1 and len(levels) > 1:
            return levels
        nodes = frozen(reduced(nodes, counts["nodes"], step))


def build(docs: DataFrame, levels: int = LEVELS) -> Manifest | None:
    """The manifest of all rows of ``docs``, ``levels`` at a time; None of an empty table."""
    leaves = frozen(numbered(frozen(leaves_of(docs))).withColumn("digest", F.col("leaf")))
    if leaves.isEmpty():
        return None
    sources = _towers(leaves, levels)
    every = sources[-1][0].select("src", "digest", F.lit("").alias("all"))
    ranks = frozen(running(every, "all", ["src"], F.lit(1), "at").withColumn("total", F.lit(sources[-1][1]).cast("long")))
    tops = _towers(ranks.select(F.lit("").alias("src"), "at", "total", "digest"), levels)
    return Manifest(sources, ranks, tops, tops[-1][0].first()["digest"].hex(), levels)


def verified_documents(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row of ``docs``.

    ``docs`` needs ``FIELDS``; others are ignored, and NULLs in any of them are
    part of the leaf. Rows of one id stand by their leaves; rows that are equal in
    all columns are leaves of their own, next to each other. A row that is alone
    in its source and table is subroot and root itself, with the digest of
    nothing as its proof. An empty table gives no rows.
    """
    made = build(docs, levels)
    if made is None:
        shape = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return docs.sparkSession.createDataFrame([], shape)
    leaves, count = made.sources[0]
    found = proved(leaves, made.paths(), count, levels)
    return found.select(
        "doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == made.root).alias("verified")
    )
