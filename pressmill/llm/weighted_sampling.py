"""Document fingerprints by consistent weighted sampling, in built-in expressions.

The terms of a text are its lower-cased words, weighted by how often they occur.
For every one of ``SAMPLES`` positions each term draws r and c from Gamma(2, 1)
and b from [0, 1), as functions of the term and the position alone. With weight w
it takes t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the text's
sample is the pair (term, t) of the least a. Two texts agree at a position with
a probability equal to the generalised Jaccard similarity of their weights, so
the share of equal positions estimates it.

The draws are quantiles of Gamma(2, 1) at ``LEVELS`` midpoints, picked by bits of
a hash. A sample is kept as one number, ln a above and bits of (term, t) below, so
that the least one is a plain minimum, taken within the tasks that hold the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import ascii_lower, fresh, frozen

SAMPLES = 64
LEVELS = 1024
HEX_DIGITS = 4
TOGETHER = 4
KEY = ["id", "no_id", "digest"]
SPACES = " \t\n\x0b\x0c\r"
SHA_PARTS = ["sha_0", "sha_1", "sha_2", "sha_3"]


def gamma_quantiles(levels: int = LEVELS) -> list[float]:
    """Quantiles of Gamma(2, 1), with distribution 1 - (1 + x) exp(-x), at the middle of each level."""
    found, x = [], 0.0
    for level in range(levels):
        wanted = (level + 0.5) / levels
        x = max(x, math.sqrt(2 * wanted) if level < levels // 50 else x)
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - wanted) / (x * math.exp(-x))
            x -= step
            if abs(step) < 1e-14 * x:
                break
        found.append(x)
    return found


def weighted_terms(text: Column) -> Column:
    """Sorted hashes of the words of a text; no words: that of the empty word."""
    words = F.split(F.btrim(ascii_lower(text), F.lit(SPACES)), "[\\x20\\x09-\\x0D]+")
    return F.sort_array(F.transform(words, lambda word: F.xxhash64(word)))


def exploded_terms(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``term`` and ``log_weight`` of every distinct word of each text, beside ``keys``.

    Counting goes along the sorted hashes of one row, so it needs the memory of one text.
    """
    hashed = texts.select(*keys, F.explode(F.array(weighted_terms(F.col("text")))).alias("terms"))
    last = F.filter(
        F.sequence(F.lit(1), F.size("terms")),
        lambda place: ~F.get("terms", place - 1).eqNullSafe(F.get("terms", place)),
    )
    ended = hashed.select(*keys, "terms", F.explode(F.array(last)).alias("last"))
    run = F.explode(
        F.transform(
            "last",
            lambda end, place: F.struct(
                F.get("terms", end - 1).alias("term"),
                (end - F.coalesce(F.get("last", place - 1), F.lit(0))).alias("weight"),
            ),
        )
    )
    runs = ended.select(*keys, run.alias("run"))
    return runs.select(*keys, F.col("run.term").alias("term"), F.log("run.weight").alias("log_weight"))


def _sample(position: Column, scale: Column, log_scale: Column) -> Column:
    """What one term offers at one position: ln a in the upper bits, (term, t) in the lower 16.

    The hash of term and position gives 10 bits for r, 10 for c, 28 for b and 16
    that name the term.
    """
    bits = F.xxhash64("term", position)
    r = F.get(scale, F.shiftrightunsigned(bits, 54).cast("int"))
    log_c = F.get(log_scale, F.shiftrightunsigned(bits, 44).bitwiseAND(LEVELS - 1).cast("int"))
    shift = F.shiftrightunsigned(bits, 16).bitwiseAND((1 << 28) - 1) / F.lit(float(1 << 28))
    t = F.floor(F.col("log_weight") / r + shift)
    log_a = log_c - r * (t - shift + 1)
    upper = F.shiftleft(((log_a + 512) * (1 << 37)).cast("long"), 16)
    return upper.bitwiseOR(bits.bitwiseXOR(t * 40503).bitwiseAND((1 << 16) - 1))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``fingerprint`` of each text, per distinct ``keys``: its samples as two bytes each.

    Positions are taken ``TOGETHER`` at a time, which keeps the compiled code small;
    all of a text's terms meet where the text is, before anything is shuffled.
    """
    quantiles = gamma_quantiles()
    scale = F.lit(quantiles)
    log_scale = F.lit([math.log(x) for x in quantiles])
    part, parts = fresh(texts, "part", "parts")
    least = [F.min(_sample(F.col(part) * TOGETHER + at, scale, log_scale)).alias(f"s{at}") for at in range(TOGETHER)]
    terms = exploded_terms(texts, keys)
    dealt = terms.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples // TOGETHER - 1))).alias(part))
    digits = [
        F.lpad(F.hex(F.col(f"s{at}").bitwiseAND((1 << 4 * HEX_DIGITS) - 1)), HEX_DIGITS, "0")
        for at in range(TOGETHER)
    ]
    grouped = dealt.groupBy(*keys, part).agg(*least).select(*keys, F.struct(part, F.concat(*digits).alias("text")).alias(parts))
    joined = F.concat_ws("", F.transform(F.sort_array(F.collect_list(parts)), lambda one: one["text"]))
    return grouped.groupBy(*keys).agg(F.unhex(joined).alias("fingerprint"))


def likeness(left: Column, right: Column, samples: int = SAMPLES) -> Column:
    """Share of positions at which two fingerprints agree."""
    part = lambda text, at: F.substring(text, HEX_DIGITS // 2 * at + 1, HEX_DIGITS // 2)
    agree = sum((part(left, at) == part(right, at)).cast("int") for at in range(samples))
    return agree / F.lit(float(samples))


def _neighbours(rows: DataFrame) -> DataFrame:
    """Every distinct row with the key of the next and with key and length of the one before.

    The order is by descending id, rows without an id last, and goes round. Rows are
    cut into ranges; only what lies at the ends of ranges is looked at across them.
    """
    spark = rows.sparkSession
    order = [F.col("no_id").asc(), F.col("id").desc(), F.col("digest").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = frozen(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    key = F.struct(*KEY)
    within = Window.partitionBy("part").orderBy(*order)
    lined = ranged.select(
        "*",
        F.lead(key).over(within).alias("next"),
        F.lag(F.struct(*KEY, "n_chars")).over(within).alias("previous"),
    )
    placed = F.struct("no_id", (-F.col("id")).alias("down"), "digest", "id", "n_chars")
    ends = frozen(ranged.groupBy("part").agg(F.min(placed).alias("first"), F.max(placed).alias("last")))
    across = Window.orderBy("part")  # one row per range
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda end, *more: F.struct(*[F.col(f"{end}.{name}").alias(name) for name in [*KEY, *more]])
    ends = ends.select(
        "part",
        F.coalesce(F.lead(of("first")).over(across), F.first(of("first")).over(whole)).alias("next_end"),
        F.coalesce(F.lag(of("last", "n_chars")).over(across), F.last(of("last", "n_chars")).over(whole)).alias("previous_end"),
    )
    return lined.join(ends, "part").select(
        *KEY,
        "copies",
        F.coalesce("next", "next_end").alias("next"),
        F.coalesce("previous", "previous_end").alias("previous"),
    )


def edited_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key, text and edited text, and copies and the key of the next, once per distinct row.

    The last half of the code points (rounded down) gives way to as many of the
    next row's first ones, or to all it has. Copies of one row count as one row;
    they are brought to one within the tasks that read them, before any shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    base = docs.select(
        F.coalesce(id_, F.lit(0).cast("long")).alias("id"),
        id_.isNull().alias("no_id"),
        F.xxhash64(text).alias("digest"),
        text.alias("text"),
    )
    rows = base.groupBy(*KEY, F.char_length("text").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("copies"))
    near = frozen(_neighbours(rows))
    donors = near.select(*KEY, "previous")
    length = F.expr("cast(previous.n_chars div 2 as int)")
    texts = base.dropDuplicates(KEY)
    heads = texts.join(donors, KEY).select(
        *[F.col(f"previous.{name}").alias(name) for name in KEY], F.left("text", length).alias("head")
    )
    n_chars = F.char_length("text")
    kept = F.left("text", (n_chars - F.floor(n_chars / 2)).cast("int"))
    return texts.join(heads, KEY).select(*KEY, "text", F.concat(kept, "head").alias("edited")), near.select(*KEY, "copies", "next")


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A NULL text
    counts as empty; an empty text and one of white space have the same
    fingerprint. The next document is that of the next lower id, after the last
    the first; rows without an id come last, equal ids go by the hash of the
    text. Repeated rows count as one document and come out as often as they went
    in. A table with one document is its own next; an empty one gives no rows.
    """
    pairs, near = edited_pairs(docs)
    sha = F.sha2("edited", 256)
    parts = [F.conv(F.substring(sha, 16 * at + 1, 16), 16, -10).cast("long").alias(name) for at, name in enumerate(SHA_PARTS)]
    # keys of fixed width: they are written and compared for every term and position
    carried = [*KEY, "n_chars", *SHA_PARTS]
    two = F.array(
        F.struct(F.lit(False).alias("edited"), "text"),
        F.struct(F.lit(True).alias("edited"), F.col("edited").alias("text")),
    )
    both = pairs.select(*KEY, F.char_length("text").cast("long").alias("n_chars"), *parts, F.explode(two).alias("one"))
    both = both.select(*carried, F.col("one.edited").alias("edited"), F.col("one.text").alias("text"))
    signed = signatures(both, [*carried, "edited"], samples)
    each = signed.groupBy(*carried).agg(
        F.max(F.when(~F.col("edited"), F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("edited"), F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    each = frozen(each)
    following = each.select(*[F.col(name).alias(f"next_{name}") for name in KEY], F.col("fingerprint").alias("next_fingerprint"))
    found = each.join(near, KEY).select(
        "*", *[F.col(f"next.{name}").alias(f"next_{name}") for name in KEY], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    )
    found = found.join(following, [f"next_{name}" for name in KEY])
    return found.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        "n_chars",
        F.concat(*[F.lower(F.lpad(F.hex(name), 16, "0")) for name in SHA_PARTS]).alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
