"""A hidden Markov language model trained on all documents of a corpus.

Words fall into classes: the ``OWN`` most frequent have one each, all others share
classes by their last letters, and the end of a document has its own. Hidden
states follow each other and emit classes; a class gives one of its words by
add-one smoothed counts. So the model sent to the tasks has one size whatever the
corpus holds, while word counts, which grow with it, stay in tables.

Training, each step over all training documents, with tables of one size added up
by Spark: word counts; profiles of the classes, which tell in the company of which
others a class stands, and whose groups start the states; Baum-Welch rounds by
expected counts made in the tasks. Long documents are cut into segments
for these rounds only. Scoring: the scaled forward recursion over each whole
document. Counts of frequent words are sent along, those of others are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import column_bytes, crc_remainder, frozen, record_batch

STATES = 8
OWN = 2047
SHARED = 1024
SUFFIX = 3
FREQUENT = 65536
ROUNDS = 2
PROFILE = 16  # signs that stand for a class where states are started
FAVOUR = 8.0
SEGMENT = 512
BATCH_TOKENS = 400_000
FLUSH_WORDS = 200_000
ROWS_TOGETHER = 500  # the rare words of so many documents are held at once
FOLDS, HELD_OUT = 7, 2
CLASSES = 1 + OWN + SHARED
END_CLASS = 0


def shared_class(word: bytes) -> int:
    """Class of a word that has none of its own, by its last bytes."""
    return 1 + OWN + zlib.crc32(word[-SUFFIX:]) % SHARED


@dataclass
class Hmm:
    """Start of a document and of a later segment, transitions, and emissions (a row a class)."""

    start: np.ndarray
    later: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    @classmethod
    def fresh(cls, shares: np.ndarray, states: int = STATES, seed: int = 5) -> Hmm:
        """States that like to stay and whose emissions are the shares of the classes, shaken."""
        rng = np.random.default_rng(seed)
        moves = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(moves, 0.9)
        emits = shares[:, None] * rng.uniform(0.2, 1.8, (len(shares), states))
        even = np.full(states, 1 / states)
        return cls(even, even, moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))

    @classmethod
    def from_counts(cls, counts: np.ndarray, shares: np.ndarray) -> Hmm:
        """The model of expected counts: rows of start, of states, and of classes; smoothed by the shares."""
        states = counts.shape[1]
        start, moves, emits = counts[0] + 0.1, counts[1 : 1 + states] + 0.1, counts[1 + states :] + shares[:, None]
        later = emits.sum(axis=0)
        return cls(start / start.sum(), later / later.sum(), moves / moves.sum(axis=1, keepdims=True), emits / later)


def _by_length(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by falling length, all symbols in a row, starts, and how many runs reach each step."""
    lengths = np.array([len(run) for run in runs])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([runs[n] for n in order]).astype(np.int64)
    sizes = lengths[order]
    starts = np.cumsum(sizes) - sizes
    reach = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1), "left")
    return order, flat, starts, reach


def log_likelihoods(model: Hmm, runs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each run of at least one class, by the scaled forward recursion."""
    order, flat, starts, reach = _by_length(runs)
    found = np.zeros(len(runs))
    state = np.broadcast_to(model.start, (len(runs), len(model.start)))
    for step, active in enumerate(reach.tolist()):
        ahead = state[:active] @ model.moves if step else state
        state = ahead * model.emits[flat[starts[:active] + step]]
        scale = state.sum(axis=1)
        state /= scale[:, None]
        found[:active] += np.log(scale)
    out = np.empty(len(runs))
    out[order] = found
    return out


def expected_counts(model: Hmm, runs: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of runs: rows as ``Hmm.from_counts`` takes them. ``first`` marks runs that open a document."""
    order, flat, starts, reach = _by_length(runs)
    first = first[order]
    states = len(model.start)
    ahead = np.where(first[:, None], model.start, model.later)
    alphas, scales, symbols = [], [], []
    for step, active in enumerate(reach.tolist()):
        symbol = flat[starts[:active] + step]
        alpha = (alphas[-1][:active] @ model.moves if step else ahead) * model.emits[symbol]
        scale = alpha.sum(axis=1, keepdims=True)
        alphas.append(alpha / scale)
        scales.append(scale)
        symbols.append(symbol)
    moves = np.zeros((states, states))
    occupied: list[np.ndarray] = []
    beta = np.ones((reach[-1], states))
    for step in range(len(reach) - 1, -1, -1):
        occupied.append(alphas[step] * beta)
        if step:
            back = model.emits[symbols[step]] * beta / scales[step]
            moves += alphas[step - 1][: reach[step]].T @ back
            beta = np.ones((reach[step - 1], states))
            beta[: reach[step]] = back @ model.moves.T
    symbol, weight = np.concatenate(symbols[::-1]), np.concatenate(occupied)
    emits = np.stack([np.bincount(symbol, weight[:, s], len(model.emits)) for s in range(states)], axis=1)
    return np.concatenate([occupied[-1][first].sum(axis=0)[None, :], moves * model.moves, emits])


def segments(classes: list[np.ndarray], size: int = SEGMENT) -> tuple[list[np.ndarray], np.ndarray]:
    """Runs of at most ``size`` classes, and whether each opens its document."""
    runs, first = [], []
    for one in classes:
        for at in range(0, len(one), size):
            runs.append(one[at : at + size])
            first.append(at == 0)
    return runs, np.array(first, dtype=bool)


def summed_counts(model: Hmm, classes: list[np.ndarray]) -> np.ndarray:
    """Expected counts of documents, taken by batches of bounded size."""
    total = np.zeros((1 + len(model.start) + len(model.emits), len(model.start)))
    runs, first = segments(classes)
    start = 0
    while start < len(runs):
        upto, held = start, 0
        while upto < len(runs) and held < BATCH_TOKENS:
            held += len(runs[upto])
            upto += 1
        total += expected_counts(model, runs[start:upto], first[start:upto])
        start = upto
    return total


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (bytes) and ``count`` over all texts; tasks add up what they can hold before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in column_bytes(batch, "text"):
                counts.update(text.lower().split())
                if len(counts) > FLUSH_WORDS:
                    yield record_batch(schema, [list(counts), list(counts.values())])
                    counts.clear()
        yield record_batch(schema, [list(counts), list(counts.values())])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, count long")
    return parts.groupBy("word").agg(F.sum("count").alias("count"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The rows of at most ``most`` of the most frequent words.

    Words fall into steps of an eighth of a doubling of their count, a few hundred
    at most; the highest steps that fit are taken whole, so no task sends more than is kept.
    Of a highest step that doesn't fit by itself the first words by count and bytes are taken.
    """
    step = F.floor(8 * F.log2(F.col("count").cast("double"))).cast("int")
    held, least = 0, None
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)
    for row in steps:
        held += row["words"]
        if held > most:
            break
        least = row["step"]
    if least is not None:
        return counts.filter(step >= least)
    return counts.filter(step == steps[0]["step"]).orderBy(F.desc("count"), "word").limit(most) if steps else counts.limit(0)


@dataclass
class Vocabulary:
    """What of the counts is sent to tasks: totals, the frequent words, and totals of the classes."""

    documents: int
    tokens: int
    distinct: int
    frequent: dict[bytes, int]
    class_tokens: np.ndarray
    class_words: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, documents: int) -> Vocabulary:
        top = sorted(((row["count"], bytes(row["word"])) for row in frequent_words(counts).collect()), key=lambda one: (-one[0], one[1]))
        frequent = {word: count for count, word in top}
        own = set(list(frequent)[:OWN])
        schema = pa.schema([("class", pa.int32()), ("tokens", pa.int64()), ("words", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, words = Counter(), Counter()
            for batch in batches:
                for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if word not in own:
                        number = shared_class(word)
                        tokens[number] += count
                        words[number] += 1
            yield record_batch(schema, [list(tokens), list(tokens.values()), [words[n] for n in tokens]])

        shared = counts.mapInArrow(run, "class int, tokens long, words long").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
        class_tokens, class_words = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
        for number, word in enumerate(list(frequent)[:OWN]):
            class_tokens[1 + number], class_words[1 + number] = frequent[word], 1
        for row in shared.collect():
            class_tokens[row["class"]], class_words[row["class"]] = row["tokens"], row["words"]
        class_tokens[END_CLASS], class_words[END_CLASS] = documents, int(documents > 0)
        return cls(documents, int(class_tokens.sum()), int(class_words.sum()), frequent, class_tokens, class_words)

    def shares(self) -> np.ndarray:
        """Shares of the classes, none zero."""
        return (self.class_tokens + 1) / (self.tokens + CLASSES)

    def class_logs(self) -> np.ndarray:
        """Per class what a word's log10(count + 1) is less by, to be that of its probability in the class."""
        logs = np.log10(self.class_tokens + self.class_words + 1.0)
        alone = np.arange(CLASSES) <= OWN
        return np.where(alone, np.log10(self.class_tokens + 1.0), logs)


def coded_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row its classes, token counts, the sum of log10(count + 1) over frequent words, and the rare words with counts."""
    kept = ["row_id", "doc_id", "held_out"]
    rare = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
    schema = pa.schema(
        [("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("classes", pa.binary())]
        + [("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("class_logs", pa.float64()), ("rare", rare)]
    )
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        own = {word: 1 + n for n, word in enumerate(list(words.frequent)[:OWN])}
        logs = {word: float(np.log10(count + 1.0)) for word, count in words.frequent.items()}
        class_logs, end_log = words.class_logs(), float(np.log10(words.documents + 1.0))

        class Classes(dict):
            def __missing__(self, word: bytes) -> int:
                number = shared_class(word)
                if len(self) < 2 * FREQUENT:
                    self[word] = number
                return number

        classes = Classes(own)
        for batch in (batch.slice(at, ROWS_TOGETHER) for batch in batches for at in range(0, batch.num_rows, ROWS_TOGETHER)):
            rows = []
            for text in column_bytes(batch, "text"):
                found = text.lower().split()
                codes = np.array([*map(classes.__getitem__, found), END_CLASS], dtype="<u2")
                bag = Counter(found)
                seldom = [{"word": word, "times": times} for word, times in bag.items() if word not in logs]
                total = sum(times * logs[word] for word, times in bag.items() if word in logs)
                known = len(found) - sum(one["times"] for one in seldom) + int(words.documents > 0)
                rows.append((codes.tobytes(), len(codes), known, total + end_log, float(class_logs[codes].sum()), seldom))
            yield record_batch(schema, [*[batch.column(n) for n in range(3)], *[[row[n] for row in rows] for n in range(6)]])

    held_out = crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    kinds = "row_id long, doc_id long, held_out boolean, classes binary, n_tokens long, known long, logs double, class_logs double, rare array<struct<word:binary,times:long>>"
    return rows.select(*kept, "text").mapInArrow(run, kinds)


def _classes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(one, "<u2") for one in column.to_pylist()]


def summed_rows(coded: DataFrame, size: tuple[int, int], of: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a table made of the classes of some documents; added up per task, then by row."""
    names = [f"s{n}" for n in range(size[1])]
    schema = pa.schema([("row", pa.int32()), *[(name, pa.float64()) for name in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_classes(batch.column(0)))
        rows = np.flatnonzero(total.any(axis=1))
        yield record_batch(schema, [rows.astype(np.int32), *[total[rows, n] for n in range(size[1])]])

    parts = coded.select("classes").mapInArrow(run, ", ".join(["row int", *[f"{name} double" for name in names]]))
    out = np.zeros(size)
    for row in parts.groupBy("row").agg(*[F.sum(name).alias(name) for name in names]).collect():
        out[row["row"]] = [row[name] for name in names]
    return out


def baum_welch_round(coded: DataFrame, model: Hmm, shares: np.ndarray) -> Hmm:
    """One round over all rows."""
    states = len(model.start)
    sent = coded.sparkSession.sparkContext.broadcast(model)
    counts = summed_rows(coded, (1 + states + CLASSES, states), lambda classes: summed_counts(sent.value, classes))
    return Hmm.from_counts(counts, shares)


def profile_sums(classes: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """Per class, over the places it stands at, the sum of the mean sign row of the document there."""
    total = np.zeros(signs.shape)
    start = 0
    while start < len(classes):
        upto, held = start, 0
        while upto < len(classes) and held < BATCH_TOKENS:
            held += len(classes[upto])
            upto += 1
        part = classes[start:upto]
        flat, sizes = np.concatenate(part).astype(np.int64), np.array([len(one) for one in part])
        means = np.add.reduceat(signs[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        for n in range(signs.shape[1]):
            total[:, n] += np.bincount(flat, np.repeat(means[:, n], sizes), len(total))
        start = upto
    return total


def class_groups(profiles: np.ndarray, weights: np.ndarray, groups: int, rounds: int = 30) -> np.ndarray:
    """Number of the group of each class, by weighted k-means; centres start far from each other."""
    centres = [np.average(profiles, axis=0, weights=weights)]
    apart = np.full(len(profiles), np.inf)
    for _ in range(groups):
        apart = np.minimum(apart, ((profiles - centres[-1]) ** 2).sum(axis=1))
        centres.append(profiles[int(np.argmax(apart * weights))])
    places = np.stack(centres[1:])
    for _ in range(rounds):
        chosen = np.argmin(((profiles[:, None, :] - places[None]) ** 2).sum(axis=2), axis=1)
        held = np.bincount(chosen, weights, groups)
        for n in range(profiles.shape[1]):
            sums = np.bincount(chosen, weights * profiles[:, n], groups)
            places[:, n] = np.where(held > 0, sums / np.maximum(held, 1e-300), places[:, n])
    return chosen


def started(training: DataFrame, shares: np.ndarray, seed: int = 5) -> Hmm:
    """States that each favour a group of classes found in the same documents.

    A random row of signs stands for each class, less their mean by the shares, so
    the mean row of a document is zero but for what it has more of than others.
    """
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (CLASSES, PROFILE))
    signs -= shares @ signs
    sent = training.sparkSession.sparkContext.broadcast(signs)
    sums = summed_rows(training, signs.shape, lambda classes: profile_sums(classes, sent.value))
    model = Hmm.fresh(shares)
    chosen = class_groups(sums / shares[:, None], shares, len(model.start))
    favour = np.where(chosen[:, None] == np.arange(len(model.start)), FAVOUR, 1.0)
    emits = model.emits * favour
    return Hmm(model.start, model.later, model.moves, emits / emits.sum(axis=0))


def trained(coded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Hmm:
    """The model of the training rows, all of which every round sees."""
    training = coded.filter(~F.col("held_out")).select("classes")
    shares = vocabulary.shares()
    if not vocabulary.documents:
        return Hmm.fresh(shares)
    model = started(training, shares)
    for _ in range(rounds):
        model = baum_welch_round(training, model, shares)
    return model


def forward_scores(coded: DataFrame, model: Hmm) -> DataFrame:
    """The rows without their classes, with ``likelihood``, log10 of the probability of the classes."""
    columns = ["row_id", "doc_id", "held_out", "n_tokens", "known", "logs", "class_logs"]
    sent = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = log_likelihoods(sent.value, _classes(batch.column(len(columns)))) / np.log(10)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*columns, "likelihood"])

    kinds = "row_id long, doc_id long, held_out boolean, n_tokens long, known long, logs double, class_logs double, likelihood double"
    return coded.select(*columns, "classes").mapInArrow(run, kinds)


def scored_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Log10 probabilities of every row of ``docs`` under the model and under smoothed word counts.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A NULL text
    counts as empty and is the end alone. Rows without an id go by the checksum of
    the empty text. Repeated rows come out, and count in training, as often as
    they went in. Without training rows counts are zero and states are as started.
    """
    held_out = crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    training = docs.filter(~held_out)
    counts = frozen(word_counts(training))
    vocabulary = Vocabulary.of(counts, training.count())
    coded = frozen(coded_documents(docs, vocabulary))
    model = trained(coded, vocabulary, rounds)
    scored = forward_scores(coded, model)
    rare = coded.select("row_id", F.explode("rare").alias("one")).select("row_id", F.col("one.word").alias("word"), F.col("one.times").alias("times"))
    seldom = rare.join(counts, "word").groupBy("row_id").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("more_logs")
    )
    whole = scored.join(seldom, "row_id", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    spread = float(np.log10(vocabulary.tokens + vocabulary.distinct + 1.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * spread).alias("base_score"),
        (F.col("likelihood") + logs - F.col("class_logs")).alias("score"),
    )
