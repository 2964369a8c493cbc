"""Quality grades by ordinal cumulative-link regression over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import Ids, batches, hash_names, keyed, released, tokens

#: Hashed weights as a power of two; rated rows that train at most; passes; step; pull towards 0;
#: and rated rows that a slot needs to have a weight.
BITS, RATED, EPOCHS, RATE, PULL, LEAST = 18, 20_000, 12, 0.15, 1e-5, 6
#: Bytes of text handled at once.
BATCH = 2_000_000
#: Shapes of a word: what it is made of and how it ends.
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|@-_/\\"


class Model(NamedTuple):
    """Chance of a grade of j or less: 1 / (1 + exp(weights . x - cuts[j])). One weight vector for all cuts."""

    weights: np.ndarray
    cuts: np.ndarray


def _facts(bits: int):
    def facts(new: list[str]) -> tuple[np.ndarray, ...]:
        """For each word as it stands: the slots of its lowered core and of its shape."""
        core, shape = [], []
        for w in new:
            c = w.strip(_STRIP)
            core.append(c.lower())
            case = "u" if len(c) > 1 and c.isupper() else "t" if c[:1].isupper() else "d" if any(x.isdigit() for x in c) else "l" if c else "e"
            shape.append(case + "|" + w[len(w.rstrip(_STRIP)):][:4] if c else "e|" + w[:4])
        slot = lambda names, seed: (hash_names(names, seed) >> np.uint64(64 - bits)).astype(np.int64)
        return slot(core, 1), slot(shape, 2)
    return facts


def features(texts: pa.Array, seen: Ids, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text: 1 for every word that occurs, the share of every shape, and the length's order."""
    names, word, cut = tokens(texts, lower=False)
    num, (core, shape) = seen.look(names)
    at = num[word]
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        here = at[a:b]
        words = np.unique(core[here])
        shapes, count = np.unique(shape[here], return_counts=True)
        size = np.array([(int(np.log2(b - a + 1)) * 0x9E3779B1 + 77) % (1 << bits)])
        out.append((np.concatenate([words, shapes, size]), np.concatenate([np.ones(len(words)), 4.0 * count / max(b - a, 1), [0.5]]).astype(np.float32)))
    return out


def _chance(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Chance of each grade or less, one column for each cut."""
    return 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -30, 30)))


def tails(texts: pa.Array, model: Model, seen: Ids, bits: int) -> np.ndarray:
    """Chance of each grade above 0 or more, one column for each."""
    rows = features(texts, seen, bits)
    at, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    row = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    return 1 - _chance(np.bincount(row, model.weights[at] * value, len(rows)), model.cuts)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, bits: int = BITS, epochs: int = EPOCHS, rate: float = RATE, pull: float = PULL, least: int = LEAST) -> Model:
    """Stochastic gradient steps on the log likelihood of the grades, in a fixed order of small batches."""
    w, square = np.zeros(1 << bits), np.full(1 << bits, 1e-2)
    share = np.cumsum(np.bincount(grades, minlength=n_grades)[:-1] + 1.0) / (len(grades) + n_grades)
    cuts = np.log(share / (1 - share))
    cut_square = np.full(len(cuts), 1e-2)
    rng = np.random.default_rng(7)
    often = np.zeros(1 << bits, np.int64)
    for at, _ in rows:
        often[at] += 1
    # what few rated rows have would only be learnt by heart
    for i, (at, value) in enumerate(rows):
        k = often[at] >= least
        rows[i] = at[k], value[k]
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 128):
            pick = order[lo:lo + 128]
            at = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            below = _chance(np.bincount(row, w[at] * value, len(pick)), cuts)
            y = grades[pick]
            full = np.concatenate([np.zeros((len(pick), 1)), below, np.ones((len(pick), 1))], 1)
            hi, lo_ = full[np.arange(len(pick)), y + 1], full[np.arange(len(pick)), y]
            p = np.maximum(hi - lo_, 1e-9)
            slope = full * (1 - full)
            up, down = slope[np.arange(len(pick)), y + 1], slope[np.arange(len(pick)), y]
            by_score = (down - up) / p / len(pick)
            by_cut = np.zeros(len(cuts))
            for j in range(len(cuts)):
                by_cut[j] = (np.where(y == j, up, 0) - np.where(y == j + 1, down, 0)).dot(1 / p) / len(pick)
            g = np.bincount(at, by_score[row] * value, len(w))
            on = np.unique(at)
            square[on] += g[on] ** 2
            w[on] += rate * g[on] / np.sqrt(square[on]) - pull * w[on]
            cut_square += by_cut**2
            cuts = np.sort(cuts + rate * by_cut / np.sqrt(cut_square))
    return Model(w.astype(np.float32), cuts)


def grade(quality: Column, toxic: Column) -> Column:
    """0 for a text rated poor, 1 for a fair but toxic one, 2 for a good one; null where quality is not rated."""
    return F.when(quality.isNull(), None).when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, n_grades: int = 3, rated: int = RATED, bits: int = BITS) -> Model:
    """Fit on rated documents: the `rated` of them at most with the smallest hash of their id.

    The sample's ids, bounded by that parameter, meet the documents in a join; what comes to the driver
    are the sample's slots, not its texts.
    """
    use = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade")).filter("grade is not null")
    one = use.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rated)
    ids = one.collect()
    sample = docs.sparkSession.createDataFrame(ids, one.schema) if ids else one

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Ids(_facts(bits))
        for b in batches(it, BATCH):
            got = features(b.column(1), seen, bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.astype(np.int32).tobytes() for x, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], names=["doc_id", "grade", "slots", "parts"])

    rows = keyed(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("grade").cast("int").alias("grade")).mapInArrow(run, "doc_id long, grade int, slots binary, parts binary")
    held = sorted((r.doc_id, r.grade, bytes(r.slots), bytes(r.parts)) for r in rows.toLocalIterator())
    grades = np.array([g for _, g, _, _ in held], np.int64)
    for i, (_, _, slots, parts) in enumerate(held):  # one row after the other gives way to its arrays
        held[i] = np.frombuffer(slots, np.int32), np.frombuffer(parts, np.float32)
    model = fit(held, grades, n_grades, bits)
    del held
    released()
    return model


def score(docs: DataFrame, model: Model, also: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """(doc_id, expected_grade, tail_1, ..., with one tail probability for each grade above 0), one row per document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"tail_{j + 1}" for j in range(len(model.cuts))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = sent.value, Ids(_facts(bits))
        for b in batches(it, BATCH):
            tail = tails(b.column(1), m, seen, bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tail.sum(1)), *(pa.array(tail[:, j].copy()) for j in range(tail.shape[1])), *b.columns[2:]], names=["doc_id", "expected_grade", *names, *b.schema.names[2:]])

    use = keyed(docs, also=also)
    extra = "".join(f", {c.name} {c.dataType.simpleString()}" for c in use.schema.fields[2:])
    return use.mapInArrow(run, "doc_id long, expected_grade double, " + ", ".join(f"{t} double" for t in names) + extra)


def classify(docs: DataFrame, labels: DataFrame, keep: float = 0.5, rated: int = RATED) -> DataFrame:
    """(doc_id, expected_grade, tail_1, tail_2, kept): grades from 0 (poor) over 1 (toxic) to 2 (good).

    kept: the chance of the best grade is `keep` at least. labels: (doc_id, quality, toxic); rows without
    quality don't train, an id rated twice trains with its lower grade, a null toxic counts as 0. Without
    rated rows every text gets the same prior. A null or empty text is graded by its length alone. Rows
    without an id are left out, repeated rows are graded each, an empty table gives no row. Only `doc_id`
    and `text` are read.
    """
    out = score(docs, train(docs, labels, rated=rated))
    return out.withColumn("kept", F.col("tail_2") >= keep)


def select_good(docs: DataFrame, labels: DataFrame, keep: float = 0.5, rated: int = RATED) -> DataFrame:
    """The documents that `classify` keeps, with all their columns; rows without an id go.

    Where no row is rated there is nothing to choose by, and every document stays.
    """
    if labels.filter("doc_id is not null and quality is not null").isEmpty():
        return docs.filter("doc_id is not null")
    model = train(docs, labels, rated=rated)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]
    # columns travel under names of their own, so that any may be called what it likes
    inside = docs.filter("doc_id is not null").select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = sent.value, Ids(_facts(BITS))
        for b in batches(it, BATCH):
            texts = b.column(0)
            yield b.filter(pa.array(tails(texts.fill_null("") if texts.null_count else texts, m, seen, BITS)[:, -1] >= keep))

    out = inside.mapInArrow(run, inside.schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"c{rest.index(c)}").alias(c) for c in docs.columns])
