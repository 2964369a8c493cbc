"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens get the log-odds of toxic against clean labelled texts, with Dirichlet priors in two levels: a
word is drawn towards its first bytes, these towards the share of all. Less a constant drift, so that
clean text goes down on average, the scores of a text are scanned once for all segments that no longer
or shorter neighbour beats. The best segments of clean texts follow an extreme-value law whose two
parameters are read off the clean labelled texts; each segment's chance under it is turned into
evidence, and a logistic curve over a text's evidence gives the score.

Everything that is fitted is a sum over all labelled rows: counts in hashed tables, tail sums, and a
histogram of evidence. Where labelled texts are scored for fitting, their own labels' counts are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.buffers import code_points, flat, lowered, word_bytes
from trackframe.llm.common import batches, keyed, offsets
from trackframe.session import checkpoint

#: Slots of the hashed counts of words and of first bytes, as powers of two; how many bytes are a word's first.
WORD_BITS, HEAD_BITS, HEAD = 20, 18, 6
#: Texts that a word's first bytes, and the share of all, count for beside the word's own texts; taken off every token.
PRIOR, HEAD_PRIOR, DRIFT = 4.0, 20.0, 1.5
#: Tail of the clean segments that the law is read off, and segments it needs; bins of evidence; score that predicts 1.
TAIL, TAIL_LEAST, BINS, PREDICT = 0.1, 50, 512, 0.7
#: A passage is reported where as good a one is expected in fewer than so many clean texts of its length.
EXPECTED = 0.05
#: Fixed multipliers of the hashes (odd, 64 bits).
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BATCH = 2_000_000
CLEAN, TOXIC, NONE = 0, 1, 2


# ---------------------------------------------------------------- tokens

def folded(raw: np.ndarray) -> np.ndarray:
    """Lowered bytes: A-Z, and the capital letters U+00C0 to U+00DE but the sign at U+00D7."""
    low = lowered(raw)
    latin = np.zeros(len(raw), bool)
    latin[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    return low + latin.astype(np.uint8) * np.uint8(0x20)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, STEP, np.uint64)
    down = np.full(n + 1, pow(STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def token_slots(raw: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: where each begins and ends, its slot, the slot of its first bytes; where each text's words end.

    The hash of a word is a polynomial in its bytes, taken from running sums modulo 2^64, so no word is looked at alone.
    """
    low = folded(raw)
    on = np.zeros(len(raw) + 1, bool)
    on[:-1] = word_bytes()[low]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[cut] = True  # a text's end also ends its last word
    begin = np.flatnonzero(on & (fresh | ~np.concatenate([[False], on[:-1]])))
    stop = np.concatenate([on[1:], [False]])
    end = np.flatnonzero(on & (np.concatenate([fresh[1:], [True]]) | ~stop)) + 1
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])

    def slot(to: np.ndarray, bits: int) -> np.ndarray:
        x = (sums[to] - sums[begin]) * down[begin]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX_A)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX_B)
        return (x >> np.uint64(64 - bits)).astype(np.int64)

    return begin, end, slot(end, WORD_BITS), slot(np.minimum(end, begin + HEAD), HEAD_BITS), np.searchsorted(begin, cut)


# ---------------------------------------------------------------- counts and log-odds

class Odds(NamedTuple):
    """Log-odds less drift: of words for texts without a known label, for clean and for toxic ones left out of the counts."""

    word: np.ndarray  # counts of words: 2 x slots
    head: np.ndarray
    texts: np.ndarray  # clean and toxic texts

    def scores(self, word: np.ndarray, head: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The score of each token; `label` tells whose own text is left out of the counts."""
        less = np.stack([label == CLEAN, label == TOXIC]).astype(np.float32)
        share = (self.texts[1] + 0.5) / (self.texts.sum() + 1.0)
        c, t = np.maximum(self.head[:, head] - less, 0)
        base = (t + HEAD_PRIOR * share) / (c + t + HEAD_PRIOR)
        c, t = np.maximum(self.word[:, word] - less, 0)
        of = (t + PRIOR * base) / (c + t + PRIOR)
        return np.log(of / (1 - of)) - math.log(share / (1 - share)) - DRIFT


def _labelled(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(doc_id, text, label): whole texts of training rows with a label; a doubly labelled id is toxic if any row says so."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("long")).alias("label"))
    # labels grow with the documents, so they are never sent whole: texts and labels meet by id at every size
    return keyed(docs.filter(train)).join(known.hint("merge"), "doc_id").select("doc_id", "text", "label")


def count_tokens(rows: DataFrame) -> Odds:
    """In how many clean and toxic texts each slot occurs. Every task counts into fixed arrays; these are added."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((2, 1 << bits), np.int64) for bits in (WORD_BITS, HEAD_BITS)]
        texts = np.zeros((2, 1), np.int64)
        for b in batches(it, BATCH):
            raw, cut = flat(b.column(0))
            label = b.column(1).to_numpy()
            _, _, word, head, ends = token_slots(raw, cut)
            owner = np.repeat(np.arange(len(label)), np.diff(ends))
            for table, slot in zip(tables, (word, head), strict=True):
                once = np.unique(owner * table.shape[1] + slot)
                np.add.at(table, (label[once // table.shape[1]], once % table.shape[1]), 1)
            np.add.at(texts, (label, 0), 1)
        whole = np.concatenate([*tables, texts], 1)
        at = np.flatnonzero(whole.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(whole[0, at]), pa.array(whole[1, at])], names=["slot", "clean", "toxic"])

    got = rows.select("text", "label").mapInArrow(run, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    sizes = [1 << WORD_BITS, 1 << HEAD_BITS, 1]
    whole = np.zeros((2, sum(sizes)))
    whole[:, got["slot"].to_numpy()] = np.stack([got["clean"].to_numpy(), got["toxic"].to_numpy()])
    word, head, texts = np.split(whole, np.cumsum(sizes)[:-1], axis=1)
    return Odds(word.astype(np.float32), head.astype(np.float32), texts[:, 0].copy())


# ---------------------------------------------------------------- segments

def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximum-scoring segments (start, stop, score) of a row of numbers, in order, by one scan.

    The best segment comes first in rank, then the best of what lies left and right of it, and so on; the
    scan keeps a stack of candidates and looks at each positive run once, so it takes linear time.
    """
    up = score > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    total = np.zeros(len(score) + 1)
    np.cumsum(score, out=total[1:])
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, stop, last candidate with a smaller sum before
    for start, stop, low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), total[edge[::2]].tolist(), total[edge[1::2]].tolist(), strict=True):
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][1] >= high:
                stack.append((low, high, start, stop, k))
                break
            low, start = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, r - l) for l, r, a, b, _ in stack]


class Law(NamedTuple):
    """Clean texts of n tokens hold n * rate * exp(-slope * s) segments of score s or more on average."""

    slope: float
    rate: float

    def expected(self, score: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return np.maximum(tokens, 1) * self.rate * np.exp(-self.slope * np.minimum(score, 600 / self.slope))

    def evidence(self, score: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Less the log of the chance that a clean text's best segment is as good: by the extreme-value law of type I."""
        e = self.expected(score, tokens)
        return np.where(e < 1e-8, -np.log(np.maximum(e, 1e-300)), -np.log(-np.expm1(-np.maximum(e, 1e-8))))


def _scan(rows: DataFrame, odds: Odds, shape: str, each) -> DataFrame:
    """Apply `each` to (batch, token starts, token ends, text ends, segments of each text) batch by batch."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(tuple(odds))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Odds(*sent.value)
        for b in batches(it, BATCH):
            raw, cut = flat(b.column(b.schema.get_field_index("text")))
            label = b.column(b.schema.get_field_index("label")).to_numpy()
            begin, end, word, head, ends = token_slots(raw, cut)
            score = use.scores(word, head, np.repeat(label, np.diff(ends)))
            yield each(b, raw, cut, begin, end, ends, [segments(score[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)])

    return rows.mapInArrow(run, shape)


def clean_law(rows: DataFrame, odds: Odds) -> Law:
    """The law of the segments of clean labelled texts, from the excess of the upper tail (scores in steps of 1/64)."""

    def each(b, raw, cut, begin, end, ends, found):
        score = np.fromiter((s for x in found for _, _, s in x), np.float64)
        step, n = np.unique(np.minimum(np.floor(score * 64), 1 << 16).astype(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.append(step, -1)), pa.array(np.append(n, len(begin)))], names=["step", "n"])

    got = _scan(rows.filter(F.col("label") == CLEAN), odds, "step long, n long", each).groupBy("step").agg(F.sum("n").alias("n")).toArrow().sort_by("step")
    step, n = got["step"].to_numpy(), got["n"].to_numpy()
    tokens, step, n = (int(n[0]) if len(n) else 0), step[1:], n[1:]
    if not len(step):  # no positive segment in any clean text: a segment of one unit is met once in all of them
        return Law(1.0, 1.0 / max(tokens, 1))
    above = n[::-1].cumsum()[::-1]
    ok = np.flatnonzero((above <= max(TAIL * n.sum(), 1)) & (above >= min(TAIL_LEAST, n.sum())))
    k = int(ok[0]) if len(ok) else 0
    low = step[k] / 64
    excess = float((n[k:] * ((step[k:] + 0.5) / 64 - low)).sum()) / float(above[k])
    slope = 1 / max(excess, 1 / 64)
    return Law(slope, float(above[k]) / max(tokens, 1) * math.exp(min(slope * low, 500)))


def _evidence(law: Law, found: list, ends: np.ndarray) -> np.ndarray:
    """The summed evidence of each text's segments, on a log scale."""
    n = np.diff(ends)
    own = np.fromiter(map(len, found), np.int64, len(found))
    score = np.fromiter((s for x in found for _, _, s in x), np.float64, int(own.sum()))
    each = law.evidence(score, np.repeat(n, own))
    return np.log1p(np.bincount(np.repeat(np.arange(len(found)), own), each, len(found)))


def fit_curve(x: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the logistic curve of the toxic share over x, each class with one text more at the ends."""
    x = np.concatenate([x, [0.0, float(x.max(initial=0)) + 1]])
    c, t = np.concatenate([clean, [1.0, 0.0]]), np.concatenate([toxic, [0.0, 1.0]])
    w = np.zeros(2)
    basis = np.stack([np.ones_like(x), x])
    loss = lambda w: float(((c + t) * np.logaddexp(0, w @ basis) - t * (w @ basis)).sum())
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w @ basis, -40, 40)))
        step = np.linalg.solve((basis * ((c + t) * p * (1 - p))) @ basis.T + 1e-6 * np.eye(2), basis @ (t - (c + t) * p))
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
    return float(w[0]), max(float(w[1]), 0.0)


class Model(NamedTuple):
    odds: Odds
    law: Law
    curve: tuple[float, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * x, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, held_out: Column) -> Model:
    """Fit all on the labelled rows outside `held_out`. The driver holds tables of fixed sizes only."""
    rows = _labelled(docs, labels, F.col("doc_id").isNotNull() & ~held_out)
    rows = checkpoint(rows)
    odds = count_tokens(rows)
    if not odds.texts.all():  # nothing to tell apart: every text gets the share of toxic ones
        share = (odds.texts[1] + 0.5) / (odds.texts.sum() + 1.0)
        return Model(odds, Law(1.0, 1.0), (math.log(share / (1 - share)), 0.0))
    law = clean_law(rows, odds)

    def each(b, raw, cut, begin, end, ends, found):
        bins = np.minimum(_evidence(law, found, ends) * (BINS / 8), BINS - 1).astype(np.int64)
        key, n = np.unique(bins * 2 + b.column(b.schema.get_field_index("label")).to_numpy(), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    table = np.zeros((BINS, 2))
    for r in _scan(rows, odds, "key long, n long", each).groupBy("key").agg(F.sum("n").alias("n")).collect():
        table[r.key // 2, r.key % 2] = r.n
    return Model(odds, law, fit_curve((np.arange(BINS) + 0.5) * 8 / BINS, table[:, 0], table[:, 1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, evidence, score, passages): all texts under one model, labels left aside.

    Passages are (start, stop, score, expected), in code points: the segments as good as which fewer than
    `EXPECTED` are expected in a clean text of that length.
    """
    odds, law = model.odds, model.law
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def each(b, raw, cut, begin, end, ends, found):
        x = _evidence(law, found, ends)
        own = np.fromiter(map(len, found), np.int64, len(found))
        flat_ = [(i, a, z, s) for i, f in enumerate(found) for a, z, s in f]
        text, a, z, s = (np.array(v) for v in zip(*flat_, strict=True)) if flat_ else (np.zeros(0, np.int64),) * 4
        e = law.expected(s.astype(np.float64), np.repeat(np.diff(ends), own))
        hit = np.flatnonzero(e < EXPECTED)
        text, a, z = text[hit], a[hit], z[hit]
        points = code_points(raw)
        start, stop = points[begin[ends[text] + a]] - points[cut[text]], points[end[ends[text] + z - 1]] - points[cut[text]]
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(stop), pa.array(s[hit].astype(np.float64)), pa.array(e[hit])], fields=list(kind.value_type))
        lists = pa.ListArray.from_arrays(pa.array(offsets(np.bincount(text, minlength=len(found))).astype(np.int32)), spans, type=kind)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), pa.array(x), pa.array(model.probability(x)), lists], names=["doc_id", "n_tokens", "evidence", "score", "passages"])

    return _scan(keyed(docs).withColumn("label", F.lit(NONE).cast("long")), odds, "doc_id long, n_tokens long, evidence double, score double, passages array<struct<start: long, stop: long, score: double, expected: double>>", each)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, predict: float = PREDICT) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_tokens, evidence, passages) of every document's whole text.

    Learns from labelled rows outside `held_out` (a condition on doc_id; by default crc32(doc_id as text) mod 3 is 1).
    A null or empty text has no tokens and gets the curve's value at no evidence; without labels of both kinds
    every text gets the share of toxic ones (one half without any). Rows without an id are left out, repeated rows
    give equal rows, an empty table none. Of `docs` only `doc_id` and `text` are read, of `labels` `doc_id` and `toxic`.
    """
    out = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1 if held_out is None else held_out
    scored = score(docs, train(docs, labels, out))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= predict).cast("int").alias("predicted"), "n_tokens", "evidence", "passages")
