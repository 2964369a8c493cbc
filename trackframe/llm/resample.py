"""Resampling documents towards a target distribution, drawn by parallel sorting by regular sampling.

Each document's weight is the mean gain of its hashed features, looked up in one array. Adding fixed
noise to the weights makes "take the highest" a draw without replacement. The exact order of all
scores comes from sorted runs: every task sorts what it holds, regular samples of the runs give
splitters, each run's rows go to the segment their splitters name, a segment is merged where it
arrives, and the sizes of the segments before it turn places into ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.buffers import flat, lowered, unflat, word_bytes
from trackframe.llm.common import batches, keyed, offsets, tokens
from trackframe.session import checkpoint

#: Hash buckets of the features; words that a document needs to be drawn; drawn share in percent; seed of the noise.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024


# ---------------------------------------------------------------- features

def bucket_runs(texts: pa.Array, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every run of `least` to `most` words, where each text's runs end, and its number of words.

    A feature is its words joined by one blank; its bucket is the crc32 of the UTF-8 bytes modulo `buckets`.
    """
    raw, cut = flat(texts)
    low = lowered(raw)
    names, at, ends = tokens(unflat(np.where(word_bytes()[low], low, np.uint8(32)), cut), lower=False)
    utf = [w.encode() for w in names]
    words = np.diff(ends)
    code = np.fromiter(map(zlib.crc32, utf), np.int64, len(utf))[at] if len(at) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), words)
    left = np.repeat(ends[1:], words) - np.arange(len(at))  # words from here to the end of the text
    rows, owners = [], []
    for size in range(1, most + 1):
        if size > 1:  # the crc of a longer run goes on from that of the shorter one
            whole = np.flatnonzero(left >= size)
            code[whole] = [zlib.crc32(b" " + utf[at[i + size - 1]], int(code[i])) for i in whole]
        if size >= least:
            whole = np.flatnonzero(left >= size)
            rows.append(code[whole] % buckets)
            owners.append(owner[whole])
    if len(rows) == 1:
        return rows[0], offsets(np.bincount(owners[0], minlength=len(words))), words
    found, of = np.concatenate(rows), np.concatenate(owners)
    return found[np.argsort(of, kind="stable")], offsets(np.bincount(of, minlength=len(words))), words


def features(docs: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, runs): the buckets of a text's features as little-endian numbers.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lowering A-Z. A null text has none.
    """
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found, ends, words = bucket_runs(b.column(1), least, most, buckets)
            data = found.astype(kind).tobytes()
            cut = (ends * np.dtype(kind).itemsize).astype(np.int64)
            runs = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(cut), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(np.diff(ends)), runs], names=["doc_id", "n_words", "n_features", "runs"])

    return keyed(docs, key=key).mapInArrow(run, "doc_id long, n_words long, n_features long, runs binary")


def _stored(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw, cut = flat(column)
    return np.frombuffer(raw.tobytes(), kind), cut // np.dtype(kind).itemsize


def bucket_counts(feats: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall in each bucket: every task counts into one array, the arrays are added."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in it:
            total += np.bincount(_stored(b.column(0), kind)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in feats.select("runs").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket: how much more the target uses it."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(feats: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): the floored mean gain, and with fixed Gumbel noise added."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found, ends = _stored(b.column(3), kind)
            sums = np.zeros(len(found) + 1, np.int64)
            np.cumsum(gains[found], out=sums[1:])
            n = np.diff(ends)
            weight = np.where(n > 0, (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1), 0)
            noise = np.floor(-1000 * np.log(-np.log((b.column(4).to_numpy() + 0.5) / 4294967296))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight), pa.array(weight + noise)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return feats.select("doc_id", "n_words", "n_features", "runs", h.alias("h")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


# ---------------------------------------------------------------- parallel sorting by regular sampling

def _pick(keys: np.ndarray, mass: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of weighted keys, those at `n` even steps of their mass, each with the mass it stands for."""
    at = np.lexsort(keys.T[::-1])
    run = np.cumsum(mass[at])
    step = np.floor(run * n / run[-1] + 1e-9).astype(np.int64)
    more = np.diff(step, prepend=0)
    hit = more > 0
    return keys[at[hit]], more[hit] * run[-1] / n


def splitters(runs: DataFrame, order: Sequence[str], parts: int) -> np.ndarray:
    """At most parts - 1 rows of (order..., run, pos) that cut the sorted whole into segments of about equal size.

    Each run gives its rows at `parts` even places. Runs are thinned in groups of about the root of their
    number before the driver sees them, so it holds root(runs) * parts rows. A segment exceeds the even share
    by two shares at most: one for the samples of the runs, one for those of the groups.
    """
    key = [*order, "run", "pos"]
    sizes = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    group = max(1, math.isqrt(max(0, sizes.count() - 1)) + 1)
    upto = lambda p: F.floor(p * parts / F.col("n")).cast("long")
    steps = upto(F.col("pos") + 1) - upto(F.col("pos"))
    some = runs.select(*key).join(sizes, "run").filter(steps > 0).select(*key, (steps * F.col("n") / parts).alias("mass"), F.pmod("run", F.lit(group)).alias("g"))

    def thin(t: pa.Table) -> pa.Table:
        k, m = _pick(np.stack([t[c].to_numpy() for c in key], 1), t["mass"].to_numpy(), parts)
        return pa.table({**{c: k[:, i] for i, c in enumerate(key)}, "mass": m})

    got = some.groupBy("g").applyInArrow(thin, ", ".join(f"{c} long" for c in key) + ", mass double").toArrow()
    if not len(got):
        return np.zeros((0, len(key)), np.int64)
    return _pick(np.stack([got[c].to_numpy() for c in key], 1), got["mass"].to_numpy(), parts)[0][:parts - 1]


def sort_ranks(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """`df` with `rank` 1, 2, 3... along the whole-number columns `order`, ascending; equal rows in any fixed order.

    A row is told apart by its run and its place there, so any number of equal rows is still cut evenly.
    `df` must not have columns called run, pos, segment or rank.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols, key = df.columns, [*order, "run", "pos"]

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, n = TaskContext.get().partitionId(), 0
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), run, np.int64)), pa.array(np.arange(n, n + len(b)))], names=[*cols, "run", "pos"])
            n += len(b)

    shape = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    runs = checkpoint(df.sortWithinPartitions(*order).mapInArrow(number, f"{shape}, run long, pos long"))
    cuts = splitters(runs, order, parts)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = np.concatenate([cuts, np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in key], 1)])
            at = np.lexsort(rows.T[::-1])  # stable: a splitter comes before the row it was
            segment = np.zeros(len(rows), np.int64)
            segment[at] = np.cumsum(at < len(cuts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segment[len(cuts):])], names=[*b.schema.names, "segment"])

    dealt = runs.mapInArrow(deal, f"{shape}, run long, pos long, segment long")
    sizes = np.zeros(len(cuts) + 1, np.int64)
    for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.segment] = r.n
    base = offsets(sizes)

    def rank(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = -1, 0
        for b in it:
            segment = b.column(b.num_columns - 1).to_numpy()
            first = np.flatnonzero(np.diff(segment, prepend=now))  # rows that open a segment
            since = np.arange(len(segment)) + done
            for i in first:
                since[i:] = np.arange(len(segment) - i)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(cols)], pa.array(base[segment] + since + 1)], names=[*cols, "rank"])
            if len(segment):
                now, done = segment[-1], int(since[-1]) + 1

    merged = dealt.repartitionById(len(cuts) + 1, F.col("segment").cast("int")).sortWithinPartitions(*key)
    return merged.mapInArrow(rank, f"{shape}, rank long")


# ---------------------------------------------------------------- the draw

def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED, target_key: str = "item_id", parts: int | None = None) -> DataFrame:
    """Draw `percent` of the documents with `words` words or more, likelier the more their features are the target's.

    Returns one row per document: (doc_id, n_features, weight, score, rank), rank from 1 for drawn documents and
    null for all others. Ties go to the smaller doc_id; repeated rows are documents of their own. A null or empty
    text has no features and weight 0; rows without an id are left out; an empty target gives every bucket the
    gain of no use; an empty table gives no rows. Only the id and `text` of either table are read.
    """
    feats = checkpoint(features(docs, least, most, buckets))
    gains = bucket_gains(bucket_counts(feats, buckets), bucket_counts(features(target, least, most, buckets, target_key), buckets))
    scored = weights(feats, gains, seed)
    long = scored.filter(F.col("n_words") >= words).select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("down"))
    drawn = feats.filter(F.col("n_words") >= words).count() * percent // 100
    placed = sort_ranks(long, ["down", "doc_id"], parts)
    out = ["doc_id", "n_features", "weight", "score"]
    none = scored.filter(F.col("n_words") < words).select(*out, F.lit(None).cast("long").alias("rank"))
    return placed.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).union(none)
