"""Exact largest inner products by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.session import checkpoint

#: Vectors of a block, queries of a block, and the local cosine threshold from which coordinates prune.
BLOCK, QUERIES, COORDINATE = 2048, 256, 0.6
SCALE = 1024.0
_BLOCK = "block_id long, bucket int, low long, dim int, ids binary, vectors binary, norms binary"


def usable(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, v, norm): components times `scale`, rounded down; vectors that are null, or hold a null or
    a number that is not finite, and rows without an id are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    v = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _blocks(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition as they come, `size` of them in one row of bytes."""
    from pyspark import TaskContext

    bucket, low, held = TaskContext.get().partitionId(), 0, []

    def cut() -> pa.RecordBatch:
        nonlocal low, held
        n, dim = len(held), max(len(v) for _, v, _ in held)
        m = np.zeros((n, dim), np.int64)
        for k, (_, v, _) in enumerate(held):
            m[k, :len(v)] = v
        cols = [np.array([i for i, _, _ in held], "<i8"), m.astype("<i8"), np.array([x for _, _, x in held], "<f8")]
        out = pa.RecordBatch.from_arrays([pa.array([bucket * 10**9 + low]), pa.array([bucket], pa.int32()), pa.array([low]), pa.array([dim], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=["block_id", "bucket", "low", "dim", "ids", "vectors", "norms"])
        low, held = low + n, []
        return out

    for b in it:
        for row in zip(*(b.column(k).to_pylist() for k in ("vec_id", "v", "norm")), strict=True):
            held.append(row)
            if len(held) == size:
                yield cut()
    if held:
        yield cut()


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products; in doubles where those are exact, else in unbounded numbers cut to 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] < 2.0**52:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    big = a.astype(object) @ b.T.astype(object)
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def best_of_block(q: np.ndarray, q_id: np.ndarray, q_norm: np.ndarray, floor: np.ndarray, v: np.ndarray, v_id: np.ndarray, v_norm: np.ndarray, k: int, coordinate: float = COORDINATE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best of a block whose vectors are ordered by falling length.

    floor: a score that k vectors reach already, or NaN. A vector reaches it only if its length is
    floor / |q| at least, and its cosine floor / (|q| * longest of the block): above 1 the block is
    left out, from `coordinate` on only those vectors are multiplied whose part along the query's
    largest coordinate lies where such a cosine allows, below it all that are long enough.
    """
    longest, slack = float(v_norm[0]), 1e-9
    unit = None
    whole = np.flatnonzero(~(floor > 0))
    every = dict(zip(whole.tolist(), _exact(q[whole], v), strict=True)) if len(whole) else {}
    for i in range(len(q)):
        if i in every:
            near, score = np.arange(len(v)), every[i]
        else:
            cos = floor[i] / max(q_norm[i] * longest, 1e-300)
            if cos > 1 + slack:
                continue
            long = int(np.searchsorted(-v_norm, -(floor[i] / q_norm[i]) * (1 - slack), side="right"))
            near = np.arange(long)
            if cos >= coordinate:
                if unit is None:
                    unit = v / np.maximum(v_norm, 1e-300)[:, None]
                c = int(np.argmax(np.abs(q[i])))
                at, cos = q[i, c] / q_norm[i], min(cos, 1.0)
                reach = np.sqrt((1 - cos * cos) * max(0.0, 1 - at * at)) + slack
                # the allowed cosines are those above `cos`, so the end on the query's side is open
                part = unit[:long, c] * np.sign(at)
                near = np.flatnonzero(part >= cos * abs(at) - reach)
            score = _exact(q[i:i + 1], v[near])[0]
        ok = v_id[near] != q_id[i]
        if floor[i] == floor[i]:
            ok &= score >= floor[i]
        near, score = near[ok], score[ok]
        if len(score) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= least
            near, score = near[keep], score[keep]
        order = np.lexsort((v_id[near], -score))[:k]
        if len(order):
            yield i, v_id[near[order]], score[order]


def _pairs(queries: DataFrame, blocks: DataFrame, k: int, lanes: int, coordinate: float, copied: str = "queries") -> DataFrame:
    """The k best of each block for each query: blocks of the stated query set against blocks of all rows.

    One side is dealt to the lanes, the one named by `copied` goes to all of them. Spark measures that side before it
    is copied, so it would gather `lanes` times what it takes for small in the driver: hence the merge join.
    """
    every, own = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))), F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int")
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "ids", "vectors", "norms", "floors")], (every if copied == "queries" else own).alias("lane"))
    v = blocks.select("dim", "ids", "vectors", "norms", (own if copied == "queries" else every).alias("lane"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(len(b)):
                one = {c: b.column(c)[r].as_py() for c in b.schema.names}
                dim = max(one["dim"], one["q_dim"])
                got = []
                for p in ("q_", ""):
                    m = np.frombuffer(one[p + "vectors"], "<i8").reshape(-1, one[p + "dim"])
                    got += [np.pad(m, ((0, 0), (0, dim - m.shape[1]))), np.frombuffer(one[p + "ids"], "<i8"), np.frombuffer(one[p + "norms"], "<f8")]
                q, qi, qn, v, vi, vn = got
                out = [(qi[i], a, s) for i, ids, scores in best_of_block(q, qi, qn, np.frombuffer(one["q_floors"], "<f8"), v, vi, vn, k, coordinate) for a, s in zip(ids, scores, strict=True)]
                if out:
                    x = np.array(out, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, j].copy()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return q.join(v.hint("merge"), "lane").drop("lane").mapInArrow(run, "query_id long, vec_id long, score long")


def _first(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query, k: int = 10, scale: float = SCALE, block: int = BLOCK, queries: int = QUERIES, coordinate: float = COORDINATE) -> DataFrame:
    """The k vectors with the largest inner product for each query row, exactly.

    vectors: (vec_id, embedding); is_query: a column over vec_id that picks the query rows. Returns
    (query_id, rank from 1, vec_id, score), ties to the smaller vec_id; fewer than k where there are no
    more. Products are of whole numbers floor(scale * x). A row's own id is never its result. Vectors
    of different length are compared as if the shorter had zeros at its end. Null vectors and those
    holding null, NaN or infinite take no part; an empty table gives no row; repeated vectors each count;
    other columns are not read. Scores beyond 64 bits are cut to the largest number.

    Vectors are dealt by range of their length into buckets, and each bucket cut into blocks. The
    longest bucket gives every query a score that k vectors reach; with it each bucket is pruned by
    length or by a coordinate, and only what is left is multiplied.
    """
    spark = vectors.sparkSession
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    use = usable(vectors, scale)
    laid = use.repartitionByRange(lanes, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = checkpoint(laid.mapInArrow(lambda it: _blocks(it, block), _BLOCK))
    asked = checkpoint(use.filter(is_query).repartition(max(1, lanes // 4), "vec_id").mapInArrow(lambda it: _blocks(it, queries), _BLOCK))

    def with_floor(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for ids, known in zip(b.column("ids").to_pylist(), b.column("known").to_pylist(), strict=True):
                known = {e["query_id"]: e["floor"] for e in known or []}
                out.append(np.array([known.get(i, np.nan) for i in np.frombuffer(ids, "<i8").tolist()], "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("dim", "ids", "vectors", "norms")), pa.array(out, pa.binary())], names=["dim", "ids", "vectors", "norms", "floors"])

    shape = "dim int, ids binary, vectors binary, norms binary, floors binary"
    none = asked.withColumn("known", F.lit(None).cast("array<struct<query_id:long,floor:double>>")).select("dim", "ids", "vectors", "norms", "known").mapInArrow(with_floor, shape)
    start = _first(_pairs(none, blocks.filter("bucket = 0"), k, lanes, coordinate, copied="blocks"), k).filter(F.col("rank") == k)
    # which block a query is in; a block has `queries` rows at most, so the lists are bounded
    member = asked.select("block_id", F.expr("explode(sequence(0, cast(length(ids) / 8 as int) - 1)) as pos"), "ids").select("block_id", F.expr("conv(hex(reverse(substring(ids, pos * 8 + 1, 8))), 16, -10)").cast("long").alias("query_id"))
    known = member.join(start.select("query_id", F.col("score").cast("double").alias("floor")), "query_id").groupBy("block_id").agg(F.collect_list(F.struct("query_id", "floor")).alias("known"))
    ready = asked.join(known, "block_id", "left").select("dim", "ids", "vectors", "norms", "known").mapInArrow(with_floor, shape)
    return _first(_pairs(ready, blocks, k, lanes, coordinate), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
