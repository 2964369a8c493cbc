"""Near-duplicate documents by bottom-k sketches from one hash function."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.llm.common import batches, hash_names, keyed, small_batches, tokens
from trackframe.llm.groups import components
from trackframe.session import checkpoint

#: Words of a shingle, values of a sketch, documents of a block in the last comparison.
SHINGLE, SKETCH, BLOCK = 5, 64, 512
#: Bytes of text handled at once.
BATCH = 1_500_000
#: Chance that two sketches of a linked pair share fewer values than the filters ask for.
MISS = 1e-10


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """The ordered distinct 64-bit shingle hashes of each text."""
    names, word, cut = tokens(texts)
    h = hash_names(names)[word]
    full = np.zeros(0, np.uint64)
    if len(h) >= width:
        full = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            full = full * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k]
        full = _mix(full)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(full[a:b - width + 1]))
        elif b > a:  # the whole sequence is one shingle
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = one * np.uint64(0x9E3779B97F4A7C15) + x
            out.append(_mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_shared(k: int, part: float, miss: float = MISS) -> int:
    """The most values that a union sketch of k values of a pair with this Jaccard shares but for a chance of `miss`."""
    p, t = 0.0, 0
    while t <= k:
        p += comb(k, t) * part**t * (1 - part) ** (k - t)
        if p > miss:
            return t
        t += 1
    return k


def _hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each set: what tells sets apart."""
    total = np.array([int(x.sum(dtype=np.uint64)) for x in sets], np.uint64).view(np.int64)
    other = np.array([int(np.bitwise_xor.reduce(_mix(x))) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
    return np.fromiter(map(len, sets), np.int64, len(sets)), total, other


def _signatures(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(doc_id, tie, n, h1, h2, sketch): the text's hash, its set's size and hashes, and its `k` smallest values."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, BATCH):
            sets = shingle_sets(b.column(1), width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *map(pa.array, _hashes(sets)), pa.array([x[:k].tobytes() for x in sets], pa.binary())], names=["doc_id", "tie", "n", "h1", "h2", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, tie long, n long, h1 long, h2 long, sketch binary")


def _postings(classes: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sketches = [np.frombuffer(x, "<i8") for x in b.column("sketch").to_pylist()]
            size = np.fromiter(map(len, sketches), np.int64, len(sketches))
            rep = np.repeat(b.column("rep").to_numpy(zero_copy_only=False), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64)), pa.array(rep)], names=["value", "rep"])

    return classes.select("rep", "sketch").mapInArrow(run, "value long, rep long")


def _sets(docs: DataFrame, classes: DataFrame, used: DataFrame, width: int) -> DataFrame:
    """(rep, set) of the classes `used`, from the text of one document each: that of the class's smallest id.

    An id may have several texts; the one whose set is the class's is told by its hashes.
    """
    of = classes.join(used, "rep", "left_semi").select(F.col("low").alias("doc_id"), "n", "h1", "h2", "rep")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, BATCH):
            sets = shingle_sets(b.column(0), width)
            same = np.all([own == b.column(k).to_numpy() for k, own in enumerate(_hashes(sets), 2)], axis=0)
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(same)), pa.array([x.tobytes() for x, ok in zip(sets, same, strict=True) if ok], pa.binary())], names=["rep", "set"])

    # classes grow with the documents: texts and classes meet by id at every size
    met = docs.join(of.hint("merge"), "doc_id").select("text", "rep", "n", "h1", "h2")
    return met.mapInArrow(run, "rep long, set binary").dropDuplicates(["rep"])


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int, k: int, shared: int) -> bool:
    """Whether den * |a and b| >= num * |a or b|. A union sketch that shares too little settles it first."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    if min(len(a), len(b)) > k:
        head = np.intersect1d(a[:k], b[:k], assume_unique=True)
        union = np.union1d(a[:k], b[:k])[:k]
        if np.searchsorted(head, union[-1], side="right") < shared:
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, k: int, shared: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = zip(*(b.column(c).to_pylist() for c in ("a", "b", "sa", "sb")), strict=True)
            ok = [(x, y) for x, y, p, q in rows if linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), num, den, k, shared)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ok], pa.int64()), pa.array([y for _, y in ok], pa.int64())], names=["a", "b"])

    with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b")
    return with_b.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def block_links(ids: list[int], comps: list[int], sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join different components among the documents of one or two blocks, a spanning few of them.

    side: 0 and 1 for two blocks (pairs across), all 0 for one block (pairs within). Intersections are
    counted as a product of 0/1 matrices over the shingles that more than one document has.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    all_values, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == (1 if side.any() else 0)))
    both = np.zeros((len(left), len(right)), np.float32)
    common = np.flatnonzero(count > 1)
    place = np.full(len(all_values), -1)
    place[common] = np.arange(len(common))
    col = place[where]
    for lo in range(0, len(common), 4096):
        m = np.zeros((len(sets), min(4096, len(common) - lo)), np.float32)
        hit = (col >= lo) & (col < lo + 4096)
        m[row[hit], col[hit] - lo] = 1
        both += m[left] @ m[right].T
    union = size[left][:, None] + size[right][None, :] - both
    comp = np.array(comps)
    ok = (den * both >= num * union) & (comp[left][:, None] != comp[right][None, :])
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        x, y = top(comps[left[i]]), top(comps[right[j]])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((ids[left[i]], ids[right[j]]))
    return out


def _rest(postings: DataFrame, sets: DataFrame, comp_of: DataFrame, num: int, den: int, block: int) -> DataFrame | None:
    """Links between components that still meet in an inverted list, or None where no list holds two."""
    comp = F.coalesce("comp", "rep")
    p = postings.join(comp_of.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", comp.alias("comp"))
    p = checkpoint(p)
    mixed = p.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("value")
    left = checkpoint(p.join(mixed, "value"))
    if left.isEmpty():
        return None
    # documents and lists that hang together; negative numbers stand for lists
    heads = left.groupBy("value").agg(F.min("rep").alias("a"))
    group = components(left.join(heads, "value").select("a", F.col("rep").alias("b")))
    member = left.select("rep", "comp").distinct().join(group.withColumnRenamed("node", "rep").withColumnRenamed("comp", "grp"), "rep")
    size = member.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("nb"))
    member = member.join(size, "grp").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    sent = member.join(sets, "rep").withColumn("o", other).select("grp", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), F.when(F.col("blk") <= F.col("o"), 0).otherwise(1).alias("side"), "rep", "comp", "set")

    def run(t: pa.Table) -> pa.Table:
        c = {x: t.column(x).to_pylist() for x in ("rep", "comp", "set", "side")}
        got = block_links(c["rep"], c["comp"], [np.frombuffer(x, np.uint64) for x in c["set"]], np.array(c["side"]), num, den)
        return pa.table([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

    return sent.groupBy("grp", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, width: int = SHINGLE, k: int = SKETCH, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Two documents are linked where den * |intersection| >= num * |union| of their sets of distinct
    `width`-word shingles; a text of fewer words is one shingle, a null or empty text has none and is
    linked with nothing. component_id is the smallest id reachable, kept tells that it is the own one.
    Rows without an id are left out; rows that repeat an id are documents of their own, in one component
    where their texts are linked; an empty table gives no row. Only `doc_id` and `text` are read.

    Equal sets become one class first. Each class keeps the k smallest hashes of its set. A linked pair
    shares `least_shared(k, num / den)` of them but for a chance of `miss`, so it also shares one of the
    rarest k - that + 1 of either; only those go into the inverted lists, and passages that many
    documents share drop out of them. In each list everyone is compared with the most central member
    and exact counts make components; lists that still hold several are compared in blocks.
    """
    out = _grouped(keyed(docs), num, den, width, k, block, miss)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), (F.col("doc_id") == F.col("low")).alias("kept"))


def select_distinct(docs: DataFrame, num: int = 80, den: int = 100, **how: int) -> DataFrame:
    """The documents without near copies: of each component the one of the smallest id, with all its columns.

    Texts that repeat an id count each on its own; of rows equal in id and text one stays. Texts without
    words are linked with nothing and stay. Rows without an id go; an empty table stays empty.
    """
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = _grouped(keyed(docs), num, den, **how).groupBy("doc_id", "tie").agg(F.min("comp").alias("comp"), F.count(F.lit(1)).alias("times"))
    rows = checkpoint(rows)
    me = F.struct("doc_id", "tie")
    many = rows.groupBy("comp").agg(F.min(me).alias("best"), F.count(F.lit(1)).alias("size")).filter("comp is not null and size > 1").select("comp", "best")
    marks = rows.join(many, "comp", "left").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.coalesce(me == F.col("best"), F.lit(True)).alias("_stays"), "times").filter("times > 1 or not _stays")
    marks = checkpoint(marks.drop("times"))
    there = docs.filter(F.col("doc_id").isNotNull())
    same = (there["doc_id"] == marks["_id"]) & (tie == marks["_tie"])
    single, twice = there.join(marks, same, "left_anti"), marks.filter("_stays")
    if twice.isEmpty():
        return single
    own = there.withColumn("_tie", tie).alias("o").join(twice.alias("m"), (F.col("o.doc_id") == F.col("m._id")) & (F.col("o._tie") == F.col("m._tie")), "left_semi")
    return single.unionByName(own.dropDuplicates(["doc_id", "_tie"]).drop("_tie"))


def _grouped(docs: DataFrame, num: int, den: int, width: int = SHINGLE, k: int = SKETCH, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """(doc_id, tie, n, comp, low): each row's text by its hash, its component, and the component's smallest id.

    Rows without words have no component; their smallest id is their own.
    """
    small_batches(docs.sparkSession)
    need = least_shared(k, num / den, miss)
    sig = checkpoint(_signatures(docs, width, k))
    classes = sig.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("low"), F.any_value("sketch").alias("sketch"))
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))  # a written number: ids may be shared by several texts

    every = _postings(classes)
    often = every.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = every.join(often, "value")
    mine = W.partitionBy("rep")
    kept = F.least(F.lit(k), F.col("n"))
    asked = F.least(F.lit(need), F.ceil(kept * num / den))
    postings = (shared.withColumn("row", F.row_number().over(mine.orderBy("df", "value"))).withColumn("have", F.count(F.lit(1)).over(mine)).withColumn("central", F.sum("df").over(mine))
                .join(classes.select("rep", "n"), "rep").filter(F.col("row") + (kept - F.col("have")) <= kept - asked + 1).select("value", "rep", "n", (F.col("central") / kept).alias("central")))
    postings = checkpoint(postings)
    hub = postings.groupBy("value").agg(F.max(F.struct("central", (-F.col("rep")).alias("rep"), "n")).alias("h")).select("value", (-F.col("h.rep")).alias("a"), F.col("h.n").alias("na"))
    pairs = postings.join(hub, "value").filter((F.col("a") != F.col("rep")) & _fits(F.col("n"), F.col("na"), num, den)).select("a", F.col("rep").alias("b")).distinct()
    sets = checkpoint(_sets(docs, classes, postings.select("rep").distinct(), width))
    links = checkpoint(_verified(checkpoint(pairs), sets, num, den, k, need))
    comp = checkpoint(components(links))
    more = _rest(postings.select("value", "rep"), sets, comp, num, den, block)
    if more is not None:
        more = checkpoint(more)
        if not more.isEmpty():
            comp = checkpoint(components(links.union(more)))
    of = classes.select("n", "h1", "h2", "low", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = of.groupBy("comp").agg(F.min("low").alias("least"))
    of = of.drop("low").join(least, "comp").select("n", "h1", "h2", "comp", "least")
    return sig.select("doc_id", "tie", "n", "h1", "h2").join(of, ["n", "h1", "h2"], "left").select("doc_id", "tie", "n", "comp", F.coalesce("least", "doc_id").alias("low"))


def _fits(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num
