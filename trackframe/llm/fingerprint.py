"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A text is cut into paragraphs at line ends, long paragraphs into pieces of a few words counted from
the paragraph's start. Every piece is hashed to a wide vector and the vectors are summed, each lane
modulo a power of two. Sums don't depend on order, and a piece is added or taken away by adding or
subtracting its vector. The first lanes are 32-bit numbers and settle equality. The others are signs,
summed as counts: their products estimate how many pieces two texts share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.llm.common import keyed, range_of

#: Words of a piece; 64-bit hashes that give two 32-bit lanes each; 64-bit hashes that give 64 signs each.
PIECE_WORDS, WIDE, SIGNS = 6, 4, 2
_MASK = 0x0000000100000001
_LOW = 0xFFFFFFFF


def pieces(text: Column, words: int = PIECE_WORDS) -> Column:
    """The pieces of a text in order: paragraphs, and within them runs of `words` words. An empty text has none."""
    runs = F.regexp_extract_all(text, F.lit(r"[^\n\s]++(?:[^\S\n]++[^\n\s]++){0," + str(words - 1) + "}+"), F.lit(0))
    return runs


def _names(wide: int = WIDE, signs: int = SIGNS) -> list[str]:
    return [f"w{k}" for k in range(2 * wide)] + [f"s{k}_{j}" for k in range(signs) for j in range(32)]


def vector(piece: str, wide: int = WIDE, signs: int = SIGNS) -> list[Column]:
    """What a piece adds to each running sum. A sign sum holds two counts of 32 bits each."""
    out = []
    for k in range(wide):
        h = F.xxhash64(F.lit(k), F.col(piece))
        out += [h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32)]
    for k in range(signs):
        h = F.col(f"_h{k}")
        out += [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_MASK)) for j in range(32)]
    return out


def summed(pieced: DataFrame, by: Sequence[str], piece: str = "piece", wide: int = WIDE, signs: int = SIGNS) -> DataFrame:
    """Sum the vectors of the pieces of each group: (by, pieces, one column per sum). Null pieces add nothing."""
    use = pieced.withColumns({f"_h{k}": F.xxhash64(F.lit(100 + k), F.col(piece)) for k in range(signs)})
    there = F.col(piece).isNotNull()
    return use.groupBy(*by).agg(F.count(piece).alias("pieces"), *[F.coalesce(F.sum(F.when(there, v)), F.lit(0)).alias(n) for n, v in zip(_names(wide, signs), vector(piece, wide, signs), strict=True)])


def state(wide: int = WIDE, signs: int = SIGNS) -> Column:
    """The fingerprint of a summed row as a struct: number of pieces, 32-bit lanes, counts of set signs."""
    lanes = F.array(*[F.col(f"w{k}").bitwiseAND(F.lit(_LOW)) for k in range(2 * wide)])
    packed = [F.col(f"s{k}_{j}") for k in range(signs) for j in range(32)]
    counts = F.array(*[c.bitwiseAND(F.lit(_LOW)) for c in packed], *[F.shiftrightunsigned(c, 32) for c in packed])
    return F.struct(F.col("pieces").cast("long").alias("pieces"), lanes.alias("lanes"), counts.alias("signs"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or with sign -1 of the first without the second."""
    add = lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW))
    return F.struct((a["pieces"] + sign * b["pieces"]).alias("pieces"), F.zip_with(a["lanes"], b["lanes"], add).alias("lanes"), F.zip_with(a["signs"], b["signs"], add).alias("signs"))


def text_of(fp: Column) -> Column:
    """A fingerprint as hexadecimal text: number of pieces, lanes, signs modulo 2**16."""
    wide = F.array_join(F.transform(fp["lanes"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    near = F.array_join(F.transform(fp["signs"], lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFF)))), 4, "0")), "")
    return F.concat_ws("-", F.lower(F.hex(fp["pieces"])), wide, near)


def likeness(a: Column, b: Column) -> Column:
    """0 for texts with nothing in common, 1 for equal ones: twice the estimated shared pieces over all pieces."""
    plus = lambda fp: F.transform(fp["signs"], lambda x: (2 * x - fp["pieces"]).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    x, y = plus(a), plus(b)
    both = dot(x, x) + dot(y, y)
    return F.when(a == b, 1.0).when(both == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * dot(x, y) / both)))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, next, blk, own): each document with the text of the next one by descending id,
    the first after the last.

    Ids are cut into ranges, and the first row of a range is also sent to the range before it, so no
    window spans more than one range. Rows with `own` false are those guests. What is broadcast is one
    number per range. Rows that repeat an id follow each other by the text's hash.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("tie"))
    # sampled range bounds, one per partition
    lows = sorted(r.low for r in ids.select("doc_id").repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("low")).collect())
    if not lows:
        return docs.select("doc_id", "text", F.col("text").alias("next"), F.lit(0).alias("blk"), F.lit(True).alias("own"), F.lit(0).cast("long").alias("tie"), F.lit(1).alias("row"))
    block = range_of(F.col("doc_id"), lows)
    n = len(lows)
    # the first row of a range has its largest id; equal ids stay in one range
    heads = ids.withColumn("blk", block).groupBy("blk").agg(F.max(F.struct("doc_id", "tie")).alias("h")).select(F.col("h.doc_id").alias("doc_id"), F.col("h.tie").alias("tie"), F.lit(True).alias("head"))
    rows = docs.withColumn("tie", F.xxhash64("text")).withColumn("blk", block).join(F.broadcast(heads), ["doc_id", "tie"], "left")
    to = F.array(F.struct(F.col("blk").alias("blk"), F.lit(True).alias("own")), F.when(F.col("head"), F.struct(F.pmod(F.col("blk") + 1, F.lit(n)).cast("int").alias("blk"), F.lit(False).alias("own"))))
    sent = rows.withColumn("to", F.explode(F.array_compact(to))).select("doc_id", "text", "tie", F.col("to.blk").alias("blk"), F.col("to.own").alias("own"))
    # guests come after the rows that own the range
    w = W.partitionBy("blk").orderBy(F.desc("own"), F.desc("doc_id"), F.desc("tie"))
    return sent.withColumn("next", F.lead("text").over(w)).withColumn("row", F.row_number().over(w))


def fingerprint_documents(docs: DataFrame, words: int = PIECE_WORDS) -> DataFrame:
    """Fingerprint every text and its edited text, whose last half is the start of the next document.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). A
    null text counts as empty: no pieces, a fingerprint of zeros, like every other empty text. With a
    single row the next document is the row itself. Rows that repeat an id follow each other by a hash
    of their text; rows without an id are left out; an empty table gives no row. Only `doc_id` and
    `text` are read. The texts are shuffled once, by ranges of the id, and everything after stays there.
    """
    rows = with_next(keyed(docs))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), (n - half).cast("int")), F.col("next").substr(F.lit(1), half))
    rows = rows.select("blk", "row", "own", "doc_id", n.cast("long").alias("n_chars"), F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
        F.when(F.col("own"), F.struct(F.lit(1).alias("kind"), edited.alias("t"))))).alias("x")).filter(F.col("x").isNotNull())
    rows = rows.select("blk", "row", "own", "doc_id", "n_chars", "x.kind", "x.t", F.when(F.col("x.kind") == 1, F.sha2(F.col("x.t"), 256)).alias("sha"))
    key = ["blk", "row", "own", "doc_id", "n_chars", "kind", "sha"]
    pieced = rows.select(*key, F.explode_outer(pieces(F.col("t"), words)).alias("piece"))
    fp = summed(pieced, key).select(*key, state().alias("fp"))
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    both = fp.groupBy("blk", "row", "own", "doc_id", "n_chars").agg(pick(1, "sha").alias("edited_sha256"), pick(0, "fp").alias("fp"), pick(1, "fp").alias("edited"))
    both = both.withColumn("following", F.lead("fp").over(W.partitionBy("blk").orderBy("row"))).filter("own")
    return both.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited")).alias("near_edited"), likeness(F.col("fp"), F.col("following")).alias("near_next"))
