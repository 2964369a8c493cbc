"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import batches, offsets
from trackframe.session import checkpoint

#: Slots of the hashed trigrams, trigrams of a text that count as independent at most.
SLOTS, EVIDENCE = 1 << 12, 60
#: Bytes of text that a task looks at at once; each takes some sixty bytes of memory.
CHARS = 1_000_000
#: Weight of the suffix against a host's own rows, of the whole against a suffix's, of the declared one's overall share.
HOST, SUFFIX, DECLARED = 20.0, 50.0, 20.0


def pages_view(pages: DataFrame) -> DataFrame:
    """(id, text, declared, suffix, host) of web pages (page_id, url, html): visible text, the language the
    markup declares, the last part of the host's name and the host."""
    html = F.coalesce("html", F.lit(""))
    seen = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*+>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1)
    return pages.select(F.col("page_id").cast("long").alias("id"), seen.alias("text"), code(declared).alias("declared"), F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"))


def documents_view(docs: DataFrame) -> DataFrame:
    """The same of documents (doc_id, text, lang, source): the declared language and the source as host, no suffix."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), code(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.lower(F.col("source").cast("string")).alias("host"))


def code(c: Column) -> Column:
    """A language code of two or three letters, or null."""
    return F.nullif(F.regexp_extract(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1), F.lit(""))


def slots_of(texts: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of all texts one after another, and how many each text has. A-Z are lowered;
    only trigrams with a letter or a character outside ASCII count."""
    raw = [t.encode() for t in texts.to_pylist()]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw), np.uint8)
    b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    owner = np.repeat(np.arange(len(raw)), size)
    ok = letter[1:-1] & (letter[:-2] | letter[2:]) & (owner[:-2] == owner[2:])
    return (h[ok] >> np.uint32(8)).astype(np.int64) % slots, np.bincount(owner[:-2][ok], minlength=len(raw))


def text_model(rows: DataFrame, slots: int = SLOTS) -> tuple[list[str], np.ndarray]:
    """All declared languages, the most frequent ones first, and log chances of each slot in each of them."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches(it, CHARS):
            at, n = slots_of(b.column(b.schema.get_field_index("text")), slots)
            coded = b.column("declared").dictionary_encode()
            names, owner = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            c = np.bincount(np.repeat(owner, n) * slots + at, minlength=len(names) * slots).reshape(-1, slots)
            for name, mine in zip(names, c, strict=True):
                held[name] = held.get(name, 0) + mine
        for name, c in held.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some].astype(np.int64))], names=["declared", "slot", "n"])

    known = rows.filter("declared is not null")
    langs = [r.declared for r in known.groupBy("declared").count().orderBy(F.desc("count"), "declared").collect()]
    counts = np.full((len(langs), slots), 0.5)
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        # as many rows as languages times slots
        got = known.select("declared", "text").mapInArrow(run, "declared string, slot int, n long").groupBy("declared", "slot").agg(F.sum("n").alias("n")).toArrow()
        at = np.fromiter((place[x] for x in got.column("declared").to_pylist()), np.int64, len(got))
        counts[at, got.column("slot").to_numpy()] += got.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def identify(rows: DataFrame, keep: float = 0.5, contradicted: float = 0.01, slots: int = SLOTS, evidence: int = EVIDENCE) -> DataFrame:
    """The language of every row of (id, text, declared, suffix, host); further columns are passed on, whatever
    their names, but for those that are added.

    Adds text_language (by the text alone), language, confidence (its posterior), declared_confidence
    (that of the declared one, null where none is declared) and kept, and leaves out text. kept: the text
    has letters, the posterior is `keep` at least and the declared language isn't under `contradicted`.
    A text that is null or has no letters keeps its prior and isn't kept. Without any declared language there is
    nothing to learn from: all answers are null and every row is kept. Null suffixes and hosts are values like others. An empty table gives no row.

    The text model counts hashed trigrams per declared language, however many and rare those are. A host's prior is smoothed towards its
    suffix's, and that towards the whole's; both are sums of the text's posteriors over their rows, a
    row's own left out. How far a declared language is to be trusted is counted against the text's answer.
    """
    own = ["id", "declared", "suffix", "host"]
    rest = [c for c in rows.columns if c not in (*own, "text", "text_language", "language", "confidence", "declared_confidence", "kept")]
    back = [F.col(c) for c in own] + [F.col(f"row.c{k}").alias(c) for k, c in enumerate(rest)]
    row = [F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]).alias("row")] if rest else []
    rows = rows.select(*own, *row, F.coalesce("text", F.lit("")).alias("text"))
    langs, logs = text_model(rows, slots)
    n = len(langs)
    others = rows.columns[:-1]
    if not n:
        return rows.select(*back, *[F.lit(None).cast(t).alias(c) for c, t in (("text_language", "string"), ("language", "string"), ("confidence", "double"), ("declared_confidence", "double"))], F.lit(True).alias("kept"))
    sent = rows.sparkSession.sparkContext.broadcast(logs.T.astype(np.float32).copy())
    shape = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches(it, CHARS):
            at, count = slots_of(b.column(b.schema.get_field_index("text")), slots)
            owner = np.repeat(np.arange(len(b)), count)
            sums = np.stack([np.bincount(owner, table[at, k], len(b)) for k in range(n)], 1)
            ll = sums / np.maximum(count, 1)[:, None] * np.minimum(count, evidence)[:, None]
            ll -= ll.max(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in others), pa.array(count.astype(np.int64)), pa.array(list(ll), pa.list_(pa.float64()))], names=[*others, "_n", "_ll"])

    light = rows.select(*others, "text").mapInArrow(run, f"{shape}, _n long, _ll array<double>")
    weight = F.transform("_ll", lambda x: F.exp(x))
    light = checkpoint(light.withColumn("_post", F.transform(weight, lambda x: x / F.aggregate(weight, F.lit(0.0), lambda a, y: a + y))))
    top = lambda c: F.array_position(F.col(c), F.array_max(c)).cast("int") - 1
    names = F.array(*map(F.lit, langs))
    told = light.filter("_n > 0")
    sums = [F.sum(F.get("_post", F.lit(k))) for k in range(n)]
    by_host = checkpoint(told.groupBy("host", "suffix").agg(F.array(*sums).alias("_h"), F.count(F.lit(1)).alias("_hn")))
    pieces = [F.sum(F.get("_h", F.lit(k))) for k in range(n)]
    by_suffix = by_host.groupBy(F.col("suffix").alias("_suffix")).agg(F.array(*pieces).alias("_s"), F.sum("_hn").alias("_sn"))
    whole = by_host.agg(F.array(*pieces).alias("s"), F.sum("_hn").alias("n")).first()
    g = (np.array([x or 0.0 for x in whole.s]) + 1) / ((whole.n or 0) + n)
    prior_s = F.zip_with("_s", F.lit(g.tolist()), lambda x, p: (x + SUFFIX * p) / (F.col("_sn") + SUFFIX))
    hosts = by_host.join(by_suffix.withColumn("_ps", prior_s), F.col("suffix").eqNullSafe(F.col("_suffix"))).select("_suffix", F.col("host").alias("_host"), "_h", "_hn", "_ps")
    # how often each language's texts declare each language: at most (languages) x (codes) numbers
    pairs = {(r.t, r.declared): r["count"] for r in told.filter("declared is not null").groupBy(top("_post").alias("t"), "declared").count().collect()}
    codes = sorted({d for _, d in pairs})
    by_code = np.array([[pairs.get((k, d), 0) for d in codes] for k in range(n)], float).reshape(n, len(codes))
    share = (by_code.sum(0) + 1) / (by_code.sum() + len(codes) + 1)
    trust = np.log((by_code + DECLARED * share) / (by_code.sum(1, keepdims=True) + DECLARED))
    declared = rows.sparkSession.createDataFrame([(d, trust[:, j].tolist()) for j, d in enumerate(codes)], "_code string, _trust array<double>")

    joined = light.join(F.broadcast(declared), F.col("declared") == F.col("_code"), "left")
    joined = joined.join(hosts, F.col("host").eqNullSafe(F.col("_host")) & F.col("suffix").eqNullSafe(F.col("_suffix")), "left")
    mine = F.when(F.col("_n") > 0, 1.0).otherwise(0.0)
    even = F.lit(g.tolist())
    smooth = F.zip_with(F.zip_with("_h", "_post", lambda h, p: F.greatest(h - mine * p, F.lit(0.0))), "_ps", lambda h, p: (h + HOST * p) / (F.greatest(F.col("_hn") - mine, F.lit(0.0)) + HOST))
    prior = F.coalesce(smooth, even)
    total = F.zip_with(F.zip_with("_ll", F.transform(prior, lambda p: F.log(p)), lambda a, b: a + b), F.coalesce("_trust", F.array_repeat(F.lit(0.0), n)), lambda a, b: a + b)
    out = joined.withColumn("_sum", total).withColumn("_w", F.transform("_sum", lambda x: F.exp(x - F.array_max("_sum"))))
    out = out.withColumn("_p", F.transform("_w", lambda x: x / F.aggregate("_w", F.lit(0.0), lambda a, y: a + y)))
    at = F.array_position(names, F.col("declared")).cast("int")
    by_declared = F.when(at > 0, F.get("_p", at - 1))
    out = out.select(*back, F.when(F.col("_n") > 0, F.get(names, top("_post"))).alias("text_language"), F.get(names, top("_p")).alias("language"), F.array_max("_p").alias("confidence"), by_declared.alias("declared_confidence"),
                     ((F.col("_n") > 0) & (F.array_max("_p") >= keep) & (F.coalesce(by_declared, F.lit(1.0)) >= contradicted)).alias("kept"))
    return out
