import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SHAPE, clashing
from trackframe.llm import fill_middle, resample, toxicity
from trackframe.llm.buffers import flat

SF = "/root/testdata/sf0.001"
LOWER = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# resampling

def _resampled(rows, target, least=1, most=1, buckets=10_000, words=20, percent=10, seed=2024):
    def feats(t):
        w = WORD.findall(LOWER(t))
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(least, most + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(x for _, r in rows for x in feats(r)[1]), Counter(x for r in target for x in feats(r)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, r in rows:
        n, f = feats(r)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= words), key=lambda x: (-x[4], x[0]))
    drawn = order[:percent * len(order) // 100]
    ranks = {}
    for k, x in enumerate(drawn):
        ranks.setdefault(x, []).append(k + 1)
    return sorted(((x[0], *x[2:], ranks[x].pop() if ranks.get(x) else None) for x in out), key=str)


@pytest.mark.parametrize("how", [{}, {"least": 1, "most": 3, "buckets": 97, "words": 3, "percent": 50, "seed": 7}])
def test_resampling_against_a_plain_sort(spark, how):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD + [(9, "É x Ü 9a-B_c" * 30)] * 300
    df = clashing(spark.createDataFrame(rows, SHAPE).repartition(6)).withColumns({c: F.lit("?") for c in ("run", "pos", "segment", "rank", "score", "down")})
    got = resample.resample(df, target, parts=5, **how)
    assert sorted(map(tuple, got.collect()), key=str) == _resampled(rows, [r.text for r in target.collect()], **how)


def test_resampling_of_odd_tables(spark):
    df, none = spark.createDataFrame(ODD, SHAPE), spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(df.limit(0), none).count() == 0
    got = resample.resample(df, none).collect()
    assert len(got) == len(ODD) and [r.rank for r in got if r.doc_id == 1] == [None]


def test_segments_of_the_sort_are_even_though_most_rows_are_equal(spark):
    df = spark.range(20_000, numPartitions=9).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 700).alias("a"), F.lit(1).cast("long").alias("b"))
    got = resample.sort_ranks(df, ["a", "b"], 8)
    rows = got.withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 20_001))
    assert [r.a for r in sorted(rows, key=lambda r: r["rank"])] == sorted(r.a for r in rows)
    assert max(Counter(r.p for r in rows).values()) <= 3 * 20_000 / 8


# fill in the middle

def _filled(i, text, seed=1):
    t = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    x = hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(u), "plain", None, None, t, t
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", t


def test_middles_against_plain_slicing(spark):
    rng = random.Random(3)
    rows = ODD + [(100 + i, "".join(rng.choice(["a", "Bc", " ", "é", "日", "\n", "<", "P>", "<S", ">", "😀", "\x00", "<M>" if i % 9 == 0 else "<"]) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(3000, "ab, é" * 60_000), (3001, "<"), (3002, "<P"), (3003, ">")]
    docs = clashing(spark.createDataFrame(rows, SHAPE))
    made = fill_middle.restore(fill_middle.transform(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    assert sorted(map(tuple, made.collect()), key=str) == sorted((_filled(*r) for r in rows), key=str)
    assert fill_middle.transform(docs.limit(0)).count() == 0 == fill_middle.restore(fill_middle.transform(docs.limit(0))).count()


def test_shifts_carry_over_blocks(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 7)
    texts = ["one two three", "", "é<S", ">x y", "四 五 六 seven"] * 5
    raw, cut = flat(pa.array(texts))
    h = np.array([[3 * k + 1, 7 * k + 2, k % 2 * 99, 10 * k] for k in range(len(texts))])
    marks = [b"<P>", b"<S>", b"<M>"]
    _, form, part = fill_middle.split(raw, cut, h, marks, 90, 20)
    back, again = fill_middle.gather(*fill_middle.scatter(raw, cut, form, part, marks), form, marks)
    assert (back.tobytes(), again.tolist()) == (raw.tobytes(), cut.tolist()) and set(form) == {0, 1, 2}


def test_restoring_keeps_columns_and_other_marks(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, "z"), (2, None, None, "z"), (3, "x" * 50 + " y", 2, "z")], "doc_id long, text string, c0 int, c1 string")
    made = fill_middle.transform(df, marks=("[pre]", "[suf]", "[mid]"), changed=100).join(df, "doc_id")
    for r in fill_middle.restore(made.withColumn("restored", F.lit(0)), ("[pre]", "[suf]", "[mid]")).collect():
        assert r.restored == (r.text or "") and r.c1 == "z"
    for bad in (("<P>", "<P>x", "y"), ("<<", "a", "b"), ("", "a", "b"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            fill_middle.check_marks(bad)


# toxicity

def _segments(x, base=0):
    """The best segment (the shortest and leftmost of the best), then those left and right of it."""
    best = max(((sum(x[i:j]), i - j, -i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return _segments(x[:i], base) + [(base + i, base + j, best[0])] + _segments(x[j:], base + j)


def test_segments_against_their_definition():
    rng = random.Random(4)
    for _ in range(400):
        x = [rng.choice([-7.5, -3.25, -1.5, 2.125, 3.0625, 4.03125]) * rng.choice([1, 1.0009765625, 0.9990234375]) for _ in range(rng.randrange(24))]
        got = toxicity.segments(np.array(x))
        want = _segments(x)
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
        assert [g[:2] for g in got] == [w[:2] for w in want]


M64 = (1 << 64) - 1


def _slot(word, bits):
    x = 0
    for k, c in enumerate(word):
        x += (c + 1) * pow(toxicity.STEP, k, 1 << 64)
    x &= M64
    x = ((x ^ (x >> 31)) * toxicity.MIX_A) & M64
    x = ((x ^ (x >> 29)) * toxicity.MIX_B) & M64
    return x >> (64 - bits)


def _fold(text):
    return re.sub("[À-ÖØ-Þ]", lambda m: chr(ord(m.group()) + 32), LOWER(text))


def test_token_slots_of_long_and_odd_texts():
    texts = ["", "Éa ÀB-×x", "word", "word9", "a" * 3000, " ", "ÿ日本", "x y", "tail", "WORD"]
    raw, cut = flat(pa.array(texts))
    begin, end, word, head, ends = toxicity.token_slots(raw, cut)
    want = [(k, w.encode()) for k, t in enumerate(texts) for w in re.findall("[0-9a-z\x80-\U0010ffff]+", _fold(t))]
    assert np.diff(ends).tolist() == [sum(k == i for i, _ in want) for k in range(len(texts))]
    assert word.tolist() == [_slot(w, toxicity.WORD_BITS) for _, w in want] and head.tolist() == [_slot(w[:toxicity.HEAD], toxicity.HEAD_BITS) for _, w in want]
    assert all(_fold(raw[a:b].tobytes().decode()).encode() == w for a, b, (_, w) in zip(begin, end, want, strict=True))


def _plain_scores(rows, labels, model):
    """Scores from dictionaries of counts, one text at a time; law and curve are the model's."""
    kinds = {i: y for i, y in labels}
    seen = lambda t: [(_slot(w, toxicity.WORD_BITS), _slot(w[:toxicity.HEAD], toxicity.HEAD_BITS)) for w in (x.encode() for x in re.findall("[0-9a-z\x80-\U0010ffff]+", _fold(t)))]
    word, head, n = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for i, t in rows:
        if i in kinds and zlib.crc32(str(i).encode()) % 3 != 1:
            y = kinds[i]
            n[y] += 1
            word[y].update({a for a, _ in seen(t)})
            head[y].update({b for _, b in seen(t)})
    share = (n[1] + 0.5) / (sum(n) + 1)
    out = {}
    for i, t in rows:
        s = []
        for a, b in seen(t):
            base = (head[1][b] + 20 * share) / (head[0][b] + head[1][b] + 20)
            of = (word[1][a] + 4 * base) / (word[0][a] + word[1][a] + 4)
            s.append(math.log(of / (1 - of)) - math.log(share / (1 - share)) - toxicity.DRIFT)
        x = 0.0
        for _, _, v in toxicity.segments(np.array(s)):
            e = len(s) * model.law.rate * math.exp(-min(model.law.slope * v, 600))
            x -= math.log(e) if e < 1e-8 else math.log(-math.expm1(-e))
        out[i] = 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * math.log1p(x))))
    return n, out


def test_toxicity_against_a_plain_version_and_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = [(r.doc_id, r.toxic) for r in labels.filter("toxic is not null").collect()]
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    n, want = _plain_scores([(r.doc_id, r.text) for r in docs.collect()], known, model)
    got = {r.doc_id: r for r in toxicity.classify(clashing(docs), labels.withColumn("text", F.lit("x"))).collect()}
    assert n == model.odds.texts.tolist() and len(got) == docs.count()
    assert max(abs(r.score - want[i]) for i, r in got.items()) < 1e-4
    held = [(got[i].score, y, got[i].predicted) for i, y in known if got[i].held_out]
    good = sum(a > b for a, y, _ in held if y for b, z, _ in held if not z) / (sum(y for _, y, _ in held) * sum(1 - y for _, y, _ in held))
    assert good > 0.85 and sum(p and not y for _, y, p in held) == 0 and sum(p and y for _, y, p in held) > 0.6 * sum(y for _, y, _ in held)


def test_every_toxic_passage_is_told_where_it_stands(spark):
    rng = random.Random(6)
    clean = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(n))
    rows = [(i, clean(80), 0) for i in range(120)] + [(200 + i, f"{clean(30)} vile rotten brute {clean(50)}", 1) for i in range(60)]
    rows += [(1000, f"é {clean(300)} vile rotten brute {clean(400)} Vile Rotten! brute {clean(20)}", None), (1001, None, None), (1002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    text = rows[-3][1]
    assert [text[p.start:p.stop].lower() for p in got[1000].passages] == ["vile rotten brute", "vile rotten! brute"] and got[1000].predicted == 1
    assert got[1001].score == got[1002].score < 0.1 and got[1001].passages == []


def test_toxicity_of_odd_tables(spark):
    df = spark.createDataFrame(ODD, SHAPE)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(6, 1), (5, 0), (None, 1), (8, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.classify(df, one).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.classify(df.limit(0), one).count() == 0
