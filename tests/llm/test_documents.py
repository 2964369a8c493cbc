import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SHAPE, clashing, lower_words, near_duplicates
from trackframe.llm import fingerprint, language_id, license, lm_score, near_dup, pii, quality
from trackframe.llm.groups import components
from trackframe.llm.topk import top_products

SF = "/root/testdata/sf0.001"


# top products

def test_top_products_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.exponential(3)]) for i in range(600)]
    rows += [(700 + i, [1.0] * 6) for i in range(40)] + [(800, None), (900, [float("nan")] * 6), (1000, [0.0] * 6), (1100, [None] * 6), (1300, [1.0, 2.0]), (1400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit("x"))
    v = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in df.collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = []
    for i, q in v:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, w, strict=False)), j) for j, w in v if j != i)[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = top_products(df, F.col("vec_id") % 100 == 0, block=64, queries=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_products(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# fingerprints

def test_fingerprints(spark):
    rows = [(5, None), (3, ""), (9, "a b c\nd e f g h i j k"), (1, "é" * 3), (7, "x"), (2, "d e f g h i j k\na b c")]
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(clashing(spark.createDataFrame(rows, SHAPE))).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest())
    assert got[2].fingerprint == got[9].fingerprint != got[7].fingerprint and got[5].fingerprint == got[3].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_fingerprints_add_and_take_away(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "y"), ("c", "x"), ("c", "y")], "k string, piece string")
    fp = fingerprint.summed(df, ["k"]).select("k", fingerprint.state().alias("fp"))
    get = lambda k: fp.filter(F.col("k") == k).select(F.col("fp").alias(k))
    one = get("a").join(get("b")).join(get("c"))
    assert one.select(fingerprint.combine(F.col("a"), F.col("b"), -1) == F.col("c"), fingerprint.combine(F.col("c"), F.col("b")) == F.col("a")).first() == (True, True)


def test_fingerprints_odd_tables(spark):
    df = spark.createDataFrame(ODD, SHAPE)
    assert fingerprint.fingerprint_documents(df).count() == len(ODD)
    assert fingerprint.fingerprint_documents(df.limit(0)).count() == 0
    alone = fingerprint.fingerprint_documents(df.filter("doc_id = 8")).first()
    assert alone.near_next == 1.0


# near duplicates

def _edited(n, words, edits, seed=3):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(words)]
    rows = []
    for i in range(n):
        w = base[:]
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = "z" + str(rng.randrange(10**6))
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [_edited(300, 130, 8), _edited(60, 30, 3, 4) + [(1000 + i, t) for i, (_, t) in enumerate(ODD[:4] + ODD[5:])]], ids=["edits", "short and odd"])
def test_near_duplicates_against_all_pairs(spark, rows):
    got = near_dup.near_duplicates(clashing(spark.createDataFrame(rows, SHAPE)), block=64)
    assert sorted(map(tuple, got.collect())) == near_duplicates(rows)


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, near_dup.near_duplicates(docs).collect())) == near_duplicates([(r.doc_id, r.text) for r in docs.collect()])
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_rows_are_one_component(spark):
    got = near_dup.near_duplicates(spark.createDataFrame(ODD, SHAPE)).filter("doc_id = 4").collect()
    assert [tuple(r) for r in got] == [(4, 1, 4, True)] * 2


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_least_shared_is_a_bound():
    t = near_dup.least_shared(64, 0.85)
    p = lambda n: sum(math.comb(64, i) * 0.85**i * 0.15 ** (64 - i) for i in range(n))
    assert p(t) <= near_dup.MISS < p(t + 1)


# language-model scores

def _base(rows):
    toks = [(i, lower_words(t) + ["\n"]) for i, t in rows]
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(x for i, w in toks if not out(i) for x in w)
    n, v = sum(c.values()), len(c)
    return sorted((i, out(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in toks)


@pytest.mark.parametrize("common", [500_000, 50])
def test_base_scores(spark, common):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = lm_score.score_documents(docs, common=common, trainers=2).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == _base([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.score < 0 for r in got)


def test_counted_words_keep_their_share_sent_or_joined(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sent, joined, some = ({r.doc_id: r for r in lm_score.score_documents(docs, common=n, trainers=2).collect()} for n in (200_000, 0, 500))
    assert len(sent) == docs.count()
    for i, r in sent.items():
        for other in (joined[i], some[i]):
            assert abs(r.score - other.score) < 1e-5 * abs(r.score) and r.n_known == other.n_known


def test_words_are_scored_alone():
    rng = np.random.default_rng(0)
    n = int(lm_score._START[-1])
    every = rng.integers(0, 9, n).astype(np.float32)
    scorer = lm_score.Scorer(lm_score.Model(np.floor(every * rng.random(n)).astype(np.float32), every, lm_score.new_weights(), lm_score.new_odds()))
    words = ["the", "then", "zq", "é#1", "\n"]
    s = scorer.words(words, np.arange(5) % 3)
    assert (s < 0).all() and np.allclose(s, np.concatenate([scorer.words([w], np.array([k % 3])) for k, w in enumerate(words)]))


def test_pairs_share_codings_and_score_as_alone():
    rng = np.random.default_rng(1)
    n = int(lm_score._START[-1])
    every = rng.integers(0, 9, n).astype(np.float32)
    scorer = lm_score.Scorer(lm_score.Model(np.floor(every * rng.random(n)).astype(np.float32), every, lm_score.new_weights(), lm_score.new_odds()))
    names = [*(f"w{i:03d}tails" for i in range(400)), "of", "é#", lm_score.END_WORD, ""]
    before, now = np.append(np.arange(400), [400, 403, 401, 403]), np.append(np.full(400, 400), [401, 402, 400, 401])
    e = lm_score.events(names, before[:400], now[:400])
    assert len(e.at) == 1200 and len(e.symbol) == 3
    got = scorer.pairs(names, before, now)
    assert len(set(got[:400].tolist())) > 300
    for i in (0, 7, 399, *range(400, 404)):
        assert np.isclose(got[i], scorer.pairs(names, before[i:i + 1], now[i:i + 1])[0])


def test_held_out_texts_cost_less_than_with_an_untrained_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'")
    got = lm_score.score_documents(docs, trainers=2).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    assert got[0] > 1.1 * got[1] and got[2] < 3


def test_words_are_scored_after_the_word_before_and_better_than_the_base_in_every_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = docs.select("doc_id", "lang")
    got = lm_score.score_documents(docs, trainers=2).filter("held_out").join(langs, "doc_id").groupBy("lang").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert got and all(r.s > r.b for r in got)


def test_scores_of_odd_tables(spark):
    df = spark.createDataFrame(ODD, SHAPE)
    got = lm_score.score_documents(df, trainers=2).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.n_tokens for r in got}[1] == 1
    assert lm_score.score_documents(df.limit(0), trainers=2).count() == 0


# personal data

_PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _holds(k, m):
    d = re.sub("[^0-9]", "", m)
    if k == 2:
        twice = lambda x: x * 2 - 9 if x > 4 else x * 2
        return 14 <= len(d) <= 19 and sum(twice(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return [True, k == 1 and all(int(x) <= 255 for x in m.split(".")), None, 10 <= len(d) <= 15][k]


def _spans(t):
    found = sorted((m.start(), k, m.end()) for k, p in enumerate(_PLAIN) for m in re.finditer(p, t or "") if _holds(k, m.group()))
    return [sum(x[1] == k for x in found) for k in range(4)], ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_formats_against_plain_matching(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + i, "".join(rng.choice("a1.@+- (9)%_é\n0x2") for _ in range(rng.randrange(120)))) for i in range(800)]
    rows += [(5002, "1" * 60000 + " " + "a" * 60000 + "@b.c@d.e .@x.y"), (5003, "4111 1111-1111 1111 4111111111111111. a@b.c@d.e.f 1.2.3.4.5.6 0001.2.3.4 +1 (234) 567-8901")]
    want = {i: _spans(t) for i, t in rows}
    for r in pii.find(clashing(spark.createDataFrame(rows, SHAPE))).collect():
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (want[r.doc_id][0], hashlib.sha256(want[r.doc_id][1].encode()).hexdigest())
        assert r.found or r.spans == want[r.doc_id][1]


def test_patterns_discover_what_no_format_has(spark):
    rows = [(i, f"Write to contact mail u{i}@x.org about item {i}") for i in range(30)] + [(100, "see contact mail u(7)@q now, room 5 of 12"), (101, None)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert got[100] == "email:17:23" and got[101] == ""
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert clean[100].text == "see contact mail <EMAIL> now, room 5 of 12" and clean[100].n_chars == len(clean[100].text)
    assert clean[3].text == "Write to contact mail <EMAIL> about item 3" and clean[101].text is None
    assert pii.find(df.limit(0)).count() == 0 == pii.redact(df.limit(0)).count()


def test_identifiers_with_blanks_are_discovered(spark):
    rows = [(i, f"please ring office tel: +4930{1000000 + i} or item {i}") for i in range(40)]
    rows += [(100, "office tel: 0171 2345678 today"), (101, "office tel: 0171\t234 56 78, 10.0.0.1 5"), (102, "on 3 a@b.cd office tel: 01712345678"), (103, "office tel:\n0171 234\n5678"), (104, "office tel: 0171 234567 " + "12345678 " * 40)]
    df = spark.createDataFrame(rows, SHAPE)
    got = {r.doc_id: r.spans.split(",") for r in pii.find(df).collect()}
    assert got[100] == ["phone:12:24"]
    assert "phone:12:27" in got[101] and any(x.startswith("ip:") for x in got[101])
    assert "phone:24:35" in got[102]
    assert "phone:12:23" not in got[103] and got[103] == ["phone:12:20"]
    assert "phone:12:32" in got[104]
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[100] == "office tel: <PHONE> today" and clean[102] == "on 3 <EMAIL> office tel: <PHONE>"
    # a word after a candidate has that one among its words before
    late = spark.createDataFrame([(i, f"section 7 {'+4930' + str(1000000 + i)}") for i in range(40)] + [(50, "section 7 0302345678")], SHAPE)
    assert {r.doc_id: r.spans for r in pii.find(late).collect()}[50] == "phone:10:20"


# quality

def test_grades(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        text = [word() for _ in range(40)]
        text = [t.upper() + "!!" for t in text] if kind == 0 else text + ["nasty"] * (kind == 1)
        rows.append((i, " ".join(text)))
        if i < 300:
            labels.append((i, int(kind > 0), int(kind == 1)))
    labels += [(None, 1, 0), (5, None, 1), (7, 0, None)]
    docs, lab = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(clashing(docs), lab).collect()}
    right = [got[i].kept == (i % 4 > 1) for i in range(300, 400)]
    assert sum(right) >= 80
    assert all(0 <= r.tail_2 <= r.tail_1 <= 1 and abs(r.expected_grade - r.tail_1 - r.tail_2) < 1e-6 for r in got.values())
    kept = quality.select_good(docs.withColumn("more", F.lit(1)), lab)
    assert kept.columns == ["doc_id", "text", "more"] and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_grades_of_odd_tables(spark):
    df, lab = spark.createDataFrame(ODD, SHAPE), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(df, lab).count() == len(ODD) == quality.classify(df, lab.limit(0)).count()
    assert quality.classify(df.limit(0), lab).count() == 0


# language

def test_languages(spark):
    docs = language_id.documents_view(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = language_id.identify(docs).collect()
    assert sum(r.language == r.declared for r in got) >= 0.98 * len(got) and sum(r.kept for r in got) >= 0.98 * len(got)


def test_evidence_beside_the_text(spark):
    docs = language_id.documents_view(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("id", "text", "declared", "suffix", "host")
    odd = spark.createDataFrame([(-1, None, "fr", None, "src1"), (-2, "", None, None, None), (-3, "12 34", "zz", "de", "q"), (-4, "und der die das", "en", None, "src2")], "id long, text string, declared string, suffix string, host string")
    got = {r.id: r for r in language_id.identify(docs.union(odd)).filter("id < 0").collect()}
    assert got[-1].language == "fr" and not got[-1].kept and got[-1].text_language is None
    assert got[-2].language == "en" and not got[-2].kept
    assert got[-4].text_language == "de"
    assert language_id.identify(docs.limit(0)).count() == 0


def test_many_and_three_letter_languages(spark):
    rng = random.Random(4)
    codes = [a + b for a in "abcdefghij" for b in "klmnopq"] + ["ceb", "yue", "fil"]
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for c in codes}
    rows = [(100 * k + i, " ".join(rng.choice(words[c]) for _ in range(40)), c + "-XX" * (i == 0), None) for k, c in enumerate(codes) for i in range(3)]
    docs = language_id.documents_view(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = language_id.identify(docs).collect()
    assert len(got) == 3 * len(codes) and all(r.declared == codes[r.id // 100] for r in got)
    assert all(r.language == r.text_language == r.declared and r.declared_confidence > 0.5 and r.kept for r in got)
    page = spark.createDataFrame([(1, "http://a.ph", "<html lang='ceb-PH'>x")], "page_id long, url string, html string")
    assert language_id.pages_view(page).first().declared == "ceb"


def test_page_view(spark):
    rows = [(1, "http://a.b.example.de:80/x", '<HTML class="q" lang = "de-AT"><script>var x;</script><p>Hallo <b>Welt</b><!-- no --></p>'), (2, None, None)]
    got = language_id.pages_view(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("id").collect()
    assert (got[0].declared, got[0].suffix, got[0].host, got[0].text.split()) == ("de", "de", "a.b.example.de", ["Hallo", "Welt"])
    assert tuple(got[1]) == (2, "", None, None, None)


# licences

def test_licences(spark):
    scan = license.Scanner(license.TEMPLATES, license.DICE)
    rows = ODD + [(20, "hello\nReleased under the MIT License.\nbye"), (21, "Licensed under the apache license, version 2.0"), (22, "This work\nis licensed under the GNU General Public\nLicense, version 3."), (23, "licensed words under a tree")]
    got = {r.doc_id: r for r in license.scan_documents(clashing(spark.createDataFrame(rows, SHAPE))).collect()}
    assert (got[20].licence, got[20].notices[0].begin, got[20].notices[0].end) == ("MIT", 6, 37)
    assert got[21].licence == "Apache-2.0" and got[22].licence == "GPL-3.0" and got[23].n_notices == 0 and got[1].n_notices == 0
    for text in (t or "" for _, t in rows):  # pruning changes nothing
        plain = [(a, b) for a, b in scan.blocks(text) if max(license.dice(license.bigrams(license.normal(text[a:b])), g) for _, _, g, _ in scan.templates) >= license.DICE]
        assert [(a, b) for a, b, _, _ in scan.scan(text)] == plain
    assert license.scan_documents(spark.createDataFrame(ODD, SHAPE).limit(0)).count() == 0


def test_licences_inside_other_words():
    scan = license.Scanner(license.TEMPLATES, license.DICE).scan
    text = "Copyright 2020 Foo Project. Released under the MIT License. All rights reserved."
    (a, b, name, d), = scan(text)
    assert (text[a:b], name, d) == ("Released under the MIT License", "MIT", 1.0)
    gpl = license.TEMPLATES["GPL-3.0"][1].split()
    head = "/*\n * foo.c\n *\n" + "".join(f" * {' '.join(gpl[k:k + 9])}\n" for k in range(0, len(gpl), 9)) + " *\n * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY.\n */"
    for text in (head, head.replace("\n *\n", "\n * and\n"), "İ " * 3 + head.replace("\n", " "), "words before " * 900 + head.replace("\n", " ") + " words after" * 900):
        assert [x[2] for x in scan(text)] == ["GPL-3.0"]
    assert [x[2] for x in scan("one Licensed under CC BY-\nNC 4.0. two\nthree")] == ["CC-BY-NC-4.0"]
    both = scan("A: Released under the MIT License. B: Licensed under the Apache License, Version 2.0. C: under the licence of a tree")
    assert [x[2] for x in both] == ["MIT", "Apache-2.0"]
    # against all windows, on words of the templates in any order
    rng = random.Random(5)
    s = license.Scanner(license.TEMPLATES, license.DICE)
    words = "released licensed under the mit license apache version 2.0 bsd 3 clause cc by 4.0 nc".split()
    for _ in range(300):
        text = [rng.choice(words) for _ in range(rng.randrange(2, 16))]
        most = max(license.dice(license.bigrams(text[i:j]), g) for i in range(len(text)) for j in range(i + 2, len(text) + 1) for _, _, g, _ in s.templates)
        got = [d for *_, d in s.scan(" ".join(text))]
        # a whole line that is enough alike stands for the runs of words in it
        assert bool(got) == (most >= license.DICE) and all(license.DICE <= d <= most for d in got)
