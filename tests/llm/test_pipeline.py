import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.helpers import ODD, SHAPE, clashing, near_duplicates
from trackframe.llm import language_id, near_dup, packing, pii, quality

SF = "/root/testdata/sf0.001"


def _write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """The small documents with odd rows, repeated rows and ids, null columns and one long text."""
    d = str(tmp_path_factory.mktemp("docs"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("doc_id % 7 = 1")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in ODD] + [(20_000, "the cat and the dog in the sun " * 20_000), (None, "lost")], SHAPE)
    odd = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("odd").alias("source"), F.length("text").cast("long").alias("n_chars"))
    _write(docs.unionByName(some).unionByName(some.withColumn("text", F.concat("text", F.lit(" and more words here")))).unionByName(odd), d, "documents")
    _write(spark.read.parquet(f"{SF}/labels.parquet"), d, "labels")
    return d


def test_the_run_is_its_stages_one_after_another(spark, odd_dir):
    """Each stage against a plain version of its own decision, on what the one before kept."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    labels = spark.read.parquet(f"{odd_dir}/labels.parquet")
    rows = lambda df: sorted((tuple(r) for r in df.select(*cp.COLUMNS).collect()), key=str)
    here = docs.filter("doc_id is not null")
    good = {(r.doc_id, r.kept) for r in quality.classify(here, labels).withColumn("doc_id", F.col("doc_id")).collect()}
    one = cp.good_quality(spark, docs, odd_dir)
    assert {r.doc_id for r in one.select("doc_id").collect()} == {i for i, k in good if k}
    told = language_id.identify(language_id.documents_view(one)).filter("kept").groupBy("id").count()
    two = cp.known_language(spark, one, odd_dir)
    assert {r.id: r["count"] for r in told.collect()} == {r.doc_id: r["count"] for r in two.groupBy("doc_id").count().collect()}
    three = cp.no_near_duplicates(spark, two, odd_dir)
    texts = rows(two)
    groups = near_duplicates([(k, t) for k, (_, t, *_) in enumerate(texts)], 80)
    want, seen = {}, set()
    for k, n, root, _ in groups:
        want.setdefault(root if n else ("own", texts[k][:2]), []).append(texts[k])
    got = rows(three)
    assert len(got) == len(want)
    for members in want.values():
        first = min(m[0] for m in members)
        kept = [g for g in got if g in members and g[0] == first]
        assert kept and not seen & {kept[0]}
    four = cp.no_personal_data(spark, three, odd_dir)
    assert four.count() == len(got) and four.columns == cp.COLUMNS
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    pieces = cp.packed(spark, four, odd_dir).collect()
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, cp.run(spark, odd_dir).collect()))
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in four.collect()}
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        own = ids[p.doc_id]
        assert (p.doc_tokens, p.ids_crc32) == (len(own), zlib.crc32(np.array(own[p.start:p.start + p.length], "<u4").tobytes()))


def test_neighbours_in_the_sequences_are_neighbours_on_the_curve(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = {r.doc_id: r.curve for r in packing.encode_and_place(docs, cp.TOKENIZER).collect()}
    order = [r.doc_id for r in packing.pack(docs, cp.TOKENIZER).filter("start = 0").orderBy("sequence_id", "offset").collect()]
    assert [placed[i] for i in order] == sorted(placed.values())


def test_nothing_to_learn_from_keeps_the_corpus(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    _write(spark.read.parquet(f"{SF}/labels.parquet").limit(0), str(tmp_path), "labels")
    n = docs.count()
    assert cp.good_quality(spark, docs, str(tmp_path)).count() == n == cp.known_language(spark, docs, str(tmp_path)).count()
    assert quality.select_good(docs, spark.createDataFrame([(1, None, 1)], "doc_id long, quality int, toxic int")).count() == n
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_different_texts_of_one_id_keep_their_links(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b c d e f g h"), (1, long), (2, long + " x"), (3, "p q r s t u"), (3, "p q r s t u"), (4, ""), (5, None), (4, "")]
    df = spark.createDataFrame(rows, SHAPE)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == sorted([(1, 4, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True), (4, 0, 4, True), (5, 0, 5, True)])
    kept = sorted(map(tuple, near_dup.select_distinct(clashing(df).withColumn("times", F.lit(1)).withColumn("best", F.lit(1))).select("doc_id", "text").collect()), key=str)
    assert kept == sorted([(1, "a b c d e f g h"), (1, long), (3, "p q r s t u"), (4, ""), (5, None)], key=str)


def test_columns_of_any_name_pass_through_language_and_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["_n", "_ll", "_post", "_suffix", "_host", "_h", "_code", "_trust", "_p", "_w", "_sum", "row", "c0", "a b"]
    wide = language_id.documents_view(docs).withColumns({n: F.lit(n) for n in names}).withColumn("language", F.lit("x"))
    got, plain = language_id.identify(wide), language_id.identify(language_id.documents_view(docs))
    assert set(got.columns) == set(plain.columns) | set(names)
    assert sorted(map(tuple, got.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert got.filter(" and ".join(f"`{n}` = '{n}'" for n in names)).count() == docs.count()
    more = docs.withColumns({n: F.lit(n) for n in (*names, "expected_grade", "tail_2")})
    some = quality.select_good(more, spark.read.parquet(f"{SF}/labels.parquet"))
    assert some.columns == more.columns and 0 < some.count() == some.filter("tail_2 = 'tail_2' and row = 'row'").count()


def test_long_texts_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "le chat et le chien sont dans la maison " * 30_000, "fr"), (2, "the cat and the dog are in the house " * 30_000, "en"), (2, "the cat and the dog are in the house " * 30_000, "en"), (3, None, "en")], "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    got = {r.id: (r.language, r.kept) for r in language_id.identify(language_id.documents_view(docs)).collect()}
    assert got[1] == ("fr", True) and got[2] == ("en", True) and got[3][1] is False
    assert pii.redact(docs.drop("lang", "source")).count() == 4
