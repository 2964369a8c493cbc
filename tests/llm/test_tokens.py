import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken

from tests.llm.helpers import ODD, SHAPE, clashing
from trackframe.llm.byte_bpe import codec, encode_documents
from trackframe.llm.packing import hilbert, pack, word_coder

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def test_long_texts_are_cut_where_the_ids_stay_the_same():
    short, whole = codec(RANKS, P.PATTERN, 40), codec(RANKS, P.PATTERN, 10**9)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "I'm", " ", "  ", "\n", "12", "é", "日", "!?", "'s", "\t", "_"]) for _ in range(rng.randrange(400)))
        assert short.encode(text) == whole.one.encode_ordinary(text)
    run = "z" * 500 + "9" * 300
    assert short.encode(run) == whole.one.encode_ordinary(run)


def test_bytes_come_back(spark):
    rows = encode_documents(clashing(spark.createDataFrame(ODD, SHAPE)), RANKS, P.PATTERN).collect()
    one = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=codec(RANKS, P.PATTERN).one._mergeable_ranks, special_tokens={})
    assert len(rows) == len(ODD) and all(r.exact for r in rows)
    texts = sorted((i, t or "") for i, t in ODD)
    for r, (i, t) in zip(sorted(rows, key=lambda r: (r.doc_id, r.n_tokens)), texts, strict=True):
        assert r.doc_id == i and r.ids == one.encode_ordinary(t)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_word_ids_are_those_of_the_tokenizer(spark):
    use = word_coder(WORDS)
    assert use.merge is not None
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = docs + [t or "" for _, t in ODD] + ["It's ''s don't x!'s", "İ ǅ ẞ", "<|endoftext|>", "á à", "a b c"]
    for text, ids in zip(texts, use.encode(pa.array(texts))[0], strict=True):
        assert ids.tolist() == [*use.tok.encode(text, add_special_tokens=False).ids, 1]


def test_curve_goes_from_cell_to_neighbour():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(hilbert(cells, 3))]
    assert len(set(hilbert(cells, 3))) == 512 and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_pieces_fill_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(pack(clashing(docs), WORDS).collect(), key=lambda r: (r.sequence_id, r.offset))
    use = word_coder(WORDS)
    ids = dict(zip([r.doc_id for r in docs.collect()], use.encode(pa.array([r.text for r in docs.collect()]))[0], strict=True))
    at = 0
    for r in rows:  # gapless, every sequence but the last full
        assert (r.sequence_id, r.offset) == divmod(at, 2048)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id].astype("<u4")[r.start:r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        at += r.length
    assert at == sum(map(len, ids.values()))
    for doc in ids:
        own = sorted((r.start, r.length) for r in rows if r.doc_id == doc)
        assert [s for s, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])])[:-1].tolist() and sum(n for _, n in own) == len(ids[doc])


def test_pack_odd_and_empty_tables(spark):
    df = spark.createDataFrame(ODD, SHAPE)
    rows = pack(df, WORDS).collect()
    assert sum(r.start == 0 for r in rows) == len(ODD)
    assert pack(df.limit(0), WORDS).count() == 0
