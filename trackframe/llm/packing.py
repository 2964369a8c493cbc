"""Packing token sequences along a space-filling curve over hashed document vectors."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import Ids, batches, hash_names, keyed, offsets, range_of, released, small_batches, tokens
from trackframe.session import checkpoint

#: Tokens of a sequence, the id that ends a document, dimensions and bits of the curve.
LENGTH, END, DIMS, BITS = 2048, 1, 3, 10
#: Strings that a worker remembers inside a task, bytes of text it handles at once.
REMEMBERED, BATCH = 100_000, 1_500_000


class Merges(NamedTuple):
    """A tokenizer's merges as the tiktoken library takes them, in flat arrays; `size` is empty where they don't fit."""

    raw: bytes
    size: np.ndarray
    ids: np.ndarray


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """The merges of the file, checked against the tokenizer itself. Run once, where the job is planned.

    A word ends in a byte that UTF-8 never has, and joining it to the last character comes before
    every merge. That gives the tokenizer's own ids if each merged token, met alone, comes out whole
    (then the last join of its parts is always its own merge); this is asked of the tokenizer here,
    and the arrays are empty where it doesn't hold.
    """
    from tokenizers.models import BPE

    tok = tokenizer_of(path)
    kind = np.dtype("<u2") if tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, last = model["vocab"], model["end_of_word_suffix"]
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    raw = lambda t: bytes(byte[c] for c in t.removesuffix(last)) + (b"\xff" if t.endswith(last) else b"")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merged = ["".join(m) for m in pairs]
    single = [t for t in vocab if len(t.removesuffix(last)) == 1]
    order = [t for t in single if t.endswith(last)] + merged + [t for t in single if not t.endswith(last)]
    inside = BPE(vocab=vocab, merges=pairs)  # as for the front of a word
    alone = lambda t: tok.model.tokenize(t.removesuffix(last)) if t.endswith(last) else inside.tokenize(t)
    if len(single) != 512 or len(set(order)) != len(order) or any([x.id for x in alone(t)] != [vocab[t]] for t in merged):
        return Merges(b"", np.zeros(0, np.uint8), np.zeros(0, kind))
    spelt = [raw(t) for t in order]
    del inside, pairs, merged
    released()
    return Merges(b"".join(spelt), np.fromiter(map(len, spelt), np.uint8, len(spelt)), np.array([vocab[t] for t in order], kind))


def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


class WordCoder:
    """Ids of texts under a tokenizer that never joins characters across white space.

    A worker gets the merges as flat arrays; the tokenizer's file is only read once a text needs it.
    """

    #: Text of these characters only is cut and lowered here; any other goes through the tokenizer whole.
    PLAIN = re.compile(r"[^\t\n\r -~¡-ɏ]")

    #: The pieces of lowered plain text: contractions, runs of letters, single digits, runs of the rest.
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")

    def __init__(self, path: str, table: Merges, end: int = END, dims: int = DIMS):
        self.path, self.end, self.dims, self.ids, self._tok = path, end, dims, table.ids, None
        self.kind = table.ids.dtype
        self.close = np.array([end], self.kind)
        self.seen = Ids(self.facts, REMEMBERED)
        self.merge = None
        if len(table.size):
            import tiktoken

            cut = offsets(table.size).tolist()
            ranks = {table.raw[a:b]: k for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))}
            self.merge = tiktoken.Encoding("merges", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @property
    def tok(self):
        if self._tok is None:
            self._tok = tokenizer_of(self.path)
        return self._tok

    def facts(self, new: list[str]) -> tuple[np.ndarray, ...]:
        """For each string: number of ids, its signs in the hashed vector; and all ids in one row."""
        if self.merge:
            ranks = [[k for p in self.PIECE.findall(w.lower()) for k in self.merge(p.encode() + b"\xff")] for w in new]
        else:
            ranks = [e.ids for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]
        size = np.fromiter(map(len, ranks), np.int64, len(ranks))
        pool = np.fromiter(chain.from_iterable(ranks), np.int64, int(size.sum()))
        h = hash_names(new)
        sign = np.stack([((h >> np.uint64(k)) & np.uint64(1)).astype(np.int8) * 2 - 1 for k in range(self.dims)], 1)
        return size, sign.astype(np.int8), self.ids[pool] if self.merge else pool.astype(self.kind)

    def plain(self, text: str) -> bool:
        return self.PLAIN.search(text) is None and (text.isascii() or unicodedata.is_normalized("NFC", text))

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text with the end id, and its hashed vector."""
        odd = {k: t for k, t in enumerate(texts.to_pylist()) if not self.plain(t)}
        if odd:
            mask = np.zeros(len(texts), bool)
            mask[list(odd)] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        names, word, cut = tokens(texts, lower=False)
        at, (size, sign, pool) = self.seen.look(names)
        at = at[word]
        start, n = offsets(size), size[at]
        ends = offsets(n)
        flat = pool[np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])]
        sums = np.zeros((len(at) + 1, self.dims))
        np.cumsum(sign[at], axis=0, out=sums[1:])
        vec = sums[cut[1:]] - sums[cut[:-1]]
        out = [np.append(flat[ends[a]:ends[b]], self.close) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for k, t in odd.items():
            own = np.array(self.tok.encode(t, add_special_tokens=False).ids, self.kind)
            vec[k] = [np.sum(1.0 - 2 * ((own.astype(np.int64) * 2654435761 >> 13 + d) & 1)) for d in range(self.dims)]
            out[k] = np.append(own, self.close)
        size = np.fromiter(map(len, out), np.float64, len(out))
        return out, vec / np.sqrt(size)[:, None]


_CODERS: dict[tuple, WordCoder] = {}


def word_coder(path: str, table: Merges | None = None, end: int = END, dims: int = DIMS) -> WordCoder:
    """The coder of this process; a worker keeps one between tasks."""
    key = (path, end, dims)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = WordCoder(path, merges(path) if table is None else table, end, dims)
    return _CODERS[key]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of `cells`, whole numbers under 2**bits in a few dimensions."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for k in range(d):
            on = (x[k] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            if k:
                x[k] ^= swap
    for k in range(1, d):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(d):
            key = (key << 1) | ((x[k] >> level) & 1)
    return key


def encode_and_place(docs: DataFrame, tokenizer: str, end: int = END, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """(doc_id, curve, n, ids): the ids as little-endian bytes, and the document's place on the curve.

    The place has the Hilbert key above and a hash of the id below, so equal documents still spread.
    """

    table = docs.sparkSession.sparkContext.broadcast(tuple(merges(tokenizer)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = word_coder(tokenizer, Merges(*table.value), end, dims)
        for b in batches(it, BATCH):
            doc = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)
            ids, vec = use.encode(b.column(1))
            cells = np.clip((0.5 + np.arctan(vec) / np.pi) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            mix = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            curve = (hilbert(cells, bits) << 24) | mix.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(curve), pa.array(np.fromiter(map(len, ids), np.int64, len(ids))), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "curve", "n", "ids"])
        use.seen.clear()
        released()

    return keyed(docs).mapInArrow(run, "doc_id long, curve long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """Pack every document into sequences of `length` ids, neighbours on the curve together.

    Returns one row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). The
    documents are laid end to end in curve order and cut at every multiple of `length`, so all
    sequences but the very last are full; the last is stored as it is where its size is a power of
    two and padded otherwise. A null or empty text is the end id alone; rows without an id are left out;
    repeated rows are packed each on its own; an empty table gives no piece. Only `doc_id` and `text` are read.

    The ids are written once and dealt once, by range of the curve. What comes to the driver is one
    key and one sum per range, as many as shuffle partitions; a task streams its rows and holds one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    coded = checkpoint(encode_and_place(docs, tokenizer, end, dims, bits), "zstd")  # ids are most of what a run keeps on disk
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = coded.select("curve", "n").repartitionByRange(parts, "curve")
    ranges = sorted((r.low, r.total) for r in light.groupBy(F.spark_partition_id().alias("p")).agg(F.min("curve").alias("low"), F.sum("n").alias("total")).collect())
    lows, base = [r[0] for r in ranges], offsets([r[1] for r in ranges])
    kind = np.dtype("<u2") if merges(tokenizer).ids.itemsize == 2 else np.dtype("<u4")
    laid = coded.withColumn("block", range_of(F.col("curve"), lows)).repartitionById(max(1, len(lows)), F.col("block")).sortWithinPartitions("block", "curve", "doc_id", "n")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pos = None, 0
        for b in it:
            out: list[tuple[int, ...]] = []
            for doc, ids, block in zip(*(b.column(k).to_pylist() for k in ("doc_id", "ids", "block")), strict=True):
                if block != now:
                    now, pos = block, int(base[block])
                wide = np.frombuffer(ids, kind).astype("<u4")
                n, start = len(wide), 0
                while start < n:
                    size = min(n - start, length - pos % length)
                    out.append((doc, start, size, zlib.crc32(wide[start:start + size]), n, pos // length, pos % length))
                    start, pos = start + size, pos + size
            cols = np.array(out, np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([pa.array(cols[:, k].copy()) for k in range(7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return laid.select("doc_id", "ids", "block").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
