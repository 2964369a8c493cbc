"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from trackframe.llm.common import batches

#: Texts above this many characters are cut at safe places before they are encoded.
LONG = 100_000


class Codec:
    """Encoder and decoder of one rank file; `pattern` splits a text before the merges."""

    def __init__(self, ranks: str, pattern: str, long: int = LONG):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.long = long
        self.one = tiktoken.Encoding(os.path.basename(ranks), pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(pattern)
        #: The first place at or after a position where white space follows something else. A match of
        #: the pattern never runs over such a place, and none looks back over it.
        self.safe = regex.compile(r"(?<=\S)(?=\s)")
        self.names = {}

    def pieces(self, text: str) -> Iterator[str]:
        """Cut a text so that encoding the pieces one by one gives the ids of the whole."""
        start = 0
        while len(text) - start > self.long:
            cut = self.safe.search(text, start + self.long)
            if cut is None:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the library gives for the whole text."""
        if len(text) <= self.long:
            return self.one.encode_ordinary(text)
        out: list[int] = []
        for piece in self.pieces(text):
            if len(piece) <= 2 * self.long:
                out += self.one.encode_ordinary(piece)
            else:  # one endless run: match by match, so that the library's own matcher never sees it
                for m in self.split.finditer(piece):
                    out += self.one._encode_single_piece(m.group())
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; they need not be valid UTF-8."""
        return self.one.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(ranks: str, pattern: str, long: int = LONG) -> Codec:
    return Codec(ranks, pattern, long)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, long: int = LONG, keep_ids: bool = True) -> DataFrame:
    """Encode every text and decode it again.

    Returns (doc_id, n_tokens, ids array<int>, ids_sha256, decoded_sha256, exact), one row per input row;
    `exact` tells that the decoded bytes are those of the text. A null text counts as empty: no ids,
    hashes of nothing. Ids may be null or repeated, each row stands alone. Only `doc_id` and `text` are
    read, other columns may have any name. Each task reads the rank file at `ranks`, a path that every
    machine has. With `keep_ids=False` the column of ids is left out.
    """
    digest = lambda b: hashlib.sha256(b).hexdigest()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(ranks, pattern, long)
        name = [str(i) for i in range(use.one.max_token_value + 1)]
        for b in batches(it):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                ids = use.encode(text)
                back = use.decode(ids)
                rows.append((i, len(ids), ids if keep_ids else None, digest(" ".join([name[k] for k in ids]).encode()), digest(back), back == text.encode()))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *([pa.array(cols[2], pa.list_(pa.int32()))] if keep_ids else []), pa.array(cols[3]), pa.array(cols[4]), pa.array(cols[5])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256", "exact"])

    shape = "doc_id long, n_tokens long, " + ("ids array<int>, " if keep_ids else "") + "ids_sha256 string, decoded_sha256 string, exact boolean"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, shape)
