"""What several operators of this package share: column choice, word counting and block layout."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from itertools import repeat
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\x20\x09-\x0D"
def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id", also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, also...) and no other column; a null text reads as empty, rows without an id are left out."""
    return docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *also)


def tokens(texts: pa.Array, lower: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of each text between ASCII white space; with `lower`, A-Z are lowered, other characters stay.

    Returns the distinct words, the number of each word of all texts one after another, and where each
    text begins and ends in that row. Runs in Arrow, so a word met twice is looked at once.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    at, cut = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(lists.offsets).astype(np.int64)
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in names:  # white space at the ends of a text
        kept = at != names.index("")
        at, cut = at[kept], offsets(kept)[cut]
    return names, at, cut


def offsets(sizes: Sequence[int]) -> np.ndarray:
    """0 and the running sums of `sizes`."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def hash_names(names: Sequence[str], seed: int = 0) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in names), np.uint64, len(names))


class Ids:
    """Numbers for strings, with a row of facts for each; forgets everything once `limit` strings are held.

    Workers are reused between tasks, so a word met again costs one dictionary lookup. The limit
    bounds the memory of a worker and changes no result.
    """

    def __init__(self, facts: Callable[[list[str]], tuple[np.ndarray, ...]], limit: int = 200_000):
        self.facts, self.limit = facts, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table: tuple[np.ndarray, ...] | None = None

    def look(self, names: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """The numbers of the strings, and the table of facts that they point into."""
        if len(self.at) > self.limit:
            self.clear()
        at = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        miss = np.flatnonzero(at < 0)
        if len(miss) or self.table is None:
            new = [names[i] for i in miss]
            at[miss] = np.arange(len(self.at), len(self.at) + len(new))
            self.at.update(zip(new, at[miss].tolist(), strict=True))
            fresh = self.facts(new)
            self.table = fresh if self.table is None else tuple(np.concatenate(x) for x in zip(self.table, fresh, strict=True))
        return at, self.table


def batches(it: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that each holds about `chars` bytes of text at most, or one row."""
    for b in it:
        col = b.column(b.schema.get_field_index("text"))
        ends = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_string(col.type) else np.int64)[col.offset:col.offset + len(b) + 1] if len(b) else np.zeros(1)
        i = 0
        while i < len(b):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + chars, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j
    released()


def released() -> None:
    """Give freed memory back to the system: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound what one Arrow batch holds in bytes, where the session doesn't say: rows may be whole long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, size)


def range_of(key: Column, lows: Sequence[int]) -> Column:
    """The number of the range that `key` lies in, from the ascending first keys of the ranges: looked up in two levels."""
    if not lows:
        return F.lit(0)
    wide = isqrt(len(lows) - 1) + 1
    heads, every = F.lit(list(lows[::wide])), F.lit(list(lows))
    first = F.greatest(F.size(F.filter(heads, lambda b: b <= key)) - 1, F.lit(0)) * wide
    return F.greatest(first + F.size(F.filter(F.slice(every, first + 1, wide), lambda b: b <= key)) - 1, F.lit(0))


def spread(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Deal rows to the session's shuffle partitions by a hash of `cols`."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
