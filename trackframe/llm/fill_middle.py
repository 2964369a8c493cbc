"""Fill-in-the-middle by displacement: every byte of a batch is moved by a shift that two cuts a text decide.

The texts of a batch are one row of bytes. Cuts are read off one scan over that row; a difference
array holds how the shift changes at each cut, its running sum is every byte's shift, and one scatter
writes all outputs. Going back finds the cuts by the markers and gathers along the same shifts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.buffers import CASE, LETTER_A, code_points, flat, unflat
from trackframe.llm.common import batches, keyed, offsets

#: Marks before prefix, suffix and middle; documents in a hundred that are changed; of these, suffix first; seed.
MARKS, CHANGED, SUFFIX_FIRST, SEED = ("<P>", "<S>", "<M>"), 90, 20, 1
#: Bytes of text handled at once, and shifts held at once: they bound a task's memory, whatever a text's length.
BATCH, BLOCK = 2_000_000, 1 << 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")


def check_marks(marks: Sequence[str]) -> None:
    """Marks must be told again in the output: none may hold another, or begin as one ends."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and b in a) or any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"marks {a!r} and {b!r} could not be told apart")


def unit_starts(raw: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Where the units `[A-Za-z]+|[^A-Za-z]` begin: letters after no letter of the same text, other code points."""
    lower = raw | np.uint8(CASE)
    letter = (lower >= LETTER_A + CASE) & (lower < LETTER_A + CASE + 26)
    first = np.zeros(len(raw) + 1, bool)
    first[cut[:-1]] = True
    goes_on = np.zeros(len(raw), bool)
    goes_on[1:] = letter[:-1]
    return np.flatnonzero(np.where(letter, ~goes_on | first[:-1], (raw & 0xC0) != 0x80))


def found(raw: np.ndarray, mark: bytes) -> np.ndarray:
    """Every place where `mark` stands in the bytes."""
    n = len(raw) - len(mark) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(raw[:n] == mark[0])
    for k in range(1, len(mark)):
        at = at[raw[at + k] == mark[k]]
    return at


def _shifts(at: np.ndarray, step: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Running sums of the difference array that has `step` at the places `at`, block by block."""
    carry = 0
    for low in range(0, size, BLOCK):
        high = min(size, low + BLOCK)
        a, b = np.searchsorted(at, (low, high))
        diff = np.zeros(high - low, np.int64)
        np.add.at(diff, at[a:b] - low, step[a:b])
        diff[0] += carry
        shift = np.cumsum(diff)
        carry = int(shift[-1])
        yield low, high, shift


def _layout(form: np.ndarray, part: np.ndarray, size: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where prefix, middle and suffix of each text begin in its output, and where its three marks do.

    `part` has the sizes of the three parts, `size` those of the marks of prefix, suffix and middle.
    """
    p, m, s = part.T
    mp, ms, mm = size
    spm = form == SPM
    plain = form == PLAIN
    at_p = np.where(spm, ms + s + mp, mp)
    at_s = np.where(spm, ms, mp + p + ms)
    at_m = mp + ms + mm + p + s
    begin = np.stack([at_p, at_m, at_s], 1)
    begin[plain] = np.stack([np.zeros_like(p), p, p + m], 1)[plain]
    marks = np.stack([at_p - mp, at_s - ms, at_m - mm], 1)
    return begin, marks


def _moves(cut: np.ndarray, out: np.ndarray, part: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The difference array of the shifts, as places and steps: input byte + shift = output byte."""
    at = (cut[:-1, None] + np.cumsum(part, 1) - part).ravel()  # where each part begins in the input
    shift = (out[:-1, None] + begin).ravel() - at
    return at, np.diff(shift, prepend=0)


def scatter(raw: np.ndarray, cut: np.ndarray, form: np.ndarray, part: np.ndarray, marks: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of all texts as one row of bytes, and where each begins and ends."""
    size = [len(m) for m in marks]
    begin, spots = _layout(form, part, size)
    out = offsets(np.diff(cut) + np.where(form == PLAIN, 0, sum(size)))
    put = np.empty(out[-1], np.uint8)
    at, step = _moves(cut, out, part, begin)
    inside = at < len(raw)  # a part without bytes at the very end moves nothing
    for low, high, shift in _shifts(at[inside], step[inside], len(raw)):
        put[np.arange(low, high) + shift] = raw[low:high]
    changed = form != PLAIN
    for k, mark in enumerate(marks):
        for j, byte in enumerate(mark):
            put[(out[:-1] + spots[:, k])[changed] + j] = byte
    return put, out


def gather(put: np.ndarray, out: np.ndarray, form: np.ndarray, marks: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts back from outputs and forms alone: the marks tell the parts, the shifts run the other way."""
    size = [len(m) for m in marks]
    spots = [found(put, m) for m in marks]
    whole = np.diff(out)
    part = np.stack([whole, np.zeros_like(whole), np.zeros_like(whole)], 1)
    for kind, (a, b) in ((PSM, (0, 1)), (SPM, (1, 0))):
        rows = np.flatnonzero(form == kind)
        head = out[rows] + size[a]  # the first part follows the mark that opens the output
        second = spots[b][np.searchsorted(spots[b], head)] if len(rows) else head
        after = second + size[b]
        third = spots[2][np.searchsorted(spots[2], after)] if len(rows) else after
        one, two = second - head, third - after
        part[rows, 0], part[rows, 2] = (one, two) if kind == PSM else (two, one)
        part[rows, 1] = out[rows + 1] - third - size[2]
    cut = offsets(part.sum(1))
    raw = np.empty(cut[-1], np.uint8)
    at, step = _moves(cut, out, part, _layout(form, part, size)[0])
    inside = at < len(raw)
    for low, high, shift in _shifts(at[inside], step[inside], len(raw)):
        raw[low:high] = put[np.arange(low, high) + shift]
    return raw, cut


def split(raw: np.ndarray, cut: np.ndarray, h: np.ndarray, marks: Sequence[bytes], changed: int, suffix_first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of units, its form and the bytes of prefix, middle and suffix. `h`: four numbers a text."""
    starts = unit_starts(raw, cut)
    first = np.searchsorted(starts, cut)
    n = np.diff(first)
    ends = np.append(starts, len(raw))
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], 1)
    place = np.where(cuts < n[:, None], ends[np.minimum(first[:-1, None] + cuts, len(starts))], cut[1:, None])
    marked = np.zeros(len(n), bool)
    for m in marks:
        spot = found(raw, m)
        text = np.searchsorted(cut, spot, side="right") - 1
        marked[text[spot + len(m) <= cut[text + 1]]] = True  # bytes of two texts make no mark
    form = np.where(h[:, 3] % 100 < suffix_first, SPM, PSM)
    form[marked | (np.diff(cut) == 0) | (h[:, 2] % 100 >= changed)] = PLAIN
    return n, form, np.stack([place[:, 0] - cut[:-1], place[:, 1] - place[:, 0], cut[1:] - place[:, 1]], 1)


def transform(docs: DataFrame, seed: int = SEED, marks: Sequence[str] = MARKS, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every text with its middle moved to the end.

    Four numbers from the sha256 of "seed:doc_id" choose two cuts between units and the form: `psm` is prefix,
    suffix, middle, `spm` suffix, prefix, middle, each part after its mark; `plain` is the text itself, with null
    sizes: empty texts, texts that hold a mark, and 100 - `changed` in a hundred. A null text reads as empty, rows
    without an id are left out, repeated rows give equal rows, an empty table none. Only `doc_id` and `text` are read.
    """
    check_marks(marks)
    sign = [m.encode() for m in marks]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, BATCH):
            raw, cut = flat(b.column(1))
            n, form, part = split(raw, cut, np.stack([c.to_numpy() for c in b.columns[2:]], 1), sign, changed, suffix_first)
            put, out = scatter(raw, cut, form, part, sign)
            points = code_points(raw)
            at = cut[:-1, None] + np.cumsum(part, 1)
            plain = form == PLAIN
            chars = [pa.array(points[at[:, k]] - points[at[:, k] - part[:, k]], mask=plain) for k in (0, 1)]
            names = pa.array(FORMS).take(pa.array(form))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), names, *chars, unflat(put, out, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return keyed(docs).select("doc_id", "text", *h).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """`made`, which has `form` and `output`, with the text rebuilt from these two as `restored`.

    All columns pass through; one called `restored` is replaced. A null output gives a null text.
    """
    check_marks(marks)
    sign = [m.encode() for m in marks]
    rest = [c for c in made.columns if c not in ("output", "restored")]
    shape = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in rest)
    inside = made.select(F.col("output").alias("text"), F.col("form").alias("form"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, BATCH):
            texts = b.column(0)
            put, out = flat(pc.fill_null(texts, ""))
            form = pc.index_in(b.column(1), pa.array(FORMS)).fill_null(PLAIN).to_numpy()
            form = np.where(np.diff(out) == 0, PLAIN, form)
            back = pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), unflat(*gather(put, out, form, sign), pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], texts.cast(pa.string()), back], names=[*rest, "output", "restored"])

    return inside.mapInArrow(run, f"{shape}, output string, restored string")
