"""Texts of a batch as one row of bytes, for work that numpy does over all of them at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LETTER_A, LETTER_Z, CASE = ord("A"), ord("Z"), ord("a") - ord("A")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and where each text begins and ends. No nulls."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    cut = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[cut[0]:cut[-1]] if data is not None and cut[-1] > cut[0] else np.zeros(0, np.uint8)
    return raw, cut - cut[0]


def unflat(raw: np.ndarray, cut: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The texts back from their bytes."""
    wide = pa.large_string() if cut[-1] >= 1 << 31 else pa.string()
    at = cut.astype(np.int64 if wide == pa.large_string() else np.int32)
    out = pa.Array.from_buffers(wide, len(cut) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])
    return out if kind is None or kind == wide else out.cast(kind)


def code_points(raw: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte, with the whole number at the end."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte as it is."""
    return np.where((raw >= LETTER_A) & (raw <= LETTER_Z), raw + np.uint8(CASE), raw).astype(np.uint8)


def word_bytes() -> np.ndarray:
    """For each byte of lowered text whether it is part of a word: digits, small letters, all beyond ASCII."""
    on = np.zeros(256, bool)
    on[ord("0"):ord("9") + 1] = on[ord("a"):ord("z") + 1] = on[128:] = True
    return on
