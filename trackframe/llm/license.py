"""Licence notices by Dice coefficient over word bigrams."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from trackframe.llm.common import batches, keyed

# The customary wording of public licences' notices.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Least Dice coefficient of a notice.
DICE = 0.8
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def normal(text: str) -> list[str]:
    """Lower-case words and numbers, without signs."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> dict[tuple[str, str], int]:
    """Pairs of neighbouring words with how often each occurs; a single word is paired with nothing."""
    out: dict[tuple[str, str], int] = {}
    for pair in zip(words, [*words[1:], ""], strict=True) if len(words) == 1 else zip(words, words[1:], strict=False):
        out[pair] = out.get(pair, 0) + 1
    return out


def dice(a: Mapping, b: Mapping) -> float:
    """Twice the shared bigrams over all bigrams."""
    total = sum(a.values()) + sum(b.values())
    return 2 * sum(min(n, b.get(p, 0)) for p, n in a.items()) / total if total else 0.0


def placed(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of `normal` with where each begins and ends in the text."""
    low = text.lower()
    if len(low) != len(text):  # a few letters are lowered to two characters
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    found = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
    return [w for w, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]


class Scanner:
    """Finds notices: lines, paragraphs of several lines, and runs of words inside, that are like a template."""

    def __init__(self, templates: Mapping[str, list[str]], least: float):
        self.least = least
        self.templates = sorted((name, k, g, sum(g.values())) for name, texts in templates.items() for k, t in enumerate(texts) for g in [bigrams(normal(t))])
        sizes = [n for *_, n in self.templates]
        # 2 min(m, n) / (m + n) bounds the coefficient
        self.low, self.high = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least
        self.starts = {w for _, _, g, _ in self.templates for p in g for w in p}
        firsts = sorted({p[0] for _, _, g, _ in self.templates for p in g if p[0]}, key=len, reverse=True)
        # templates that have a bigram
        self.of: dict[tuple[str, str], list[int]] = {}
        for t, (_, _, g, _) in enumerate(self.templates):
            for p in g:
                self.of.setdefault(p, []).append(t)
        self.alone = any(not p[1] for p in self.of)
        # a notice shares at least this part of a template's bigrams; if more than the rest begin with a
        # longer word, a text without any of those words has no notice
        need = least / (2 - least)
        self.long = all(sum(n for p, n in g.items() if len(p[0]) <= 4) < need * size for _, _, g, size in self.templates)
        self.any = re.compile(r"(?:^|[\W_])(?:" + "|".join(re.escape(w) for w in firsts if len(w) > 4) + r")(?:$|[\W_])")

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Begin and end of every line, and of every run of two or more lines without one that has no word between."""
        at = 0
        first, last, lines = 0, 0, 0
        for line in text.split("\n"):
            end = at + len(line)
            if _WORD.search(line):
                first = at if not lines else first
                last = end
                lines += 1
                yield at, end
            else:
                if lines > 1:
                    yield first, last
                lines = 0
            at = end + 1
        if lines > 1:
            yield first, last

    def best(self, words: list[str]) -> tuple[float, str, int] | None:
        """The most alike template that reaches the least coefficient: (coefficient, licence, template)."""
        m = len(words) - 1 if len(words) > 1 else len(words)
        if not self.low <= m <= self.high or not any(w in self.starts for w in words):
            return None
        own, out = None, None
        for name, k, g, n in self.templates:
            if 2 * min(m, n) < self.least * (m + n):
                continue
            own = own if own is not None else bigrams(words)
            d = dice(own, g)
            if d >= self.least and (out is None or (-d, name, k) < (-out[0], out[1], out[2])):
                out = (d, name, k)
        return out

    def windows(self, text: str) -> list[tuple[int, int, str, float]]:
        """(begin, end, licence, coefficient) of the most alike runs of words, whatever stands around them, none over another.

        The best run begins and ends with a bigram of its template: without another one the coefficient is higher.
        """
        words, begin, end = placed(text)
        hits: dict[int, list[int]] = {}
        of = self.of
        for i, p in enumerate(zip(words, words[1:], strict=False)):
            if p in of:
                for t in of[p]:
                    hits.setdefault(t, []).append(i)
        found = []
        for t, at in hits.items():
            name, k, g, n = self.templates[t]
            need = math.ceil(self.least / (2 - self.least) * n - 1e-9)
            most = math.floor(n * (2 - self.least) / self.least + 1e-9)
            for a in range(len(at) - need + 1):
                first = at[a]
                if at[a + need - 1] - first >= most:
                    continue
                seen: dict[tuple[str, str], int] = {}
                shared, best = 0, (0.0, 0)
                for i in itertools.islice(at, a, None):
                    if i - first >= most:
                        break
                    p = (words[i], words[i + 1])
                    seen[p] = seen.get(p, 0) + 1
                    if seen[p] <= g[p]:
                        shared += 1
                        best = max(best, (2 * shared / (i - first + 1 + n), i))
                if best[0] >= self.least:
                    found.append((-best[0], -(best[1] - first), name, k, first, best[1] + 1))
        if self.alone:
            found += [(-1.0, 0, *self.templates[t][:2], i, i) for i, w in enumerate(words) for t in of.get((w, ""), [])]
        out: list[tuple[int, int, str, float]] = []
        taken = bytearray(len(words))
        for d, _, name, _, i, j in sorted(found):
            if 1 not in taken[i:j + 1]:
                taken[i:j + 1] = b"\x01" * (j + 1 - i)
                out.append((begin[i], end[j], name, -d))
        return out

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(begin, end, licence, coefficient) of every notice, in order."""
        out = []
        if self.long and not self.any.search(text.lower()):
            return out
        for a, b in self.blocks(text):
            if b - a > 40 * (self.high + 2) and len(text[a:b].split()) > self.high + 2:
                continue
            hit = self.best(normal(text[a:b]))
            if hit:
                out.append((a, b, hit[1], hit[0]))
        # runs of words that no line or paragraph stands for as well
        blocks, at = sorted(out), 0
        longest = max((b - a for a, b, _, _ in blocks), default=0)
        for a, b, name, d in sorted(self.windows(text)):
            while at < len(blocks) and blocks[at][0] + longest <= a:
                at += 1
            over = itertools.takewhile(lambda x: x[0] < b, itertools.islice(blocks, at, None))
            if not any(x[1] > a and (x[2] == name or x[3] >= d) for x in over):
                out.append((a, b, name, d))
        return out if len(out) == len(blocks) else sorted(out)


def scan_documents(docs: DataFrame, templates: Mapping[str, list[str]] | None = None, least: float = DICE) -> DataFrame:
    """Licence notices in every text: (doc_id, n_notices, licence, dice, notices), one row per document.

    Lines and paragraphs are lowered, stripped of signs and compared with each template by the Dice
    coefficient of their word bigrams; templates too long or too short for `least` are not compared. So
    are runs of words inside them or across them, the most alike first; one that overlaps a line or
    paragraph found for the same licence, or for another one that is at least as much alike, is not given again.
    notices: array of (begin, end, licence, dice), code points, end exclusive; licence and dice are those
    of the most alike, ties to the smaller name, null where there is none. A null or empty text has
    none. Rows without an id are left out, repeated rows stand each alone, an empty table gives no row.
    Only `doc_id` and `text` are read. Row by row, without a shuffle.
    """
    templates = dict(TEMPLATES if templates is None else templates)
    item = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for b in batches(it):
            found = [scanner.scan(t) for t in b.column(1).to_pylist()]
            top = [min(((-d, n) for _, _, n, d in f), default=(None, None)) for f in found]
            lists = [[dict(zip(("begin", "end", "licence", "dice"), x, strict=True)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([n for _, n in top], pa.string()), pa.array([None if d is None else -d for d, _ in top], pa.float64()), pa.array(lists, pa.list_(item))], names=["doc_id", "n_notices", "licence", "dice", "notices"])

    return keyed(docs).mapInArrow(run, "doc_id long, n_notices long, licence string, dice double, notices array<struct<begin:long,end:long,licence:string,dice:double>>")
