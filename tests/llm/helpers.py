"""Plain versions of the operators, for small tables."""

import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string"
#: Null, empty, blank, one word, repeated rows, odd characters.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "A b\tc\x0bd e f"), (6, "a\x00b \x1c é Σας 日本 ½"), (7, "x" * 5000), (8, "w " * 3000)]


def lower_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = lower_words(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def near_duplicates(rows, num=85, den=100):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in sets)


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = "n rep value row blk own kind fp base cand token c held_out block curve tie _salt _n _h lang source".split()
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})
