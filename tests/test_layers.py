"""Layer trees against a plain walk, and what their steps write."""

import random
from collections import Counter

from trackframe.operators import matching as mt


def _walk(links):
    """{(id, ancestor): least depth} by breadth first search."""
    up, out = {}, {}
    for i, p in links:
        up.setdefault(i, set()).add(p)
    for i in up:
        level, depth = up[i], 1
        while level:
            for a in level:
                out[i, a] = depth
            level, depth = {p for a in level for p in up.get(a, ())} - {a for x, a in out if x == i}, depth + 1
    return out


def _figures(links, names, limbs):
    up = {k: d for k, d in _walk(links).items() if k[0] in limbs}
    held, best = Counter(a for _, a in up), {}
    for (i, a), d in up.items():
        tier = None if a not in names else 0 if held[a] > 1 and names[a] else 1 if held[a] > 1 else 2 if names[a] else None
        if tier is not None:
            best[i] = min(best.get(i, (9, 0, "")), (tier, d, a))
    return {(i, a, t) for i, (t, _, a) in best.items()}


def test_layers_with_cycles_repeats_and_several_parents(spark):
    rng = random.Random(3)
    rows, limbs, want, figures = [], [], set(), set()
    for art in range(12):
        ids = [f"n{i}" for i in range(14)]
        links = [(i, rng.choice([*ids[:6], i, "gone"])) for i in ids if rng.random() < 0.8]
        links += rng.sample(links, 2) + ([(rng.choice(ids), rng.choice(ids[:6])) for _ in range(3)] if art % 2 else [])
        names = {i: rng.choice(["", "name"]) for i in ids}
        own = rng.sample(ids, 8)
        rows += [(art, i, p, names[i]) for i, p in links] + [(art, i, None, names[i]) for i in ids if i not in dict(links)]
        limbs += [(art, i) for i in [*own, own[0], "not a layer"]]
        want |= {(art, i, a, d) for (i, a), d in _walk(links).items()}
        figures |= {(art, *x) for x in _figures(links, names, set(own))}
    lay = spark.createDataFrame(rows, "art long, id string, parent string, name string")
    got = [tuple(r) for r in mt.ancestors(lay).select("art", "id", "ancestor", "depth").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    found = [tuple(r) for r in mt.figure_of(spark.createDataFrame(limbs, "art long, id string"), lay).select("art", "id", "figure", "tier").collect()]
    assert len(found) == len(set(found)) and set(found) == figures


def test_layers_without_children_are_written_once(spark, monkeypatch):
    written, keep = [], mt.checkpoint
    monkeypatch.setattr(mt, "checkpoint", lambda df, *a: (written.append(keep(df, *a)), written[-1])[1])
    rows = [(1, "root", None, "")] + [(1, f"g{i}", "root", "g") for i in range(3)] + [(1, f"p{i}", f"g{i % 3}", "p") for i in range(300)]
    lay = spark.createDataFrame(rows, "art long, id string, parent string, name string")
    assert mt.ancestors(lay).count() == 3 + 600
    assert sum(d.count() for d in written) < 1.1 * len(rows)
    written.clear()
    assert mt.figure_of(lay.filter("id LIKE 'p%'"), lay).filter("tier = 0").count() == 300
    assert sum(d.count() for d in written) < 1.1 * len(rows)
