import math
import random

import pytest

from trackframe.operators import matching as mt

SHAPES = ("g long, i long, ax double, ay double", "g long, j long, bx double, by_ double")


def _plain(a, b):
    out = {}
    for g, i, x, y in a:
        near = [((x - u) ** 2 + (y - v) ** 2, j) for h, j, u, v in b if h == g]
        if near:
            d, j = min(near)
            out[i] = (j, math.sqrt(d))
    return out


def _found(spark, a, b):
    rows = mt.nearest(spark.createDataFrame(a, SHAPES[0]), spark.createDataFrame(b, SHAPES[1]), ["g"], "i", "j").collect()
    assert len(rows) == len({r.i for r in rows})
    return {r.i: (r.j, r.distance) for r in rows}


R = random.Random(8)
CASES = {
    "far clusters": ([(1, i, R.uniform(1, 500), R.randrange(50)) for i in range(300)], [(1, j, R.uniform(900, 1000), R.randrange(50)) for j in range(400)]),
    "one crowded cell and an outlier": ([(1, i, R.gauss(0, 1e-6), R.gauss(0, 1e-6)) for i in range(200)] + [(1, 999, 1e9, 1e9)], [(1, j, R.gauss(0, 1e-6), R.gauss(0, 1e-6)) for j in range(400)] + [(1, 900, -1e9, 3.0)]),
    "ties on a grid and repeated points": ([(g, 100 * g + i, i % 7 + 0.5, i % 5 + 0.5) for i in range(60) for g in (1, 2)], [(g, j, j % 9, j % 6) for j in range(300) for g in (1, 2, 3)]),
    "a circle around one point": ([(1, 1, 0.0, 0.0), (1, 2, 0.25, 0.0)], [(1, j, math.cos(j) * 5, math.sin(j) * 5) for j in range(200)]),
    "one place": ([(1, i, 2.0, 2.0) for i in range(5)] + [(4, 77, 0.0, 0.0)], [(1, j, 2.0, 2.0) for j in range(9, 3, -1)]),
}


@pytest.mark.parametrize("name", CASES)
def test_nearest_against_all_pairs(spark, name):
    a, b = ([(g, i, float(x), float(y)) for g, i, x, y in rows] for rows in CASES[name])
    assert _found(spark, a, b) == _plain(a, b)


def test_few_candidates_stay_on_two_far_clusters(spark, monkeypatch):
    """What the pyramid leaves for each cell is what a point is compared with."""
    kept = []
    real = mt.checkpoint
    monkeypatch.setattr(mt, "checkpoint", lambda df: kept.append(real(df)) or kept[-1])
    a, b = ([(g, i, float(x), float(y)) for g, i, x, y in rows] for rows in CASES["far clusters"])
    _found(spark, a, b)
    ended = [d for d in kept if "left" in d.columns]
    assert max(r.left for d in ended for r in d.filter(f"left <= {mt.FEW}").collect()) <= 50
    assert ended[-1].filter(f"left > {mt.FEW}").isEmpty()
