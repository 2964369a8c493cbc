import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import flow as fl
from trackframe.operators import masks as mk
from trackframe.operators import regions as rg


def _plain_components(cells):
    left, out = set(cells), {}
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        seen = []
        while todo:
            y, x = todo.pop()
            seen.append((y, x))
            near = [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            todo += [c for c in near if c in left]
            left.difference_update(near)
        out.update(dict.fromkeys(seen, min(seen)))
    return out


@pytest.mark.parametrize("tile", [256, 5])
def test_components_against_a_flood_fill(spark, tile):
    rng = random.Random(4)
    images = {k: [(y, x) for y in range(-6, 17) for x in range(-9, 14) if rng.random() < share] for k, share in enumerate((0.2, 0.4, 0.5, 0.9))}
    rows = [(k, y, x) for k, cells in images.items() for y, x in cells] + [(9, 3, 3)]
    df = spark.createDataFrame(rows + rows[:40], "clip int, y int, x int").withColumn("note", F.lit("n"))
    got = rg.components8(df, ["clip"], "y", "x", tile=tile).collect()
    assert len(got) == len(rows) + 40 and got[0].note == "n"
    for k, cells in images.items():
        assert {(r.y, r.x): tuple(r.comp) for r in got if r.clip == k} == _plain_components(cells)
    assert rg.components8(df.limit(0), ["clip"], "y", "x").count() == 0


def test_touching_runs_are_fewer_than_twice_the_runs():
    rng = np.random.default_rng(1)
    cells = np.argwhere(rng.random((300, 300)) < 0.5)
    run, above, below = rg._row_runs(cells[:, 0], cells[:, 1])
    assert len(above) <= 2 * (run[-1] + 1)


def test_a_spiral_of_a_million_pixels_is_one_component(spark):
    side = 1416  # every second ring of the square is wall
    img = np.zeros((side, side), bool)
    y, x, dy, dx, low, high_y, high_x, left = 0, 0, 0, 1, 0, side - 1, side - 1, 0
    lo_y, lo_x = 2, 0
    img[0, 0] = True
    while True:
        end = {(0, 1): high_x - x, (1, 0): high_y - y, (0, -1): x - lo_x, (-1, 0): y - lo_y}[dy, dx]
        if end < 2:
            break
        ys, xs = (y, y + dy * end), (x, x + dx * end)
        img[min(ys):max(ys) + 1, min(xs):max(xs) + 1] = True
        y, x = ys[1], xs[1]
        if (dy, dx) == (0, 1):
            high_x -= 2
        elif (dy, dx) == (1, 0):
            high_y -= 2
        elif (dy, dx) == (0, -1):
            lo_x += 2
        else:
            lo_y += 2
        dy, dx = dx, -dy
    cells = np.argwhere(img)
    assert len(cells) > 990_000
    df = spark.createDataFrame(__import__("pyarrow").table({"y": cells[:, 0], "x": cells[:, 1]})).withColumn("clip", F.lit(1))
    got = rg.components8(df, ["clip"], "y", "x").agg(F.count(F.lit(1)), F.min("comp"), F.max("comp")).first()
    assert tuple(got) == (len(cells), (0, 0), (0, 0))


def test_long_zooms_and_turns_stay_exact(spark):
    n, zoom, turn = 100_000, 1.001, 0.01
    t = F.col("id")
    pairs = spark.range(n).select(F.lit(1).alias("clip"), t.alias("t"), F.array(*[F.lit(v) for v in (zoom * math.cos(turn), -zoom * math.sin(turn))], F.lit(0.5), *[F.lit(v) for v in (zoom * math.sin(turn), zoom * math.cos(turn))], (t % 7) * 0.1).alias("m"))
    got = {r.t: complex(r.a, r.b) for r in mk.scan_similarities(pairs.select("clip", "t", F.col("m")[0].alias("a"), F.col("m")[3].alias("b"), F.col("m")[2].alias("tx"), F.col("m")[5].alias("ty")), ["clip"], block=64).filter("t % 9999 = 0 or t = 99999").collect()}
    for k, v in got.items():
        want = (k + 1) * (math.log(zoom) + 1j * turn)
        assert abs(v) == pytest.approx(math.exp(want.real), rel=1e-8) and math.isfinite(abs(v))
    near = mk.compose_transforms(pairs.filter("t < 300")).filter("i = 300").first()
    p, q = 1, 0
    for k in range(300):
        w = zoom * complex(math.cos(turn), math.sin(turn))
        p, q = w * p, w * q + complex(0.5, k % 7 * 0.1)
    assert (near.a, near.b, near.tx, near.ty) == pytest.approx((p.real, p.imag, q.real, q.imag), abs=2e-6)


def test_flow_over_tile_borders_against_whole_frames(spark):
    rng = np.random.default_rng(2)
    frames, h, w, gx_n, gy_n, r = 18, 70, 131, 9, 5, 3
    yy, xx = np.mgrid[0:h, 0:w]
    g = np.stack([100 + 40 * np.sin((xx - 0.4 * t) / 5) + 30 * np.cos((yy + 0.3 * t) / 6) + rng.normal(0, 0.3, (h, w)) for t in range(frames)])
    t, y, x = np.nonzero(np.ones_like(g))
    keep = rng.random(len(t)) > 0.01
    df = spark.createDataFrame(__import__("pyarrow").table({"t": t[keep], "y": y[keep], "x": x[keep], "g": g[t, y, x][keep]})).withColumn("clip", F.lit("c"))
    got = {(q.t, q.gy, q.gx): (q.vx, q.vy, q.valid) for q in fl.lucas_kanade(df, w, h, gx_n, gy_n, r).collect()}
    g[t[~keep], y[~keep], x[~keep]] = np.nan
    seen = 0
    for k in range(frames - 1):
        ix, iy, it = np.full((h, w), np.nan), np.full((h, w), np.nan), g[k + 1] - g[k]
        ix[:, 1:-1], iy[1:-1] = (g[k][:, 2:] - g[k][:, :-2]) / 2, (g[k][2:] - g[k][:-2]) / 2
        bad = np.isnan(ix) | np.isnan(iy) | np.isnan(it)
        ix, iy, it = (np.where(bad, 0, v) for v in (ix, iy, it))
        for a in range(gy_n):
            for b in range(gx_n):
                py, px = math.floor((a + 0.5) * h / gy_n + 0.5), math.floor((b + 0.5) * w / gx_n + 0.5)
                s = (slice(max(py - r, 0), py + r + 1), slice(max(px - r, 0), px + r + 1))
                m = np.array([[(ix[s] ** 2).sum(), (ix[s] * iy[s]).sum()], [(ix[s] * iy[s]).sum(), (iy[s] ** 2).sum()]])
                ok = np.linalg.eigvalsh(m)[0] >= 40
                v = np.clip(-np.linalg.solve(m, [(ix[s] * it[s]).sum(), (iy[s] * it[s]).sum()]), -6, 6) if ok else np.zeros(2)
                assert got[k, a, b] == (pytest.approx(v[0], abs=1e-6), pytest.approx(v[1], abs=1e-6), ok)
                seen += 1
    assert seen == len([key for key in got if key[0] < frames - 1]) and max(key[0] for key in got) == frames - 2


def test_pixels_travel_little_more_than_once(spark, monkeypatch):
    sent = []
    real = type(spark.range(1)).groupBy
    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda self, *c: sent.append(self) or real(self, *c))
    df = spark.range(64 * 128 * 128).select(F.lit(1).alias("clip"), (F.col("id") % 64).alias("t"), F.floor(F.col("id") / 64 % 128).alias("y"), F.floor(F.col("id") / 8192).alias("x"), F.rand(1).alias("g"))
    fl.lucas_kanade(df, 128, 128)
    assert next(d for d in sent if "_ty" in d.columns).count() < 1.3 * 64 * 128 * 128
