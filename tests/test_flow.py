"""Dials and regions on synthetic flow with known truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import flow as fl
from trackframe.operators import matching as mt
from trackframe.operators import regions as rg

G, T, FPS = 12, 100, 20.0


def clip_rows(clip, fn, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(T):
        for gy in range(G):
            for gx in range(G):
                vx, vy = fn(t / FPS, gy, gx)
                rows.append((clip, t, gy, gx, float(vx + noise * rng.normal()), float(vy + noise * rng.normal())))
    return rows


def block(x0, x1, y0, y1):
    return lambda gy, gx: y0 <= gy < y1 and x0 <= gx < x1


@pytest.fixture(scope="module")
def cells(spark):
    b = block(3, 9, 3, 9)
    left, right = block(1, 5, 3, 9), block(7, 11, 3, 9)
    rng = np.random.default_rng(3)
    still = rng.random((G, G)) * 0.9 * (rng.random((G, G)) > 0.6)
    walks = rng.normal(size=(T, G, G, 2)) * 4
    rows = clip_rows(1, lambda s, y, x: (5 * math.cos(2 * math.pi * 0.8 * s) if b(y, x) else 0, 0), 0.02, 1)
    rows += clip_rows(2, lambda s, y, x: (0, 5 * math.cos(2 * math.pi * 2.5 * s) if b(y, x) else 0), 0.02, 2)
    rows += clip_rows(3, lambda s, y, x: (0, 5 * math.cos(2 * math.pi * 1.2 * s + 0.9 * x)), 0.02, 3)
    rows += clip_rows(4, lambda s, y, x: walks[int(round(s * FPS)), y, x])
    rows += clip_rows(5, lambda s, y, x: (still[y, x], 0), 0.002, 5)
    rows += clip_rows(6, lambda s, y, x: (5 * math.cos(2 * math.pi * 0.8 * s) if left(y, x) else 0, 5 * math.cos(2 * math.pi * 2.5 * s) if right(y, x) else 0), 0.02, 6)
    return spark.createDataFrame(rows, "clip long, t long, gy long, gx long, vx double, vy double").cache()


@pytest.fixture(scope="module")
def clips(spark):
    return spark.createDataFrame([(c, FPS, 480.0, 480.0, G) for c in range(1, 7)], "clip long, fps double, width double, height double, grid long")


def test_truth_checks(spark, cells, clips):
    dials = fl.distill(cells, clips)
    truth = spark.createDataFrame([(1, 0.8, 0.0, "low", "low", None), (2, 2.5, 90.0, "low", "low", None), (3, 1.2, None, "high", None, None), (4, None, None, None, "high", None), (5, None, None, None, None, "zero")],
                                  "clip long, frequency double, direction double, phase_spread string, turbulence string, amplitude string")
    failed = [tuple(r) for r in mt.score(dials, truth, ["clip"]).filter("NOT passed").collect()]
    assert failed == []


def test_distill_matches_numpy(cells, clips):
    got = {r.clip: r for r in fl.distill_parts(cells, clips).collect()}
    for clip in (1, 3, 4):
        pdf = cells.filter(F.col("clip") == clip).orderBy("t", "gy", "gx").toPandas()
        f = pdf[["vx", "vy"]].to_numpy().reshape(T, G * G, 2)
        mean = f.mean(axis=1)
        g = mean - mean.mean(axis=0)
        axis = np.linalg.eigh(np.cov(g.T))[1][:, -1]
        spec = np.abs(np.fft.rfft(g @ axis))
        spec[0] = 0
        assert got[clip].k == int(np.argmax(spec))
        mag = np.linalg.norm(f - mean.mean(axis=0), axis=2)
        corr = [np.corrcoef(mag[t], mag[t + 1])[0, 1] for t in range(T - 1)]
        assert got[clip].persistence == pytest.approx(np.mean(corr), abs=1e-6)
        ft = (np.exp(-2j * np.pi * got[clip].k * np.arange(T) / T)[:, None] * (f @ axis)).sum(axis=0)
        w = np.abs(ft) ** 2
        assert got[clip].spread == pytest.approx(1 - abs((ft / np.abs(ft) * w).sum()) / w.sum(), abs=1e-6)


def test_region_counts(cells, clips):
    # a static clip has no region, two separate motions have two
    some = cells.filter("clip IN (5, 6)")
    n = {r.clip: r.n for r in rg.segment_regions(some, some, clips).groupBy("clip").agg(F.count("region").alias("n")).collect()}
    assert n == {6: 2}


@pytest.mark.parametrize("size,bins,groups", [(8, range(8), [{0, 1, 7}, {2, 3, 4}, {5, 6}]), (4, range(4), [{0, 1}, {2, 3}]), (4, (0, 1, 2), [{0, 1}, {2}])])
def test_ring_merging(size, bins, groups):
    bins = list(bins)
    got = rg.merged_bins(size, sum(1 << b for b in bins))
    assert sorted(tuple(sorted(b for b in range(size) if got[b] == g)) for g in set(got) if g) == sorted(tuple(sorted(s)) for s in groups)


def test_components_on_a_snake(spark):
    snake = [(1, y, x) for y in range(0, 20, 2) for x in range(20)] + [(1, y, 19 if y % 4 == 1 else 0) for y in range(1, 19, 2)]
    d = spark.createDataFrame(snake + [(1, 40, 40)], "clip long, y long, x long")
    assert rg.components8(d, ["clip"], "y", "x").select("comp").distinct().count() == 2
    assert rg.largest_component(d).count() == len(snake)


def test_masked_tracks_stay_and_count(spark, cells, clips):
    keep = spark.createDataFrame([(1, y, x, (y, x) == (5, 5)) for y in range(G) for x in range(G)], "clip long, gy long, gx long, keep boolean")
    tr = fl.grid_tracks(cells.filter("clip = 1"), clips, keep=keep)
    assert tr.count() == G * G * (T + 1)
    moved = tr.groupBy("gy", "gx").agg((F.max("x") - F.min("x")).alias("d")).filter("d > 0").collect()
    assert [(r.gy, r.gx) for r in moved] == [(5, 5)]
