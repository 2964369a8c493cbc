"""Block-wise ordered operators against plain loops, with blocks small enough to be crossed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import series as se
from trackframe.operators import spectra as sp


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    # one hot group and two small ones
    return [(g, t, float(rng.normal())) for g, n in ((1, 300), (2, 9), (3, 2)) for t in range(n)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g long, t long, v double")


def by_group(rows):
    out = {}
    for g, t, v in rows:
        out.setdefault(g, []).append(v)
    return out


def test_prefix_sums_cross_blocks(df, rows):
    got = {(r.g, r.t): r.s for r in se.prefix_sums(df, ["g"], "t", {"s": "v"}, block=16).collect()}
    for g, vs in by_group(rows).items():
        assert np.allclose([got[g, t] for t in range(len(vs))], np.cumsum(vs))


def test_neighbours_cross_blocks_and_gaps(df, rows):
    gappy = df.filter("t % 50 < 3")
    got = {(r.g, r.t): (r.prev_v, r.next_v) for r in se.neighbours(gappy, ["g"], "t", ["v"], block=8).collect()}
    for g, vs in by_group(rows).items():
        kept = [t for t in range(len(vs)) if t % 50 < 3]
        for k, t in enumerate(kept):
            want = (vs[kept[k - 1]] if k else None, vs[kept[k + 1]] if k + 1 < len(kept) else None)
            assert got[g, t] == want


def test_smooth_pinned_matches_shrinking_window(df, rows):
    n = df.groupBy("g").agg(F.count("v").alias("n"))
    got = {(r.g, r.t): r.v for r in se.smooth_pinned(df.join(n, "g"), ["g"], ["v"], i="t", block=16).collect()}
    for g, vs in by_group(rows).items():
        for i, v in enumerate(vs):
            r = min(2, i, len(vs) - 1 - i)
            want = v if len(vs) <= 2 or r == 0 else np.mean(vs[i - r:i + r + 1])
            assert got[g, i] == pytest.approx(want)


def test_fill_gaps_leaves_long_runs_and_edges(spark):
    vals = [None, 1.0, None, None, 4.0, None, None, None, None, None, None, 11.0, None]
    d = spark.createDataFrame([(1, t, v) for t, v in enumerate(vals)], "g long, t long, v double")
    got = {r.t: (r.v, r.flag) for r in se.fill_gaps(d, ["g"], ["v"], k=5).collect()}
    assert got[2] == (2.0, "interp") and got[3] == (3.0, "interp")
    assert got[0] == (None, "gap") and got[12] == (None, "gap") and got[7] == (None, "gap")


def test_dense_index_and_sorted_index(df, rows):
    got = {(r.g, r.t): r.i for r in se.dense_index(df, ["g"], ["t"], F.col("t"), "i", block=7).collect()}
    assert all(i == t for (g, t), i in got.items())
    ranks = {(r.g, r.t): r.rank for r in se.sorted_index(df, ["g"], [F.col("v").desc(), F.col("t")]).collect()}
    for g, vs in by_group(rows).items():
        order = np.argsort(-np.array(vs), kind="stable")
        assert [ranks[g, int(t)] for t in order] == list(range(1, len(vs) + 1))


@pytest.mark.parametrize("p", [0.5, 0.7])
def test_quantiles_interpolate_like_numpy(df, rows, p):
    got = {r.g: r.q for r in se.quantiles(df, ["g"], {"q": "v"}, p).collect()}
    for g, vs in by_group(rows).items():
        assert got[g] == pytest.approx(np.quantile(vs, p))


def test_upper_median(df, rows):
    got = {r.g: r.q for r in se.quantiles(df, ["g"], {"q": "v"}, upper=True).collect()}
    for g, vs in by_group(rows).items():
        assert got[g] == sorted(vs)[len(vs) // 2]


def test_dft_matches_fft(df, rows):
    n = df.groupBy("g").agg(F.count("v").alias("n"))
    got = {(r.g, r.k): r.mag for r in sp.dft(df.join(n, "g"), ["g"]).collect()}
    for g, vs in by_group(rows).items():
        want = np.abs(np.fft.rfft(vs))
        assert np.allclose([got[g, k] for k in range(len(want))], want)


def test_bandpass_matches_inverse_fft(spark):
    rng = np.random.default_rng(1)
    x = rng.random(21)
    d = spark.createDataFrame([(1, 0, t, float(v)) for t, v in enumerate(x)], "clip long, px long, t long, v double")
    clips = spark.createDataFrame([(1, 21, 10.0)], "clip long, n long, fps double")
    got = [r.v for r in sp.temporal_bandpass(d, clips, ["clip"], ["px"]).orderBy("t").collect()]
    f = np.fft.rfft(x)
    hz = np.fft.rfftfreq(21, 0.1)
    f[~((hz >= 0.4) & (hz <= 3.0))] = 0
    assert np.allclose(got, np.clip(x + 12 * np.fft.irfft(f, 21), 0, 1))


def test_runs_first_longest_wins(spark):
    bits = "0110111001110"
    d = spark.createDataFrame([(1, t, b == "1") for t, b in enumerate(bits)], "g long, t long, b boolean")
    r = se.longest_run(d, ["g"], F.col("b")).first()
    assert (r.start, r.stop, r.length) == (4, 7, 3)


def test_top_k_ranks(df):
    top = se.top_k(df, ["g"], [F.col("v").desc(), F.col("t")], 3).groupBy("g").agg(F.max("rank").alias("m")).collect()
    assert {r.g: r.m for r in top} == {1: 3, 2: 3, 3: 2}
