import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import spectra as sp


def _series(spark, lengths, seed=0):
    """One sine with noise a length, with a gap: (g, n, t, v) and the plain rows."""
    rng = np.random.default_rng(seed)
    x = {g: np.sin(np.arange(n) * 0.7) + rng.normal(size=n) for g, n in enumerate(lengths)}
    rows = [(g, len(v), t, float(v[t])) for g, v in x.items() for t in range(len(v))]
    return spark.createDataFrame(rows, "g int, n int, t int, v double"), x


@pytest.mark.parametrize("whole", [1 << 14, 40], ids=["in one row", "in two steps"])
def test_transforms_of_any_length(spark, monkeypatch, whole):
    monkeypatch.setattr(sp, "WHOLE", whole)
    df, x = _series(spark, [1, 2, 9, 64, 97, 360, 1009, 2018])  # primes, twice a prime, products
    got = {}
    out = sp.dft(df, ["g"])
    assert out.columns == ["g", "k", "n", "re", "im", "mag"] and dict(out.dtypes)["n"] == "int"
    for r in out.collect():
        got.setdefault(r.g, {})[r.k] = complex(r.re, r.im)
    for g, v in x.items():
        want = np.fft.rfft(v)
        assert sorted(got[g]) == list(range(len(want)))
        assert np.allclose([got[g][k] for k in range(len(want))], want, atol=1e-8)


@pytest.mark.parametrize("n", [100_000, 100_003], ids=["composite", "prime"])
def test_a_long_series_takes_rows_in_proportion(spark, monkeypatch, n):
    sizes = []
    real = sp._per_row

    def counted(df, *a):
        sizes.append(df.agg(F.count(F.lit(1)), F.max(F.size("s")), F.sum(F.size("s"))).first())
        return real(df, *a)

    monkeypatch.setattr(sp, "_per_row", counted)
    t = F.col("id")
    s = spark.range(n).select(F.lit("a").alias("g"), F.lit(n).cast("long").alias("n"), t.alias("t"), (F.sin(t * 0.01) + F.pmod(t * 7919, F.lit(104729)) / 104729).alias("v"))
    got = sp.dft(s, ["g"]).orderBy("k").toArrow()
    i = np.arange(n)
    want = np.fft.rfft(np.sin(i * 0.01) + (i * 7919 % 104729) / 104729)
    assert len(got) == n // 2 + 1 and np.allclose(got["re"].to_numpy() + 1j * got["im"].to_numpy(), want, atol=1e-6)
    # no row holds more than some roots of the length, every step passes each sample on once
    assert max(r[1] or 0 for r in sizes) <= 64 * n**0.5 and sum(r[2] or 0 for r in sizes) <= 14 * 2 * n


@pytest.mark.parametrize("n", [96, 4100, 4099], ids=["product", "even", "prime"])
def test_complex_transforms_both_ways(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) + 1j * rng.normal(size=n)
    df = spark.createDataFrame([(1, n, t, float(x[t].real), float(x[t].imag)) for t in range(n)], "g int, n long, t long, re double, im double")
    for sign, want in ((-1, np.fft.fft(x)), (1, np.fft.ifft(x) * n)):
        got = sp.long_transform(df, ["g"], sign).orderBy("k").toArrow()
        assert np.allclose(got["re"].to_numpy() + 1j * got["im"].to_numpy(), want, atol=1e-8)


@pytest.mark.parametrize("whole", [1 << 14, 40], ids=["in one row", "in two steps"])
def test_autocorrelation_against_pairs(spark, monkeypatch, whole):
    monkeypatch.setattr(sp, "WHOLE", whole)
    df, x = _series(spark, [7, 8, 31, 200, 331])
    df = df.withColumn("v", F.when(F.col("t") % 17 != 5, F.col("v"))).filter("not (g = 3 and t between 20 and 24)").union(spark.range(50).selectExpr("9", "50", "int(id)", "2D"))
    got = {(r.g, r.lag): r.r for r in sp.autocorrelation(df, ["g"]).collect()}
    want = {}
    for g, v in x.items():
        n = len(v)
        v = np.where((np.arange(n) % 17 == 5) | ((g == 3) & (np.arange(n) >= 20) & (np.arange(n) <= 24)), np.nan, v)
        z = (v - np.nanmean(v)) / np.nanstd(v)
        for lag in range(1, n // 2 if n >= 8 else 0):
            want[g, lag] = np.nanmean(z[:-lag] * z[lag:])
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-9


@pytest.mark.parametrize("whole", [1 << 14, 40], ids=["in one row", "in two steps"])
def test_bandpass_against_the_whole_transform(spark, monkeypatch, whole):
    monkeypatch.setattr(sp, "WHOLE", whole)
    df, x = _series(spark, [5, 6, 61, 96, 211], 3)
    df = df.withColumn("v", F.col("v") / 40 + 0.5)
    clips = df.select("g", "n").distinct().withColumn("fps", F.lit(20.0))
    got = {(r.g, r.t): r.v for r in sp.temporal_bandpass(df.drop("n").withColumn("p", F.lit(0)), clips, ["g"], ["p"], gain=4.0).collect()}
    for g, v in x.items():
        v, n = v / 40 + 0.5, len(v)
        z, hz = np.fft.rfft(v), np.arange(n // 2 + 1) * 20.0 / n
        want = v if n < 6 else np.clip(v + 4 * np.fft.irfft(np.where((hz >= 0.4) & (hz <= 3), z, 0), n), 0, 1)
        assert np.allclose([got[g, t] for t in range(n)], want, atol=1e-9)


def test_no_pairs_and_no_bins_in_the_plans(spark):
    df, _ = _series(spark, [64])
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (sp.dft(df, ["g"]), sp.autocorrelation(df, ["g"]))]
    assert not any(w in p for p in plans for w in ("Join", "Generate"))
