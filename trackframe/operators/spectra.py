"""Spectra of series of any length: Fourier transforms, band power, band filters, autocorrelation.

A series of up to `WHOLE` samples is packed into one row and transformed there, many series at once. A
longer one is transformed in two keyed steps: with n = n1 * n2, samples n2 apart make rows of n1, and
what comes of them, turned by the step's angle, makes rows of n2. No row holds more than about the root
of the length, and every step passes each sample on once. Lengths without such factors go through a
chirp, which turns the transform into a convolution of a power of two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.functions.scalar import hann, parabolic_offset
from trackframe.operators.series import neighbours, salted_join
from trackframe.session import checkpoint

#: Samples of a series that one row may hold, samples that a worker transforms at once.
WHOLE, CHUNK = 1 << 14, 1 << 20


# ---------------------------------------------------------------- series in rows

def _flat(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Lengths of an array of lists of structs, the fields one after another (null as 0), and where they are known."""
    inner = lists.flatten()
    size = np.diff(np.asarray(lists.offsets))
    held, known = {}, {}
    for name in (f.name for f in inner.type):
        column = inner.field(name)
        known[name] = np.asarray(column.is_valid())
        held[name] = column.fill_null(0).to_numpy(zero_copy_only=False)
    return size, held, known


def _per_row(df: DataFrame, keys: Sequence[str], shape: str, each: Callable) -> DataFrame:
    """Apply `each` to packed rows of equal length `m` together; it returns (rows, columns) of the results.

    `df` has the keys, `m`, further numbers, and `s`, a list of structs. `each` gets the length, the numbers
    of the rows, the row of every sample, the samples' fields, and where these are known; it tells for each
    result the row it belongs to, whose keys are put beside it.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)
    names = [*keys, *[c.split()[0] for c in shape.split(", ")]]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            facts = {c: b.column(len(keys) + i).to_numpy(zero_copy_only=False) for i, c in enumerate(rest) if c != "s"}
            size, held, known = _flat(b.column(len(keys) + rest.index("s")))
            ends = np.concatenate([[0], np.cumsum(size)])
            for length in np.unique(facts["m"]).tolist():
                rows, step = np.flatnonzero(facts["m"] == length), max(1, CHUNK // length)
                for low in range(0, len(rows), step):
                    some = rows[low:low + step]
                    at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in some])
                    row = np.repeat(np.arange(len(some)), size[some])
                    picked, got = each(length, {c: x[some] for c, x in facts.items()}, row, {c: x[at] for c, x in held.items()}, {c: x[at] for c, x in known.items()})
                    back = pa.array(some[picked])
                    yield pa.RecordBatch.from_arrays([*[b.column(k).take(back) for k in range(len(keys))], *[pa.array(x) for x in got]], names=names)

    return df.select(*keys, *rest).mapInArrow(run, kept + shape)


def _packed(series: DataFrame, by: Sequence[str], n: str, t: str, v: str, *more: str) -> DataFrame:
    return series.groupBy(*by, *more, F.col(n).cast("long").alias("m")).agg(F.collect_list(F.struct(F.col(t).cast("long").alias("t"), F.col(v).cast("double").alias("v"))).alias("s"))


def _matrix(n: int, rows: int, row: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One line a series, each sample at its place modulo n; samples of one place are added."""
    return np.bincount(row * n + t % n, v, rows * n).reshape(rows, n)


def _any_long(series: DataFrame, n: str) -> bool:
    return not series.filter(F.col(n) > WHOLE).isEmpty()


# ---------------------------------------------------------------- long series

def two_step(rows: DataFrame, by: Sequence[str], sign: int = -1) -> DataFrame:
    """(by, n1, n2, k, re, im): sums of (re, im) e^(sign 2 pi i k t / n) over t, with n = n1 * n2, for all k.

    `rows` has by, n1, n2, t, re, im; absent places count as 0.
    """
    def small(m: int, fact: dict, row: np.ndarray, held: dict) -> np.ndarray:
        z = _matrix(m, len(fact["m"]), row, held["t"], held["re"]) + 1j * _matrix(m, len(fact["m"]), row, held["t"], held["im"])
        return np.fft.fft(z, axis=1) if sign < 0 else np.fft.ifft(z, axis=1) * m

    def first(m, fact, row, held, known):
        k, whole = np.arange(m), fact["m"] * fact["n2"]
        # the product is reduced in integers, so the angle stays exact
        turn = (fact["low"][:, None] * k[None, :]) % whole[:, None]
        z = small(m, fact, row, held) * np.exp(sign * 2j * np.pi * turn / whole[:, None])
        lines = len(whole)
        return np.repeat(np.arange(lines), m), [np.repeat(fact["m"], m), np.repeat(fact["n2"], m), np.tile(k, lines), np.repeat(fact["low"], m), z.real.ravel(), z.imag.ravel()]

    def second(m, fact, row, held, known):
        z = small(m, fact, row, held)
        k = fact["k1"][:, None] + fact["n1"][:, None] * np.arange(m)[None, :]
        return np.repeat(np.arange(len(k)), m), [np.repeat(fact["n1"], m), np.repeat(fact["m"], m), k.ravel(), z.real.ravel(), z.imag.ravel()]

    sample = F.collect_list(F.struct("t", "re", "im")).alias("s")
    n1, n2 = F.col("n1"), F.col("n2")
    apart = rows.select(*by, n1.alias("m"), "n2", F.pmod("t", n2).alias("low"), F.floor(F.pmod("t", n1 * n2) / n2).cast("long").alias("t"), "re", "im")
    one = _per_row(apart.groupBy(*by, "m", "n2", "low").agg(sample), by, "n1 long, n2 long, k1 long, t long, re double, im double", first)
    two = one.groupBy(*by, "n1", n2.alias("m"), "k1").agg(sample)
    return _per_row(two, by, "n1 long, n2 long, k long, re double, im double", second)


def _power_sizes(length: Column) -> dict[str, Column]:
    """n1 and n2, powers of two, whose product is `length` at least."""
    e = F.ceil(F.log2(length.cast("double")))
    low = F.floor(e / 2)
    return {"n1": F.pow(F.lit(2.0), e - low).cast("long"), "n2": F.pow(F.lit(2.0), low).cast("long")}


def _chirp(j: Column, n: Column) -> tuple[Column, Column]:
    """Cosine and sine of pi j^2 / n, from j^2 modulo 2n, in whole numbers: lengths stay under 2^31."""
    angle = F.pmod(j * j, n * 2).cast("double") * F.lit(float(np.pi)) / n
    return F.cos(angle), F.sin(angle)


def long_transform(rows: DataFrame, by: Sequence[str], sign: int = -1) -> DataFrame:
    """(by, n, k, re, im): sums of (re, im) e^(sign 2 pi i k t / n) over the rows (by, n, t, re, im), for k = 0 .. n - 1."""
    by = list(by)
    # the largest divisor up to the root; a lopsided one is no use
    best = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(F.col("n"))).cast("long")), lambda d: F.col("n") % d == 0))
    sizes = checkpoint(rows.select("n").distinct().withColumn("n2", best).withColumn("n1", (F.col("n") / F.col("n2")).cast("long")).withColumn("even", F.col("n1") <= 64 * F.sqrt("n")))
    d = salted_join(rows, sizes, ["n"], [*by, "t"])
    out = two_step(d.filter("even").select(*by, "n1", "n2", "t", "re", "im"), by, sign).select(*by, (F.col("n1") * F.col("n2")).alias("n"), "k", "re", "im")
    odd = sizes.filter("not even").select("n")
    if odd.isEmpty():
        return out
    # with w = e^(sign pi i t^2 / n): x w, convolved with the conjugate of w, times w
    own, size = [*by, "n"], F.col("n1") * F.col("n2")
    c, q = _chirp(F.col("t"), F.col("n"))
    re, im = F.col("re"), F.col("im")
    a = d.filter("not even").drop("n1", "n2", "even").withColumns(_power_sizes(F.col("n") * 2))
    a = two_step(a.select(*own, "n1", "n2", "t", (re * c - im * q * sign).alias("re"), (re * q * sign + im * c).alias("im")), own)
    w = odd.withColumns(_power_sizes(F.col("n") * 2)).withColumn("t", F.explode(F.sequence(1 - F.col("n"), F.col("n") - 1)))
    w = two_step(w.select("n", "n1", "n2", F.pmod("t", size).alias("t"), c.alias("re"), (q * -sign).alias("im")), ["n"])
    w = w.select("n", "k", F.col("re").alias("wr"), F.col("im").alias("wi"))
    wr, wi = F.col("wr"), F.col("wi")
    both = a.join(w, ["n", "k"]).select(*own, "n1", "n2", F.col("k").alias("t"), (re * wr - im * wi).alias("re"), (re * wi + im * wr).alias("im"))
    back = two_step(both, own, 1).filter(F.col("k") < F.col("n"))
    c, q = _chirp(F.col("k"), F.col("n"))
    return out.union(back.select(*own, "k", ((re * c - im * q * sign) / size).alias("re"), ((re * q * sign + im * c) / size).alias("im")))


def _long_rows(series: DataFrame, by: Sequence[str], n: str, t: str, v: str | Column) -> DataFrame:
    value = F.col(v) if isinstance(v, str) else v
    return series.select(*by, F.col(n).cast("long").alias("n"), F.pmod(F.col(t), F.col(n)).cast("long").alias("t"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))


# ---------------------------------------------------------------- spectra

def dft(series: DataFrame, by: Sequence[str], n: str = "n", t: str = "t", v: str = "v") -> DataFrame:
    """Real-input DFT: (by, k, n, re, im, mag) for k = 0 .. n/2. Absent and null samples count as 0."""
    by = list(by)

    def spectrum(size, fact, row, held, known):
        z = np.fft.rfft(_matrix(size, len(fact["m"]), row, held["t"], held["v"]), axis=1)
        lines, bins = z.shape
        return np.repeat(np.arange(lines), bins), [np.repeat(fact["m"], bins), np.tile(np.arange(bins), lines), z.real.ravel(), z.imag.ravel()]

    kind = series.schema[n].dataType.simpleString()
    short = series.filter(F.col(n).between(1, WHOLE))
    out = _per_row(_packed(short, by, n, t, v), by, "n long, k long, re double, im double", spectrum)
    if _any_long(series, n):
        out = out.union(long_transform(_long_rows(series.filter(F.col(n) > WHOLE), by, n, t, v), by).filter(F.col("k") <= F.floor(F.col("n") / 2)))
    return out.select(*by, "k", F.col("n").cast(kind).alias(n), "re", "im", F.hypot("re", "im").alias("mag"))


def spectral_peak(spec: DataFrame, by: Sequence[str], first_bin: int = 1) -> DataFrame:
    """Strongest bin per series with its neighbours: (by, n, k, mag, mag_lo, mag_hi, flatness).

    The lowest bin wins a tie. k is 0 when the whole spectrum is zero.
    """
    by = list(by)
    usable = spec.filter(F.col("k") >= first_bin)
    power = F.pow("mag", 2) + 1e-12
    top = usable.groupBy(*by, "n").agg(
        F.max(F.struct("mag", (-F.col("k")).alias("neg"))).alias("_top"),
        (F.exp(F.avg(F.log(power))) / F.avg(power)).alias("flatness"))
    top = top.select(*by, "n", "flatness", F.col("_top.mag").alias("mag"),
                     F.when(F.col("_top.mag") > 0, -F.col("_top.neg")).otherwise(F.lit(0)).cast("long").alias("peak"))
    around = top.select(*by, F.explode(F.array(F.col("peak") - 1, F.col("peak") + 1)).alias("k"),
                        F.col("peak").alias("_p"))
    # bin 0 counts as zero: the mean is not part of the spectrum
    lo_hi = (around.join(spec.select(*by, "k", "mag"), by + ["k"], "left")
             .groupBy(*by).agg(
                 F.max(F.when(F.col("k") < F.col("_p"), F.when(F.col("k") == 0, 0.0).otherwise(F.col("mag")))).alias("mag_lo"),
                 F.max(F.when(F.col("k") > F.col("_p"), F.col("mag"))).alias("mag_hi")))
    return top.join(lo_hi, by).withColumnRenamed("peak", "k")


def refined_bin(k: Column, n: Column, lo: Column, mid: Column, hi: Column, least: int = 1) -> Column:
    """Peak bin plus its log-parabolic offset, where both neighbours exist."""
    inside = (k >= least) & (k < F.floor(n / 2))
    return F.when(inside, k + parabolic_offset(lo, mid, hi)).otherwise(k.cast("double"))


def band_power(series: DataFrame, by: Sequence[str], fps: str, lo: float = 0.5, hi: float = 1.5,
               n: str = "n", t: str = "t", v: str = "v") -> DataFrame:
    """Share of Hann-windowed power between lo and hi Hz and the period of the strongest bin there.

    (by, share, period); both 0 for fewer than 8 samples, no power, or no bin in the band.
    """
    by = list(by)
    mean = series.groupBy(*by).agg(F.avg(v).alias("_m"))
    w = salted_join(series, mean, by, [t]).withColumn("_w", (F.col(v) - F.col("_m")) * hann(F.col(t), F.col(n)))
    spec = dft(w.select(*by, n, fps, t, F.col("_w").alias("v")), by + [fps], n, t, "v").filter(F.col("k") > 0)
    p = F.pow("mag", 2)
    per = F.col(n) / F.col("k")
    sel = (per >= F.col(fps) / hi) & (per <= F.col(fps) / lo)
    out = spec.groupBy(*by, n, fps).agg(
        F.sum(p).alias("_tot"), F.sum(F.when(sel, p)).alias("_in"),
        F.max(F.when(sel, F.struct(p.alias("p"), (-F.col("k")).alias("neg")))).alias("_top"))
    ok = (F.col(n) >= 8) & F.col("_in").isNotNull() & (F.col("_tot") > 0)
    return out.select(*by, F.when(ok, F.col("_in") / F.col("_tot")).otherwise(0.0).alias("share"),
                      F.when(ok, F.col(n) / -F.col("_top.neg") / F.col(fps)).otherwise(0.0).alias("period"))


def temporal_bandpass(pixels: DataFrame, clips: DataFrame, by: Sequence[str], px: Sequence[str],
                      lo: float = 0.4, hi: float = 3.0, gain: float = 12.0, t: str = "t", v: str = "v") -> DataFrame:
    """Amplify each pixel's motion between lo and hi Hz and clip to 0..1. Clips need n, fps; n < 6 passes through.

    A pixel's samples stay together: forward, all bins outside the band to 0, and back, in one row where
    they fit and in two keyed steps each way where they don't.
    """
    by, px = list(by), list(px)
    base = salted_join(pixels, clips.select(*by, F.col("n").cast("long").alias("n"), "fps"), by, px)
    key = [*by, *px]

    def clipped(value: Column, band: Column) -> Column:
        return F.least(F.greatest(value + F.coalesce(band, F.lit(0.0)) * gain, F.lit(0.0)), F.lit(1.0))

    def filtered(size, fact, row, held, known):
        z = np.fft.rfft(_matrix(size, len(fact["m"]), row, held["t"], held["v"]), axis=1)
        hz = np.arange(z.shape[1])[None, :] * fact["fps"][:, None] / size
        band = np.fft.irfft(np.where((hz >= lo) & (hz <= hi), z, 0), size, axis=1)
        # a sample is met at its own place; what was unknown stays unknown
        return row, [held["t"], pa.array(held["v"], mask=~known["v"]), band[row, held["t"] % size]]

    few = base.filter(F.col("n") < 6).select(*key, t, F.col(v).cast("double").alias(v))
    mid = base.filter(F.col("n").between(6, WHOLE))
    kind = pixels.schema[t].dataType.simpleString()
    got = _per_row(_packed(mid, key, "n", t, v, "fps"), key, "t long, v double, band double", filtered)
    out = few.union(got.select(*key, F.col("t").cast(kind).alias(t), clipped(F.col("v"), F.col("band")).alias(v)))
    if not _any_long(clips, "n"):
        return out
    long = base.filter(F.col("n") > WHOLE)
    spec = long_transform(_long_rows(long, [*key, "fps"], "n", t, v), [*key, "fps"])
    hz = F.least(F.col("k"), F.col("n") - F.col("k")) * F.col("fps") / F.col("n")
    back = long_transform(spec.filter((hz >= lo) & (hz <= hi)).select(*key, "n", F.col("k").alias("t"), "re", "im"), key, 1)
    back = back.select(*key, F.col("k").alias("t"), (F.col("re") / F.col("n")).alias("band"))
    joined = long.withColumn("_at", F.pmod(F.col(t), F.col("n")).cast("long")).join(back.select(*key, F.col("t").alias("_at"), "band"), [*key, "_at"], "left")
    return out.union(joined.select(*key, t, clipped(F.col(v).cast("double"), F.col("band")).alias(v)))


# ---------------------------------------------------------------- autocorrelation

def autocorrelation(series: DataFrame, by: Sequence[str], n: str = "n", t: str = "t", v: str = "v") -> DataFrame:
    """(by, n, lag, r) for lags 1 .. n/2 - 1 of the standardized series; n < 8 or flat series give no rows.

    The sums over pairs of samples come from the power spectrum of the series, padded with zeros to twice its
    length, and the numbers of pairs from that of its known places: no sample meets another.
    """
    by = list(by)
    kind = series.schema[n].dataType.simpleString()

    def lags(size, fact, row, held, known):
        lines, wide = len(fact["m"]), 1 << (2 * size - 1).bit_length()
        ok = known["v"].astype(np.float64)
        count = np.maximum(np.bincount(row, ok, lines), 1)
        mean = np.bincount(row, held["v"] * ok, lines) / count
        off = (held["v"] - mean[row]) * ok
        sd = np.sqrt(np.bincount(row, off * off, lines) / count)
        z = _matrix(size, lines, row, held["t"], off / np.where(sd > 0, sd, 1)[row])
        power = lambda x: np.fft.irfft(np.abs(np.fft.rfft(x, wide, axis=1)) ** 2, wide, axis=1)[:, 1:size // 2]
        pairs = np.rint(power(_matrix(size, lines, row, held["t"], ok)))
        line, lag = np.nonzero((pairs > 0) & (sd >= 1e-9)[:, None])
        return line, [fact["m"][line], lag + 1, power(z)[line, lag] / pairs[line, lag]]

    out = _per_row(_packed(series.filter(F.col(n).between(8, WHOLE)), by, n, t, v), by, "n long, lag long, r double", lags)
    if _any_long(series, n):
        out = out.union(_long_lags(series.filter(F.col(n) > WHOLE), by, n, t, v))
    return out.select(*by, F.col("n").cast(kind).alias(n), "lag", "r")


def _long_lags(series: DataFrame, by: Sequence[str], n: str, t: str, v: str) -> DataFrame:
    stats = series.groupBy(*by).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_sd"))
    z = salted_join(series.select(*by, n, t, v), stats, by, [t]).filter((F.col("_sd") >= 1e-9) & F.col(v).isNotNull())
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), ((F.col(v) - F.col("_m")) / F.col("_sd")).alias("re")), F.struct(F.lit(1).alias("kind"), F.lit(1.0).alias("re"))))
    rows = z.select(*by, F.col(n).cast("long").alias("n"), F.col(t).cast("long").alias("t"), both.alias("_b")).select(*by, "n", "t", "_b.*", F.lit(0.0).alias("im"))
    own = [*by, "n", "kind"]
    there = two_step(rows.withColumns(_power_sizes(F.col("n") * 2)), own)
    power = there.select(*own, "n1", "n2", F.col("k").alias("t"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), F.lit(0.0).alias("im"))
    back = two_step(power, own, 1).filter((F.col("k") >= 1) & (F.col("k") < F.floor(F.col("n") / 2))).withColumn("c", F.col("re") / (F.col("n1") * F.col("n2")))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("c")))
    got = back.groupBy(*by, "n", F.col("k").alias("lag")).agg(pick(0).alias("s"), F.round(pick(1)).alias("c"))
    return got.filter("c > 0").select(*by, "n", "lag", (F.col("s") / F.col("c")).alias("r"))


def best_lag(series: DataFrame, by: Sequence[str], n: str = "n", t: str = "t", v: str = "v") -> DataFrame:
    """(by, corr, lag): the strongest positive local maximum of the autocorrelation, 0 and 0 if none."""
    by = list(by)
    r = autocorrelation(series, by, n, t, v)
    near = neighbours(r, by, "lag", ["r"])
    local = F.col("prev_r").isNotNull() & F.col("next_r").isNotNull() & (F.col("r") > F.col("prev_r")) \
        & (F.col("r") >= F.col("next_r")) & (F.col("r") > 0)
    best = near.filter(local).groupBy(*by).agg(F.max(F.struct("r", (-F.col("lag")).alias("neg"))).alias("_b"))
    return (series.select(*by).distinct().join(best, by, "left")
            .select(*by, F.coalesce(F.round("_b.r", 3), F.lit(0.0)).alias("corr"),
                    F.coalesce(-F.col("_b.neg"), F.lit(0)).cast("long").alias("lag")))
