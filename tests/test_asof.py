import numpy as np
from pyspark.sql import functions as F

from trackframe.operators import paths as pt
from trackframe.operators import series as se


def test_a_long_polyline_on_a_short_axis_takes_many_tasks(spark, monkeypatch):
    """A million points with positions in 0..1: ranges hold even shares, values are those of linear interpolation."""
    shares = []
    real = se.checkpoint
    monkeypatch.setattr(se, "checkpoint", lambda df: shares.append(real(df)) or shares[-1])
    n = 1_000_000
    samples = spark.range(n).select(F.lit("a").alias("g"), (F.col("id") / n).alias("at"), (F.col("id") % 1000).cast("double").alias("x"))
    instants = spark.range(2000).select(F.lit("a").alias("g"), ((F.col("id") * 7919 % 2000) / 2000 + 1e-7).alias("at"), "id")
    got = pt.bracket_sample(samples, instants, ["g"], "at", ["x"]).orderBy("id").toArrow()
    i = np.arange(2000) * 7919 % 2000 / 2000 + 1e-7
    assert np.allclose(got["x"].to_numpy(), np.interp(i, np.arange(n) / n, np.arange(n) % 1000), atol=1e-6)
    sizes = [r["count"] for r in shares[0].groupBy("_blk").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_ties_ends_and_groups_of_the_merge(spark):
    samples = spark.createDataFrame([(1, 0.0, 5.0), (1, 2.0, 7.0), (1, 2.0, 7.0), (2, 1.0, -1.0)], "g int, at double, x double")
    instants = spark.createDataFrame([(1, t, "k") for t in (-1.0, 0.0, 0.5, 2.0, 2.0, 9.0)] + [(2, 0.0, "k"), (3, 1.0, "k")], "g int, at double, note string")
    got = sorted((r.g, r.at, r.x) for r in pt.bracket_sample(samples, instants, ["g"], "at", ["x"]).filter("g < 3").collect())
    assert got == [(1, -1.0, 5.0), (1, 0.0, 5.0), (1, 0.5, 5.5), (1, 2.0, 7.0), (1, 2.0, 7.0), (1, 9.0, 7.0), (2, 0.0, -1.0)]
    assert [r.x for r in pt.bracket_sample(samples, instants, ["g"], "at", ["x"]).filter("g = 3").collect()] == [None]
