"""What a salted join may gather in the driver."""

import pytest
from pyspark.sql import functions as F

from trackframe.operators.series import salted_join
from trackframe.session import checkpoint


@pytest.fixture
def threshold(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


@pytest.mark.parametrize("share", [0.5, 2, 20])
def test_copies_for_the_salts_are_never_gathered(spark, threshold, share):
    keys = list(range(2000))
    small = checkpoint(spark.createDataFrame([(k, f"group {k * 7919}") for k in keys] + [(3, "twice"), (None, "none")], "clip long, name string").coalesce(1))
    big = checkpoint(spark.createDataFrame([(k % 2500, k) for k in range(6000)] + [(None, 1)], "clip long, t long"))
    # the threshold is `share` times what Spark takes the small side for
    threshold(int(share * int(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    for how in ("inner", "left"):
        got = salted_join(big, small, ["clip"], ["t"], how)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan or "Broadcast" not in plan
        assert got.columns == ["clip", "t", "name"]
        want = big.join(small, ["clip"], how)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    kept = salted_join(big, small, ["clip"], ["t"], keep_salt=True)
    assert set(kept.columns) == {"clip", "t", "name", "_salt"} and kept.filter(F.col("_salt").isNull()).isEmpty()
