"""Copies of query blocks never meet in the driver."""

import numpy as np
from pyspark.sql import functions as F

from trackframe.llm.topk import top_products


def test_copies_for_the_lanes_are_not_broadcast(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)] + [(7, [1.0] * 4), (None, [1.0] * 4)]
    got = top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, k=3, block=32, queries=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [lane" in plan and not any("BroadcastHashJoin [lane" in x for x in plan.splitlines())
    assert {r.query_id for r in got.collect()} == set(range(0, 300, 50)) and got.count() == 18
