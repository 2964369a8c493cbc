"""Sizes and values that have no limit, and rows that can't be used but must not vanish."""

from pyspark.sql import functions as F

from trackframe import dims
from trackframe.operators import matching as mt
from trackframe.operators import regions as rg


def test_chain_of_a_hundred_layers_and_a_cycle(spark):
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None) for i in range(101)] + [(2, "a", "b"), (2, "b", "c"), (2, "c", "a")]
    got = mt.ancestors(spark.createDataFrame(rows, "art long, id string, parent string"))
    assert got.filter("art = 1 and id = 'n100'").agg(F.count("*"), F.max("depth")).first() == (100, 100)
    assert got.filter("art = 1").count() == 100 * 101 // 2
    assert {(r.id, r.ancestor, r.depth) for r in got.filter("art = 2").collect()} >= {("a", "b", 1), ("a", "c", 2), ("a", "a", 3)}


def test_components_in_wide_frames(spark):
    wide = 1 << 20
    cells = [(0, wide + 5), (1, 5), (0, wide - 1), (1, 0), (1, wide + 6), (-1, -3)]
    got = {(r.gy, r.gx): tuple(r.comp) for r in rg.components8(spark.createDataFrame([(1, *c) for c in cells], "clip long, gy long, gx long"), ["clip"]).collect()}
    assert got == {(0, wide + 5): (0, wide + 5), (1, wide + 6): (0, wide + 5), (1, 5): (1, 5), (0, wide - 1): (0, wide - 1), (1, 0): (1, 0), (-1, -3): (-1, -3)}


def test_layers_with_long_and_negative_positions(spark):
    rows = [(1, "root", None, 0, "", 1.0, 1.0), (1, "x", "root", 10**13, "x", 0.1, 0.1), (1, "y", "root", 9 * 10**12, "y", 0.1, 0.1), (1, "z", "root", -5, "z", 0.1, 0.1), (1, "w", "root", 3, "w", 1.0, 1.0)]
    lay = spark.createDataFrame(rows, "art long, id string, parent string, pos long, name string, w double, h double")
    assert [r.id for r in mt.layer_cover(lay, cap=2).orderBy("rank").collect()] == ["z", "y"]
    assert {(r.id, r.why) for r in mt.layer_cover_rest(lay, cap=2).collect()} == {("x", "over the cap"), ("w", "covers the canvas")}


def test_points_that_cannot_be_compared(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, None, 0.0), (1, 3, float("nan"), 1.0), (1, 4, float("inf"), 1.0)], "g long, i long, ax double, ay double")
    b = spark.createDataFrame([(1, 7, 3.0, 4.0), (1, 8, None, 0.0), (1, 9, float("nan"), 0.0)], "g long, j long, bx double, by_ double")
    got = {r.i: (r.j, r.distance) for r in mt.nearest(a, b, ["g"], "i", "j").collect()}
    assert got == {1: (7, 5.0), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_rule_without_engines_still_matches(spark):
    rules = dims.route_rules(spark).collect()
    cls = "articulated"
    req = spark.createDataFrame([(1, cls, None, None, False)], "id long, class string, subject_type string, count string, has_text_prompt boolean")
    req = req.withColumn("count", F.col("count").cast(dict(dims.route_rules(spark).dtypes)["count"]))
    none = spark.createDataFrame([("unheard of", True, "")], "name string, available boolean, reason string")
    got = mt.resolve_route(req, none).first()
    assert rules and got.engine == dims.CLASS_FLOOR[cls] and not got.usable and got.reason.endswith("floor not usable (not registered)")
    gated = spark.createDataFrame([(dims.CLASS_FLOOR[cls], False, "no weights")], "name string, available boolean, reason string")
    assert mt.resolve_route(req, gated).first().reason.endswith("floor not usable (no weights)")
    there = spark.createDataFrame([(dims.CLASS_FLOOR[cls], True, "")], "name string, available boolean, reason string")
    assert mt.resolve_route(req, there).first().usable
