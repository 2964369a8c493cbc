"""Contract tables: boxes, policy, matching, corrections, labels."""

import random

import pytest
from pyspark.sql import functions as F

from trackframe import dims
from trackframe.functions import names as nm
from trackframe.operators import contracts as ct
from trackframe.operators import matching as mt


@pytest.mark.parametrize("box,want", [([0.8, 0.1, 0.5, 0.2], [0.8, 0.1, 0.2, 0.2]), ([0.1, 0.9, 0.2, 0.5], [0.1, 0.9, 0.2, 0.1]), ([float("nan"), 0.0, 0.5, 0.5], [0.0, 0.0, 1.0, 1.0]),
                                      ([0.0, 0.0, float("inf"), 0.5], [0.0, 0.0, 1.0, 1.0]), ([0.2, 0.2], [0.0, 0.0, 1.0, 1.0]), ([0.2, 0.2, 0.0, 0.0], [0.2, 0.2, 0.8, 0.8])])
def test_finite_box(spark, box, want):
    d = spark.createDataFrame([(box,)], "b array<double>")
    assert d.select(ct.clamp_box(F.col("b"), "finite").alias("o")).first().o == pytest.approx(want)


POLICY = [([0.85], "tune", True, False, 0), ([0.2], "wrong_class", False, False, 0), ([0.3], "tune", True, True, 0), ([0.3], "tune", False, False, 0), ([0.30, 0.31], "tune", True, False, 1),
          ([0.30, 0.50], "tune", True, True, 1), ([0.50, 0.20], "tune", True, False, 0), ([0.1, 0.3, 0.5], "tune", True, False, 2), ([0.5, 0.5], "tune", True, False, 0)]


def test_policy_and_best(spark):
    rows = [(s, i, v, x, d) for s, (xs, v, d, _, _) in enumerate(POLICY) for i, x in enumerate(xs)]
    h = spark.createDataFrame(rows, "session long, i long, verdict string, score double, has_deltas boolean")
    last = {r.session: r.go for r in ct.judge_policy(h).groupBy("session").agg(F.max_by("go", "i").alias("go")).collect()}
    best = {r.session: r.best for r in ct.judge_best(h).collect()}
    assert last == {s: p[3] for s, p in enumerate(POLICY)} and best == {s: p[4] for s, p in enumerate(POLICY)}


def test_matching_equals_greedy(spark):
    rng = random.Random(5)
    classes = list(dims.MOTION_CLASSES)
    sw = [(i, rng.choice(classes + [""])) for i in range(60)]
    lb = [(p, f"L{p}", rng.choice(classes + [""]), round(rng.random(), 2)) for p in range(50)]
    free = sorted((l for l in lb if l[2] and l[3] >= 0.35), key=lambda l: -l[3])
    used, want = set(), {}
    for i, c in sw:
        hit = next((l for l in free if l[2] == c and l[1] not in used), None)
        if hit:
            used.add(hit[1])
            want[i] = hit[1]
    pairs, rest = mt.match_to_layers(spark.createDataFrame(sw, "idx long, class string"), spark.createDataFrame(lb, "pos long, id string, class string, confidence double"))
    assert {r.idx: r.id for r in pairs.collect()} == want
    assert {r.idx for r in rest.collect()} == {i for i, _ in sw} - set(want)


def test_deltas_wrap_clamp_and_keep_other_keys(spark):
    d = spark.createDataFrame([({"frequency": 1.0, "amplitude": 0.95, "direction": 350.0, "leaf": 1.0}, {"amplitude": 0.2, "direction": 45.0, "frequency": 0.5})], "params map<string,double>, deltas map<string,double>")
    r = ct.apply_deltas(d).first()
    assert r.next_params == {"frequency": 1.5, "amplitude": 1.0, "direction": 35.0, "leaf": 1.0} and len(r.notes) == 1


def test_labels(spark):
    raw = '{"labels":[{"id":"L1","label":"flag","motion_class":"cloth","confidence":0.91},{"id":"L2","motion_class":"flock","confidence":4.2},{"id":"L3","motion_class":"NULL","confidence":"high"},{"id":"L9","motion_class":"cloth"},"x"]}'
    d = spark.createDataFrame([(1, raw)], "doc_id long, raw string")
    layers = spark.createDataFrame([(1, f"L{i}") for i in range(1, 5)], "doc_id long, id string")
    labels, notes = ct.normalize_layer_labels(d, layers)
    got = {r.id: (r.motion_class, r.applicator, r.deforms, r.confidence) for r in labels.collect()}
    assert got == {"L1": ("cloth", "wave", "mesh", 0.91), "L2": ("flock", "flock_drift", "rigid", 1.0), "L3": ("", "", "rigid", 0.5)}
    assert {(r.id, r.note) for r in notes.collect()} == {("", "left out: label without fields"), ("L9", "left out: no such layer"), ("L4", "has no label")}


def test_names(spark):
    names = ["Left_Hand-2", "RightLeg", "Handle", "Leg", "Torso", "arm_x5F_left"]
    d = spark.createDataFrame([(n,) for n in names], "n string").select("n", nm.limb_role(F.col("n")).alias("r"), nm.decode_escaped_name(F.col("n")).alias("d"))
    got = {r.n: (r.r.role, r.r.skipped) for r in d.collect()}
    assert got["Left_Hand-2"] == ("arm-l", None) and got["RightLeg"] == ("leg-r", None) and got["Handle"] == (None, None)
    assert got["Leg"] == (None, "no left or right") and got["Torso"] == (None, "torso-like name")
    assert d.filter("n = 'arm_x5F_left'").first().d == "arm_left"


def test_nearest_is_exact(spark):
    rng = random.Random(2)
    a = [(1, i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(40)]
    b = [(1, i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(30)]
    got = {r.a: r.b for r in mt.nearest(spark.createDataFrame(a, "g long, a long, ax double, ay double"), spark.createDataFrame(b, "g long, b long, bx double, by_ double"), ["g"], "a", "b").collect()}
    assert got == {i: min(b, key=lambda q: (q[2] - x) ** 2 + (q[3] - y) ** 2)[1] for _, i, x, y in a}


def test_a_document_is_parsed_once_and_an_item_read_once(spark):
    df = spark.createDataFrame([(1, '{"motions": [{"class": "flow", "bbox": [0, 0, 1, 1]}], "verdict": "tune"}')], "doc_id long, raw string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    motions, _, documents = ct.normalize_decomposition(df)
    for p, reads in ((plan(motions), 6), (plan(documents), 4), (plan(ct.normalize_judgement(df)), 6)):
        assert p.count("parseJson") == 1 and p.count("variant_get") <= reads
