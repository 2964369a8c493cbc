"""What travels when tables grow: the planner can't see how many rows an explode makes of one."""

from pyspark.sql import functions as F

from trackframe.operators import contracts as ct
from trackframe.operators import regions as rg
from trackframe.plans.analyze import analyze_batch
from trackframe.plans.q_regions import PROFILES, PSCHEMA
from trackframe.sources import sampling as sm


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_meet_their_clips_without_the_driver(spark):
    clips = spark.range(50).select(F.col("id").alias("clip"), F.lit(60.0).alias("fps"), (F.col("id") * 6 + 1).alias("total"))
    frames = clips.select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("t"))
    for d, step, cap in ((sm.sample_stride(frames, clips), 3, 160), (sm.sample_decimate(frames, clips), 4, 160)):
        assert "Broadcast" not in plan(d)
        want = {(c, t, t // step) for c in range(50) for t in range(0, c * 6 + 1, step) if t // step < cap}
        assert {(r.clip, r.t, r.i) for r in d.collect()} == want


def test_keys_travel_and_not_the_parts_of_names(spark):
    files = spark.range(200).select(F.col("id").alias("clip"), F.concat(F.lit("My Small RING "), F.col("id").cast("string"), F.lit(".mp4")).alias("filename"))
    d = rg.profile_match(files, spark.createDataFrame(PROFILES, PSCHEMA))
    lines = plan(d).splitlines()
    sent = next(i for i, line in enumerate(lines) if "BroadcastExchange" in line)
    assert not any("Generate" in line for line in lines[sent:])
    assert {(r.clip, r.key) for r in d.collect()} == {(i, "small ring") for i in range(200)}


def test_even_picks_leave_their_clip_row_once(spark):
    clips = spark.range(1, 130).select(F.col("id").alias("clip"), F.col("id").alias("total"))
    d = sm.sample_even(clips, 48)
    assert "Aggregate" not in plan(d) and "Exchange" not in plan(d)
    want = {}
    for c in range(1, 130):
        for i in range(48):
            want.setdefault((c, round(i * (c - 1) / 47)), i)
    got = d.select("clip", "t", "i").collect()
    assert len(got) == len(want) and {(r.clip, r.t): r.i for r in got} == want


def test_each_label_table_reads_the_answers_once(spark, tmp_path):
    raw = '{"labels":["x",{"id":"L1","motion_class":"wobble"},{"id":"L1","label":"b"},{"id":"L9"},{"id":"L9"}]}'
    spark.createDataFrame([(1, raw), (2, "oops")], "doc_id long, raw string").write.parquet(str(tmp_path / "raw"))
    layers = spark.createDataFrame([(d, i) for d in (1, 2) for i in ("L1", "L2")], "doc_id long, id string")
    labels, notes = ct.normalize_layer_labels(spark.read.parquet(str(tmp_path / "raw")), layers)
    assert all(plan(d).count("FileScan") == 1 for d in (labels, notes))
    assert [(r.doc_id, r.id, r.pos) for r in labels.collect()] == [(1, "L1", 1)]
    assert sorted((r.doc_id, r.id, r.note) for r in notes.collect()) == [
        (1, "", "left out: label without fields"), (1, "L1", "no such motion class, taken as none"), (1, "L1", "second label left out"), (1, "L2", "has no label"),
        (1, "L9", "left out: no such layer"), (1, "L9", "left out: no such layer"), (2, "L1", "has no label"), (2, "L2", "has no label")]


def test_a_run_for_regions_alone_builds_nothing_else(spark):
    flow = spark.range(16 * 64).select(F.lit(1).cast("long").alias("clip"), F.floor(F.col("id") / 64).alias("t"), F.floor(F.col("id") / 8 % 8).alias("y"), (F.col("id") % 8).alias("x"),
                                       F.sin(F.col("id") / 64 * 1.0).alias("vx"), F.lit(0.1).alias("vy"))
    clips = spark.createDataFrame([(1, 20.0, 8.0, 8.0, 4, 16, "cloth", "flow")], "clip long, fps double, width double, height double, grid long, frames long, class string, engine string")
    assert set(analyze_batch(flow, clips, want=["regions"])) == {"regions"}
    assert "regions" not in analyze_batch(flow, clips, want=["params"])
