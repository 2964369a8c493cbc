"""Masks, cloth, pose goldens, playback and streams against plain loops."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import cloth as cl
from trackframe.operators import masks as mk
from trackframe.operators import playback as pb
from trackframe.operators import pose as ps
from trackframe.sources import documents as dc
from trackframe.streaming import judge as sj


def test_morphology_matches_loops(spark):
    rng = np.random.default_rng(4)
    img = rng.random((12, 15)) > 0.25
    d = spark.createDataFrame([(1, int(y), int(x), 12, 15) for y, x in zip(*np.where(img))], "clip long, y long, x long, h long, w long")

    def step(a, dilate):
        out = np.zeros_like(a)
        for y in range(12):
            for x in range(15):
                seen = [a[y + i, x + j] for i, j in mk.ELLIPSE if 0 <= y + i < 12 and 0 <= x + j < 15]
                out[y, x] = any(seen) if dilate else all(seen)
        return out

    want = step(step(step(step(img, False), True), True), False)
    got = np.zeros_like(img)
    for r in mk.open_close(d).collect():
        got[r.y, r.x] = True
    assert (got == want).all() and len(mk.ELLIPSE) == 17


def test_run_lengths_round_trip(spark):
    px = [(1, 0, 0), (1, 0, 1), (1, 2, 3), (2, 1, 1)]
    d = spark.createDataFrame(px, "clip long, y long, x long")
    sizes = spark.createDataFrame([(c, 3, 4) for c in (1, 2, 3)], "clip long, h int, w int")
    runs = mk.rle_encode(d, sizes)
    got = {}
    for r in runs.orderBy("clip", "k").collect():
        got.setdefault(r.clip, []).append(r.length)
    assert got == {1: [0, 2, 9, 1], 2: [5, 1, 6], 3: [12]}
    assert sorted(tuple(r) for r in mk.rle_decode(runs, sizes).collect()) == sorted(px)


def test_fit_modes_matches_loop(spark):
    rng = np.random.default_rng(9)
    u = np.linspace(0, 1, 25)
    rows = np.sin(np.pi * 0.5 * u)[None] * rng.normal(size=(6, 1)) + rng.normal(size=(6, 25)) * 0.02
    rows[:, 7] += 1.0
    d = spark.createDataFrame([(1, f, s, float(u[s]), float(rows[f, s])) for f in range(6) for s in range(25)], "clip long, frame long, station long, u double, d double")
    got = np.zeros_like(rows)
    for r in cl.fit_modes(d).collect():
        got[r.frame, r.station] = r.d
    # an outlying station is outvoted and the pinned end stays exactly where it is
    assert np.abs(got[:, 0]).max() < 1e-12 and np.abs(got[:, 7] - np.delete(rows, 7, 1)[:, 6:8].mean(axis=1)).max() < 0.2


def test_track_columns_follows_the_near_lobe(spark):
    rows = [(1, 0, c, s, s + 20) for c in range(10) for s in (20,)] + [(1, 0, c, 60, 90) for c in range(4, 8)]
    runs = spark.createDataFrame(rows, "clip long, frame long, col long, start long, stop long")
    seeds = spark.createDataFrame([(1, 0)], "clip long, seed long")
    mids = {r.col: r.mid for r in cl.track_columns(runs, seeds, 100.0).collect()}
    assert mids == {c: 29.5 for c in range(10)}


def walk(axis, frames=60, fps=15.0):
    joints = {j: (0.5, i / 13, 0.0) for i, j in enumerate(ps.JOINTS)}
    rows = []
    for f in range(frames):
        s = 0.25 * np.sin(2 * np.pi * 1.0 * f / fps)
        for j, (x, y, z) in joints.items():
            k = {"l_ank": s, "r_ank": -s, "l_knee": s / 2, "r_knee": -s / 2}.get(j, 0.0)
            rows.append((1, f, j, float(x + (k if axis == "x" else 0)), float(y), 0.9, float(z + (k if axis == "z" else 0))))
    return rows


@pytest.mark.parametrize("axis,stride", [("x", "image"), ("z", "depth")])
def test_walks_are_found(spark, axis, stride):
    pose = spark.createDataFrame(walk(axis), "clip long, frame long, joint string, x double, y double, vis double, z double")
    g = ps.gait(pose, spark.createDataFrame([(1, 15.0)], "clip long, fps double")).first()
    assert g.walkable and g.stride_axis == stride and g.period == 15


GOLDEN = os.environ.get("TRACKFRAME_GOLDEN_DIR", "")


@pytest.mark.skipif(not GOLDEN, reason="set TRACKFRAME_GOLDEN_DIR to a folder of recorded motion documents")
def test_recorded_results(spark):
    docs = dc.read_motion_json(spark, GOLDEN)
    raw = {}
    for p in glob.glob(f"{GOLDEN}/*.json"):
        m = json.load(open(p))
        raw[m["id"]] = m
    pose = dc.pose_rows(docs).withColumnRenamed("id", "clip")
    fps = docs.filter("pose IS NOT NULL").select(F.col("id").alias("clip"), F.col("pose.fps").alias("fps"))
    for r in ps.gait(pose, fps).collect():
        want = raw[r.clip]["pose"]["gait"]
        for k in ("score", "period", "foot_gap", "periodicity", "ankle_visibility", "walkable", "stride_axis", "depth_gap", "depth_antiphase"):
            assert r[k] == pytest.approx(want[k]) if not isinstance(want[k], str) else r[k] == want[k]
        assert [r.depth_band_l, r.depth_band_r] == pytest.approx(want["depth_band"]) and [r.depth_period_l, r.depth_period_r] == pytest.approx(want["depth_period"])
    line = dc.centreline_rows(docs).withColumnRenamed("id", "clip")
    for r in cl.cloth_measure(line, 24.0).collect():
        want = raw[r.clip]["centreline"]["measured"]
        for k in r.asDict():
            if k != "clip":
                assert r[k] == want[k] if isinstance(want[k], str) else r[k] == pytest.approx(want[k], abs=1.1e-3 if k == "phase_linearity_resid_rad" else 2e-5)


def test_mls_keeps_controls_and_rotates_rigidly(spark):
    th = 0.3
    ctl = [(1, float(x), float(y), x * np.cos(th) - y * np.sin(th), x * np.sin(th) + y * np.cos(th)) for x in range(3) for y in range(3)]
    pts = [(1, 0, 1.0, 2.0), (1, 1, 0.4, 1.7)]
    got = {r.pid: r for r in pb.mls_warp(spark.createDataFrame(pts, "clip long, pid long, x double, y double"), spark.createDataFrame([(a, b, c, float(d), float(e)) for a, b, c, d, e in ctl], "clip long, x double, y double, qx double, qy double")).collect()}
    for _, p, x, y in pts:
        assert (got[p].x, got[p].y) == pytest.approx((x * np.cos(th) - y * np.sin(th), x * np.sin(th) + y * np.cos(th)))
    assert got[1].rot == pytest.approx(np.degrees(th))


def test_judge_stream_stops_and_resets(spark, tmp_path):
    rows = [(1, 0, "tune", 0.3, True), (1, 1, "tune", 0.31, True), (1, 2, "tune", 0.9, True), (1, 3, "reset", 0.0, False), (1, 4, "tune", 0.2, True)]
    src = spark.createDataFrame([(s, q, v, x, d, 1000 + q) for s, q, v, x, d in rows], "session long, seq long, verdict string, score double, has_deltas boolean, sec long")
    src = src.select("session", "seq", "verdict", "score", "has_deltas", F.timestamp_seconds("sec").alias("ts")).coalesce(1)
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    got = [(r.seq, r.go, r.stopped, r.best) for r in sj.drain(stream, "test").orderBy("seq").collect()]
    assert got == [(0, True, False, 0), (1, False, False, 1), (2, False, True, 1), (4, True, False, 0)]


def test_motion_documents_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", [[0.1, 0.2], [0.3, 0.4]])], "id string, tracks array<array<double>>")
    dc.write_motion_json(d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().tracks == [[0.1, 0.2], [0.3, 0.4]]


def test_pose_documents_keep_gaps_and_long_clips(spark, tmp_path):
    rows = [(clip, f, "nose" if k else "l_sho", float(f), 0.25, 0.5, -1.0) for clip in (3, 4) for f in (0, 2, 159, 160, 400) for k in (0, 1)]
    df = spark.createDataFrame(rows, "clip long, frame long, joint string, x double, y double, vis double, z double")
    dc.write_motion_json(dc.nest_pose(df), str(tmp_path / "poses"))
    read = dc.read_motion_json(spark, str(tmp_path / "poses"), lines=True)
    assert read.count() == 6
    assert {r.id: (r.pose.detected, r.pose.total) for r in read.collect()}["3/0"] == (3, 160)
    clip, first = dc.place_of()
    back = dc.pose_rows(read).select(clip.alias("clip"), (first + F.col("frame")).alias("frame"), "x", "y", "vis", "z").collect()
    assert sorted(map(tuple, back)) == sorted((c, f, x, y, v, z) for c, f, _, x, y, v, z in rows)
