"""Registered queries over sampling, playback tables, documents, streams and the whole job, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe import dims
from trackframe.functions.scalar import displacement, fixed, heading
from trackframe.operators import contracts as ct
from trackframe.operators import flow as fl
from trackframe.operators import playback as pb
from trackframe.operators import pose as ps
from trackframe.plans.analyze import analyze_batch
from trackframe.plans.q_flow import MASKED, SPARSE, TRACKS, _mask, dial_steps
from trackframe.plans.q_flow import ORACLE as FLOW_SQL
from trackframe.plans.q_masks import LINE, _line
from trackframe.plans.q_pose import TRK, _limbs
from trackframe.plans.views import spread_rows, table, v_boxes, v_cells, v_clips, v_det, v_flow, v_hist, v_pose, with_views
from trackframe.sources import documents as dc
from trackframe.sources import sampling as sm
from trackframe.streaming import judge as sj
from trackframe.streaming import windows as sw

QUERIES, ORACLE = {}, {}
PI = "3.141592653589793e0"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


# ---------------------------------------------------------------- sampling

RATES = (24.0, 23.976, 29.97, 30.0, 60.0, 0.0, 500.0)


def _rated(spark, sf):
    fps = F.get(F.array(*[F.lit(r) for r in RATES]), F.pmod("c_custkey", F.lit(7)))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("clip"), fps.alias("fps"), (F.col("c_custkey") % 300 + 1).alias("total"))


RATED = {"rat": "SELECT c_custkey AS clip, ([" + ", ".join(f"{r}e0" for r in RATES) + "])[CAST(c_custkey % 7 + 1 AS INTEGER)] AS fps, c_custkey % 300 + 1 AS total FROM customer"}


def _plan_sql(target: str, low: str, high: str) -> str:
    return f"SELECT *, CASE WHEN fps >= {low} AND fps <= {high} THEN fps ELSE 30e0 END AS f, greatest(1, CAST(round_even((CASE WHEN fps >= {low} AND fps <= {high} THEN fps ELSE 30e0 END) / {target}, 0) AS BIGINT)) AS step FROM rat"


@query("sample_stride", with_views("SELECT clip, k AS t, k // step AS i FROM pln JOIN (SELECT unnest(range(0, 301)) AS k) ON k < total AND k % step = 0 AND k // step < floor(f / step * 8)", [], {**RATED, "pln": _plan_sql("20e0", "1", "240")}))
def sample_stride(spark, sf):
    c = _rated(spark, sf)
    frames = c.select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("t"))
    return sm.sample_stride(frames, c).select("clip", "t", "i")


@query("stride_plan", with_views("SELECT clip, step, round(f / step, 4) AS eff_fps, CAST(floor(f / step * 8) AS BIGINT) AS keep FROM pln", [], {**RATED, "pln": _plan_sql("20e0", "1", "240")}))
def stride_plan(spark, sf):
    return sm.stride_plan(_rated(spark, sf)).select("clip", "step", F.round("eff_fps", 4).alias("eff_fps"), "keep")


@query("sample_decimate", with_views("SELECT clip, k AS t, k // step AS i FROM pln JOIN (SELECT unnest(range(0, 301)) AS k) ON k < total AND k % step = 0 AND k // step < 160", [], {**RATED, "pln": _plan_sql("15e0", "1e-9", "1e300")}))
def sample_decimate(spark, sf):
    c = _rated(spark, sf)
    frames = c.select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("t"))
    return sm.sample_decimate(frames, c).select("clip", "t", "i")


@query("sample_even", with_views("SELECT clip, CAST(round_even(k * (total - 1) / 47e0, 0) AS BIGINT) AS t, CAST(min(k) AS BIGINT) AS i FROM rat CROSS JOIN (SELECT unnest(range(0, 48)) AS k) GROUP BY 1, 2", [], RATED))
def sample_even(spark, sf):
    return sm.sample_even(_rated(spark, sf), 48).select("clip", "t", "i")


@query("strided_cap", """SELECT o_custkey AS g, CASE WHEN n > 5 THEN list_transform([0, 1, 2, 3, 4], lambda k: l[CAST(round_even(k * (n - 1) / 4e0, 0) AS BIGINT) + 1]) ELSE l END::VARCHAR AS picked FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l, count(*) AS n FROM orders GROUP BY o_custkey)""")
def strided_cap(spark, sf):
    # the operator thins an array column, a clip's points; here a customer's orders stand for them
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    return o.select("g", F.concat(F.lit("["), F.array_join(F.transform(sm.strided_cap(F.col("l"), 5), lambda v: v.cast("string")), ", "), F.lit("]")).alias("picked"))


@query("phase_samples", """SELECT id, CAST(i AS BIGINT) AS i, round(i * cyc / 8e0, 5) AS tt FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 200 + 1) / 15e0 WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 90 + 2) / 30e0
    ELSE least(4e0, greatest(0.4e0, CASE WHEN o_totalprice / 100000 > 0.05 THEN 1 / (o_totalprice / 100000) ELSE 2 END)) END / CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE o_custkey % 4 END AS cyc FROM orders) CROSS JOIN (SELECT unnest(range(0, 8)) AS i)""")
def phase_samples(spark, sf):
    k = F.col("o_orderkey")
    m = table(spark, sf, "orders").select(k.alias("id"), F.when(k % 3 == 0, k % 200 + 1).alias("pose_frames"), F.lit(None).cast("double").alias("pose_fps"), F.when(k % 3 == 1, k % 90 + 2).alias("path_points"),
                                          F.lit(30.0).alias("path_fps"), (F.col("o_totalprice") / 100000).alias("frequency"), (F.col("o_custkey") % 4).cast("double").alias("speed"))
    return pb.phase_samples(m, ["id"]).select("id", "i", F.round("tt", 5).alias("tt"))


# ---------------------------------------------------------------- fields

FIELD = {"tr": TRACKS, "rel": "SELECT t.clip, t.gy, t.gx, t.t, t.x - s.x AS dx, t.y - s.y AS dy FROM tr t JOIN tr s ON s.clip = t.clip AND s.gy = t.gy AND s.gx = t.gx AND s.t = 0",
         "fld": "SELECT clip, gy, gx, t, dx - avg(dx) OVER (PARTITION BY clip, t) AS dx, dy - avg(dy) OVER (PARTITION BY clip, t) AS dy FROM rel",
         "eng": "SELECT clip, gy, gx, max(sqrt(dx * dx + dy * dy)) AS energy FROM fld GROUP BY clip, gy, gx",
         "win": """SELECT clip, peak, greatest(0, min(gx) FILTER (WHERE hot) - 1) AS x0, least(4, max(gx) FILTER (WHERE hot) + 1) AS x1, greatest(0, min(gy) FILTER (WHERE hot) - 1) AS y0, least(4, max(gy) FILTER (WHERE hot) + 1) AS y1 FROM (
             SELECT *, energy >= greatest(0.004e0, 0.25e0 * peak) AS hot FROM (SELECT *, max(energy) OVER (PARTITION BY clip) AS peak FROM eng)) GROUP BY clip, peak"""}


def _tracks(spark, sf):
    return fl.grid_tracks(v_cells(spark, sf), v_clips(spark, sf))


@query("relative_to_start", with_views("SELECT clip, gy, gx, t, round(dx, 5) + 0e0 AS dx, round(dy, 5) + 0e0 AS dy FROM rel", ["v_cells"], FIELD))
def relative_to_start(spark, sf):
    return pb.relative_to_start(_tracks(spark, sf)).select("clip", "gy", "gx", "t", fixed(F.col("dx"), 5).alias("dx"), fixed(F.col("dy"), 5).alias("dy"))


@query("remove_common_motion", with_views("SELECT clip, gy, gx, t, round(dx, 5) + 0e0 AS dx, round(dy, 5) + 0e0 AS dy FROM fld", ["v_cells"], FIELD))
def remove_common_motion(spark, sf):
    return pb.remove_common_motion(pb.relative_to_start(_tracks(spark, sf))).select("clip", "gy", "gx", "t", fixed(F.col("dx"), 5).alias("dx"), fixed(F.col("dy"), 5).alias("dy"))


@query("track_energy", with_views("SELECT clip, gy, gx, round(energy, 5) AS energy FROM eng", ["v_cells"], FIELD))
def track_energy(spark, sf):
    f, _ = pb.traj_field(_tracks(spark, sf), v_clips(spark, sf))
    return pb.track_energy(f).select("clip", "gy", "gx", F.round("energy", 5).alias("energy"))


@query("active_window", with_views("SELECT clip, x0, x1, y0, y1 FROM win", ["v_cells"], FIELD))
def active_window(spark, sf):
    return pb.traj_field(_tracks(spark, sf), v_clips(spark, sf))[1].select("clip", "x0", "x1", "y0", "y1")


@query("lattice_subsample", with_views("SELECT clip, CAST(j * 5 + i AS BIGINT) AS i, CAST(y0 + floor(j * (y1 - y0) / 4e0 + 0.5e0) AS BIGINT) AS gy, CAST(x0 + floor(i * (x1 - x0) / 4e0 + 0.5e0) AS BIGINT) AS gx FROM win CROSS JOIN (SELECT unnest(range(0, 5)) AS i) CROSS JOIN (SELECT unnest(range(0, 5)) AS j)", ["v_cells"], FIELD))
def lattice_subsample(spark, sf):
    return pb.lattice_subsample(pb.traj_field(_tracks(spark, sf), v_clips(spark, sf))[1])


SAMPLE = {**FIELD, "q": """SELECT w.clip, k AS pid, n, least(3.999e0, greatest(0e0, x0 + (k % 7) / 6e0 * greatest(1, x1 - x0))) AS px, least(3.999e0, greatest(0e0, y0 + (k % 5) / 4e0 * greatest(1, y1 - y0))) AS py,
              CASE WHEN u <= n - 1 THEN u ELSE 2 * (n - 1) - u END AS pt, greatest(0.08e0, greatest(1, x1 - x0) / 4e0) AS aw, greatest(0.08e0, greatest(1, y1 - y0) / 4e0) AS ah FROM (
              SELECT w.*, k, n, k * 0.37e0 * 20 - floor(k * 0.37e0 * 20 / (2 * (n - 1))) * 2 * (n - 1) AS u FROM win w JOIN (SELECT clip, max(t) + 1 AS n FROM tr GROUP BY clip) USING (clip) CROSS JOIN (SELECT unnest(range(0, 35)) AS k)) w""",
          "smp": """SELECT q.clip, pid, aw, ah, sum(w * dx) AS dx, sum(w * dy) AS dy FROM (SELECT q.*, least(4, floor(py) + oy) AS cy, least(4, floor(px) + ox) AS cx, least(n - 1, floor(pt) + ot) AS ct,
              (CASE ox WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) * (CASE oy WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE ot WHEN 1 THEN pt - floor(pt) ELSE 1 - pt + floor(pt) END) AS w
              FROM q CROSS JOIN (VALUES (0), (1)) a(ox) CROSS JOIN (VALUES (0), (1)) b(oy) CROSS JOIN (VALUES (0), (1)) c(ot)) q JOIN fld f ON f.clip = q.clip AND f.gy = cy AND f.gx = cx AND f.t = ct GROUP BY q.clip, pid, aw, ah"""}


@query("traj_field_sample", with_views("SELECT clip, pid, round(greatest(-0.55e0, least(0.55e0, dx / aw)), 5) + 0e0 AS dx, round(greatest(-0.55e0, least(0.55e0, dy / ah)), 5) + 0e0 AS dy FROM smp", ["v_cells"], SAMPLE))
def traj_field_sample(spark, sf):
    field, meta = pb.traj_field(_tracks(spark, sf), v_clips(spark, sf))
    k = F.col("pid")
    pts = meta.select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(34).cast("long"))).alias("pid")).select("clip", "pid", (k % 7 / 6.0).alias("u"), (k % 5 / 4.0).alias("v"), (k * F.lit(0.37)).alias("tt"))
    return pb.sample_field(field, meta, pts).select("clip", "pid", fixed(F.col("dx"), 5).alias("dx"), fixed(F.col("dy"), 5).alias("dy"))


@query("sample_centreline", with_views("""SELECT clip, pid, round(sum(w * d), 6) + 0e0 AS d FROM (SELECT q.clip, pid, CASE ot WHEN 0 THEN CAST(floor(fp) AS BIGINT) ELSE (CAST(floor(fp) AS BIGINT) + 1) % n END AS fr, s0 + os AS st, (CASE ot WHEN 1 THEN fp - floor(fp) ELSE 1 - fp + floor(fp) END) * (CASE os WHEN 1 THEN sp - s0 ELSE 1 - sp + s0 END) AS w FROM (
    SELECT clip, pid, n, (pid * 0.23e0 * 20) - floor(pid * 0.23e0 * 20 / n) * n AS fp, sp, least(23, CAST(floor(sp) AS BIGINT)) AS s0 FROM (SELECT clip, frames AS n, k AS pid, least(1e0, (k % 9) / 7e0) * 24 AS sp FROM v_clips CROSS JOIN (SELECT unnest(range(0, 40)) AS k))) q
    CROSS JOIN (VALUES (0), (1)) a(ot) CROSS JOIN (VALUES (0), (1)) b(os)) q JOIN line l ON l.clip = q.clip AND l.frame = fr AND l.station = st GROUP BY q.clip, pid""".replace("SELECT clip, pid, round(sum", "SELECT q.clip, pid, round(sum"), ["v_vec", "v_clips"], LINE))
def sample_centreline(spark, sf):
    clips = v_clips(spark, sf).select("clip", F.col("frames").alias("n"), F.lit(25).cast("long").alias("ns"), "fps")
    k = F.col("pid")
    pts = clips.select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("pid")).select("clip", "pid", (k % 9 / 7.0).alias("u"), (k * F.lit(0.23)).alias("tt"))
    return pb.sample_centreline(_line(spark, sf), pts, clips).select("clip", "pid", fixed(F.col("d"), 6).alias("d"))


# ---------------------------------------------------------------- parametric motion

def _h(x: str) -> str:
    return f"(sin({x}) * 43758.5453e0 - floor(sin({x}) * 43758.5453e0))"


def _n(x: str) -> str:
    f = f"(({x}) - floor({x}))"
    return f"({_h(f'floor({x})')} * (1 - {f} * {f} * (3 - 2 * {f})) + {_h(f'(floor({x}) + 1)')} * ({f} * {f} * (3 - 2 * {f})))"


# SQL of one displacement, step by step, from columns t, seed, gain and the dials
def move_steps(src: str, name: str) -> dict[str, str]:
    e = f"CASE WHEN damping <= 0.02e0 THEN 1e0 ELSE (1 - damping) + damping * pow({_n('t * (0.6e0 + damping * 1.8e0) + seed * 37.7e0')}, 1 + damping * 4) * 2.2e0 END"
    X, Y, T_ = "(seed * 40)", "(seed * 70)", "(t + seed)"
    tx = f"({_n(f'{X} * 0.015e0 + {T_} * 1.7e0 + 5.2e0')} - 0.5e0) * 2 + ({_n(f'{X} * 0.045e0 + {T_} * 3.1e0 + {Y} * 0.03e0')} - 0.5e0)"
    ty = f"({_n(f'{Y} * 0.015e0 + {T_} * 1.9e0 + 91.7e0')} - 0.5e0) * 2 + ({_n(f'{Y} * 0.045e0 + {T_} * 2.7e0 + {X} * 0.03e0')} - 0.5e0)"
    return {f"{name}1": f"SELECT *, {e} AS env, {tx} AS tux, {ty} AS tuy, sin(2 * {PI} * frequency * t + seed * phasespread * 3) AS osc, CASE WHEN (t - 10 * trunc(t / 10)) / 10 < 0.85e0 THEN (t - 10 * trunc(t / 10)) / 10 / 0.85e0 ELSE (1 - (t - 10 * trunc(t / 10)) / 10) / 0.15e0 END AS lp FROM {src}",
            name: f"SELECT *, amplitude * 16 * gain * env * osc * cos(radians(direction)) + turbulence * 11 * tux * env * gain + driftx * 26 * lp * gain AS dx, -amplitude * 16 * gain * env * osc * sin(radians(direction)) + turbulence * 11 * tuy * env * gain + drifty * 26 * lp * gain AS dy, degrees(0.06e0 * amplitude * gain * env * cos(2 * {PI} * frequency * t)) AS rot FROM {name}1"}


PRE = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([str(i)] + [f"'{p[0]}'"] + [f"{v}e0" for v in p[1:]]) + ")" for i, p in enumerate(dims.PRESETS)) + ") q(pi, preset, frequency, amplitude, direction, turbulence, damping, phasespread, driftx, drifty)"
# one motion per part: a preset, a seed from its size, a speed and an intensity
MOTION = {"pre": PRE, "mo": "SELECT p_partkey AS id, p_size / 50e0 AS seed, 1 + p_partkey % 3 * 0.5e0 AS speed, 1 + p_partkey % 2 * 0.5e0 AS gain, pre.* FROM part JOIN pre ON pi = p_partkey % 9"}


def _motions(spark, sf):
    p = dims.presets(spark)
    ids = F.array(*[F.lit(x[0]) for x in dims.PRESETS])
    k = F.col("p_partkey")
    d = spread_rows(table(spark, sf, "part").select("p_partkey", "p_size")).select(k.alias("id"), (F.col("p_size") / 50.0).alias("seed"), (k % 3 * 0.5 + 1).alias("speed"), (k % 2 * 0.5 + 1).alias("intensity"), F.get(ids, F.pmod(k, F.lit(9))).alias("pid"))
    return d.join(F.broadcast(p.withColumnRenamed("id", "pid")), "pid")


@query("displacement", with_views("SELECT id, k, round(dx, 3) + 0e0 AS dx, round(dy, 3) + 0e0 AS dy, round(rot, 3) + 0e0 AS rot FROM mv", [], {**MOTION, "mt": "SELECT *, k * 0.29e0 AS t FROM mo CROSS JOIN (SELECT unnest(range(0, 12)) AS k)", **move_steps("mt", "mv")}))
def displacement_query(spark, sf):
    d = _motions(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    m = displacement({c: F.col(c) for c in dims.PARAM_KEYS}, F.col("seed"), F.col("k") * F.lit(0.29), F.col("intensity"))
    return d.select("id", "k", *[fixed(m[c], 3).alias(c) for c in ("dx", "dy", "rot")])


BAKE = {**MOTION, "bk": "SELECT *, CASE WHEN driftx <> 0 OR drifty <> 0 THEN 10e0 / speed ELSE 8e0 END AS dd FROM mo",
        "bs": "SELECT * REPLACE (greatest(1, floor(frequency * dd * speed + 0.5e0)) / (dd * speed) AS frequency), dd * speed AS span, CAST(least(200, greatest(60, floor(dd * 15 + 0.5e0))) AS BIGINT) AS steps FROM bk",
        "ba": "SELECT *, k / CAST(steps AS DOUBLE) AS frac, k / CAST(steps AS DOUBLE) * span AS t FROM bs JOIN (SELECT unnest(range(0, 201)) AS k) ON k <= steps", "bb": "SELECT * REPLACE (t - span AS t) FROM ba", **move_steps("ba", "va"), **move_steps("bb", "vb")}


@query("bake_keyframes", with_views("""SELECT a.id, a.k, round(a.frac, 6) AS frac, round(CASE WHEN a.frac > 0.88e0 THEN a.dx * (1 - (a.frac - 0.88e0) / 0.12e0) + b.dx * ((a.frac - 0.88e0) / 0.12e0) ELSE a.dx END, 5) + 0e0 AS dx,
    round(CASE WHEN a.frac > 0.88e0 THEN a.dy * (1 - (a.frac - 0.88e0) / 0.12e0) + b.dy * ((a.frac - 0.88e0) / 0.12e0) ELSE a.dy END, 5) + 0e0 AS dy,
    round(CASE WHEN a.frac > 0.88e0 THEN a.rot * (1 - (a.frac - 0.88e0) / 0.12e0) + b.rot * ((a.frac - 0.88e0) / 0.12e0) ELSE a.rot END, 5) + 0e0 AS rot FROM va a JOIN vb b ON a.id = b.id AND a.k = b.k""", [], BAKE))
def bake_keyframes(spark, sf):
    b = pb.bake_keyframes(_motions(spark, sf), ["id"])
    return b.select("id", "k", F.round("frac", 6).alias("frac"), *[fixed(F.col(c), 5).alias(c) for c in ("dx", "dy", "rot")])


@query("heading", """SELECT id, round(CASE WHEN still THEN ax ELSE mx / CASE WHEN sqrt(mx * mx + my * my) = 0 THEN 1 ELSE sqrt(mx * mx + my * my) END END, 5) + 0e0 AS hx, round(CASE WHEN still THEN ay ELSE my / CASE WHEN sqrt(mx * mx + my * my) = 0 THEN 1 ELSE sqrt(mx * mx + my * my) END END, 5) + 0e0 AS hy FROM (
    SELECT *, (sg * ax + dx / l) / 2 AS mx, (sg * ay + dy / l) / 2 AS my FROM (SELECT *, sqrt(dx * dx + dy * dy) AS l, dx = 0 AND dy = 0 AS still, CASE WHEN ax * dx + ay * dy < 0 THEN -1 ELSE 1 END AS sg FROM (
    SELECT o_orderkey AS id, cos(radians(o_orderkey % 180)) AS ax, -sin(radians(o_orderkey % 180)) AS ay, CASE WHEN o_custkey % 5 = 0 THEN 0e0 ELSE (o_custkey % 21 - 10.5e0) / 10 END AS dx, CASE WHEN o_custkey % 5 = 0 THEN 0e0 ELSE (o_custkey % 17 - 8.3e0) / 10 END AS dy FROM orders)))""")
def heading_query(spark, sf):
    c = F.col("o_custkey")
    off = c % 5 == 0
    h = heading((F.col("o_orderkey") % 180).cast("double"), F.when(off, 0.0).otherwise((c % 21 - 10.5) / 10), F.when(off, 0.0).otherwise((c % 17 - 8.3) / 10))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), fixed(h[0], 5).alias("hx"), fixed(h[1], 5).alias("hy"))


@query("limb_rotations", with_views("""SELECT clip, CAST(k AS BIGINT) AS k, role, round(deg, 3) + 0e0 AS deg FROM (SELECT clip, k, 'torso' AS role, sw AS deg FROM spl WHERE role = 'torso' UNION ALL
    SELECT s.clip, s.k, s.role, (s.sw + 10 - coalesce(t.sw, 0e0)) - 360 * floor((s.sw + 10 - coalesce(t.sw, 0e0) + 180) / 360) FROM spl s LEFT JOIN spl t ON t.clip = s.clip AND t.k = s.k AND t.role = 'torso' WHERE s.role IN ('leg-l', 'leg-r') UNION ALL
    SELECT clip, k, role, sw FROM spl WHERE role IN ('arm-l', 'arm-r', 'forearm-r'))""", ["v_pose"], {**TRK,
    "ins": "SELECT clip, k, keep AS n, k * 0.11e0 * 15 - floor(k * 0.11e0 * 15 / keep) * keep AS p FROM kp CROSS JOIN (SELECT unnest(range(0, 20)) AS k)",
    "at4": "SELECT i.clip, i.k, a.role, p - floor(p) AS f, a.v AS v1, z.v - a.v AS d0, b.v - a.v AS d2, c.v - a.v AS d3 FROM ins i JOIN trk a ON a.clip = i.clip AND a.i = floor(p) JOIN trk z ON z.clip = i.clip AND z.role = a.role AND z.i = (floor(p) - 1 + n) % n JOIN trk b ON b.clip = i.clip AND b.role = a.role AND b.i = (floor(p) + 1) % n JOIN trk c ON c.clip = i.clip AND c.role = a.role AND c.i = (floor(p) + 2) % n",
    "wr": "SELECT clip, k, role, f, v1, d0 - 360 * floor((d0 + 180) / 360) AS d0, d2 - 360 * floor((d2 + 180) / 360) AS d2, d3 - 360 * floor((d3 + 180) / 360) AS d3 FROM at4",
    "spl": "SELECT clip, k, role, greatest(-75e0, least(75e0, 1.5e0 * (v1 + f * (d2 - d0) / 2 + f * f * (3 * d2 - (d2 - d0) - d3 / 2) + f * f * f * ((d2 - d0) / 2 + d3 / 2 - 2 * d2)))) AS sw FROM wr"}))
def limb_rotations(spark, sf):
    t, facts = ps.bone_tracks(v_pose(spark, sf), _limbs(spark, sf), v_clips(spark, sf))
    limbs = facts.select("clip", "role", F.col("role").startswith("leg").alias("retarget"), F.lit(10.0).alias("rest_offset"), F.lit(15.0).alias("fps"), F.col("keep").alias("n"))
    inst = facts.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("k")).withColumn("tt", F.col("k") * F.lit(0.11))
    r = pb.limb_rotations(t, limbs, inst, intensity=1.5)
    return r.select("clip", F.round(F.col("tt") / 0.11, 0).cast("long").alias("k"), "role", fixed(F.col("deg"), 3).alias("deg"))


WARP = {"ctl": "SELECT clip, CAST(gx AS DOUBLE) AS x, CAST(gy AS DOUBLE) AS y, gx + avg(vx) * 0.1e0 AS qx, gy + avg(vy) * 0.1e0 AS qy FROM v_cells GROUP BY clip, gy, gx",
        "pts": """SELECT id % 10 AS clip, id AS pid, bx * 4 AS x, "by" * 4 AS y FROM v_boxes""",
        "pr": "SELECT p.clip, pid, p.x AS vx, p.y AS vy, c.x, c.y, qx, qy, pow(c.x - p.x, 2) + pow(c.y - p.y, 2) AS d2 FROM pts p JOIN ctl c ON c.clip = p.clip",
        "wt": "SELECT *, 1 / greatest(d2, 1e-9) AS w FROM pr",
        "mn": "SELECT clip, pid, sum(w * x) / sum(w) AS mpx, sum(w * y) / sum(w) AS mpy, sum(w * qx) / sum(w) AS mqx, sum(w * qy) / sum(w) AS mqy, min(CASE WHEN d2 < 1e-9 THEN {'qx': qx, 'qy': qy} END) AS hit FROM wt GROUP BY clip, pid",
        "cv": "SELECT clip, pid, any_value(vx - mpx) AS vx, any_value(vy - mpy) AS vy, any_value(mqx) AS mqx, any_value(mqy) AS mqy, any_value(hit) AS hit, sum(w * ((x - mpx) * (qx - mqx) + (y - mpy) * (qy - mqy))) AS re, sum(w * ((x - mpx) * (qy - mqy) - (y - mpy) * (qx - mqx))) AS im FROM wt JOIN mn USING (clip, pid) GROUP BY clip, pid"}


@query("mls_warp", with_views("""SELECT clip, pid, round(CASE WHEN hit IS NOT NULL THEN hit.qx ELSE mqx + (re * vx - im * vy) / sqrt(re * re + im * im) END, 5) + 0e0 AS x, round(CASE WHEN hit IS NOT NULL THEN hit.qy ELSE mqy + (im * vx + re * vy) / sqrt(re * re + im * im) END, 5) + 0e0 AS y,
    round(CASE WHEN hit IS NOT NULL THEN 0e0 ELSE degrees(atan2(im, re)) END, 4) + 0e0 AS rot FROM cv""", ["v_cells", "v_boxes"], WARP))
def mls_warp(spark, sf):
    # controls: the cells of each clip, moved by their mean flow; points: the order boxes' corners
    c = v_cells(spark, sf).groupBy("clip", "gy", "gx").agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy")).select("clip", F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"), (F.col("gx") + F.col("vx") * 0.1).alias("qx"), (F.col("gy") + F.col("vy") * 0.1).alias("qy"))
    p = v_boxes(spark, sf).select((F.col("id") % 10).alias("clip"), F.col("id").alias("pid"), (F.col("bx") * 4).alias("x"), (F.col("by") * 4).alias("y"))
    return pb.mls_warp(p, c).select("clip", "pid", fixed(F.col("x"), 5).alias("x"), fixed(F.col("y"), 5).alias("y"), fixed(F.col("rot"), 4).alias("rot"))


@query("detail_filter", with_views("""SELECT art, id, w < 0.34e0 * gw AND h < 0.34e0 * gh AS detail FROM (SELECT *, max(x + w) OVER g - min(x) OVER g AS gw, max(y + h) OVER g - min(y) OVER g AS gh FROM (SELECT id % 50 AS art, id, bx AS x, "by" AS y, bw AS w, bh AS h FROM v_boxes) WINDOW g AS (PARTITION BY art))""", ["v_boxes"]))
def detail_filter(spark, sf):
    b = v_boxes(spark, sf).select((F.col("id") % 50).alias("art"), "id", F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bw").alias("w"), F.col("bh").alias("h"))
    return pb.detail_filter(b).select("art", "id", "detail")


# ---------------------------------------------------------------- documents and the whole job

def _docs(spark, sf, want):
    clips = v_clips(spark, sf).select("clip", "fps", F.lit(8.0).alias("width"), F.lit(8.0).alias("height"), F.lit(4).cast("long").alias("grid"), "frames", F.lit("cloth").alias("class"), F.lit("flow").alias("engine"))
    f = v_flow(spark, sf)
    det = v_det(spark, sf)
    return analyze_batch(f, clips, mask=_mask(f), detections=det, want=[want])


@query("swatch_summary", with_views("SELECT clip, 'texture · cloth · flow+grid · ' || CAST(n + 1 AS VARCHAR) || ' frames @ 20.0fps · confidence ' || CAST(CAST(floor(amplitude * 100 + 0.5e0) AS BIGINT) AS VARCHAR) || '% (gated_motion_amplitude)' AS summary FROM dials JOIN (SELECT clip, n FROM clip_a) USING (clip)", ["v_flow", "v_clips"],
    {**MASKED, "pxl": "SELECT clip, t, y AS gy, x AS gx, vx, vy FROM cut", "c8": "SELECT * REPLACE (8e0 AS width) FROM v_clips", **dial_steps("pxl", "c8")}))
def swatch_summary(spark, sf):
    s = _docs(spark, sf, "swatches")["swatches"].filter("kind = 'texture'")
    return pb.swatch_summary(s).select("clip", "summary")


@query("analyze_params", with_views("SELECT * FROM dials", ["v_flow", "v_clips"], {**MASKED, "pxl": "SELECT clip, t, y AS gy, x AS gx, vx, vy FROM cut", "c8": "SELECT * REPLACE (8e0 AS width) FROM v_clips", **dial_steps("pxl", "c8")}))
def analyze_params(spark, sf):
    return _docs(spark, sf, "params")["params"]


@query("analyze_gate", with_views("""SELECT c.clip, coalesce(px, 0) >= 4 AS masked, CASE WHEN coalesce(px, 0) >= 4 AND k > 0 THEN k END AS cells_tracked FROM v_clips c LEFT JOIN msz USING (clip) LEFT JOIN (SELECT clip, count(*) FILTER (WHERE n / 4e0 >= 0.2e0) AS k FROM (SELECT clip, y // 2, x // 2, count(*) AS n FROM msk GROUP BY ALL) GROUP BY clip) USING (clip)""", ["v_flow", "v_clips"], MASKED))
def analyze_gate(spark, sf):
    return _docs(spark, sf, "gate")["gate"]


@query("analyze_batch")
def analyze_whole(spark, sf):
    s = _docs(spark, sf, "swatches")["swatches"]
    return s.select("clip", "kind", "class", "applicator", "fps", "frames", "confidence", "confidence_of", "track_stride", F.size("tracks").alias("tracks"), F.size("path.points").alias("points"), "ok", F.array_join("errors", "; ").alias("errors"))


@query("analyze_regions")
def analyze_regions(spark, sf):
    return _docs(spark, sf, "regions")["regions"]


@query("analyze_notes")
def analyze_notes(spark, sf):
    return _docs(spark, sf, "notes")["notes"]


# ---------------------------------------------------------------- streams

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark, sf):
    return spark.readStream.format("parquet").schema(EVENTS).option("pathGlobFilter", "events.parquet").load(sf)


@query("judge_stream", with_views("""SELECT session, event_id AS seq, CASE WHEN i <= st THEN i + 1 ELSE st + 1 END AS iteration, i <= st AND reason IS NULL AS go, coalesce(CASE WHEN i <= st THEN reason ELSE srs END, 'still gaining') AS reason, i > st AS stopped FROM (
    SELECT *, coalesce(min(CASE WHEN reason IS NOT NULL THEN i END) OVER (PARTITION BY session), 999999) AS st, arg_min(reason, i) FILTER (WHERE reason IS NOT NULL) OVER (PARTITION BY session) AS srs FROM (
    SELECT *, CASE WHEN verdict = 'wrong_class' THEN 'other applicator needed' WHEN score >= 0.8e0 THEN 'score is high enough' WHEN verdict = 'good' THEN 'judged good' WHEN i + 1 >= 3 THEN 'no passes left'
    WHEN NOT has_deltas THEN 'nothing to change' WHEN score - lag(score) OVER (PARTITION BY session ORDER BY i) < 0.03e0 THEN 'too little gain' END AS reason FROM v_hist))""", ["v_hist"]))
def judge_stream(spark, sf):
    e = F.col("event_type")
    verdict = F.when(e == "signup", "good").when(e == "error", "wrong_class").otherwise("tune")
    v = _events(spark, sf).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), verdict.alias("verdict"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (e != "view").alias("has_deltas"))
    return sj.drain(v, "judge").select("session", "seq", "iteration", "go", "reason", "stopped")


SPARSE_BODY = FLOW_SQL["distill_sparse"][FLOW_SQL["distill_sparse"].rindex("SELECT clip, round(frequency"):]
STREAMED = {"ev": "SELECT ts, CAST(floor(epoch(ts) / 43200) AS BIGINT) AS clip, event_id // 4 AS t, event_id // 2 % 2 AS gy, event_id % 2 AS gx, value / 50 - 1 AS vx, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50 - 1 AS vy, event_type <> 'error' AS valid FROM events",
            "vld": "SELECT clip, t - min(t) OVER (PARTITION BY clip) AS t, gy, gx, vx, vy, valid FROM ev",
            "v_clips": "SELECT DISTINCT clip, 30e0 AS fps FROM vld", **{k: v for k, v in SPARSE.items() if k != "vld"}}


@query("distill_windows", with_views(SPARSE_BODY, [], STREAMED))
def distill_windows(spark, sf):
    # four cells by event number, twelve-hour windows
    k = F.get_json_object("props", "$.k").cast("double")
    i = F.col("event_id")
    s = _events(spark, sf).select(F.lit(1).cast("long").alias("clip"), F.col("ts").cast("timestamp").alias("ts"), F.floor(i / 4).alias("t"), (F.floor(i / 2) % 2).alias("gy"), (i % 2).alias("gx"),
                                  (F.col("value") / 50 - 1).alias("vx"), (k / 50 - 1).alias("vy"), (F.col("event_type") != "error").alias("valid"))
    d = sw.distill_windows(s, fps=30.0, window="12 hours", late="1 hour")
    return d.select(F.floor(F.unix_seconds("start") / 43200).alias("clip"), "frequency", "amplitude", "direction", "turbulence", "damping", "phaseSpread")
