"""Registered queries over body pose, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe import dims
from trackframe.functions.scalar import fixed
from trackframe.operators import pose as ps
from trackframe.operators import series as se
from trackframe.plans.views import JOINTS, v_clips, v_pose, v_pose_frames, with_views

QUERIES, ORACLE = {}, {}
PI = "3.141592653589793e0"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def _aspect(spark, sf):
    return v_clips(spark, sf).select("clip", F.lit(1.5).alias("aspect"), F.lit(15.0).alias("fps"))


PIV = "SELECT clip, frame, " + ", ".join(f"max(CASE WHEN joint = '{j}' THEN {c} END) AS {j}_{c}" for j in JOINTS for c in ("x", "y", "vis", "z")) + ", min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi FROM v_pose GROUP BY clip, frame"
HIPS = "greatest(l_hip_vis, r_hip_vis) >= 0.5e0"
NORM = {"piv": PIV,
        "anc": f"""SELECT *, CASE WHEN {HIPS} THEN (l_hip_x + r_hip_x) / 2 * 1.5e0 ELSE (xlo + xhi) / 2 * 1.5e0 END AS ax, CASE WHEN {HIPS} THEN (l_hip_y + r_hip_y) / 2 ELSE (ylo + yhi) / 2 END AS ay,
            CASE WHEN {HIPS} AND greatest(l_sho_vis, r_sho_vis) >= 0.5e0 THEN abs((l_sho_y + r_sho_y) / 2 - (l_hip_y + r_hip_y) / 2) END AS torso FROM piv""",
        "scl": "SELECT clip, coalesce(greatest(1e-3, median(torso)), greatest(1e-3, (max(xhi) - min(xlo)) * 1.5e0, max(yhi) - min(ylo))) AS scale, avg(ax) AS mx, avg(ay) AS my FROM anc GROUP BY clip",
        "cen": "SELECT p.clip, p.frame, joint, (x * 1.5e0 - ax) / scale AS cx, (y - ay) / scale AS cy, vis, z / scale AS cz FROM v_pose p JOIN anc USING (clip, frame) JOIN scl ON scl.clip = p.clip",
        "ext": "SELECT clip, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1, greatest(1e-6, max(cx) - min(cx), max(cy) - min(cy)) AS ext FROM cen GROUP BY clip",
        "nrm": "SELECT c.clip, frame, joint, round((cx - x0 + (ext - (x1 - x0)) / 2) / ext, 4) + 0e0 AS x, round((cy - y0 + (ext - (y1 - y0)) / 2) / ext, 4) + 0e0 AS y, round(vis, 3) AS vis, round(cz / ext, 4) + 0e0 AS z FROM cen c JOIN ext USING (clip)",
        "root": "SELECT a.clip, frame, round((ax - mx) / scale / ext, 4) + 0e0 AS dx, round((ay - my) / scale / ext, 4) + 0e0 AS dy FROM anc a JOIN scl USING (clip) JOIN ext USING (clip)"}


@query("pose_scale", with_views("SELECT clip, round(scale, 5) AS scale FROM scl", ["v_pose"], NORM))
def pose_scale(spark, sf):
    return ps.pose_scale(ps.wide(v_pose(spark, sf))).select("clip", F.round("scale", 5).alias("scale"))


@query("normalize_clip", with_views("SELECT * FROM nrm", ["v_pose"], NORM))
def normalize_clip(spark, sf):
    return ps.normalize_clip(v_pose(spark, sf), _aspect(spark, sf))[0]


ROOT = {**NORM, "hld": """SELECT clip, frame, coalesce(last_value(dx IGNORE NULLS) OVER w, 0e0) AS dx, coalesce(last_value(dy IGNORE NULLS) OVER w, 0e0) AS dy FROM v_pose_frames LEFT JOIN root USING (clip, frame) WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING)"""}


@query("root_track", with_views("SELECT * FROM hld", ["v_pose", "v_pose_frames"], ROOT))
def root_track(spark, sf):
    root = ps.normalize_clip(v_pose(spark, sf), _aspect(spark, sf))[1]
    return ps.root_travel(root, v_pose_frames(spark, sf))[0]


@query("root_travel", with_views("SELECT clip, round(max(dx) - min(dx), 4) AS x, round(max(dy) - min(dy), 4) AS y, CASE WHEN max(dy) - min(dy) > max(dx) - min(dx) THEN 'jump' ELSE 'dance' END AS mode FROM hld GROUP BY clip", ["v_pose", "v_pose_frames"], ROOT))
def root_travel(spark, sf):
    root = ps.normalize_clip(v_pose(spark, sf), _aspect(spark, sf))[1]
    return ps.root_travel(root, v_pose_frames(spark, sf))[1]


@query("normalize_frame", with_views("SELECT clip, frame, joint, round((x - min(x) OVER w) / greatest(1e-3, max(x) OVER w - min(x) OVER w), 4) + 0e0 AS x, round((y - min(y) OVER w) / greatest(1e-3, max(y) OVER w - min(y) OVER w), 4) + 0e0 AS y FROM v_pose WINDOW w AS (PARTITION BY clip, frame)", ["v_pose"]))
def normalize_frame(spark, sf):
    return ps.normalize_frame(v_pose(spark, sf), ["clip", "frame"]).select("clip", "frame", "joint", "x", "y")


@query("fill_pose", with_views("""SELECT clip, frame, joint, CASE WHEN x IS NOT NULL THEN 'ok' WHEN rt - lt - 1 <= 5 THEN 'interp' ELSE 'gap' END AS flag, round(CASE WHEN x IS NOT NULL THEN x WHEN rt - lt - 1 <= 5 THEN lx + (rx - lx) * (frame - lt) / (rt - lt) END, 5) + 0e0 AS x FROM (
    SELECT s.clip, s.frame, s.joint, x, max(CASE WHEN x IS NOT NULL THEN s.frame END) OVER b AS lt, min(CASE WHEN x IS NOT NULL THEN s.frame END) OVER f AS rt, last_value(x IGNORE NULLS) OVER b AS lx, first_value(x IGNORE NULLS) OVER f AS rx
    FROM (SELECT clip, frame, joint FROM v_pose_frames CROSS JOIN (SELECT DISTINCT joint FROM v_pose)) s LEFT JOIN v_pose p ON p.clip = s.clip AND p.frame = s.frame AND p.joint = s.joint
    WINDOW b AS (PARTITION BY s.clip, s.joint ORDER BY s.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY s.clip, s.joint ORDER BY s.frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", ["v_pose", "v_pose_frames"]))
def fill_pose(spark, sf):
    return ps.fill_pose(v_pose(spark, sf), v_pose_frames(spark, sf)).select("clip", "frame", "joint", "flag", fixed(F.col("x"), 5).alias("x"))


@query("joints22_to_pose", with_views("""SELECT clip, frame, joint, round((x - min(x) OVER w) / greatest(1e-3, max(x) OVER w - min(x) OVER w), 4) + 0e0 AS x, round((y - min(y) OVER w) / greatest(1e-3, max(y) OVER w - min(y) OVER w), 4) + 0e0 AS y, 1e0 AS vis FROM (
    SELECT clip, t AS frame, joint, CAST(embedding[j + 1] AS DOUBLE) AS x, -CAST(embedding[j + 23] AS DOUBLE) AS y FROM v_vec JOIN (VALUES """ + ", ".join(f"({k}, '{v}')" for k, v in ps.JOINT22.items()) + """) q(j, joint) ON true WHERE vec_id % 6 <> 0) WINDOW w AS (PARTITION BY clip, frame)""", ["v_vec"]))
def joints22_to_pose(spark, sf):
    return ps.joints22_to_pose(_joints22(spark, sf))[0]


def _joints22(spark, sf):
    from trackframe.plans.views import _vectors
    d = _vectors(spark, sf).select("clip", F.col("t").alias("frame"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(21))).alias("j"))
    # every sixth frame is short of its last joint
    return d.filter((F.col("vec_id") % 6 != 0) | (F.col("j") < 21)).select("clip", "frame", "j", F.get("embedding", F.col("j")).cast("double").alias("x"), F.get("embedding", F.col("j") + 22).cast("double").alias("y"))


@query("joints22_frames", with_views("SELECT clip, t AS frame, vec_id % 6 <> 0 AS detected FROM v_vec", ["v_vec"]))
def joints22_frames(spark, sf):
    return ps.joints22_to_pose(_joints22(spark, sf))[1]


@query("viewpoint", with_views("""SELECT c.clip, coalesce(v.label, 'unknown') AS viewpoint FROM (SELECT DISTINCT clip FROM v_pose) c LEFT JOIN (SELECT clip, label, row_number() OVER (PARTITION BY clip ORDER BY count(*) DESC, min(frame)) AS rn FROM (
    SELECT clip, frame, CASE WHEN r >= 0.45e0 AND least(l_sho_vis, r_sho_vis) >= 0.6e0 AND nose <= 0.5e0 THEN 'front' WHEN r <= 0.25e0 OR abs(l_sho_vis - r_sho_vis) >= 0.35e0 OR nose >= 0.9e0 THEN 'side' ELSE 'unknown' END AS label FROM (
    SELECT *, sw / greatest(1e-3, abs((l_sho_y + r_sho_y) / 2 - (l_hip_y + r_hip_y) / 2)) AS r, abs(nose_x - (l_sho_x + r_sho_x) / 2) / greatest(sw, 1e-3) AS nose FROM (SELECT *, abs(l_sho_x - r_sho_x) AS sw FROM piv))
    WHERE greatest(l_sho_vis, r_sho_vis) >= 0.5e0 AND greatest(l_hip_vis, r_hip_vis) >= 0.5e0) GROUP BY clip, label) v ON v.clip = c.clip AND rn = 1""", ["v_pose"], {"piv": PIV}))
def viewpoint(spark, sf):
    return ps.viewpoint(v_pose(spark, sf))


@query("skeleton_confidence", with_views("SELECT clip, total, detected, mv AS mean_visibility, round(detected / greatest(1, total), 3) AS detection_ratio FROM (SELECT clip, count(*) AS total, count(*) FILTER (WHERE detected) AS detected FROM v_pose_frames GROUP BY clip) JOIN (SELECT clip, round(avg(vis), 3) AS mv FROM v_pose GROUP BY clip) USING (clip)", ["v_pose", "v_pose_frames"]))
def skeleton_confidence(spark, sf):
    return ps.skeleton_confidence(v_pose(spark, sf), v_pose_frames(spark, sf))


@query("subject_confidence", with_views("""SELECT f.clip, subject, CASE subject WHEN 'pose' THEN coalesce(mv, 0e0) WHEN 'hands' THEN coalesce(hs, 0e0) ELSE round(seen, 3) END AS confidence,
    CASE subject WHEN 'pose' THEN 'mean_visibility' WHEN 'hands' THEN 'handedness_score' ELSE 'detection_ratio' END AS confidence_of FROM (
    SELECT clip, CASE clip % 3 WHEN 0 THEN 'pose' WHEN 1 THEN 'hands' ELSE 'face' END AS subject, avg(CAST(detected AS INTEGER)) AS seen FROM v_pose_frames GROUP BY ALL) f
    LEFT JOIN (SELECT clip, round(avg(vis), 3) AS mv FROM v_pose GROUP BY clip) p ON p.clip = f.clip LEFT JOIN (SELECT clip, round(avg(round(vis, 3)), 3) AS hs FROM v_pose WHERE joint IN ('l_wri', 'r_wri') GROUP BY clip) h ON h.clip = f.clip""", ["v_pose", "v_pose_frames"]))
def subject_confidence(spark, sf):
    kind = F.when(F.col("clip") % 3 == 0, "pose").when(F.col("clip") % 3 == 1, "hands").otherwise("face")
    hands = v_pose(spark, sf).filter(F.col("joint").isin("l_wri", "r_wri")).select("clip", "frame", F.col("vis").alias("score"))
    return ps.subject_confidence(v_pose_frames(spark, sf).withColumn("subject", kind), v_pose(spark, sf), hands)


BONES8 = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(ps.DEPTH_BONES))


@query("depth_scale", with_views(f"""SELECT clip, round(coalesce(median(CASE WHEN iy >= 1e-4 AND iz >= 1e-4 AND wy / iy > 1e-6 THEN (wz / iz) / (wy / iy) END), 0.5e0), 5) AS depth_scale FROM (
    SELECT a.clip, bone, median(abs(b.y - a.y)) AS iy, median(abs(b.z - a.z)) AS iz, median(abs(b.y * 2.5e0 - a.y * 2.5e0)) AS wy, median(abs(b.x - a.x)) AS wz FROM (VALUES {BONES8}) q(bone, ja, jb)
    JOIN v_pose a ON a.joint = ja JOIN v_pose b ON b.joint = jb AND b.clip = a.clip AND b.frame = a.frame GROUP BY a.clip, bone) GROUP BY clip""", ["v_pose"]))
def depth_scale(spark, sf):
    p = v_pose(spark, sf)
    world = p.select("clip", "frame", "joint", "x", (F.col("y") * 2.5).alias("y"), "vis", F.col("x").alias("z"))
    return ps.depth_scale(p, world).select("clip", F.round("depth_scale", 5).alias("depth_scale"))


GAIT = {**NORM, "npv": PIV.replace("FROM v_pose", "FROM nrm"),
        "gs": "SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS t, count(*) OVER (PARTITION BY clip) AS n, l_ank_x - r_ank_x AS gap FROM npv",
        "gb": "SELECT clip, max(n) AS n, max(gap) - min(gap) AS swing, round(least(median(l_ank_vis), median(r_ank_vis)), 2) AS av, max(l_ank_z - r_ank_z) - min(l_ank_z - r_ank_z) AS ds, avg(gap) AS m, stddev_pop(gap) AS sd FROM gs GROUP BY clip",
        "gr": "SELECT a.clip, b.t - a.t AS lag, avg((a.gap - m) / sd * ((b.gap - m) / sd)) AS r FROM gs a JOIN gs b ON a.clip = b.clip AND b.t > a.t AND b.t - a.t < a.n // 2 JOIN gb ON gb.clip = a.clip GROUP BY 1, 2",
        "gl": "SELECT clip, lag, round(r, 3) AS corr FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY r DESC, lag) AS rn FROM (SELECT *, lag(r) OVER w AS p, lead(r) OVER w AS q FROM gr WINDOW w AS (PARTITION BY clip ORDER BY lag)) WHERE r > p AND r >= q AND r > 0) WHERE rn = 1",
        "gsc": "SELECT b.*, coalesce(l.corr, 0e0) AS corr, coalesce(l.lag, 0) AS lag, round(least(1e0, swing / 0.3e0) * greatest(0e0, coalesce(l.corr, 0e0)), 3) AS score FROM gb b LEFT JOIN gl l USING (clip)",
        "th": "SELECT clip, t, n, s, degrees(atan2(kz - hz, ky - hy)) AS a FROM (SELECT clip, t, n, 'l' AS s, l_knee_z AS kz, l_hip_z AS hz, l_knee_y AS ky, l_hip_y AS hy FROM gs UNION ALL SELECT clip, t, n, 'r', r_knee_z, r_hip_z, r_knee_y, r_hip_y FROM gs) WHERE clip IN (SELECT clip FROM gsc WHERE score < 0.6e0)",
        "tu": "SELECT clip, t, n, s, sum(CASE WHEN d IS NULL THEN a ELSE d - 360 * floor((d + 180) / 360) END) OVER (PARTITION BY clip, s ORDER BY t) AS u FROM (SELECT *, a - lag(a) OVER (PARTITION BY clip, s ORDER BY t) AS d FROM th)",
        "td": "SELECT clip, s, t, n, u - (u0 + (u1 - u0) * t / (n - 1)) + mu AS v FROM tu JOIN (SELECT clip, s, arg_min(u, t) AS u0, arg_max(u, t) AS u1, avg(u) AS mu FROM tu GROUP BY clip, s) USING (clip, s)",
        "tc": "SELECT a.clip, covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) AS ant FROM td a JOIN td b ON a.clip = b.clip AND a.t = b.t AND a.s = 'l' AND b.s = 'r' GROUP BY a.clip",
        "tp": f"SELECT clip, s, n, k, re * re + im * im AS p, n * 1e0 / k >= 15e0 / 1.5e0 AND n * 1e0 / k <= 15e0 / 0.5e0 AS sel FROM (SELECT clip, s, n, k, sum(w * cos(2 * {PI} * ((k * t) % n) / n)) AS re, sum(-w * sin(2 * {PI} * ((k * t) % n) / n)) AS im FROM (SELECT *, (v - avg(v) OVER (PARTITION BY clip, s)) * (0.5e0 - 0.5e0 * cos(2 * {PI} * t / (n - 1))) AS w FROM td) JOIN (SELECT unnest(range(1, 2000)) AS k) ON k <= n // 2 GROUP BY clip, s, n, k)",
        "tb": "SELECT clip, s, sum(CASE WHEN sel THEN p END) / sum(p) AS share, max(CASE WHEN rk = 1 AND sel THEN n * 1e0 / k / 15 END) AS period FROM (SELECT *, row_number() OVER (PARTITION BY clip, s, sel ORDER BY p DESC, k) AS rk FROM tp) GROUP BY clip, s"}


@query("gait", with_views("""SELECT clip, score, CASE WHEN score > 0 THEN lag ELSE 0 END AS period, round(swing, 3) AS foot_gap, corr AS periodicity, av AS ankle_visibility, score >= 0.6e0 AS walkable, 'image' AS stride_axis, round(ds, 3) AS depth_gap, round(ant, 2) + 0e0 AS depth_antiphase,
    round(l.share, 2) AS depth_band_l, round(r.share, 2) AS depth_band_r, round(l.period, 2) AS depth_period_l, round(r.period, 2) AS depth_period_r, round(1 - abs(l.period - r.period) / greatest(l.period, r.period, 1e-9), 2) AS depth_agreement
    FROM gsc LEFT JOIN tc USING (clip) LEFT JOIN (SELECT * FROM tb WHERE s = 'l') l USING (clip) LEFT JOIN (SELECT * FROM tb WHERE s = 'r') r USING (clip)""", ["v_pose"], GAIT))
def gait(spark, sf):
    n = ps.normalize_clip(v_pose(spark, sf), _aspect(spark, sf))[0]
    g = ps.gait(n, _aspect(spark, sf)).drop("note")
    return g.withColumn("depth_gap", F.when(F.col("depth_antiphase").isNotNull(), F.col("depth_gap"))).withColumn("depth_antiphase", F.col("depth_antiphase") + 0.0)


def _mid(j, c):
    if j[0] != "@":
        return f"{j}_{c}"
    a = j[1:]
    return f"least(l_{a}_vis, r_{a}_vis)" if c == "vis" else f"(l_{a}_{c} + r_{a}_{c}) / 2"


def bones_sql(chords: bool) -> str:
    named = dict(dims.LIMB_BONES)
    if chords:
        named.update({f"{r}+": (dims.LIMB_BONES[r][0], dims.LIMB_BONES[c][1]) for r, c in dims.LIMB_CHILD.items()})
    return " UNION ALL ".join(f"SELECT clip, frame, '{r}' AS role, {_mid(b, 'x')} - {_mid(a, 'x')} AS bx, {_mid(b, 'y')} - {_mid(a, 'y')} AS by_, least({_mid(a, 'vis')}, {_mid(b, 'vis')}) >= 0.5e0 AS seen FROM piv" for r, (a, b) in named.items())


@query("bones", with_views("SELECT clip, frame, role, round(sqrt(bx * bx + by_ * by_), 5) AS length, round(atan2(by_, bx), 5) + 0e0 AS angle, seen FROM bn", ["v_pose"], {"piv": PIV, "bn": bones_sql(False)}))
def bones(spark, sf):
    return ps.bones(v_pose(spark, sf)).select("clip", "frame", "role", F.round("length", 5).alias("length"), fixed(F.col("angle"), 5).alias("angle"), "seen")


@query("bone_visibility", with_views("SELECT clip, role, round(avg(CASE WHEN seen THEN 1e0 ELSE 0e0 END), 5) AS seen_fraction FROM bn GROUP BY clip, role", ["v_pose"], {"piv": PIV, "bn": bones_sql(True)}))
def bone_visibility(spark, sf):
    return ps.bone_visibility(v_pose(spark, sf)).select("clip", "role", F.round("seen_fraction", 5).alias("seen_fraction"))


UMED = "list_sort(list({v}) FILTER (WHERE {v} IS NOT NULL))[count({v}) // 2 + 1]"


@query("facing", with_views("SELECT clip, round(coalesce(" + UMED.format(v="dx") + ", 0e0), 5) + 0e0 AS side FROM (SELECT clip, CASE WHEN least(l_hip_vis, r_hip_vis) >= 0.5e0 THEN l_hip_x - r_hip_x END AS dx FROM piv) GROUP BY clip", ["v_pose"], {"piv": PIV}))
def facing(spark, sf):
    return ps.facing(v_pose(spark, sf)).select("clip", fixed(F.col("side"), 5).alias("side"))


@query("visible_frames", with_views("SELECT clip, role, count(*) AS usable FROM bn b JOIN (SELECT clip, role, " + UMED.format(v="len") + " AS med FROM (SELECT clip, role, CASE WHEN seen THEN sqrt(bx * bx + by_ * by_) END AS len FROM bn) GROUP BY clip, role) m USING (clip, role) WHERE seen AND sqrt(bx * bx + by_ * by_) >= 0.6e0 * med GROUP BY clip, role", ["v_pose"], {"piv": PIV, "bn": bones_sql(False)}))
def visible_frames(spark, sf):
    b = ps.bones(v_pose(spark, sf)).filter("seen")
    m = ps.upper_median(b, ["clip", "role"], "length", "med")
    return se.salted_join(b, m, ["clip", "role"], ["frame"]).filter(F.col("length") >= F.col("med") * ps.FORESHORTEN).groupBy("clip", "role").agg(F.count(F.lit(1)).alias("usable"))


LIMBS = [("arm-l", 10.0), ("arm-r", -12.0), ("forearm-r", -20.0), ("leg-l", 5.0), ("leg-r", -5.0), ("torso", 0.0)]
TRK = {"piv": PIV, "bn": bones_sql(True), "lim": "SELECT clip, role, px FROM (SELECT DISTINCT clip FROM v_pose) CROSS JOIN (VALUES " + ", ".join(f"('{r}', {p}e0)" for r, p in LIMBS) + ") q(role, px)",
       "fr": "SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip) AS n FROM piv",
       "vf": "SELECT clip, role, avg(CASE WHEN seen THEN 1e0 ELSE 0e0 END) AS vfr FROM bn GROUP BY clip, role",
       "pick": "SELECT l.clip, l.role, CASE WHEN l.role IN ('arm-l', 'leg-l', 'leg-r') AND v.vfr >= 0.5e0 THEN l.role || '+' ELSE l.role END AS bone FROM lim l LEFT JOIN vf v ON v.clip = l.clip AND v.role = l.role || '+'",
       "an": "SELECT p.clip, p.role, i, n, CASE WHEN seen THEN sqrt(bx * bx + by_ * by_) END AS len, atan2(by_, bx) AS ang FROM pick p JOIN bn b ON b.clip = p.clip AND b.role = p.bone JOIN fr f ON f.clip = p.clip AND f.frame = b.frame",
       "md": "SELECT clip, role, " + UMED.format(v="len") + " AS med FROM an GROUP BY clip, role",
       "okk": "SELECT a.*, coalesce(len >= 0.6e0 * med, false) AS ok FROM an a LEFT JOIN md USING (clip, role)",
       "rst": "SELECT clip, role, atan2(sum(sin(ang)), sum(cos(ang))) AS rest, count(*) AS usable FROM okk WHERE ok GROUP BY clip, role",
       "dv": "SELECT o.clip, o.role, i, n, CASE WHEN ok THEN degrees(ang - rest) - 360 * floor((degrees(ang - rest) + 180) / 360) END AS v FROM okk o LEFT JOIN rst USING (clip, role)",
       "hd0": "SELECT clip, role, i, n, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY clip, role ORDER BY i ROWS UNBOUNDED PRECEDING), 0e0) AS v FROM dv",
       "mir": "SELECT clip, coalesce(" + UMED.format(v="dx") + ", 0e0) * 10 < 0 AS mirror FROM (SELECT clip, CASE WHEN least(l_hip_vis, r_hip_vis) >= 0.5e0 THEN l_hip_x - r_hip_x END AS dx FROM piv) GROUP BY clip",
       "hd": "SELECT clip, role, i, n, CASE WHEN mirror THEN -v ELSE v END AS v FROM hd0 JOIN mir USING (clip)",
       "lg": "SELECT clip, role, arg_min(v, i) AS v0, max(v) - min(v) AS rng FROM hd JOIN (SELECT clip, role FROM rst) USING (clip, role) WHERE role IN ('leg-l', 'leg-r') GROUP BY clip, role",
       "cand": "SELECT h.clip, i + 1 AS c FROM hd h JOIN lg USING (clip, role) WHERE abs(v - v0) <= 0.15e0 * rng AND i + 1 >= greatest(4, floor(0.55e0 * n + 0.5e0)) GROUP BY h.clip, i HAVING count(*) = 2",
       "kp": "SELECT n.clip, coalesce(k.c, n.n) AS keep FROM (SELECT clip, max(n) AS n FROM fr GROUP BY clip) n LEFT JOIN (SELECT clip, max(c) AS c FROM cand WHERE clip IN (SELECT clip FROM lg GROUP BY clip HAVING count(*) = 2 AND min(rng) > 0) GROUP BY clip) k USING (clip)",
       "ct": "SELECT h.clip, role, i, v, keep FROM hd h JOIN kp USING (clip) WHERE i < keep",
       "trk": "SELECT c.clip, c.role, c.i, CASE WHEN keep < 4 THEN v ELSE v - ((z - s) - 360 * floor((z - s + 180) / 360)) / keep * (i - (keep - 1) / 2e0) END AS v FROM ct c JOIN (SELECT clip, role, arg_min(v, i) AS s, arg_max(v, i) AS z FROM ct GROUP BY clip, role) USING (clip, role)"}


def _limbs(spark, sf):
    rows = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(p).alias("px")) for r, p in LIMBS])
    return v_clips(spark, sf).select("clip", F.explode(rows).alias("l")).select("clip", "l.*")


@query("bone_tracks", with_views("SELECT clip, role, i, round(v, 3) + 0e0 AS v FROM trk", ["v_pose"], TRK))
def bone_tracks(spark, sf):
    t, _ = ps.bone_tracks(v_pose(spark, sf), _limbs(spark, sf), v_clips(spark, sf))
    return t.select("clip", "role", "i", fixed(F.col("v"), 3).alias("v"))


@query("limb_facts", with_views("""SELECT clip, role, bone, coalesce(usable, 0) AS usable, round(CASE WHEN mirror THEN (180 - d) - 360 * floor((180 - d + 180) / 360) ELSE d END, 3) + 0e0 AS rest_deg, mirror, keep FROM (
    SELECT p.clip, p.role, bone, usable, degrees(coalesce(rest, 0e0)) AS d, mirror, keep FROM pick p LEFT JOIN rst USING (clip, role) JOIN mir USING (clip) JOIN kp USING (clip))""", ["v_pose"], TRK))
def limb_facts(spark, sf):
    _, f = ps.bone_tracks(v_pose(spark, sf), _limbs(spark, sf), v_clips(spark, sf))
    return f.select("clip", "role", "bone", "usable", fixed(F.col("rest_deg"), 3).alias("rest_deg"), "mirror", "keep")


@query("body_channels", with_views("""SELECT clip, frame, round(coalesce(last_value(tilt - mt IGNORE NULLS) OVER w, 0e0), 4) + 0e0 AS tilt, round(coalesce(last_value(CASE WHEN ms <> 0 THEN torso / ms - 1 END IGNORE NULLS) OVER w, 0e0), 4) + 0e0 AS squash FROM bc
    JOIN (SELECT clip, """ + UMED.format(v="tilt") + " AS mt, " + UMED.format(v="torso") + " AS ms FROM bc GROUP BY clip) USING (clip) WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING)", ["v_pose"], {"piv": PIV,
    "bc": """SELECT clip, frame, CASE WHEN least(l_sho_vis, r_sho_vis) >= 0.5e0 THEN (a + 90) - 180 * floor((a + 90) / 180) - 90 END AS tilt, CASE WHEN least(l_sho_vis, r_sho_vis, l_hip_vis, r_hip_vis) >= 0.5e0
        THEN sqrt(((l_sho_x + r_sho_x) / 2 - (l_hip_x + r_hip_x) / 2) ** 2 + ((l_sho_y + r_sho_y) / 2 - (l_hip_y + r_hip_y) / 2) ** 2) END AS torso FROM (SELECT *, degrees(atan2(r_sho_y - l_sho_y, r_sho_x - l_sho_x)) AS a FROM piv)"""}))
def body_channels(spark, sf):
    return ps.body_channels(v_pose(spark, sf)).select("clip", "frame", fixed(F.col("tilt"), 4).alias("tilt"), fixed(F.col("squash"), 4).alias("squash"))


@query("wrist_height", with_views("SELECT clip, frame, round((v - min(v) OVER w) / greatest(1e-3, max(v) OVER w - min(v) OVER w) * 2 - 1, 5) + 0e0 AS up FROM (SELECT clip, frame, ((l_sho_y + r_sho_y) / 2 - (l_wri_y + r_wri_y) / 2) / greatest(1e-3, abs((l_sho_y + r_sho_y) / 2 - (l_hip_y + r_hip_y) / 2)) AS v FROM piv) WINDOW w AS (PARTITION BY clip)", ["v_pose"], {"piv": PIV}))
def wrist_height(spark, sf):
    return ps.wrist_height(v_pose(spark, sf)).select("clip", "frame", fixed(F.col("up"), 5).alias("up"))
