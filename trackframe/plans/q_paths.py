"""Registered queries over tracks, series repairs and polylines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.functions.scalar import fixed, half_even
from trackframe.operators import paths as pt
from trackframe.operators import series as se
from trackframe.plans.views import table, v_day, v_det, v_hist, v_poly, v_signal, with_views

QUERIES, ORACLE = {}, {}
PI = "3.141592653589793e0"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


@query("longest_track", with_views("""SELECT d.clip, d.track_id, d.t, round(d.cx, 5) + 0e0 AS cx FROM v_det d JOIN (SELECT clip, track_id, row_number() OVER (PARTITION BY clip ORDER BY count(*) DESC, min(t), track_id) AS rn
    FROM v_det GROUP BY clip, track_id) b ON b.clip = d.clip AND b.track_id = d.track_id AND rn = 1""", ["v_det"]))
def longest_track(spark, sf):
    return pt.longest_track(v_det(spark, sf)).select("clip", "track_id", "t", fixed(F.col("cx"), 5).alias("cx"))


@query("min_length_gate", with_views("""SELECT clip, track_id, count(*) AS n, count(*) >= 6 AS ok, CASE WHEN count(*) < 6 THEN 'only ' || count(*) || ' detections (need 6)' END AS note FROM v_det GROUP BY clip, track_id""", ["v_det"]))
def min_length_gate(spark, sf):
    return pt.min_length_gate(v_det(spark, sf), ["clip", "track_id"], pt.MIN_POINTS, "detections")


# every third day of a user goes missing in the gap queries
DENSE = {"rng": "SELECT clip, min(t) AS lo, max(t) AS hi, count(*) AS raw FROM v_day GROUP BY clip HAVING count(*) >= 6",
         "nxt": "SELECT v.*, lead(t) OVER w AS t2, lead(cx) OVER w AS cx2, lead(cy) OVER w AS cy2, lead(w) OVER w AS w2, lead(h) OVER w AS h2 FROM v_day v WINDOW w AS (PARTITION BY clip ORDER BY t)",
         "dns": """SELECT clip, t + k AS t, k > 0 AS filled, CASE WHEN k > 0 THEN cx + (cx2 - cx) * k / (t2 - t) ELSE cx END AS cx, CASE WHEN k > 0 THEN cy + (cy2 - cy) * k / (t2 - t) ELSE cy END AS cy,
             CASE WHEN k > 0 THEN w + (w2 - w) * k / (t2 - t) ELSE w END AS w, CASE WHEN k > 0 THEN h + (h2 - h) * k / (t2 - t) ELSE h END AS h
             FROM nxt JOIN (SELECT unnest(range(0, 40)) AS k) ON k = 0 OR k < t2 - t WHERE clip IN (SELECT clip FROM rng)""",
         "num": "SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY clip) AS n FROM dns",
         "smo": """SELECT *, CASE WHEN r = 0 THEN cx WHEN r = 1 THEN avg(cx) OVER w1 ELSE avg(cx) OVER w2 END AS sx, CASE WHEN r = 0 THEN cy WHEN r = 1 THEN avg(cy) OVER w1 ELSE avg(cy) OVER w2 END AS sy FROM (
             SELECT *, least(2, i, n - 1 - i) AS r FROM num) WINDOW w1 AS (PARTITION BY clip ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), w2 AS (PARTITION BY clip ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
         "pts": "SELECT *, sx - first_value(sx) OVER w AS dx, sy - first_value(sy) OVER w AS dy, first_value(sx) OVER w AS x0, first_value(sy) OVER w AS y0, sqrt((sx - lag(sx) OVER w) ** 2 + (sy - lag(sy) OVER w) ** 2) AS leg FROM smo WINDOW w AS (PARTITION BY clip ORDER BY i)",
         "sums": """SELECT p.clip, count(*) AS frames, max(raw) AS raw, count(*) FILTER (WHERE filled) AS filled_n, max(x0) AS x0, max(y0) AS y0, arg_max(dx, i) AS dx, arg_max(dy, i) AS dy,
             max(sx) - min(sx) AS span_x, max(sy) - min(sy) AS span_y, coalesce(sum(leg), 0e0) AS dist, avg(w) AS w, avg(h) AS h FROM pts p JOIN rng USING (clip) GROUP BY p.clip"""}


@query("densify", with_views("SELECT clip, t, filled, round(cx, 5) + 0e0 AS cx, round(cy, 5) + 0e0 AS cy FROM dns", ["v_day"], {k: (v if k != "dns" else v.replace(" WHERE clip IN (SELECT clip FROM rng)", "")) for k, v in DENSE.items() if k in ("nxt", "dns")}))
def densify(spark, sf):
    d = se.densify(v_day(spark, sf), ["clip"], ["cx", "cy", "w", "h"])
    return d.select("clip", "t", "filled", fixed(F.col("cx"), 5).alias("cx"), fixed(F.col("cy"), 5).alias("cy"))


def _clips(day):
    return day.select("clip").distinct().select("clip", F.lit("event").alias("label"), F.lit(15.0).alias("fps"), F.lit(40).cast("long").alias("total_frames"))


@query("path_points", with_views("SELECT clip, i, t, filled, round(dx, 5) + 0e0 AS dx, round(dy, 5) + 0e0 AS dy FROM pts", ["v_day"], DENSE))
def path_points(spark, sf):
    d = v_day(spark, sf)
    return pt.build_path(d, _clips(d))[0]


@query("smooth_pinned", with_views("SELECT clip, i, round(sx, 5) + 0e0 AS x, round(sy, 5) + 0e0 AS y FROM smo", ["v_day"], DENSE))
def smooth_pinned(spark, sf):
    d = v_day(spark, sf)
    n = d.groupBy("clip").agg(F.count(F.lit(1)).alias("_c")).filter("_c >= 6")
    dense = se.dense_index(se.densify(d.join(n, "clip", "left_semi"), ["clip"], ["cx", "cy"]), ["clip"], ["t"], F.col("t"), name="i")
    d = se.group_stats(dense, ["clip"], [F.count(F.lit(1)).alias("n")], ["i"])
    return se.smooth_pinned(d, ["clip"], ["cx", "cy"]).select("clip", "i", fixed(F.col("cx"), 5).alias("x"), fixed(F.col("cy"), 5).alias("y"))


@query("path_summary", with_views("""SELECT clip, 'event' AS label, frames, 15e0 AS fps, round(x0, 5) + 0e0 AS start_x, round(y0, 5) + 0e0 AS start_y, round(w, 5) + 0e0 AS size_w, round(h, 5) + 0e0 AS size_h, round(dx, 5) + 0e0 AS dx, round(dy, 5) + 0e0 AS dy,
    round(span_x, 5) + 0e0 AS span_x, round(span_y, 5) + 0e0 AS span_y, round(dist, 5) + 0e0 AS dist, CASE WHEN dist > 1e-6 THEN round(sqrt(dx * dx + dy * dy) / dist, 4) ELSE 0e0 END AS straightness, round(raw / 40e0, 3) AS confidence,
    (CASE WHEN filled_n > 0 THEN 1 ELSE 0 END) + (CASE WHEN sqrt(dx * dx + dy * dy) < 0.02e0 THEN 2 ELSE 0 END) + (CASE WHEN greatest(w, h) > 0.6e0 THEN 4 ELSE 0 END) + (CASE WHEN round(raw / 40e0, 3) < 0.5e0 THEN 8 ELSE 0 END) AS warned FROM sums""", ["v_day"], DENSE))
def path_summary(spark, sf):
    d = v_day(spark, sf)
    s = pt.build_path(d, _clips(d))[1]
    has = lambda text, code: F.when(F.exists("warnings", lambda w: w.contains(text)), code).otherwise(0)
    return s.withColumn("warned", has("gaps filled", 1) + has("hovering", 2) + has("large box", 4) + has("short track", 8)).drop("warnings")


GAPPY = {"spine": "SELECT clip, lo + k AS t, v.cx, v.cy FROM (SELECT clip, min(t) AS lo, max(t) AS hi FROM v_day GROUP BY clip) JOIN (SELECT unnest(range(0, 40)) AS k) ON lo + k <= hi LEFT JOIN (SELECT clip AS c2, t AS t2, cx, cy FROM v_day WHERE (t * 7 + clip) % 5 > 1) v ON c2 = clip AND t2 = lo + k",
         "arnd": """SELECT *, max(CASE WHEN cx IS NOT NULL THEN t END) OVER b AS lt, min(CASE WHEN cx IS NOT NULL THEN t END) OVER f AS rt, last_value(cx IGNORE NULLS) OVER b AS lx, first_value(cx IGNORE NULLS) OVER f AS rx, last_value(cy IGNORE NULLS) OVER b AS ly, first_value(cy IGNORE NULLS) OVER f AS ry FROM spine
             WINDOW b AS (PARTITION BY clip ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY clip ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""}


def _spine(spark, sf):
    d = v_day(spark, sf)
    rng = d.groupBy("clip").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    spine = rng.select("clip", F.explode(F.sequence("lo", "hi")).alias("t"))
    seen = d.filter((F.col("t") * 7 + F.col("clip")) % 5 > 1).select("clip", "t", "cx", "cy")
    return spine.join(seen, ["clip", "t"], "left")


@query("fill_gaps", with_views("""SELECT clip, t, CASE WHEN cx IS NOT NULL THEN 'ok' WHEN rt - lt - 1 <= 2 THEN 'interp' ELSE 'gap' END AS flag,
    round(CASE WHEN cx IS NOT NULL THEN cx WHEN rt - lt - 1 <= 2 THEN lx + (rx - lx) * (t - lt) / (rt - lt) END, 5) + 0e0 AS cx,
    round(CASE WHEN cx IS NOT NULL THEN cy WHEN rt - lt - 1 <= 2 THEN ly + (ry - ly) * (t - lt) / (rt - lt) END, 5) + 0e0 AS cy FROM arnd""", ["v_day"], GAPPY))
def fill_gaps(spark, sf):
    d = se.fill_gaps(_spine(spark, sf), ["clip"], ["cx", "cy"], k=2)
    return d.select("clip", "t", "flag", fixed(F.col("cx"), 5).alias("cx"), fixed(F.col("cy"), 5).alias("cy"))


@query("hold_last", with_views("SELECT clip, t, round(coalesce(lx, 0e0), 5) + 0e0 AS cx FROM arnd", ["v_day"], GAPPY))
def hold_last(spark, sf):
    return se.hold_last(_spine(spark, sf), ["clip"], ["cx"]).select("clip", "t", fixed(F.col("cx"), 5).alias("cx"))


@query("interp_time", with_views("SELECT clip, t, cx IS NULL AS filled, round(coalesce(cx, lx + (rx - lx) * (t - lt) / (rt - lt), lx, rx, 0e0), 5) + 0e0 AS cx FROM arnd", ["v_day"], GAPPY))
def interp_time(spark, sf):
    return se.interp_time(_spine(spark, sf), ["clip"], "cx").select("clip", "t", "filled", fixed(F.col("cx"), 5).alias("cx"))


RUNS = {"isl": """SELECT clip, t, t - row_number() OVER (PARTITION BY clip ORDER BY t) AS g FROM v_signal WHERE v > 0""",
        "rn": "SELECT clip, min(t) AS start, max(t) + 1 AS stop, count(*) AS length FROM isl GROUP BY clip, g"}


@query("runs", with_views("SELECT * FROM rn WHERE length >= 3", ["v_signal"], RUNS))
def runs(spark, sf):
    return se.runs(v_signal(spark, sf), ["clip"], F.col("v") > 0, min_len=3)


@query("longest_run", with_views("SELECT clip, start, stop, length FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY length DESC, start) AS k FROM rn) WHERE k = 1", ["v_signal"], RUNS))
def longest_run(spark, sf):
    return se.longest_run(v_signal(spark, sf), ["clip"], F.col("v") > 0)


ANG = {"ang": "SELECT clip, t, 900e0 * v AS a FROM v_signal",
       "stp": "SELECT clip, t, a, a - lag(a) OVER (PARTITION BY clip ORDER BY t) AS d FROM ang",
       "unw": "SELECT clip, t, sum(CASE WHEN d IS NULL THEN a ELSE d - 360 * floor((d + 180) / 360) END) OVER (PARTITION BY clip ORDER BY t) AS u FROM stp"}


def _angles(spark, sf):
    return v_signal(spark, sf).select("clip", "t", (F.col("v") * 900).alias("a"))


@query("unwrap", with_views("SELECT clip, t, round(u, 4) + 0e0 AS a FROM unw", ["v_signal"], ANG))
def unwrap(spark, sf):
    return se.unwrap_degrees(_angles(spark, sf), ["clip"], "a").select("clip", "t", fixed(F.col("a"), 4).alias("a"))


@query("detrend_ends", with_views("SELECT clip, t, round(u - (u0 + (u1 - u0) * t / 63e0) + m, 4) + 0e0 AS a FROM unw JOIN (SELECT clip, arg_min(u, t) AS u0, arg_max(u, t) AS u1, avg(u) AS m FROM unw GROUP BY clip) USING (clip)", ["v_signal"], ANG))
def detrend_ends(spark, sf):
    u = se.unwrap_degrees(_angles(spark, sf), ["clip"], "a")
    return se.detrend_ends(u, ["clip"], "a").select("clip", "t", fixed(F.col("a"), 4).alias("a"))


@query("close_loop", with_views("""SELECT clip, t, round(a - ((z - s) - 360 * floor((z - s + 180) / 360)) / 64e0 * (t - 31.5e0), 4) + 0e0 AS a FROM ang
    JOIN (SELECT clip, arg_min(a, t) AS s, arg_max(a, t) AS z FROM ang GROUP BY clip) USING (clip)""", ["v_signal"], ANG))
def close_loop(spark, sf):
    return se.close_loop(_angles(spark, sf), ["clip"], "a").select("clip", "t", fixed(F.col("a"), 4).alias("a"))


@query("circular_mean", with_views("SELECT clip, round(degrees(atan2(sum(sin(radians(a))), sum(cos(radians(a))))), 4) + 0e0 AS mean_deg, round(sqrt(sum(sin(radians(a))) ** 2 + sum(cos(radians(a))) ** 2) / count(*), 4) AS resultant FROM ang GROUP BY clip", ["v_signal"], ANG))
def circular_mean(spark, sf):
    c = se.circular_mean(_angles(spark, sf), ["clip"], F.radians("a"))
    return c.select("clip", fixed(F.degrees("mean_angle"), 4).alias("mean_deg"), F.round("resultant", 4).alias("resultant"))


@query("detrend_minmax", with_views("""SELECT clip, t, round(2 * (v - lo) / greatest(1e-3, hi - lo) - 1, 5) + 0e0 AS v FROM v_signal JOIN (SELECT clip, min(v) AS lo, max(v) AS hi FROM v_signal GROUP BY clip) USING (clip)""", ["v_signal"]))
def minmax_scale(spark, sf):
    s = se.group_stats(v_signal(spark, sf), ["clip"], [F.min("v").alias("lo"), F.max("v").alias("hi")], ["t"])
    return s.select("clip", "t", fixed((F.col("v") - F.col("lo")) / F.greatest(F.lit(1e-3), F.col("hi") - F.col("lo")) * 2 - 1, 5).alias("v"))


ARC = {"arc": "SELECT clip, i, x, y, sum(leg) OVER (PARTITION BY clip ORDER BY i) AS cum FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0e0) AS leg FROM v_poly WINDOW w AS (PARTITION BY clip ORDER BY i))",
       "tot": "SELECT clip, max(cum) AS total FROM arc GROUP BY clip HAVING count(*) >= 2 AND max(cum) > 0.5e0",
       "seg": "SELECT clip, i, lag(cum) OVER w AS c0, cum AS c1, lag(x) OVER w AS x0, x AS x1, lag(y) OVER w AS y0, y AS y1 FROM arc WINDOW w AS (PARTITION BY clip ORDER BY i)"}


def at_arc(src: str) -> str:
    """Points at the fractions f of `src` (clip, f and more)."""
    return f"""SELECT q.*, x0 + (x1 - x0) * (tg - c0) / (c1 - c0) AS px, y0 + (y1 - y0) * (tg - c0) / (c1 - c0) AS py FROM (SELECT s.*, greatest(0e0, least(1e0, f)) * total AS tg FROM {src} s JOIN tot USING (clip)) q
        JOIN seg g ON g.clip = q.clip AND c1 > c0 AND ((tg > c0 AND tg <= c1) OR (tg = 0 AND c0 = 0))"""


@query("arc_length", with_views("SELECT clip, i, round(cum, 4) + 0e0 AS cum FROM arc", ["v_poly"], ARC))
def arc_length(spark, sf):
    return pt.arc_length(v_poly(spark, sf)).select("clip", "i", fixed(F.col("cum"), 4).alias("cum"))


@query("resample_by_arc", with_views("SELECT clip, round(f, 4) AS f, round(px, 3) + 0e0 AS x, round(py, 3) + 0e0 AS y FROM smp", ["v_poly"], {**ARC, "fr": "SELECT clip, k / 8e0 AS f FROM tot CROSS JOIN (SELECT unnest(range(0, 9)) AS k)", "smp": at_arc("fr")}))
def resample_by_arc(spark, sf):
    p = v_poly(spark, sf)
    at = p.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select("clip", (F.col("k") / 8.0).alias("f"))
    d = pt.resample_by_arc(p, at)
    return d.select("clip", F.round("f", 4).alias("f"), fixed(F.col("x"), 3).alias("x"), fixed(F.col("y"), 3).alias("y"))


@query("bracket_sample", with_views("""SELECT z.clip, pos, round(coalesce(l.cx + (r.cx - l.cx) * CASE WHEN r.t > l.t THEN (pos - l.t) / (r.t - l.t) ELSE 0e0 END, l.cx, r.cx), 5) + 0e0 AS cx FROM (
    SELECT clip, pos, (SELECT max(t) FROM v_day v WHERE v.clip = q.clip AND v.t <= pos) AS lt, (SELECT min(t) FROM v_day v WHERE v.clip = q.clip AND v.t >= pos) AS rt FROM (
    SELECT DISTINCT clip, k * 0.75e0 AS pos FROM v_day CROSS JOIN (SELECT unnest(range(0, 40)) AS k)) q) z LEFT JOIN v_day l ON l.clip = z.clip AND l.t = lt LEFT JOIN v_day r ON r.clip = z.clip AND r.t = rt""", ["v_day"]))
def bracket_sample(spark, sf):
    d = v_day(spark, sf).select("clip", F.col("t").cast("double").alias("pos"), "cx")
    q = d.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")).select("clip", (F.col("k") * 0.75).cast("double").alias("pos"))
    return pt.bracket_sample(d, q, ["clip"], "pos", ["cx"]).select("clip", "pos", fixed(F.col("cx"), 5).alias("cx"))


@query("seam_gap", with_views("SELECT clip, round(sqrt((arg_max(x, i) - arg_min(x, i)) ** 2 + (arg_max(y, i) - arg_min(y, i)) ** 2), 4) + 0e0 AS gap FROM v_poly GROUP BY clip", ["v_poly"]))
def seam_gap(spark, sf):
    return pt.seam_gap(v_poly(spark, sf)).select("clip", fixed(F.col("gap"), 4).alias("gap"))


ART = {"art": "SELECT clip, (clip % 7) * 40e0 AS bx, (clip % 5) * 50e0 AS by_, 60e0 AS bw, 80e0 AS bh, 500e0 AS vw, 400e0 AS vh FROM rng",
       "room": "SELECT clip, vw, vh, greatest(0e0, bx - 8) AS l_, greatest(0e0, vw - bx - bw - 8) AS r_, greatest(0e0, by_ - 8) AS u_, greatest(0e0, vh - by_ - bh - 8) AS d_ FROM art",
       "want": "SELECT clip, max(round(dx, 5)) AS wr, max(-round(dx, 5)) AS wl, max(round(dy, 5)) AS wd, max(-round(dy, 5)) AS wu, max(i) AS span FROM pts GROUP BY clip",
       "fit": """SELECT *, least(1e0, CASE WHEN wr * vw > 1e-3 THEN r_ / (wr * vw) ELSE 1e0 END, CASE WHEN wl * vw > 1e-3 THEN l_ / (wl * vw) ELSE 1e0 END,
           CASE WHEN wd * vh > 1e-3 THEN d_ / (wd * vh) ELSE 1e0 END, CASE WHEN wu * vh > 1e-3 THEN u_ / (wu * vh) ELSE 1e0 END) AS k FROM want JOIN room USING (clip)"""}


def _art(points):
    c = F.col("clip")
    return points.select("clip").distinct().select(
        "clip", ((c % 7) * 40).cast("double").alias("bx"), ((c % 5) * 50).cast("double").alias("by_"), F.lit(60.0).alias("bw"), F.lit(80.0).alias("bh"), F.lit(500.0).alias("vw"), F.lit(400.0).alias("vh"))


@query("extent_fit", with_views("SELECT clip, span, round(k, 5) AS scale FROM fit", ["v_day"], {**DENSE, **ART}))
def extent_fit(spark, sf):
    d = v_day(spark, sf)
    p = pt.build_path(d, _clips(d))[0]
    return pt.extent_fit(p, _art(p)).select("clip", "span", F.round("scale", 5).alias("scale"))


@query("path_playback", with_views(f"""SELECT clip, tt, round(greatest(-l_, least(r_, ox)), 3) + 0e0 AS dx, round(greatest(-u_, least(d_, oy)), 3) + 0e0 AS dy FROM (
    SELECT f.clip, tt, l_, r_, u_, d_, (a.dx + (c.dx - a.dx) * (pos - ii)) * k * vw - ny * bob AS ox, (a.dy + (c.dy - a.dy) * (pos - ii)) * k * vh + nx * bob AS oy FROM (
    SELECT *, least(span - 1, CAST(floor(pos) AS BIGINT)) AS ii FROM (SELECT *, CASE WHEN u <= span THEN u ELSE 2 * span - u END AS pos FROM (
    SELECT f.*, tt, (tt * 15) - floor(tt * 15 / (2 * span)) * 2 * span AS u, CASE WHEN sdx = 0 AND sdy = 0 THEN 0e0 ELSE sdx / sqrt(sdx * sdx + sdy * sdy) END AS nx, CASE WHEN sdx = 0 AND sdy = 0 THEN 0e0 ELSE sdy / sqrt(sdx * sdx + sdy * sdy) END AS ny,
    4 * (0.4e0 + 0.25e0) * sin(2 * {PI} * 0.28e0 * (0.6e0 + 1.5e0 * 0.5e0) * tt) AS bob FROM fit f JOIN (SELECT clip, round(dx, 5) AS sdx, round(dy, 5) AS sdy FROM sums) USING (clip) CROSS JOIN (SELECT unnest(range(0, 12)) * 0.3e0 AS tt)))) f
    JOIN (SELECT clip, i, round(dx, 5) AS dx, round(dy, 5) AS dy FROM pts) a ON a.clip = f.clip AND a.i = ii JOIN (SELECT clip, i, round(dx, 5) AS dx, round(dy, 5) AS dy FROM pts) c ON c.clip = f.clip AND c.i = ii + 1)""", ["v_day"], {**DENSE, **ART}))
def path_playback(spark, sf):
    d = v_day(spark, sf)
    p, s = pt.build_path(d, _clips(d))
    dials = s.select("clip", F.lit(0.25).alias("amplitude"), F.lit(1.5).alias("frequency"))
    inst = s.select("clip", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).select("clip", (F.col("k") * F.lit(0.3)).alias("tt"))
    o = pt.path_playback(p, s, _art(p), dials, inst)
    return o.select("clip", "tt", fixed(F.col("dx"), 3).alias("dx"), fixed(F.col("dy"), 3).alias("dy"))


@query("route_playback", with_views("SELECT clip, tt, round(px - sx, 3) + 0e0 AS dx, round(py - sy, 3) + 0e0 AS dy FROM smp JOIN (SELECT clip, arg_min(x, i) AS sx, arg_min(y, i) AS sy FROM v_poly GROUP BY clip) USING (clip)", ["v_poly"], {
    **ARC, "fr": """SELECT clip, tt, CASE WHEN clip % 2 = 0 THEN raw - floor(raw) ELSE least(1e0, raw) ** 2 * (3 - 2 * least(1e0, raw)) END AS f FROM (SELECT clip, tt, tt / 2.5e0 AS raw FROM tot CROSS JOIN (SELECT unnest(range(0, 10)) * 0.4e0 AS tt))""", "smp": at_arc("fr")}))
def route_playback(spark, sf):
    p = v_poly(spark, sf)
    clips = p.select("clip").distinct()
    routes = clips.select("clip", F.lit(2.5).alias("duration"), (F.col("clip") % 2 == 0).alias("loop"))
    inst = clips.select("clip", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("clip", (F.col("k") * F.lit(0.4)).alias("tt"))
    o = pt.route_playback(p, routes, inst)
    return o.select("clip", "tt", fixed(F.col("dx"), 3).alias("dx"), fixed(F.col("dy"), 3).alias("dy"))
