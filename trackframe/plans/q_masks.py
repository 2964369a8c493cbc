"""Registered queries over masks, camera, depth and cloth, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.functions.scalar import fixed
from trackframe.operators import cloth as cl
from trackframe.operators import masks as mk
from trackframe.plans.q_flow import MASKED, _mask
from trackframe.plans.views import _vectors, table, v_clips, v_flow, v_pixels, v_poly, with_views

QUERIES, ORACLE = {}, {}
PI = "3.141592653589793e0"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def _sizes(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip"), F.lit(8).alias("h"), F.lit(8).alias("w"))


ENERGY = {"en": "SELECT clip, y, x, max(sqrt(vx * vx + vy * vy)) AS energy FROM v_flow GROUP BY clip, y, x"}


@query("motion_energy", with_views("SELECT clip, y, x, round(energy, 5) AS energy FROM en", ["v_flow"], ENERGY))
def motion_energy(spark, sf):
    return mk.motion_energy(v_flow(spark, sf)).select("clip", "y", "x", F.round("energy", 5).alias("energy"))


GATE = {**ENERGY, "bx": "SELECT * FROM en WHERE x >= 1 AND x < 7 AND y >= 1 + clip % 2 AND y < 8", "gt": "SELECT clip, y, x FROM bx JOIN (SELECT clip, quantile_cont(energy, 0.7) AS q FROM bx GROUP BY clip) USING (clip) WHERE energy > greatest(0.6e0, q)"}


def _gate(spark, sf):
    boxes = v_clips(spark, sf).select("clip", F.lit(1).alias("x0"), (F.col("clip") % 2 + 1).alias("y0"), F.lit(7).alias("x1"), F.lit(8).alias("y1"))
    return mk.motion_gate(mk.motion_energy(v_flow(spark, sf)), boxes), boxes


@query("motion_gate", with_views("SELECT * FROM gt", ["v_flow"], GATE))
def motion_gate(spark, sf):
    return _gate(spark, sf)[0]


@query("mask_intersect", with_views("SELECT clip, y, x FROM gt WHERE EXISTS (SELECT 1 FROM msk m WHERE m.clip = gt.clip AND m.y = gt.y AND m.x = gt.x)", ["v_flow"], {**GATE, **MASKED}))
def mask_intersect(spark, sf):
    return mk.intersect(_gate(spark, sf)[0], _mask(v_flow(spark, sf)))


KER = ", ".join(f"({a}, {b})" for a, b in mk.ELLIPSE)


def _erode(src: str) -> str:
    return f"""SELECT g.clip, g.y, g.x FROM (SELECT vec_id AS clip, y, x FROM embeddings CROSS JOIN (SELECT unnest(range(0, 8)) AS y) CROSS JOIN (SELECT unnest(range(0, 8)) AS x)) g CROSS JOIN ker
        LEFT JOIN {src} m ON m.clip = g.clip AND m.y = g.y + dy AND m.x = g.x + dx WHERE g.y + dy BETWEEN 0 AND 7 AND g.x + dx BETWEEN 0 AND 7 GROUP BY ALL HAVING count(*) = count(m.clip)"""


def _dilate(src: str) -> str:
    return f"SELECT DISTINCT clip, y + dy AS y, x + dx AS x FROM {src} CROSS JOIN ker WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7"


MORPH = {"dens": "SELECT clip, t // 8 AS y, t % 8 AS x FROM v_signal WHERE v > -0.1e0", "ker": f"SELECT * FROM (VALUES {KER}) q(dy, dx)", "e1": _erode("dens"), "d1": _dilate("e1"), "d2": _dilate("d1"), "e2": _erode("d2")}


def _dense(spark, sf):
    from trackframe.plans.views import v_signal
    px = v_signal(spark, sf).filter("v > -0.1").select("clip", F.floor(F.col("t") / 8).alias("y"), F.pmod("t", F.lit(8)).cast("long").alias("x"))
    return px.withColumn("h", F.lit(8)).withColumn("w", F.lit(8))


@query("erode", with_views("SELECT clip, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM e1", ["v_signal"], MORPH))
def erode(spark, sf):
    return mk.erode(_dense(spark, sf)).select("clip", "y", "x")


@query("dilate", with_views("SELECT clip, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM dd", ["v_pixels"], {"ker": MORPH["ker"], "dd": _dilate("v_pixels")}))
def dilate(spark, sf):
    return mk.dilate(v_pixels(spark, sf).withColumn("h", F.lit(8)).withColumn("w", F.lit(8))).select("clip", "y", "x")


@query("open_close", with_views("SELECT clip, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM e2", ["v_signal"], MORPH))
def open_close(spark, sf):
    return mk.open_close(_dense(spark, sf)).select("clip", "y", "x")


@query("finish_mask")
def finish_mask(spark, sf):
    d = _dense(spark, sf)
    return mk.finish_mask(d, v_pixels(spark, sf).unionByName(d.select("clip", "y", "x").filter("y > 1")).distinct(), _sizes(spark, sf))


PICK = {"cnd": "SELECT clip, CASE WHEN x < 4 THEN 0 ELSE 1 END AS rk, CASE WHEN x < 4 THEN 'first' ELSE 'second' END AS method, y, x FROM v_pixels WHERE clip % 9 > 0",
        "cnt": "SELECT clip, rk, method, count(*) AS px FROM cnd GROUP BY clip, rk, method",
        "cho": "SELECT clip, rk, method, px FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY CASE WHEN rk = 0 AND px >= 16 THEN 0 ELSE 1 END, px DESC, rk) AS rn FROM cnt) WHERE rn = 1"}


def _pick(spark, sf):
    left = F.col("x") < 4
    c = v_pixels(spark, sf).filter("clip % 9 > 0").select("clip", F.when(left, 0).otherwise(1).alias("rank"), F.when(left, "first").otherwise("second").alias("method"), "y", "x")
    boxes = _sizes(spark, sf).select("clip", *[F.lit(v).cast("long").alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", 8), ("y1", 8))])
    return mk.pick_mask(c, boxes)


@query("pick_mask", with_views("SELECT e.vec_id AS clip, coalesce(c.method, 'bbox_empty_fallback') AS method, coalesce(c.px, 64) AS px FROM embeddings e LEFT JOIN cho c ON c.clip = e.vec_id", ["v_pixels"], PICK))
def pick_mask(spark, sf):
    return _pick(spark, sf)[1].select("clip", "method", F.col("px").cast("long").alias("px"))


@query("picked_pixels", with_views("""SELECT e.vec_id AS clip, count(*) AS px, CAST(sum(y * 8 + x) AS BIGINT) AS spot FROM embeddings e JOIN (SELECT clip, y, x FROM cnd JOIN cho USING (clip, rk) UNION ALL
    SELECT vec_id, y, x FROM embeddings CROSS JOIN (SELECT unnest(range(0, 8)) AS y) CROSS JOIN (SELECT unnest(range(0, 8)) AS x) WHERE vec_id NOT IN (SELECT clip FROM cho)) p ON p.clip = e.vec_id GROUP BY 1""", ["v_pixels"], PICK))
def picked_pixels(spark, sf):
    return _pick(spark, sf)[0].groupBy("clip").agg(F.count(F.lit(1)).alias("px"), F.sum(F.col("y") * 8 + F.col("x")).alias("spot"))


@query("mask_stats", with_views("""SELECT vec_id AS clip, coalesce(round(min(x) / 8e0, 4), 0e0) AS bx, coalesce(round(min(y) / 8e0, 4), 0e0) AS by_, coalesce(round((max(x) - min(x) + 1) / 8e0, 4), 1e0) AS bw, coalesce(round((max(y) - min(y) + 1) / 8e0, 4), 1e0) AS bh, round(count(p.clip) / 64e0, 4) AS coverage
    FROM embeddings LEFT JOIN (SELECT * FROM v_pixels WHERE clip % 11 > 0) p ON p.clip = vec_id GROUP BY vec_id""", ["v_pixels"]))
def mask_stats(spark, sf):
    return mk.mask_stats(v_pixels(spark, sf).filter("clip % 11 > 0"), _sizes(spark, sf))


RLE = {"bits": "SELECT clip, t, v > 0.05e0 AND clip % 11 > 0 AS b FROM v_signal", "chg": "SELECT *, sum(CASE WHEN b = p THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY t) - 1 AS run FROM (SELECT *, lag(b) OVER (PARTITION BY clip ORDER BY t) AS p FROM bits)",
       "rle": "SELECT clip, CAST(run + CASE WHEN f THEN 1 ELSE 0 END AS BIGINT) AS k, count(*) AS length FROM chg JOIN (SELECT clip AS c, b AS f FROM bits WHERE t = 0) ON c = clip GROUP BY clip, run, f UNION ALL SELECT clip, 0, 0 FROM bits WHERE t = 0 AND b"}


@query("rle_encode", with_views("SELECT * FROM rle", ["v_signal"], RLE))
def rle_encode(spark, sf):
    return mk.rle_encode(v_pixels(spark, sf).filter("clip % 11 > 0"), _sizes(spark, sf))


@query("rle_decode", with_views("SELECT clip, y, x FROM v_pixels WHERE clip % 11 > 0", ["v_pixels"]))
def rle_decode(spark, sf):
    return mk.rle_decode(mk.rle_encode(v_pixels(spark, sf).filter("clip % 11 > 0"), _sizes(spark, sf)), _sizes(spark, sf))


# similarity transforms from the vectors
PAIR = {"par": """SELECT clip, t, s * cos(th) AS a, s * sin(th) AS b, CAST(embedding[3] AS DOUBLE) * 20 AS tx, CAST(embedding[4] AS DOUBLE) * 20 AS ty, vec_id % 40 + 10 AS inliers, CAST(50 AS BIGINT) AS matches FROM (
    SELECT *, 1 + CAST(embedding[1] AS DOUBLE) / 20 AS s, CAST(embedding[2] AS DOUBLE) / 10 AS th FROM v_vec)""",
        "cor": "SELECT *, (" + " + ".join(f"sqrt((a * {x} - b * {y} + tx - {x}) ** 2 + (b * {x} + a * {y} + ty - {y}) ** 2)" for x, y in ((0, 0), (480, 0), (480, 270), (0, 270))) + ") / 4 AS dr FROM par",
        "acc": "SELECT clip, t, CASE WHEN ok THEN 'affine' ELSE 'none' END AS model, CASE WHEN ok THEN dr ELSE 0e0 END AS drift FROM (SELECT *, inliers >= 20 AND inliers >= 0.5e0 * matches AND dr < 120 AS ok FROM cor)"}


def _pairs(spark, sf):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    s, th = at(0) / 20 + 1, at(1) / 10
    a, b, z = s * F.cos(th), s * F.sin(th), F.lit(0.0)
    return _vectors(spark, sf).select("clip", "t", F.array(a, -b, at(2) * 20, b, a, at(3) * 20, z, z, F.lit(1.0)).alias("m"), (F.col("vec_id") % 40 + 10).alias("inliers"), F.lit(50).cast("long").alias("matches"))


def _csizes(spark, sf):
    return v_clips(spark, sf).select("clip", F.lit(270).alias("h"), F.lit(480).alias("w"))


@query("accept_pairs", with_views("SELECT clip, t, model, round(drift, 5) + 0e0 AS drift FROM acc", ["v_vec"], PAIR))
def accept_pairs(spark, sf):
    return mk.accept_pairs(_pairs(spark, sf), _csizes(spark, sf)).select("clip", "t", "model", fixed(F.col("drift"), 5).alias("drift"))


@query("camera_static", with_views("""SELECT clip, coalesce(m < 3, true) AS is_static, CASE WHEN coalesce(m < 3, true) THEN 'none' ELSE 'affine' END AS model, round(coalesce(m, 0e0), 3) AS residual_px, (CASE WHEN nn > 0 THEN 1 ELSE 0 END) + (CASE WHEN m IS NULL THEN 1 ELSE 0 END) AS warnings FROM (
    SELECT clip, median(CASE WHEN model = 'affine' THEN drift END) AS m, count(*) FILTER (WHERE model = 'none') AS nn FROM v_clips LEFT JOIN (SELECT * FROM acc WHERE clip <> 3) USING (clip) GROUP BY clip)""", ["v_vec", "v_clips"], PAIR))
def camera_static(spark, sf):
    pairs = _pairs(spark, sf).filter("clip <> 3")  # one clip without any pair
    c = mk.camera_static(mk.accept_pairs(pairs, _csizes(spark, sf)), clips=v_clips(spark, sf))
    return c.select("clip", "is_static", "model", "residual_px", F.size("warnings").alias("warnings"))


@query("compose_transforms", with_views("""SELECT clip, i, round(ca, 6) + 0e0 AS a, round(cb, 6) + 0e0 AS b, round(cx, 6) + 0e0 AS tx, round(cy, 6) + 0e0 AS ty FROM (WITH RECURSIVE cum AS (SELECT DISTINCT clip, CAST(0 AS BIGINT) AS i, 1e0 AS ca, 0e0 AS cb, 0e0 AS cx, 0e0 AS cy FROM par UNION ALL
    SELECT p.clip, p.t + 1, p.a * ca - p.b * cb, p.b * ca + p.a * cb, p.a * cx - p.b * cy + p.tx, p.b * cx + p.a * cy + p.ty FROM cum c JOIN par p ON p.clip = c.clip AND p.t = c.i) SELECT * FROM cum)""", ["v_vec"], PAIR))
def compose_transforms(spark, sf):
    return mk.compose_transforms(_pairs(spark, sf))


@query("camera_residual", with_views("""SELECT f.clip, f.t, y, x, round(CASE WHEN f.clip % 3 = 0 THEN vx ELSE vx - (a * x - b * y + tx - x) END, 4) + 0e0 AS vx, round(CASE WHEN f.clip % 3 = 0 THEN vy ELSE vy - (b * x + a * y + ty - y) END, 4) + 0e0 AS vy FROM v_flow f JOIN par p ON p.clip = f.clip AND p.t = f.t""", ["v_flow", "v_vec"], PAIR))
def camera_residual(spark, sf):
    p = _pairs(spark, sf).withColumn("is_static", F.col("clip") % 3 == 0)
    return mk.camera_residual(v_flow(spark, sf), p).select("clip", "t", "y", "x", fixed(F.col("vx"), 4).alias("vx"), fixed(F.col("vy"), 4).alias("vy"))


@query("depth_summary", with_views("""SELECT clip, round(avg(scene), 4) AS scene, round(avg(obj), 4) AS object, round(avg(rk), 4) AS rank, round(avg(sp), 4) AS spread, count(*) AS frames FROM (SELECT d.clip, d.t, any_value(scene) AS scene, any_value(obj) AS obj, any_value(sp) AS sp, avg(CASE WHEN obj IS NOT NULL THEN CASE WHEN d < obj THEN 1e0 ELSE 0e0 END END) AS rk FROM dp d
    JOIN (SELECT clip, t, avg(d) AS scene, avg(CASE WHEN inn THEN d END) AS obj, stddev_pop(CASE WHEN inn THEN d END) AS sp FROM dp GROUP BY clip, t) o ON o.clip = d.clip AND o.t = d.t GROUP BY d.clip, d.t) GROUP BY clip""", ["v_flow"],
    {**MASKED, "dp": "SELECT f.clip, f.t, (f.vx / 8 + 1) / 2 AS d, m.clip IS NOT NULL AS inn FROM v_flow f LEFT JOIN msk m ON m.clip = f.clip AND m.y = f.y AND m.x = f.x"}))
def depth_summary(spark, sf):
    f = v_flow(spark, sf)
    return mk.depth_summary(f.select("clip", F.col("t").alias("frame"), "y", "x", ((F.col("vx") / 8 + 1) / 2).alias("d")), _mask(f))


# ---------------------------------------------------------------- cloth

@query("color_key", """SELECT key, count(*) AS px FROM (SELECT unnest(['red', 'green', 'blue', 'dark']) AS key) JOIN (SELECT l_partkey % 256 AS r, l_suppkey * 7 % 256 AS g, l_orderkey % 256 AS b FROM lineitem) ON
    CASE key WHEN 'red' THEN r > 80 AND r - g > 45 AND r - b > 35 WHEN 'green' THEN g > 80 AND g - r > 40 AND g - b > 30 WHEN 'blue' THEN b > 80 AND b - r > 40 AND b - g > 30 ELSE r < 70 AND g < 70 AND b < 70 END GROUP BY key""")
def color_key(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") * 7 % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"))
    keys = ("red", "green", "blue", "dark")
    hits = F.array_compact(F.array(*[F.when(cl.color_key(F.col("r"), F.col("g"), F.col("b"), k), k) for k in keys]))
    return d.select(F.explode(hits).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("px"))


SIL = {"runs0": """SELECT clip, t AS frame, CAST(c AS BIGINT) AS col, 30 + CAST(floor(20 * CAST(embedding[c + 1] AS DOUBLE)) AS BIGINT) AS a, 12 + c % 5 AS len FROM v_vec CROSS JOIN (SELECT unnest(range(0, 40)) AS c) WHERE (t + c) % 17 > 0 AND c < 36
           UNION ALL SELECT clip, t, CAST(c AS BIGINT), 60, 5 + c % 6 FROM v_vec CROSS JOIN (SELECT unnest(range(0, 40)) AS c) WHERE (t * 3 + c) % 7 = 0""",
       "sil": "SELECT DISTINCT clip, frame, col, a + k AS y FROM runs0 JOIN (SELECT unnest(range(0, 20)) AS k) ON k < len",
       "cr": "SELECT clip, frame, col, min(y) AS start, max(y) + 1 AS stop FROM (SELECT *, y - row_number() OVER (PARTITION BY clip, frame, col ORDER BY y) AS g FROM sil) GROUP BY clip, frame, col, g HAVING count(*) >= 3"}


def _sil(spark, sf):
    v = _vectors(spark, sf).select("clip", F.col("t").alias("frame"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("c"))
    main = v.filter("(frame + c) % 17 > 0 AND c < 36").select("clip", "frame", F.col("c").cast("long").alias("col"), (F.floor(F.get("embedding", F.col("c")).cast("double") * 20) + 30).alias("a"), (F.col("c") % 5 + 12).alias("len"))
    extra = v.filter("(frame * 3 + c) % 7 = 0").select("clip", "frame", F.col("c").cast("long").alias("col"), F.lit(60).cast("long").alias("a"), (F.col("c") % 6 + 5).alias("len"))
    return main.unionByName(extra).select("clip", "frame", "col", F.explode(F.sequence("a", F.col("a") + F.col("len") - 1)).alias("y")).distinct()


@query("column_runs", with_views("SELECT * FROM cr", ["v_vec"], SIL))
def column_runs(spark, sf):
    return cl.column_runs(_sil(spark, sf))


@query("widest_column", with_views("SELECT clip, col AS seed FROM (SELECT clip, col, row_number() OVER (PARTITION BY clip ORDER BY median(ch) DESC, col) AS rn FROM (SELECT clip, frame, col, max(stop - start) AS ch FROM cr GROUP BY ALL) GROUP BY clip, col) WHERE rn = 1", ["v_vec"], SIL))
def widest_column(spark, sf):
    return cl.widest_columns(cl.column_runs(_sil(spark, sf)))


def _tracked(spark, sf):
    r = cl.checkpoint(cl.column_runs(_sil(spark, sf)))
    return cl.track_columns(r, cl.widest_columns(r), 80.0)


WALK = {**SIL, "wide": "SELECT clip, col AS seed FROM (SELECT clip, col, row_number() OVER (PARTITION BY clip ORDER BY median(ch) DESC, col) AS rn FROM (SELECT clip, frame, col, max(stop - start) AS ch FROM cr GROUP BY ALL) GROUP BY clip, col) WHERE rn = 1",
        "cand": "SELECT clip, frame, col, list({'s': start, 'm': (start + stop - 1) / 2e0, 'z': CAST(stop - start AS DOUBLE)}) FILTER (WHERE stop - start >= greatest(3, 0.2e0 * big)) AS c FROM (SELECT *, max(stop - start) OVER (PARTITION BY clip, frame, col) AS big FROM cr) GROUP BY clip, frame, col",
        "ord": "SELECT c.*, sign(col - seed) AS side, row_number() OVER (PARTITION BY clip, frame, sign(col - seed) ORDER BY abs(col - seed)) AS k FROM cand c JOIN wide USING (clip) WHERE col <> seed",
        "top": "SELECT clip, frame, col, mid, chord FROM (SELECT r.clip, frame, col, (start + stop - 1) / 2e0 AS mid, CAST(stop - start AS DOUBLE) AS chord, row_number() OVER (PARTITION BY r.clip, frame ORDER BY stop - start DESC, start) AS rn FROM cr r JOIN wide w ON w.clip = r.clip AND w.seed = r.col) WHERE rn = 1"}


@query("track_columns", with_views("""SELECT clip, frame, col, mid, chord FROM (WITH RECURSIVE walk AS (SELECT clip, frame, side, CAST(0 AS BIGINT) AS k, col, mid, chord, mid AS last FROM top CROSS JOIN (SELECT unnest([1, -1]) AS side) UNION ALL
    SELECT clip, frame, side, k, col, CASE WHEN n.d <= 20 THEN n.m END, n.z, CASE WHEN n.d <= 20 THEN n.m ELSE last END FROM (SELECT o.clip, o.frame, w.side, o.k, o.col, w.last, list_sort(list_transform(o.c, lambda x: {'d': abs(x.m - w.last), 's': x.s, 'm': x.m, 'z': x.z}))[1] AS n
    FROM walk w JOIN ord o ON o.clip = w.clip AND o.frame = w.frame AND o.side = w.side AND o.k = w.k + 1))
    SELECT clip, frame, col, mid, chord FROM walk WHERE mid IS NOT NULL AND (k > 0 OR side = 1))""", ["v_vec"], WALK))
def track_columns(spark, sf):
    return _tracked(spark, sf)


@query("cloth_extent")
def cloth_extent(spark, sf):
    return cl.cloth_extent(cl.checkpoint(_tracked(spark, sf)), v_clips(spark, sf).select("clip", F.col("frames").alias("n")))


TRIM = {"cols": "SELECT o_custkey % 40 AS clip, CAST(o_custkey // 40 AS BIGINT) AS col, avg(o_totalprice) / 60000 * CASE WHEN o_custkey // 40 % 7 = 0 THEN 4 ELSE 1 END AS travel FROM orders GROUP BY 1, o_custkey // 40",
        "verd": """SELECT *, travel > 3 * greatest(coalesce(median(travel) OVER (PARTITION BY clip ORDER BY col ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 0e0), 0.05e0) AS bl, travel > 3 * greatest(coalesce(median(travel) OVER (PARTITION BY clip ORDER BY col ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0e0), 0.05e0) AS br FROM cols""",
        "lf": "SELECT s.clip, s.c0, s.c1, least(coalesce((SELECT min(col) FROM verd v WHERE v.clip = s.clip AND v.col >= s.c0 AND NOT bl), s.c1), greatest(s.c0, s.c1 - 20)) AS n0 FROM (SELECT DISTINCT clip, clip % 3 AS c0, 36 - clip % 2 AS c1 FROM cols) s"}


@query("trim_edges", with_views("SELECT clip, CAST(n0 AS BIGINT) AS c0, CAST(greatest(coalesce((SELECT max(col) FROM verd v WHERE v.clip = lf.clip AND v.col <= lf.c1 AND NOT br), n0), least(c1, n0 + 20)) AS BIGINT) AS c1 FROM lf", [], TRIM))
def trim_edges(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("clip"), F.floor(F.col("o_custkey") / 40).alias("col"), "o_totalprice")
    cols = o.groupBy("clip", "col").agg((F.avg("o_totalprice") / 60000).alias("travel")).withColumn("travel", F.col("travel") * F.when(F.col("col") % 7 == 0, 4).otherwise(1))
    span = cols.select("clip").distinct().select("clip", (F.col("clip") % 3).alias("c0"), (36 - F.col("clip") % 2).alias("c1"))
    return cl.trim_edges(cols, span)


LINE = {"line": "SELECT clip, t AS frame, CAST(s AS BIGINT) AS station, s / 24e0 AS u, CAST(embedding[s + 1] AS DOUBLE) * s / 24e0 AS d, count(*) OVER (PARTITION BY clip, s) AS n FROM v_vec CROSS JOIN (SELECT unnest(range(0, 25)) AS s)"}


def _line(spark, sf):
    v = _vectors(spark, sf).join(v_clips(spark, sf).select("clip", F.col("frames").alias("n")), "clip")
    v = v.select("clip", F.col("t").alias("frame"), "n", "embedding", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("s"))
    return v.select("clip", "frame", F.col("s").cast("long").alias("station"), (F.col("s") / 24.0).alias("u"), (F.get("embedding", F.col("s")).cast("double") * F.col("s") / 24.0).alias("d"), "n", F.lit(25).cast("long").alias("ns"))


@query("anchor_end", with_views("SELECT clip, frame, CASE WHEN fl THEN station ELSE 24 - station END AS station, NOT fl AS flipped, round(d, 6) + 0e0 AS d FROM line JOIN (SELECT clip, stddev_pop(CASE WHEN station >= 21 THEN d END) >= stddev_pop(CASE WHEN station < 4 THEN d END) AS fl FROM line GROUP BY clip) USING (clip)", ["v_vec"], LINE))
def anchor_end(spark, sf):
    return cl.anchor_end(_line(spark, sf)).select("clip", "frame", "station", "flipped", fixed(F.col("d"), 6).alias("d"))


@query("loop_quality", with_views("""SELECT clip, round(seam, 5) AS loop_wrap_seam, round(step, 5) AS median_frame_step, round(seam / step, 3) AS seam_in_frame_steps FROM (SELECT clip, avg(abs(z - a)) AS seam FROM (SELECT clip, station, arg_max(d, frame) AS z, arg_min(d, frame) AS a FROM line GROUP BY clip, station) GROUP BY clip)
    JOIN (SELECT clip, median(s) AS step FROM (SELECT clip, frame, avg(abs(d - p)) AS s FROM (SELECT *, lag(d) OVER (PARTITION BY clip, station ORDER BY frame) AS p FROM line) WHERE p IS NOT NULL GROUP BY clip, frame) GROUP BY clip) USING (clip)""", ["v_vec"], LINE))
def loop_quality(spark, sf):
    return cl.loop_quality(_line(spark, sf)).select("clip", F.round("loop_wrap_seam", 5).alias("loop_wrap_seam"), F.round("median_frame_step", 5).alias("median_frame_step"), F.round("seam_in_frame_steps", 3).alias("seam_in_frame_steps"))


@query("fit_modes")
def fit_modes(spark, sf):
    return cl.fit_modes(_line(spark, sf)).select("clip", "frame", "station", fixed(F.col("d"), 6).alias("d"))


MEAS = {**LINE, "st": "SELECT clip, station, any_value(u) AS u, stddev_pop(d) AS rms, avg(d) AS mean FROM line GROUP BY clip, station",
        "mx": "SELECT clip, max(rms) AS rmax, arg_min(rms, station) AS r0, arg_max(rms, station) AS r1 FROM st GROUP BY clip",
        "tipid": "SELECT clip, min(station) AS tip FROM st JOIN mx USING (clip) WHERE rms = rmax GROUP BY clip",
        "rmp": "SELECT clip, regr_slope(ln(rms), ln(u)) AS ramp FROM st JOIN mx USING (clip) WHERE u > 0.05e0 AND rms > 0.05e0 * rmax GROUP BY clip HAVING count(*) >= 3",
        "sp": f"SELECT l.clip, l.station, any_value(l.u) AS u, k, any_value(n) AS n, sum((d - mean) * cos(2 * {PI} * ((k * frame) % n) / n)) AS re, sum(-(d - mean) * sin(2 * {PI} * ((k * frame) % n) / n)) AS im FROM line l JOIN st s ON s.clip = l.clip AND s.station = l.station JOIN (SELECT unnest(range(1, 2000)) AS k) ON k <= n // 2 GROUP BY l.clip, l.station, k",
        "tp": "SELECT s.clip, k, n, sqrt(re * re + im * im) AS mag FROM sp s JOIN tipid t ON t.clip = s.clip AND t.tip = s.station",
        "kd": "SELECT clip, k, n, mag FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY mag DESC, k) AS rn FROM tp) WHERE rn = 1",
        "ph": "SELECT s.clip, station, u, degrees(atan2(im, re)) AS ph FROM sp s JOIN kd ON kd.clip = s.clip AND kd.k = s.k",
        "un": "SELECT clip, station, u, radians(sum(CASE WHEN d IS NULL THEN ph ELSE d - 360 * floor((d + 180) / 360) END) OVER (PARTITION BY clip ORDER BY station)) AS ph FROM (SELECT *, ph - lag(ph) OVER (PARTITION BY clip ORDER BY station) AS d FROM ph)",
        "ln": "SELECT clip, regr_slope(ph, u) AS slope, regr_intercept(ph, u) AS icpt FROM un GROUP BY clip",
        "meas": f"""SELECT kd.clip, round(kd.k * 20e0 / kd.n, 3) AS dominant_hz, round(kd.mag ** 2 / tot, 3) AS spectral_share_of_dominant, round(abs(slope) / (2 * {PI}), 3) AS wavelengths_across, CASE WHEN slope < 0 THEN 'anchor->tip' ELSE 'tip->anchor' END AS travel,
            round(resid, 3) AS phase_linearity_resid_rad, round(ramp, 3) + 0e0 AS amp_ramp_exponent, round(s2.mag / kd.mag, 3) AS second_harmonic_ratio, round(rms, 5) AS rms, round(peak, 5) AS peak, round(r0, 5) AS rms_at_anchor, round(r1, 5) AS rms_at_tip
            FROM kd JOIN (SELECT clip, sum(mag * mag) AS tot FROM tp GROUP BY clip) USING (clip) JOIN tp s2 ON s2.clip = kd.clip AND s2.k = least(kd.k * 2, kd.n // 2) JOIN ln ON ln.clip = kd.clip JOIN rmp ON rmp.clip = kd.clip JOIN mx ON mx.clip = kd.clip
            JOIN (SELECT un.clip, stddev_pop(ph - (slope * u + icpt)) AS resid FROM un JOIN ln USING (clip) GROUP BY un.clip) rs ON rs.clip = kd.clip JOIN (SELECT clip, stddev_pop(d) AS rms, max(abs(d)) AS peak FROM line GROUP BY clip) w ON w.clip = kd.clip"""}


@query("cloth_measure", with_views("SELECT * FROM meas", ["v_vec"], MEAS))
def cloth_measure(spark, sf):
    return cl.cloth_measure(_line(spark, sf), 20.0)


@query("cloth_params", with_views("""SELECT clip, dominant_hz AS frequency, round(least(1e0, 2 * rms_at_tip), 3) AS amplitude, 0e0 AS direction, round(1 - spectral_share_of_dominant, 3) AS turbulence, round(least(1e0, rms_at_anchor / rms_at_tip), 4) AS damping, round(least(1e0, wavelengths_across), 3) AS "phaseSpread", 0e0 AS "driftX", 0e0 AS "driftY" FROM meas""", ["v_vec"], MEAS))
def cloth_params(spark, sf):
    return cl.cloth_params(cl.cloth_measure(_line(spark, sf), 20.0))


@query("principal_axis", with_views("""SELECT clip, round(c, 4) + 0e0 AS c, round(s, 4) + 0e0 AS s, round(max((x - mx) * c + (y - my) * s) - min((x - mx) * c + (y - my) * s), 3) AS length, round(max(abs((y - my) * c - (x - mx) * s)), 3) AS half FROM v_poly JOIN (
    SELECT clip, mx, my, abs(cos(th)) AS c, sin(th) * CASE WHEN cos(th) < 0 THEN -1 ELSE 1 END AS s FROM (SELECT clip, avg(x) AS mx, avg(y) AS my, 0.5e0 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS th FROM v_poly GROUP BY clip HAVING count(*) >= 8)) USING (clip) GROUP BY clip, c, s""", ["v_poly"]))
def principal_axis(spark, sf):
    return cl.principal_axis(v_poly(spark, sf)).select("clip", fixed(F.col("c"), 4).alias("c"), fixed(F.col("s"), 4).alias("s"), F.round("length", 3).alias("length"), F.round("half", 3).alias("half"))
