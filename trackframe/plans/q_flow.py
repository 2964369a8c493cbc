"""Registered queries over flow fields, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.functions.scalar import fixed
from trackframe.operators import flow as fl
from trackframe.operators import spectra as sp
from trackframe.plans.views import table, v_boxes, v_cells, v_clips, v_flow, v_pixels, v_signal, with_views

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def r(places: int, **cols: str):
    return [fixed(F.col(c), places).alias(n) for n, c in cols.items()]


PI = "3.141592653589793e0"


def dial_steps(cells: str = "v_cells", clips: str = "v_clips", key: str = "clip", floor: str = "0.55e0") -> dict[str, str]:
    """SQL steps of the dials over a cell table keyed by `key`, with per-group fps, width and floor."""
    k = key
    on = lambda a, b: " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in k.split(","))
    q = lambda a: ", ".join(f"{a}.{c.strip()}" for c in k.split(","))
    return {
        "frame_m": f"""SELECT {k}, t, count(*) AS px, avg(vx) AS gxm, avg(vy) AS gym, sum(vx) AS sx, sum(vy) AS sy,
            sum(sqrt(vx * vx + vy * vy) + 1e-9) AS wsum FROM {cells} GROUP BY {k}, t""",
        "clip_a": f"""SELECT *, 0.5e0 * atan2(2 * cxy, cxx - cyy) AS theta FROM (SELECT {k}, count(*) AS n, max(px) AS px, avg(gxm) AS dx, avg(gym) AS dy,
            var_pop(gxm) AS cxx, var_pop(gym) AS cyy, covar_pop(gxm, gym) AS cxy,
            coalesce(avg(CASE WHEN wsum / px > 0.02e0 THEN 1 - sqrt(sx * sx + sy * sy) / wsum END), 0e0) AS disorder
            FROM frame_m GROUP BY {k}) z JOIN (SELECT {k}, fps, width, {floor} AS floor FROM {clips}) c USING ({k}) WHERE n >= 12 AND px >= 4""",
        "proj": f"""SELECT {q('f')}, n, t, (gxm - dx) * cos(theta) + (gym - dy) * sin(theta) AS v FROM frame_m f JOIN clip_a a ON {on('f', 'a')}""",
        "spec": f"""SELECT {k}, n, k, sqrt(re * re + im * im) AS mag FROM (SELECT {k}, n, k,
            sum(v * cos(2 * {PI} * ((k * t) % n) / n)) AS re, sum(-v * sin(2 * {PI} * ((k * t) % n) / n)) AS im
            FROM proj JOIN (SELECT unnest(range(1, 4000)) AS k) b ON k <= n // 2 GROUP BY {k}, n, k)""",
        "top": f"""SELECT {k}, n, k, mag FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY mag DESC, k) AS rn FROM spec) WHERE rn = 1""",
        "flat": f"""SELECT {k}, exp(avg(ln(mag * mag + 1e-12))) / avg(mag * mag + 1e-12) AS flatness FROM spec GROUP BY {k}""",
        "peak": f"""SELECT {q('p')}, p.n, p.k, p.mag, CASE WHEN p.k = 1 THEN 0e0 ELSE lo.mag END AS lo, hi.mag AS hi FROM top p
            LEFT JOIN spec lo ON {on('p', 'lo')} AND lo.k = p.k - 1 LEFT JOIN spec hi ON {on('p', 'hi')} AND hi.k = p.k + 1""",
        "freq": f"""SELECT {k}, k, fps, n, greatest(0.05e0, least(8e0, (k + CASE WHEN k < n // 2 AND abs(den) > 1e-12 AND abs(0.5e0 * (la - lc) / den) < 1
            THEN 0.5e0 * (la - lc) / den ELSE 0e0 END) * fps / n)) AS frequency FROM (SELECT {q('p')}, p.k, p.n, fps, ln(lo + 1e-12) AS la, ln(hi + 1e-12) AS lc,
            ln(lo + 1e-12) - 2 * ln(p.mag + 1e-12) + ln(hi + 1e-12) AS den FROM peak p JOIN clip_a a ON {on('p', 'a')})""",
        "damp": f"""SELECT {k}, greatest(0e0, least(1e0, 1 - CASE WHEN den > 1e-9 THEN abs(num / den) ELSE 0.5e0 END)) AS damping FROM (
            SELECT {q('p')}, sum(p.v * p.v) AS den, coalesce(sum(p.v * o.v), 0e0) AS num FROM proj p
            JOIN (SELECT {k}, greatest(2, least(n - 4, CAST(round_even(fps / frequency, 0) AS BIGINT))) AS lag FROM freq) l ON {on('p', 'l')}
            LEFT JOIN proj o ON {on('p', 'o')} AND o.t = p.t + l.lag GROUP BY {q('p')})""",
        "pix": f"""SELECT {q('c')}, t, gy, gx, a.n, floor, sqrt((vx - dx) * (vx - dx) + (vy - dy) * (vy - dy)) AS m, vx * cos(theta) + vy * sin(theta) AS q, f.k AS kk
            FROM {cells} c JOIN clip_a a ON {on('c', 'a')} JOIN freq f ON {on('c', 'f')}""",
        "move": f"""SELECT {k}, avg(CASE WHEN m > floor THEN 1e0 ELSE 0e0 END) AS frac, avg(CASE WHEN m > floor THEN m - floor END) AS strength FROM pix GROUP BY {k}""",
        "pers": f"""SELECT {k}, avg(corr) AS persistence FROM (SELECT {k}, t, count(*) * covar_pop(m, m2) / (count(*) * sqrt(var_pop(m) * var_pop(m2)) + 1e-9) AS corr
            FROM (SELECT *, lead(m) OVER (PARTITION BY {k}, gy, gx ORDER BY t) AS m2 FROM pix) WHERE m2 IS NOT NULL GROUP BY {k}, t) GROUP BY {k}""",
        "phase": f"""SELECT {k}, CASE WHEN sum(w) > 1e-9 THEN greatest(0e0, least(1e0, 1 - sqrt(sum(re / (sqrt(w) + 1e-12) * w) ** 2 + sum(im / (sqrt(w) + 1e-12) * w) ** 2) / sum(w))) ELSE 0.3e0 END AS spread
            FROM (SELECT *, re * re + im * im AS w FROM (SELECT {k}, gy, gx, sum(q * cos(2 * {PI} * ((kk * t) % n) / n)) AS re, sum(-q * sin(2 * {PI} * ((kk * t) % n) / n)) AS im
            FROM pix GROUP BY {k}, gy, gx)) GROUP BY {k}""",
        "dial": f"""SELECT {k}, a.n, f.k, f.frequency, CASE WHEN frac > 0.003e0 THEN greatest(0e0, least(1e0, strength / (0.006e0 * width) * least(1e0, frac / 0.03e0)
            * greatest(0e0, least(1e0, (0.92e0 - persistence) / 0.12e0)))) ELSE 0e0 END AS amplitude, degrees(atan2(-sin(theta), cos(theta))) AS deg,
            disorder, flatness, spread, damping, frac, strength, persistence, dx / (0.005e0 * width) AS ddx, dy / (0.005e0 * width) AS ddy
            FROM clip_a a JOIN freq f USING ({k}) JOIN flat USING ({k}) JOIN damp USING ({k}) JOIN move USING ({k}) JOIN pers USING ({k}) JOIN phase USING ({k})""",
        "dials": f"""SELECT {k}, round(frequency, 3) + 0e0 AS frequency, round(amplitude, 3) + 0e0 AS amplitude,
            round_even(CASE WHEN deg < 0 THEN deg + 180 WHEN deg >= 180 THEN deg - 180 ELSE deg END, 0) + 0e0 AS direction,
            round(greatest(0e0, least(1e0, (0.5e0 * flatness + 0.5e0 * disorder) * 1.4e0)) * least(1e0, amplitude / 0.1e0), 3) + 0e0 AS turbulence,
            round(damping, 3) + 0e0 AS damping, round(spread * least(1e0, amplitude / 0.1e0), 3) + 0e0 AS "phaseSpread",
            round(greatest(-1e0, least(1e0, ddx)), 3) + 0e0 AS "driftX", round(greatest(-1e0, least(1e0, ddy)), 3) + 0e0 AS "driftY" FROM dial""",
    }


VC = ["v_cells", "v_clips"]


@query("distill", with_views("SELECT * FROM dials", VC, dial_steps()))
def distill(spark, sf):
    return fl.distill(v_cells(spark, sf), v_clips(spark, sf))


@query("distill_pixels", with_views("SELECT * FROM dials", ["v_flow", "v_clips"], {
    "pxl": "SELECT clip, t, y AS gy, x AS gx, vx, vy FROM v_flow", **dial_steps("pxl")}))
def distill_pixels(spark, sf):
    return fl.distill(v_flow(spark, sf), v_clips(spark, sf), px=("y", "x"))


@query("distill_drift", with_views("""SELECT clip, n AS frames, round(greatest(-1e0, least(1e0, dx / (0.005e0 * width))), 4) + 0e0 AS drift_x,
    round(greatest(-1e0, least(1e0, dy / (0.005e0 * width))), 4) + 0e0 AS drift_y FROM clip_a""", VC, dial_steps()))
def distill_drift(spark, sf):
    a = fl.clip_axis(fl.frame_moments(v_cells(spark, sf)), v_clips(spark, sf))
    return a.select("clip", F.col("n").alias("frames"), *r(4, drift_x="driftX", drift_y="driftY"))


@query("distill_axis", with_views("""SELECT clip, CAST(round_even(CASE WHEN deg < 0 THEN deg + 180 WHEN deg >= 180 THEN deg - 180 ELSE deg END, 0) AS BIGINT) AS direction
    FROM dial""", VC, dial_steps()))
def distill_axis(spark, sf):
    return fl.clip_axis(fl.frame_moments(v_cells(spark, sf)), v_clips(spark, sf)).select("clip", "direction")


@query("distill_frequency", with_views("SELECT clip, k, round(frequency, 4) + 0e0 AS frequency FROM freq", VC, dial_steps()))
def distill_frequency(spark, sf):
    fr = fl.frame_moments(v_cells(spark, sf))
    a = fl.clip_axis(fr, v_clips(spark, sf))
    return fl.rhythm(fl.projection(fr, a), a).select("clip", "k", *r(4, frequency="frequency"))


@query("distill_pieces", with_views("""SELECT clip, round(persistence, 4) + 0e0 AS persistence, round(frac, 4) + 0e0 AS moving_fraction, round(strength, 4) + 0e0 AS strength,
    round(flatness, 4) + 0e0 AS flatness, round(disorder, 4) + 0e0 AS disorder, round(damping, 4) + 0e0 AS damping, round(spread, 4) + 0e0 AS spread FROM dial""", VC, dial_steps()))
def distill_pieces(spark, sf):
    p = fl.distill_parts(v_cells(spark, sf), v_clips(spark, sf))
    return p.select("clip", *r(4, persistence="persistence", moving_fraction="frac", strength="strength", flatness="flatness",
                               disorder="disorder", damping="damping", spread="spread"))


MASKED = {"msk": "SELECT DISTINCT clip, y, x FROM v_flow WHERE t % 5 = 0 AND vx > 1.5e0 AND clip % 3 > 0",
          "msz": "SELECT clip, count(*) AS px FROM msk GROUP BY clip",
          "cut": """SELECT f.*, coalesce(px, 0) >= 4 AS masked FROM v_flow f LEFT JOIN msz USING (clip)
              WHERE coalesce(px, 0) < 4 OR EXISTS (SELECT 1 FROM msk m WHERE m.clip = f.clip AND m.y = f.y AND m.x = f.x)"""}


def _mask(flow):
    return flow.filter((F.col("t") % 5 == 0) & (F.col("vx") > 1.5) & (F.col("clip") % 3 > 0)).select("clip", "y", "x").distinct()


@query("restrict_to_mask", with_views("""SELECT clip, masked, count(*) AS rows_kept, round(sum(vx), 3) + 0e0 AS sum_vx FROM cut GROUP BY clip, masked""", ["v_flow"], MASKED))
def restrict_to_mask(spark, sf):
    f = v_flow(spark, sf)
    d = fl.restrict_to_mask(f, _mask(f))
    return d.groupBy("clip", "masked").agg(F.count(F.lit(1)).alias("rows_kept"), fixed(F.sum("vx"), 3).alias("sum_vx"))


@query("distill_masked", with_views("SELECT * FROM dials", ["v_flow", "v_clips"], {
    **MASKED, "pxl": "SELECT clip, t, y AS gy, x AS gx, vx, vy FROM cut", **dial_steps("pxl")}))
def distill_masked(spark, sf):
    f = v_flow(spark, sf)
    return fl.distill(fl.restrict_to_mask(f, _mask(f)), v_clips(spark, sf), px=("y", "x"))


# the validity-flagged variant, written out separately: other gates, weights and bins
SPARSE = {
    "vld": "SELECT *, (gy + gx + t) % 7 <> 0 AS valid FROM v_cells",
    "frame_m": """SELECT clip, t, coalesce(avg(CASE WHEN valid THEN vx END), 0e0) AS gxm, coalesce(avg(CASE WHEN valid THEN vy END), 0e0) AS gym,
        sum(CASE WHEN valid AND sqrt(vx * vx + vy * vy) >= 0.05e0 THEN vx END) AS sx, sum(CASE WHEN valid AND sqrt(vx * vx + vy * vy) >= 0.05e0 THEN vy END) AS sy,
        coalesce(sum(CASE WHEN valid AND sqrt(vx * vx + vy * vy) >= 0.05e0 THEN sqrt(vx * vx + vy * vy) END), 0e0) AS wsum FROM vld GROUP BY clip, t""",
    "clip_a": """SELECT *, 0.5e0 * atan2(2 * cxy, cxx - cyy) AS theta FROM (SELECT clip, count(*) AS n, avg(gxm) AS dx, avg(gym) AS dy, var_pop(gxm) AS cxx, var_pop(gym) AS cyy,
        covar_pop(gxm, gym) AS cxy, coalesce(avg(CASE WHEN wsum >= 0.3e0 THEN 1 - sqrt(sx * sx + sy * sy) / wsum END), 0e0) AS disorder FROM frame_m GROUP BY clip)
        JOIN (SELECT clip, fps FROM v_clips) USING (clip) WHERE n >= 16""",
    **{k: v for k, v in dial_steps().items() if k in ("proj", "spec", "top", "flat", "peak")},
    "freq": dial_steps()["freq"].replace("CASE WHEN k < n // 2", "CASE WHEN k > 1 AND k < n // 2"),
    "damp": dial_steps()["damp"].replace("CAST(round_even(fps / frequency, 0) AS BIGINT)", "CAST(floor(fps / frequency + 0.5e0) AS BIGINT)"),
    "pixe": f"""SELECT clip, gy, gx, n, sum(q * cos(2 * {PI} * ((k * t) % n) / n)) AS re, sum(-q * sin(2 * {PI} * ((k * t) % n) / n)) AS im, sum(q * q) AS e FROM (
        SELECT c.clip, gy, gx, t, a.n, f.k, CASE WHEN valid THEN vx * cos(theta) + vy * sin(theta) ELSE 0e0 END AS q FROM vld c JOIN clip_a a USING (clip) JOIN freq f USING (clip)) GROUP BY ALL""",
    "phase": """SELECT clip, count(*) AS cells, sqrt(sum(re / m) ** 2 + sum(im / m) ** 2) / count(*) AS res FROM (SELECT *, sqrt(re * re + im * im) AS m FROM pixe WHERE e / n >= 0.005e0) GROUP BY clip""",
}


@query("distill_sparse", with_views("""SELECT clip, round(frequency, 3) + 0e0 AS frequency, round(least(1e0, sqrt(cxx + cyy) / 1.5e0), 3) + 0e0 AS amplitude,
    floor(CASE WHEN degrees(atan2(-sin(theta), cos(theta))) < 0 THEN degrees(atan2(-sin(theta), cos(theta))) + 180 WHEN degrees(atan2(-sin(theta), cos(theta))) >= 180
        THEN degrees(atan2(-sin(theta), cos(theta))) - 180 ELSE degrees(atan2(-sin(theta), cos(theta))) END + 0.5e0) AS direction,
    round(greatest(0e0, least(1e0, 0.5e0 * flatness + 0.5e0 * disorder)), 3) + 0e0 AS turbulence, round(damping, 3) + 0e0 AS damping,
    round(CASE WHEN coalesce(cells, 0) < 4 THEN 0.3e0 ELSE greatest(0e0, 1 - res) END, 3) + 0e0 AS "phaseSpread"
    FROM clip_a JOIN freq USING (clip) JOIN flat USING (clip) JOIN damp USING (clip) LEFT JOIN phase USING (clip)""", VC, SPARSE))
def distill_sparse(spark, sf):
    c = v_cells(spark, sf).withColumn("valid", (F.col("gy") + F.col("gx") + F.col("t")) % 7 != 0)
    return fl.distill_sparse(c, v_clips(spark, sf))


@query("to_cells", with_views("""SELECT clip, t, y // 2 AS gy, x // 2 AS gx, round(avg(vx), 6) + 0e0 AS vx, round(avg(vy), 6) + 0e0 AS vy FROM v_flow
    WHERE y // 2 < 3 AND x // 2 < 3 GROUP BY ALL""", ["v_flow"]))
def to_cells(spark, sf):
    clips = v_clips(spark, sf).select("clip", F.lit(8.0).alias("height"), F.lit(8.0).alias("width"), F.lit(3).cast("long").alias("grid"))
    return fl.to_cells(v_flow(spark, sf), clips).select("clip", "t", "gy", "gx", *r(6, vx="vx", vy="vy"))


GEOM = """SELECT *, CASE WHEN x1 - x0 >= 8 AND y1 - y0 >= 8 THEN greatest(1e0, 128e0 / (x1 - x0), 128e0 / (y1 - y0)) END AS s FROM (
    SELECT *, least(480, x0 + CAST(round_even(bw * 480, 0) AS BIGINT)) AS x1, least(272, y0 + CAST(round_even(bh * 272, 0) AS BIGINT)) AS y1 FROM (
    SELECT *, least(greatest(CAST(round_even(bx * 480, 0) AS BIGINT), 0), 479) AS x0, least(greatest(CAST(round_even("by" * 272, 0) AS BIGINT), 0), 271) AS y0 FROM v_boxes))"""


@query("crop_geometry", with_views("""SELECT id, x0, y0, x1, y1, s IS NOT NULL AS ok, greatest(128, CAST(floor(round_even((x1 - x0) * s, 0) / 8) AS BIGINT) * 8) * CASE WHEN s IS NULL THEN NULL ELSE 1 END AS out_w,
    greatest(128, CAST(floor(round_even((y1 - y0) * s, 0) / 8) AS BIGINT) * 8) * CASE WHEN s IS NULL THEN NULL ELSE 1 END AS out_h FROM geo""", ["v_boxes"], {"geo": GEOM}))
def crop_geometry(spark, sf):
    g = fl.crop_geometry(v_boxes(spark, sf), F.lit(480), F.lit(272))
    return g.select("id", "x0", "y0", "x1", "y1", "ok", "out_w", "out_h")


@query("crop", with_views("""SELECT clip, t, count(*) AS px, round(sum(vx), 4) + 0e0 AS sum_vx, max(y) AS max_y, max(x) AS max_x FROM (
    SELECT clip, t, vx, CASE WHEN clip % 4 = 0 THEN y ELSE y - 1 END AS y, CASE WHEN clip % 4 = 0 THEN x ELSE x - 2 END AS x FROM v_flow
    WHERE clip % 4 = 0 OR (x >= 2 AND x < 7 AND y >= 1 AND y < 6)) GROUP BY clip, t""", ["v_flow"]))
def crop(spark, sf):
    boxes = v_clips(spark, sf).select("clip", F.lit(2).alias("x0"), F.lit(1).alias("y0"), F.lit(7).alias("x1"), F.lit(6).alias("y1"),
                                      (F.col("clip") % 4 != 0).alias("ok"))
    d = fl.crop(v_flow(spark, sf), boxes)
    return d.groupBy("clip", "t").agg(F.count(F.lit(1)).alias("px"), fixed(F.sum("vx"), 4).alias("sum_vx"), F.max("y").alias("max_y"), F.max("x").alias("max_x"))


@query("resample_nearest", with_views("""SELECT clip, oy AS y, ox AS x FROM v_pixels JOIN (SELECT unnest(range(0, 13)) AS oy) ON floor(oy * 8e0 / 13e0) = y
    JOIN (SELECT unnest(range(0, 5)) AS ox) ON floor(ox * 8e0 / 5e0) = x""", ["v_pixels"]))
def resample_nearest(spark, sf):
    return fl.resample_nearest(v_pixels(spark, sf), (F.lit(8), F.lit(8)), (F.lit(13), F.lit(5)))


@query("align_mask", with_views("""SELECT clip, o3y AS y, o3x AS x FROM v_pixels
    JOIN (SELECT unnest(range(0, 16)) AS ay) ON floor(ay * 8e0 / 16e0) = y JOIN (SELECT unnest(range(0, 12)) AS ax) ON floor(ax * 8e0 / 12e0) = x
    JOIN (SELECT unnest(range(0, 20)) AS o3y) ON floor(o3y * 10e0 / 20e0) = ay - 4 JOIN (SELECT unnest(range(0, 8)) AS o3x) ON floor(o3x * 8e0 / 8e0) = ax - 2
    WHERE ay >= 4 AND ay < 14 AND ax >= 2 AND ax < 10""", ["v_pixels"]))
def align_mask(spark, sf):
    px = v_pixels(spark, sf)
    geo = table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip"), *[F.lit(v).alias(k) for k, v in {
        "mask_h": 8, "mask_w": 8, "src_h": 16, "src_w": 12, "x0": 2, "y0": 4, "x1": 10, "y1": 14, "out_h": 20, "out_w": 8}.items()], F.lit(True).alias("ok"))
    return fl.align_mask(px, geo)


@query("noise_floor", with_views("""SELECT clip, round(avg(CASE WHEN m > 0.55e0 THEN 1e0 ELSE 0e0 END), 5) + 0e0 AS moving_fraction,
    round(avg(CASE WHEN m > 0.55e0 THEN m - 0.55e0 END), 5) + 0e0 AS strength FROM pix GROUP BY clip""", VC, dial_steps()))
def noise_floor(spark, sf):
    p = fl.distill_parts(v_cells(spark, sf), v_clips(spark, sf))
    return p.select("clip", *r(5, moving_fraction="frac", strength="strength"))


@query("persistence", with_views("""SELECT clip, round(p, 5) + 0e0 AS persistence, p >= 0.85e0 AS is_static, round(greatest(0e0, least(1e0, (0.92e0 - p) / 0.12e0)), 5) + 0e0 AS gate FROM (
    SELECT clip, avg(corr) AS p FROM (SELECT clip, t, count(*) * covar_pop(m, m2) / (count(*) * sqrt(var_pop(m) * var_pop(m2)) + 1e-9) AS corr FROM (
    SELECT *, lead(m) OVER (PARTITION BY clip, gy, gx ORDER BY t) AS m2 FROM (SELECT *, sqrt(vx * vx + vy * vy) AS m FROM v_cells)) WHERE m2 IS NOT NULL GROUP BY clip, t) GROUP BY clip)""", ["v_cells"]))
def persistence(spark, sf):
    return fl.static_clips(v_cells(spark, sf)).select("clip", "is_static", *r(5, persistence="persistence", gate="gate"))


@query("consecutive_pairs", with_views("""SELECT clip, gy, gx, count(*) AS pairs, round(avg(v2 - vx), 6) + 0e0 AS mean_step FROM (
    SELECT *, lead(vx) OVER (PARTITION BY clip, gy, gx ORDER BY t) AS v2 FROM v_cells) WHERE v2 IS NOT NULL GROUP BY ALL""", ["v_cells"]))
def consecutive_pairs(spark, sf):
    p = fl.next_frame(v_cells(spark, sf), ["clip", "gy", "gx"], "vx").filter(F.col("next_vx").isNotNull())
    return p.groupBy("clip", "gy", "gx").agg(F.count(F.lit(1)).alias("pairs"), fixed(F.avg(F.col("next_vx") - F.col("vx")), 6).alias("mean_step"))


FEAT = """SELECT clip, gy, gx, avg(sqrt(vx * vx + vy * vy)) AS energy, avg(vx) AS drift_x, avg(vy) AS drift_y, sqrt(var_pop(vx) + var_pop(vy)) AS osc,
    0.5e0 * atan2(2 * covar_pop(vx, vy), var_pop(vx) - var_pop(vy)) AS osc_axis FROM v_cells GROUP BY clip, gy, gx"""


@query("cell_features", with_views("""SELECT clip, gy, gx, round(energy, 5) + 0e0 AS energy, round(drift_x, 5) + 0e0 AS drift_x, round(drift_y, 5) + 0e0 AS drift_y,
    round(osc, 5) + 0e0 AS osc, round(osc_axis, 5) + 0e0 AS osc_axis FROM feat""", ["v_cells"], {"feat": FEAT}))
def cell_features(spark, sf):
    return fl.cell_features(v_cells(spark, sf)).select("clip", "gy", "gx", *r(5, energy="energy", drift_x="drift_x", drift_y="drift_y", osc="osc", osc_axis="osc_axis"))


TRACKS = """SELECT clip, gy, gx, CAST(0 AS BIGINT) AS t, (gx + 0.5e0) / 5 AS x, (gy + 0.5e0) / 5 AS y FROM v_cells WHERE t = 0 UNION ALL
    SELECT clip, gy, gx, t + 1, (gx + 0.5e0) / 5 + sum(vx / 480e0) OVER w, (gy + 0.5e0) / 5 + sum(vy / 480e0) OVER w FROM v_cells
    WINDOW w AS (PARTITION BY clip, gy, gx ORDER BY t ROWS UNBOUNDED PRECEDING)"""


@query("grid_tracks", with_views("SELECT clip, gy, gx, t, round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y FROM tr", ["v_cells"], {"tr": TRACKS}))
def grid_tracks(spark, sf):
    return fl.grid_tracks(v_cells(spark, sf), v_clips(spark, sf)).select("clip", "gy", "gx", "t", *r(4, x="x", y="y"))


@query("grid_tracks_masked", with_views("""SELECT clip, gy, gx, t, round(CASE WHEN (gy + gx) % 2 = 0 THEN x ELSE (gx + 0.5e0) / 5 END, 4) + 0e0 AS x,
    round(CASE WHEN (gy + gx) % 2 = 0 THEN y ELSE (gy + 0.5e0) / 5 END, 4) + 0e0 AS y FROM tr""", ["v_cells"], {"tr": TRACKS}))
def grid_tracks_masked(spark, sf):
    cells = v_cells(spark, sf)
    keep = cells.select("clip", "gy", "gx").distinct().withColumn("keep", (F.col("gy") + F.col("gx")) % 2 == 0)
    return fl.grid_tracks(cells, v_clips(spark, sf), keep=keep).select("clip", "gy", "gx", "t", *r(4, x="x", y="y"))


@query("cell_coverage", with_views("""SELECT e.clip, gy, gx, round(count(p.clip) / 4e0, 4) AS coverage, count(p.clip) / 4e0 >= 0.2e0 AS keep
    FROM (SELECT vec_id AS clip FROM embeddings) e CROSS JOIN (SELECT unnest(range(0, 3)) AS gy) CROSS JOIN (SELECT unnest(range(0, 3)) AS gx)
    LEFT JOIN v_pixels p ON p.clip = e.clip AND p.y // 2 = gy AND p.x // 2 = gx GROUP BY e.clip, gy, gx""", ["v_pixels"]))
def cell_coverage(spark, sf):
    clips = table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).cast("long").alias("grid"))
    return fl.cell_coverage(v_pixels(spark, sf), clips).withColumn("coverage", F.round("coverage", 4))


@query("lucas_kanade", with_views("""SELECT clip, t, gy, gx, round(CASE WHEN ok THEN greatest(-6e0, least(6e0, (-syy * sxt + sxy * syt) / det)) ELSE 0e0 END, 4) + 0e0 AS vx,
    round(CASE WHEN ok THEN greatest(-6e0, least(6e0, (sxy * sxt - sxx * syt) / det)) ELSE 0e0 END, 4) + 0e0 AS vy, ok AS valid FROM (
    SELECT *, (sxx + syy) / 2 - sqrt(greatest(0e0, (sxx + syy) * (sxx + syy) / 4 - det)) >= 40 AND det <> 0 AS ok FROM (
    SELECT *, sxx * syy - sxy * sxy AS det FROM (SELECT clip, t, gy, gx, sum(ix * ix) AS sxx, sum(ix * iy) AS sxy, sum(iy * iy) AS syy, sum(ix * it) AS sxt, sum(iy * it) AS syt FROM (
    SELECT g.clip, g.t, g.y, g.x, (rr.g - ll.g) * 0.5e0 AS ix, (dn.g - up.g) * 0.5e0 AS iy, nx.g - g.g AS it FROM gray g
    JOIN gray rr ON rr.clip = g.clip AND rr.t = g.t AND rr.y = g.y AND rr.x = g.x + 1 JOIN gray ll ON ll.clip = g.clip AND ll.t = g.t AND ll.y = g.y AND ll.x = g.x - 1
    JOIN gray dn ON dn.clip = g.clip AND dn.t = g.t AND dn.y = g.y + 1 AND dn.x = g.x JOIN gray up ON up.clip = g.clip AND up.t = g.t AND up.y = g.y - 1 AND up.x = g.x
    JOIN gray nx ON nx.clip = g.clip AND nx.t = g.t + 1 AND nx.y = g.y AND nx.x = g.x) d
    JOIN (SELECT unnest(range(0, 2)) AS gx) ON abs(d.x - (gx * 4 + 2)) <= 3 JOIN (SELECT unnest(range(0, 2)) AS gy) ON abs(d.y - (gy * 4 + 2)) <= 3 GROUP BY clip, t, gy, gx)))""",
    ["v_flow"], {"gray": "SELECT clip, t, y, x, 40e0 * vx AS g FROM v_flow"}))
def lucas_kanade(spark, sf):
    gray = v_flow(spark, sf).select("clip", "t", "y", "x", (F.col("vx") * 40).alias("g"))
    return fl.lucas_kanade(gray, 8, 8, 2, 2).select("clip", "t", "gy", "gx", "valid", *r(4, vx="vx", vy="vy"))


# ---------------------------------------------------------------- series kit on single vectors

@query("dft", with_views(f"""SELECT clip, CAST(k AS BIGINT) AS k, round(sqrt(re * re + im * im), 4) + 0e0 AS mag FROM (SELECT clip, k, sum(v * cos(2 * {PI} * ((k * t) % 64) / 64)) AS re,
    sum(-v * sin(2 * {PI} * ((k * t) % 64) / 64)) AS im FROM v_signal CROSS JOIN (SELECT unnest(range(0, 33)) AS k) GROUP BY clip, k)""", ["v_signal"]))
def dft(spark, sf):
    return sp.dft(v_signal(spark, sf), ["clip"]).select("clip", "k", *r(4, mag="mag"))


SIG = {"spec": f"""SELECT clip, k, n, sqrt(re * re + im * im) AS mag FROM (SELECT clip, k, n, sum(v * cos(2 * {PI} * ((k * t) % 64) / 64)) AS re,
    sum(-v * sin(2 * {PI} * ((k * t) % 64) / 64)) AS im FROM v_signal CROSS JOIN (SELECT unnest(range(1, 33)) AS k) GROUP BY clip, k, n)""",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY mag DESC, k) AS rn FROM spec) WHERE rn = 1"}


@query("parabolic_peak", with_views("""SELECT clip, CAST(k AS BIGINT) AS k, round(k + CASE WHEN k < 32 AND abs(den) > 1e-12 AND abs(0.5e0 * (la - lc) / den) < 1 THEN 0.5e0 * (la - lc) / den ELSE 0e0 END, 4) AS refined FROM (
    SELECT *, la - 2 * lb + lc AS den FROM (SELECT p.clip, p.k, ln(coalesce(lo.mag, 0e0) + 1e-12) AS la, ln(p.mag + 1e-12) AS lb, ln(hi.mag + 1e-12) AS lc FROM top p
    LEFT JOIN spec lo ON lo.clip = p.clip AND lo.k = p.k - 1 LEFT JOIN spec hi ON hi.clip = p.clip AND hi.k = p.k + 1))""", ["v_signal"], SIG))
def parabolic_peak(spark, sf):
    p = sp.spectral_peak(sp.dft(v_signal(spark, sf), ["clip"]), ["clip"])
    return p.select("clip", "k", F.round(sp.refined_bin(F.col("k"), F.col("n"), F.col("mag_lo"), F.col("mag"), F.col("mag_hi")), 4).alias("refined"))


@query("band_power", with_views(f"""SELECT clip, round(sum(CASE WHEN sel THEN p END) / sum(p), 4) AS share, round(max(CASE WHEN rk = 1 THEN 64e0 / k / 15e0 END), 4) AS period FROM (
    SELECT *, CASE WHEN sel THEN row_number() OVER (PARTITION BY clip, sel ORDER BY p DESC, k) END AS rk FROM (
    SELECT clip, k, re * re + im * im AS p, 64e0 / k >= 15e0 / 1.5e0 AND 64e0 / k <= 15e0 / 0.5e0 AS sel FROM (
    SELECT clip, k, sum(w * cos(2 * {PI} * ((k * t) % 64) / 64)) AS re, sum(-w * sin(2 * {PI} * ((k * t) % 64) / 64)) AS im FROM (
    SELECT clip, t, (v - avg(v) OVER (PARTITION BY clip)) * (0.5e0 - 0.5e0 * cos(2 * {PI} * t / 63e0)) AS w FROM v_signal)
    CROSS JOIN (SELECT unnest(range(1, 33)) AS k) GROUP BY clip, k))) GROUP BY clip""", ["v_signal"]))
def band_power(spark, sf):
    s = v_signal(spark, sf).withColumn("fps", F.lit(15.0))
    return sp.band_power(s, ["clip"], "fps").select("clip", *r(4, share="share", period="period"))


@query("temporal_bandpass", with_views(f"""SELECT clip, t, round(greatest(0e0, least(1e0, v + 12 * band)), 4) + 0e0 AS v FROM (
    SELECT s.clip, s.t, s.v, sum((re * cos(2 * {PI} * ((k * s.t) % 64) / 64) - im * sin(2 * {PI} * ((k * s.t) % 64) / 64)) * 2 / 64e0) AS band FROM v_signal s JOIN (
    SELECT clip, k, sum(v * cos(2 * {PI} * ((k * t) % 64) / 64)) AS re, sum(-v * sin(2 * {PI} * ((k * t) % 64) / 64)) AS im FROM v_signal
    CROSS JOIN (SELECT unnest(range(1, 32)) AS k) WHERE k * 20e0 / 64 BETWEEN 0.4e0 AND 3e0 GROUP BY clip, k) b ON b.clip = s.clip GROUP BY s.clip, s.t, s.v)""", ["v_signal"]))
def temporal_bandpass(spark, sf):
    s = v_signal(spark, sf)
    clips = table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip"), F.lit(64).cast("long").alias("n"), F.lit(20.0).alias("fps"))
    return sp.temporal_bandpass(s.select("clip", F.lit(0).alias("px"), "t", "v"), clips, ["clip"], ["px"]).select("clip", "t", *r(4, v="v"))


AC = {"z": "SELECT clip, t, (v - avg(v) OVER (PARTITION BY clip)) / stddev_pop(v) OVER (PARTITION BY clip) AS z FROM v_signal",
      "ac": "SELECT a.clip, b.t - a.t AS lag, avg(a.z * b.z) AS r FROM z a JOIN z b ON a.clip = b.clip AND b.t - a.t BETWEEN 1 AND 31 GROUP BY 1, 2",
      "pk": """SELECT clip, lag, r FROM (SELECT *, lag(r) OVER w AS p, lead(r) OVER w AS q FROM ac WINDOW w AS (PARTITION BY clip ORDER BY lag)) WHERE r > p AND r >= q AND r > 0"""}


@query("autocorrelation", with_views("SELECT clip, lag, round(r, 4) + 0e0 AS r FROM ac", ["v_signal"], AC))
def autocorrelation(spark, sf):
    return sp.autocorrelation(v_signal(spark, sf), ["clip"]).select("clip", "lag", *r(4, r="r"))


@query("best_lag", with_views("""SELECT e.clip, coalesce(round(b.r, 3), 0e0) AS corr, coalesce(b.lag, 0) AS lag FROM (SELECT vec_id AS clip FROM embeddings) e LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY r DESC, lag) AS rn FROM pk) WHERE rn = 1) b USING (clip)""", ["v_signal"], AC))
def best_lag(spark, sf):
    return sp.best_lag(v_signal(spark, sf), ["clip"])
