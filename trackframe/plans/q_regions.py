"""Registered queries over motion regions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.functions.scalar import direction_name, fixed
from trackframe.operators import flow as fl
from trackframe.operators import regions as rg
from trackframe.plans.q_flow import FEAT, dial_steps
from trackframe.plans.views import table, v_cells, v_clips, v_pixels, with_views

QUERIES, ORACLE = {}, {}
# the first cell of a component as one number, for the side-by-side check
COMP = lambda: (F.col("comp.y") * 1048576 + F.col("comp.x")).alias("comp")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


ACTIVE = {"feat": FEAT,
          "act": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY clip) AS cnt FROM (SELECT *, max(energy) OVER (PARTITION BY clip) AS peak FROM feat)
              WHERE peak >= 0.05e0 AND energy >= greatest(least(0.3e0, 0.3e0 * peak), 0.05e0)) WHERE cnt >= 4"""}
SIGN = {**ACTIVE, "sig": """SELECT *, CASE WHEN drifting THEN 'drift' ELSE 'osc' END AS kind,
    CASE WHEN drifting THEN (CAST(round_even(degrees(atan2(drift_y, drift_x)) / 45, 0) AS BIGINT) + 8) % 8
         ELSE CAST(round_even(CASE WHEN degrees(osc_axis) < 0 THEN degrees(osc_axis) + 180 ELSE degrees(osc_axis) END / 45, 0) AS BIGINT) % 4 END AS bin
    FROM (SELECT *, sqrt(drift_x * drift_x + drift_y * drift_y) >= 0.8e0 * osc AND sqrt(drift_x * drift_x + drift_y * drift_y) > 0.02e0 AS drifting FROM act)"""}
LOOK = ", ".join(f"({a}, {b}, {c}, {d})" for a, b, c, d in rg.merge_lookup())
MERGED = {**SIGN, "look": f"SELECT * FROM (VALUES {LOOK}) q(ring, mask, bin, grp)",
          "mrg": """SELECT s.*, CAST(grp AS BIGINT) AS grp FROM sig s JOIN (SELECT clip, kind, bit_or(CAST(1 AS BIGINT) << CAST(bin AS INTEGER)) AS mask FROM sig GROUP BY ALL) p USING (clip, kind)
              JOIN look l ON l.ring = CASE WHEN s.kind = 'drift' THEN 8 ELSE 4 END AND l.mask = p.mask AND l.bin = s.bin"""}
def cc_sql(src: str, key: str, y: str, x: str) -> str:
    k = ", ".join(f"a.{c}" for c in key.split(", "))
    same = " AND ".join(f"a.{c} = b.{c}" for c in key.split(", "))
    return f"""SELECT {key}, {y}, {x}, min(root) AS comp FROM (WITH RECURSIVE walk AS (
        SELECT {key}, {y}, {x}, {y} * 1048576 + {x} AS root FROM {src} UNION
        SELECT {k}, a.{y}, a.{x}, b.root FROM {src} a JOIN walk b ON {same} AND abs(a.{y} - b.{y}) <= 1 AND abs(a.{x} - b.{x}) <= 1)
        SELECT * FROM walk) GROUP BY {key}, {y}, {x}"""


COMPS = {**MERGED, "cc": cc_sql("mrg", "clip, kind, grp", "gy", "gx"),
         "reg": """SELECT clip, kind, grp, comp, count(*) AS cells, sum(energy) AS energy, max(energy) AS peak_cell, avg(drift_x) AS mdx, avg(drift_y) AS mdy,
             min(gx) AS gx0, min(gy) AS gy0, max(gx) + 1 AS gx1, max(gy) + 1 AS gy1 FROM cc JOIN mrg USING (clip, kind, grp, gy, gx) GROUP BY clip, kind, grp, comp""",
         "top8": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY energy DESC, kind, comp) - 1 AS region, max(energy) OVER (PARTITION BY clip) AS te
             FROM reg WHERE cells >= 4) WHERE region < 8 AND (region = 0 OR energy >= 0.25e0 * te)"""}


@query("active_cells", with_views("SELECT clip, gy, gx, round(energy, 5) + 0e0 AS energy FROM act", ["v_cells"], ACTIVE))
def active_cells(spark, sf):
    return rg.active_cells(fl.cell_features(v_cells(spark, sf))).select("clip", "gy", "gx", fixed(F.col("energy"), 5).alias("energy"))


@query("signature", with_views("SELECT clip, gy, gx, kind, bin FROM sig", ["v_cells"], SIGN))
def signature(spark, sf):
    return rg.signature(rg.active_cells(fl.cell_features(v_cells(spark, sf)))).select("clip", "gy", "gx", "kind", "bin")


@query("merge_circular_bins", with_views("SELECT clip, gy, gx, kind, bin, grp FROM mrg", ["v_cells"], MERGED))
def merge_circular_bins(spark, sf):
    s = rg.signature(rg.active_cells(fl.cell_features(v_cells(spark, sf))))
    return rg.merge_circular_bins(s).select("clip", "gy", "gx", "kind", "bin", "grp")


@query("components8", with_views("SELECT clip, y, x, comp FROM cc", ["v_pixels"], {"cc": cc_sql("v_pixels", "clip", "y", "x")}))
def components8(spark, sf):
    return rg.components8(v_pixels(spark, sf), ["clip"], "y", "x").select("clip", "y", "x", COMP())


@query("largest_component", with_views("""SELECT clip, y, x FROM cc JOIN (SELECT clip, comp FROM (SELECT clip, comp, row_number() OVER (PARTITION BY clip ORDER BY count(*) DESC, comp) AS rn
    FROM cc GROUP BY clip, comp) WHERE rn = 1) USING (clip, comp)""", ["v_pixels"], {"cc": cc_sql("v_pixels", "clip", "y", "x")}))
def largest_component(spark, sf):
    return rg.largest_component(v_pixels(spark, sf)).select("clip", "y", "x")


@query("region_bbox", with_views("SELECT clip, kind, bin, round(min(gx) / 5e0, 4) AS x0, round(min(gy) / 5e0, 4) AS y0, round((max(gx) + 1) / 5e0, 4) AS x1, round((max(gy) + 1) / 5e0, 4) AS y1 FROM sig GROUP BY ALL", ["v_cells"], SIGN))
def region_bbox(spark, sf):
    s = rg.signature(rg.active_cells(fl.cell_features(v_cells(spark, sf))))
    b = rg.region_bbox(s, ["clip", "kind", "bin"], F.lit(5))
    return b.select("clip", "kind", "bin", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("top_regions", with_views("SELECT clip, region, kind, comp, cells, round(energy, 4) AS energy FROM top8", ["v_cells"], COMPS))
def top_regions(spark, sf):
    top, _ = rg.candidate_regions(v_cells(spark, sf))
    return top.select("clip", "region", "kind", COMP(), "cells", F.round("energy", 4).alias("energy"))


DIR = "CASE WHEN direction < 22.5 OR direction >= 157.5 THEN 'horizontal' WHEN direction >= 67.5 AND direction < 112.5 THEN 'vertical' WHEN direction >= 22.5 AND direction < 67.5 THEN 'diagonal ↘' ELSE 'diagonal ↗' END"
NAME = f"""CASE WHEN kind = 'drift' THEN CASE WHEN abs(mdy) >= abs(mdx) THEN CASE WHEN mdy > 0 THEN CASE WHEN turbulence > 0.35e0 AND frequency > 1.5e0 THEN 'Streaming' ELSE 'Falling' END ELSE 'Rising' END ELSE 'Drifting' END
    WHEN amplitude < 0.06e0 THEN 'Shimmer' WHEN turbulence > 0.45e0 THEN 'Flutter' WHEN frequency >= 2 THEN CASE WHEN turbulence > 0.25e0 THEN 'Flutter' ELSE 'Fast ' || ({DIR}) END
    WHEN frequency < 0.6e0 THEN 'Sway' WHEN turbulence > 0.2e0 THEN 'Ripple' WHEN ({DIR}) = 'horizontal' THEN 'Wave' ELSE 'Sway' END"""
COLORS = "[" + ", ".join(f"'{c}'" for c in rg.REGION_COLORS) + "]"
SEGMENT = {**COMPS,
           "pstill": """SELECT clip FROM (SELECT clip, t, count(*) * covar_pop(m, m2) / (count(*) * sqrt(var_pop(m) * var_pop(m2)) + 1e-9) AS corr FROM (
               SELECT *, lead(m) OVER (PARTITION BY clip, gy, gx ORDER BY t) AS m2 FROM (SELECT *, sqrt(vx * vx + vy * vy) AS m FROM v_cells)) WHERE m2 IS NOT NULL GROUP BY clip, t) GROUP BY clip HAVING avg(corr) >= 0.85e0""",
           "rmeta": """SELECT clip, region, 20e0 AS fps, (gx1 - gx0) * 96e0 AS width, least(0.55e0, greatest(0.12e0, 0.6e0 * peak_cell)) AS fl FROM top8 WHERE clip NOT IN (SELECT clip FROM pstill)""",
           "rcells": "SELECT v.*, region FROM v_cells v JOIN cc USING (clip, gy, gx) JOIN top8 r USING (clip, kind, grp, comp)",
           **dial_steps("rcells", "rmeta", "clip, region", "fl")}


@query("segment_regions", with_views(f"""SELECT clip, region, kind, cells, frequency, amplitude, direction, turbulence, damping, "phaseSpread", "driftX", "driftY", round(gx0 / 5e0, 4) AS x0, round(gy0 / 5e0, 4) AS y0,
    round(gx1 / 5e0, 4) AS x1, round(gy1 / 5e0, 4) AS y1, {NAME} AS suggested_name, {COLORS}[region % 8 + 1] AS color FROM dials JOIN top8 USING (clip, region)""", ["v_cells", "v_clips"], SEGMENT))
def segment_regions(spark, sf):
    c = v_cells(spark, sf)
    return rg.segment_regions(c, c, v_clips(spark, sf)).select(
        "clip", "region", "kind", "cells", *fl.DIALS, *[F.round(b, 4).alias(b) for b in ("x0", "y0", "x1", "y1")], "suggested_name", "color")


# curated layouts used by the two profile queries: key, region, name, kind, cell box (null = every active cell)
PROFILES = [("ring", 0, "Ring Turn", "osc", 0, 0, 2, 2), ("ring", 1, "Ring Fall", "drift", 3, 0, 4, 4), ("red", 0, None, "drift", None, None, None, None),
            ("small ring", 0, "Small Ring", "osc", 0, 0, 4, 1), ("widget", 0, None, "osc", 1, 1, 4, 4)]
PSCHEMA = "key string, idx int, name string, kind string, gy0 long, gx0 long, gy1 long, gx1 long"


@query("profile_match", """SELECT clip, key FROM (SELECT p_partkey AS clip, key, row_number() OVER (PARTITION BY p_partkey ORDER BY length(key) DESC, key DESC) AS rn
    FROM part JOIN (VALUES ('ring'), ('red'), ('small ring'), ('widget')) q(key) ON contains(lower(p_name) || '.mp4', key)) WHERE rn = 1""")
def profile_match(spark, sf):
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("clip"), F.concat("p_name", F.lit(".MP4")).alias("filename"))
    return rg.profile_match(files, spark.createDataFrame(PROFILES, PSCHEMA))


def _sql_null(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


PROF = {"pf": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_sql_null(v) for v in r) + ")" for r in PROFILES) + ") q(key, idx, pname, kind, gy0, gx0, gy1, gx1)",
        "fname": "SELECT clip, (['small ring.mp4', 'red.mov', 'my widget.mp4', 'other.mp4', 'ring2.mp4'])[CAST(clip % 5 + 1 AS INTEGER)] AS fn FROM v_clips",
        "hit": "SELECT clip, key FROM (SELECT clip, key, row_number() OVER (PARTITION BY clip ORDER BY length(key) DESC) AS rn FROM fname JOIN (SELECT DISTINCT key FROM pf) ON contains(lower(fn), key)) WHERE rn = 1",
        "feat": FEAT,
        "pcell": """SELECT f.*, idx AS region, pname, kind FROM (SELECT *, bool_or(act) OVER (PARTITION BY clip) AS anyact FROM (SELECT *, energy >= greatest(least(0.3e0, 0.3e0 * peak), 0.05e0) AS act FROM (
            SELECT *, max(energy) OVER (PARTITION BY clip) AS peak FROM feat) WHERE peak >= 0.05e0)) f JOIN hit USING (clip) JOIN pf USING (key)
            WHERE CASE WHEN gy0 IS NULL THEN CASE WHEN anyact THEN act ELSE energy >= 0.5e0 * peak END ELSE gy BETWEEN gy0 AND gy1 AND gx BETWEEN gx0 AND gx1 END""",
        "preg": """SELECT clip, region, max(pname) AS pname, max(kind) AS kind, count(*) AS cells, max(energy) AS peak_cell, avg(drift_x) AS mdx, avg(drift_y) AS mdy, min(gx) AS gx0, min(gy) AS gy0, max(gx) + 1 AS gx1, max(gy) + 1 AS gy1 FROM pcell GROUP BY clip, region""",
        "rmeta": "SELECT clip, region, 20e0 AS fps, (gx1 - gx0) * 96e0 AS width, least(0.55e0, greatest(0.12e0, 0.6e0 * peak_cell)) AS fl FROM preg",
        "rcells": "SELECT v.*, region FROM v_cells v JOIN (SELECT clip, gy, gx, region FROM pcell) USING (clip, gy, gx)",
        **dial_steps("rcells", "rmeta", "clip, region", "fl")}


@query("profile_regions", with_views(f"""SELECT clip, CAST(region AS BIGINT) AS region, kind, cells, frequency, amplitude, direction, turbulence, damping, "phaseSpread", "driftX", "driftY", coalesce(pname, {NAME}) AS suggested_name
    FROM dials JOIN preg USING (clip, region)""", ["v_cells", "v_clips"], PROF))
def profile_regions(spark, sf):
    c, clips = v_cells(spark, sf), v_clips(spark, sf)
    names = F.array(*[F.lit(n) for n in ("small ring.mp4", "red.mov", "my widget.mp4", "other.mp4", "ring2.mp4")])
    files = clips.select("clip", F.get(names, F.pmod("clip", F.lit(5))).alias("filename"))
    prof = spark.createDataFrame(PROFILES, PSCHEMA)
    top, members = rg.profile_regions(c, clips, rg.profile_match(files, prof), prof)
    return rg.build_regions(c, top, members, clips).select("clip", "region", "kind", "cells", *fl.DIALS, "suggested_name")


@query("direction_name", with_views(f"SELECT clip, {DIR} AS name FROM dials", ["v_cells", "v_clips"], dial_steps()))
def direction_of_clip(spark, sf):
    a = fl.clip_axis(fl.frame_moments(v_cells(spark, sf)), v_clips(spark, sf))
    return a.select("clip", direction_name(F.col("direction")).alias("name"))
