"""Registered queries over raw answers, verdicts, matching and layer trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe import dims
from trackframe.functions import names as nm
from trackframe.functions.scalar import fixed
from trackframe.operators import contracts as ct
from trackframe.operators import flow as fl
from trackframe.operators import matching as mt
from trackframe.operators import series as se
from trackframe.plans.q_flow import TRACKS, dial_steps
from trackframe.plans.views import spread_rows, table, v_boxes, v_cells, v_clips, v_hist, with_views

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


# ---------------------------------------------------------------- raw answers, the same text in both dialects

def _item(k: int) -> str:
    s = f"(o_orderkey * 3 + {k} + o_custkey)"
    cls = f"CASE {s} % 8 WHEN 0 THEN 'articulated' WHEN 1 THEN 'cloth' WHEN 2 THEN ' Cloth ' WHEN 3 THEN 'fluid' WHEN 4 THEN 'FLOCK' WHEN 5 THEN 'rigid_path' WHEN 6 THEN 'oscillation' ELSE 'wobble' END"
    box = f"""CASE {s} % 7 WHEN 0 THEN '' WHEN 1 THEN ',"bbox":["a",0,1,1]' WHEN 2 THEN ',"bbox":[0.8,0.1,0.5,0.2]' WHEN 3 THEN ',"bbox":[0.2,0.2,0,0]' WHEN 4 THEN ',"bbox":["0.1","0.2","0.3","0.4"]'
        WHEN 5 THEN ',"bbox":[0.1,0.9]' ELSE ',"bbox":[0.' || lpad(CAST(o_custkey % 97 AS STRING), 2, '0') || ',0.9,0.2,0.5]' END"""
    conf = f"CASE {s} % 5 WHEN 0 THEN ',\"confidence\":\"high\"' WHEN 1 THEN '' WHEN 2 THEN ',\"confidence\":4.2' ELSE ',\"confidence\":0.' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') END"
    count = f"CASE {s} % 6 WHEN 0 THEN ',\"count\":2' WHEN 1 THEN ',\"count\":\"5\"' WHEN 2 THEN ',\"count\":\" Several\"' WHEN 3 THEN ',\"count\":1' WHEN 4 THEN '' ELSE ',\"count\":\"solo\"' END"
    sub = f"CASE {s} % 4 WHEN 0 THEN ',\"subject_type\":\"HUMAN\"' WHEN 1 THEN ',\"subject_type\":\"animal\"' WHEN 2 THEN ',\"subject_type\":\"robot\"' ELSE '' END"
    lab = f"CASE {s} % 3 WHEN 0 THEN '' ELSE ',\"label\":\"thing ' || CAST(o_custkey AS STRING) || '\"' END"
    return f"CASE WHEN {s} % 11 = 0 THEN '\"just text\"' ELSE '{{\"class\":\"' || {cls} || '\"' || {box} || {conf} || {count} || {sub} || {lab} || '}}' END"


RAW_MOTIONS = f"""CASE o_orderkey % 50 WHEN 0 THEN 'not json' WHEN 1 THEN '[1,2]' WHEN 2 THEN '{{"motions":[]}}' ELSE '{{"motions":[' || {_item(0)} || ',' || {_item(1)} || ',' || {_item(2)} || ']}}' END"""


def _raw(spark, sf, expr):
    o = spread_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.expr(expr).alias("raw"))


MOTIONS = {
    "rw": f"SELECT o_orderkey AS doc_id, {RAW_MOTIONS} AS raw FROM orders",
    "js": "SELECT doc_id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM rw",
    "itm": """SELECT doc_id, k, json_extract(j, '$.motions[' || k || ']') AS m FROM js JOIN (SELECT unnest(range(0, 3)) AS k) ON k < coalesce(json_array_length(j, '$.motions'), 0) WHERE json_type(j) = 'OBJECT'""",
    "rd": """SELECT doc_id, k, json_type(m) = 'OBJECT' AS is_obj, lower(trim(coalesce(json_extract_string(m, '$.class'), ''))) AS cls, coalesce(json_array_length(m, '$.bbox'), 0) AS nb,
        TRY_CAST(json_extract_string(m, '$.bbox[0]') AS DOUBLE) AS b0, TRY_CAST(json_extract_string(m, '$.bbox[1]') AS DOUBLE) AS b1, TRY_CAST(json_extract_string(m, '$.bbox[2]') AS DOUBLE) AS b2, TRY_CAST(json_extract_string(m, '$.bbox[3]') AS DOUBLE) AS b3,
        TRY_CAST(json_extract_string(m, '$.confidence') AS DOUBLE) AS cf, json_extract_string(m, '$.count') AS ct, lower(json_extract_string(m, '$.subject_type')) AS st, json_extract_string(m, '$.label') AS lb FROM itm""",
    "kept": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth, nb = 0 OR (nb >= 4 AND b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL) AS bok FROM rd
        WHERE is_obj AND cls IN ('articulated', 'cloth', 'fluid', 'flock', 'rigid_path', 'oscillation')""",
    "bx": """SELECT *, CASE WHEN x + w0 > 1 THEN 1 - x ELSE w0 END AS w, CASE WHEN y + h0 > 1 THEN 1 - y ELSE h0 END AS h FROM (
        SELECT *, CASE WHEN bok AND nb > 0 THEN least(1e0, greatest(0e0, b0)) ELSE 0e0 END AS x, CASE WHEN bok AND nb > 0 THEN least(1e0, greatest(0e0, b1)) ELSE 0e0 END AS y,
        CASE WHEN bok AND nb > 0 AND b2 > 0 THEN least(1e0, b2) ELSE 1e0 END AS w0, CASE WHEN bok AND nb > 0 AND b3 > 0 THEN least(1e0, b3) ELSE 1e0 END AS h0 FROM kept)""",
    "mot": """SELECT doc_id, nth - 1 AS pos, 'm' || nth AS id, coalesce(lb, cls) AS label, cls AS class, round(x, 4) + 0e0 AS bx, round(y, 4) + 0e0 AS by_, round(w, 4) + 0e0 AS bw, round(h, 4) + 0e0 AS bh,
        round(least(1e0, greatest(0e0, coalesce(cf, 0.5e0))), 3) AS confidence, CASE cls WHEN 'articulated' THEN 'pose_mediapipe' WHEN 'rigid_path' THEN 'track_bytetrack' WHEN 'oscillation' THEN 'parametric' ELSE 'flow_raft' END AS backend,
        CASE cls WHEN 'articulated' THEN 'skeletal' WHEN 'cloth' THEN 'wave' WHEN 'fluid' THEN 'flow_field' WHEN 'flock' THEN 'flock_drift' WHEN 'rigid_path' THEN 'path_travel' ELSE 'oscillate' END AS applicator,
        CASE WHEN st IN ('human', 'animal', 'object') THEN st ELSE 'object' END AS subject_type,
        CASE WHEN TRY_CAST(trim(ct) AS DOUBLE) IS NOT NULL THEN CASE WHEN TRY_CAST(trim(ct) AS DOUBLE) > 1 THEN 'many' ELSE 'one' END WHEN lower(trim(ct)) IN ('many', 'few', 'several', 'multiple', 'group', 'flock', 'crowd') THEN 'many' ELSE 'one' END AS "count" FROM bx"""}


def _motions(spark, sf):
    return ct.normalize_decomposition(_raw(spark, sf, RAW_MOTIONS))[0].withColumn("has_text_prompt", F.lit(False))


@query("normalize_decomposition", with_views("SELECT * FROM mot", [], MOTIONS))
def normalize_decomposition(spark, sf):
    m = _motions(spark, sf)
    return m.select("doc_id", "pos", "id", "label", "class", *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("bx", "by_", "bw", "bh"))],
                    "confidence", "backend", "applicator", "subject_type", "count")


@query("decomposition_documents", with_views("SELECT js.doc_id, coalesce(n, 0) = 0 AS static, j IS NULL AS quarantined FROM js LEFT JOIN (SELECT doc_id, count(*) AS n FROM mot GROUP BY doc_id) USING (doc_id)", [], MOTIONS))
def decomposition_documents(spark, sf):
    return ct.normalize_decomposition(_raw(spark, sf, RAW_MOTIONS))[2]


@query("decomposition_notes", with_views("""SELECT r.doc_id, r.k AS "at", CASE WHEN NOT r.is_obj THEN 'left out: item without fields' WHEN kp.doc_id IS NULL THEN 'left out: class ''' || r.cls || '''' ELSE 'box unusable, whole frame taken' END AS note
    FROM rd r LEFT JOIN kept kp ON kp.doc_id = r.doc_id AND kp.k = r.k WHERE kp.doc_id IS NULL OR NOT kp.bok UNION ALL SELECT doc_id, NULL, 'unreadable text, set apart' FROM js WHERE j IS NULL""", [], MOTIONS))
def decomposition_notes(spark, sf):
    return ct.normalize_decomposition(_raw(spark, sf, RAW_MOTIONS))[1]


@query("confidence_gate", with_views("SELECT doc_id, id, confidence FROM mot WHERE confidence >= 0.35e0", [], MOTIONS))
def confidence_gate(spark, sf):
    return ct.confidence_gate(_motions(spark, sf)).select("doc_id", "id", "confidence")


@query("top_motions", with_views("SELECT doc_id, id, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, pos) AS rank FROM mot WHERE class <> 'articulated') WHERE rank <= 4", [], MOTIONS))
def top_motions(spark, sf):
    m = _motions(spark, sf).filter("class <> 'articulated'")
    return se.top_k(m.select("doc_id", "pos", "id", "confidence"), ["doc_id"], [F.col("confidence").desc(), F.col("pos")], 4).select("doc_id", "id", "confidence", "rank")


@query("classify_lookup", with_views("SELECT doc_id, id, backend, applicator, CASE WHEN class IN ('cloth', 'fluid') THEN 'mesh' ELSE 'rigid' END AS deforms FROM mot", [], MOTIONS))
def classify_lookup(spark, sf):
    return mt.classify_lookup(_motions(spark, sf)).select("doc_id", "id", "backend", "applicator", "deforms")


@query("count_bucket", with_views('SELECT doc_id, id, "count", subject_type FROM mot', [], MOTIONS))
def count_bucket(spark, sf):
    return _motions(spark, sf).select("doc_id", "id", "count", "subject_type")


ENGINES = [("raft_small", "flow", True, True, ""), ("raft_large", "flow", False, True, ""), ("searaft", "flow", False, False, "weights missing"), ("cotracker3", "trajectory", True, True, ""),
           ("tapir", "trajectory", False, False, "not installed"), ("pose_mediapipe", "pose", True, True, ""), ("keypointrcnn", "pose", False, True, ""), ("momask", "pose", False, False, "no weights"),
           ("wham", "pose", False, False, "gated"), ("mmpose_animal", "pose", False, False, "gated"), ("yolo_bytetrack", "object_path", True, False, "not installed"), ("objectron", "object_path", False, False, "gated")]
ENGINE_SCHEMA = "name string, kind string, is_default boolean, available boolean, reason string"
ENG = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d}, '{e}')" for a, b, c, d, e in ENGINES) + ") q(name, kind, is_default, available, reason)"
_nul = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
RULES = "SELECT class, rule_no, subject_type, cnt, prompt, pos, e FROM (VALUES " + ", ".join(
    f"('{c}', {n}, CAST({_nul(s)} AS VARCHAR), CAST({_nul(k)} AS VARCHAR), CAST({_nul(p)} AS BOOLEAN), {i}, '{e}')" for c, n, s, k, p, es in dims.ROUTE_RULES for i, e in enumerate(es)) + ") q(class, rule_no, subject_type, cnt, prompt, pos, e)"


@query("resolve_route", with_views("""SELECT m.doc_id, m.id, coalesce(a.e, CASE m.class WHEN 'articulated' THEN 'keypointrcnn' ELSE 'raft_small' END) AS engine FROM mot m
    JOIN (SELECT doc_id, id, min(rule_no) AS rn FROM mot JOIN (SELECT DISTINCT class, rule_no, subject_type AS st, cnt, prompt FROM rules) r USING (class)
        WHERE (st IS NULL OR st = subject_type) AND (cnt IS NULL OR cnt = "count") AND (prompt IS NULL OR prompt = false) GROUP BY doc_id, id) f USING (doc_id, id)
    LEFT JOIN (SELECT class, rule_no, arg_min(e, pos) AS e FROM rules JOIN eng ON eng.name = e AND available GROUP BY class, rule_no) a ON a.class = m.class AND a.rule_no = f.rn""", [], {**MOTIONS, "eng": ENG, "rules": RULES}))
def resolve_route(spark, sf):
    m = _motions(spark, sf).select("doc_id", "id", "class", "subject_type", "count", "has_text_prompt")
    return mt.resolve_route(m, spark.createDataFrame(ENGINES, ENGINE_SCHEMA)).select("doc_id", "id", "engine")


ASK = "CASE o_orderkey % 6 WHEN 0 THEN 'searaft' WHEN 1 THEN 'raft_large' WHEN 2 THEN '' WHEN 3 THEN 'cotracker3' WHEN 4 THEN 'nope' ELSE 'raft_small' END"


@query("resolve_engine", f"""WITH eng AS ({ENG}), a AS (SELECT o_orderkey AS id, {ASK} AS name FROM orders)
    SELECT id, CASE WHEN e.available THEN a.name ELSE 'raft_small' END AS engine, CASE WHEN a.name = '' THEN NULL WHEN e.name IS NULL THEN '''' || a.name || ''' is not a registered flow engine' WHEN NOT e.available THEN a.name || ' unavailable (' || e.reason || ')' END AS fallback
    FROM a LEFT JOIN eng e ON e.name = a.name AND e.kind = 'flow'""")
def resolve_engine(spark, sf):
    req = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(ASK).alias("name"), F.lit("flow").alias("kind"))
    return mt.resolve_engine(req, spark.createDataFrame(ENGINES, ENGINE_SCHEMA)).select("id", "engine", "fallback")


# ---------------------------------------------------------------- boxes

BOXCOLS = "id, CASE WHEN id % 13 = 0 THEN NULL ELSE bx - 0.1e0 END AS x, \"by\" + 0.05e0 AS y, CASE WHEN id % 7 = 0 THEN 0e0 WHEN id % 17 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN id % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE bw END AS w, bh AS h"


def _boxes(spark, sf):
    i = F.col("id")
    w = F.when(i % 7 == 0, 0.0).when(i % 17 == 0, float("inf")).when(i % 19 == 0, float("nan")).otherwise(F.col("bw"))
    x = F.when(i % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("bx") - 0.1)
    return v_boxes(spark, sf).select("id", F.array(x, F.col("by") + 0.05, w, F.col("bh")).alias("b"))


@query("clamp_box", with_views("""SELECT id, round(CASE WHEN bad THEN 0e0 ELSE cx END, 4) + 0e0 AS fx, round(CASE WHEN bad THEN 1e0 ELSE CASE WHEN cx + cw > 1 THEN 1 - cx ELSE cw END END, 4) + 0e0 AS fw,
    round(CASE WHEN bad THEN 1e0 ELSE CASE WHEN cy + ch > 1 THEN 1 - cy ELSE ch END END, 4) + 0e0 AS fh,
    round(CASE WHEN bad OR least(w, 1 - cx) <= 0 OR least(h, 1 - cy) <= 0 THEN NULL ELSE least(w, 1 - cx) END, 4) + 0e0 AS sw FROM (
    SELECT *, x IS NULL OR NOT isfinite(w) AS bad, greatest(0e0, least(1e0, x)) AS cx, greatest(0e0, least(1e0, y)) AS cy,
    CASE WHEN w = 0 THEN 1e0 ELSE greatest(0e0, least(1e0, w)) END AS cw, CASE WHEN h = 0 THEN 1e0 ELSE greatest(0e0, least(1e0, h)) END AS ch FROM (SELECT """ + BOXCOLS + " FROM v_boxes))", ["v_boxes"]))
def clamp_box(spark, sf):
    b = _boxes(spark, sf)
    f, s = ct.clamp_box(F.col("b"), "finite"), ct.clamp_box(F.col("b"), "strict")
    return b.select("id", F.get(f, F.lit(0)).alias("fx"), F.get(f, F.lit(2)).alias("fw"), F.get(f, F.lit(3)).alias("fh"), F.get(s, F.lit(2)).alias("sw"))


@query("norm_box", with_views("""SELECT id, CASE WHEN ok THEN round(greatest(0e0, least(1e0, x0)), 4) + 0e0 END AS nx, CASE WHEN ok THEN round(greatest(0e0, least(1e0, y0)), 4) + 0e0 END AS ny, CASE WHEN ok THEN round(greatest(0e0, least(1e0, x1 - x0)), 4) + 0e0 END AS nw, CASE WHEN ok THEN round(greatest(0e0, least(1e0, y1 - y0)), 4) + 0e0 END AS nh FROM (
    SELECT id, ok, (least(px1, px2, px3, px4) - 10) / 400e0 AS x0, (greatest(px1, px2, px3, px4) - 10) / 400e0 AS x1, (least(py1, py2, py3, py4) - 5) / 300e0 AS y0, (greatest(py1, py2, py3, py4) - 5) / 300e0 AS y1 FROM (
    SELECT id, w > 0 AND h > 0 AS ok, 0.8e0 * x - 0.3e0 * y + 20 AS px1, 0.8e0 * (x + w) - 0.3e0 * y + 20 AS px2, 0.8e0 * x - 0.3e0 * (y + h) + 20 AS px3, 0.8e0 * (x + w) - 0.3e0 * (y + h) + 20 AS px4,
    0.3e0 * x + 0.8e0 * y - 7 AS py1, 0.3e0 * (x + w) + 0.8e0 * y - 7 AS py2, 0.3e0 * x + 0.8e0 * (y + h) - 7 AS py3, 0.3e0 * (x + w) + 0.8e0 * (y + h) - 7 AS py4
    FROM (SELECT id, bx * 400 AS x, "by" * 300 AS y, bw * 200 AS w, bh * 100 AS h FROM v_boxes)))""", ["v_boxes"]))
def norm_box(spark, sf):
    b = v_boxes(spark, sf)
    n = nm.norm_box(F.col("bx") * 400, F.col("by") * 300, F.col("bw") * 200, F.col("bh") * 100, tuple(F.lit(v) for v in (10.0, 5.0, 400.0, 300.0)),
                    tuple(F.lit(v) for v in (0.8, 0.3, -0.3, 0.8, 20.0, -7.0)))
    return b.select("id", *[F.get(n, F.lit(i)).alias(c) for i, c in enumerate(("nx", "ny", "nw", "nh"))])


# ---------------------------------------------------------------- preprocess, skeleton

RAW_PRE = """CASE o_orderkey % 40 WHEN 0 THEN '"nope"' WHEN 1 THEN '{{{' ELSE '{"motion_id":"m' || CAST(o_custkey AS STRING) || '","class":"cloth","seed_bbox":' || CASE o_orderkey % 4 WHEN 0 THEN '[0.8,0.1,0.5,0.2]' WHEN 1 THEN '[0.2,0.2]' WHEN 2 THEN '[0.2,0.2,0,0]' ELSE '[0.1,0.2,0.3,0.4]' END
    || ',"mask":' || CASE o_custkey % 7 WHEN 0 THEN 'null' WHEN 1 THEN '{"encoding":"jpeg","w":480,"h":270}' WHEN 2 THEN '{"encoding":"rle","w":"480","h":270}' WHEN 3 THEN '{"encoding":"RLE","w":480,"h":270,"coverage":7.5,"method":"x"}' WHEN 4 THEN '{"encoding":"rle","w":480.5,"h":270}' ELSE '{"encoding":"rle","w":480,"h":' || CAST(o_orderkey % 300 AS STRING) || ',"data":[12,30],"bbox":[0.1,0.2,0.3,0.4],"coverage":0.04}' END
    || ',"camera":' || CASE o_orderkey % 3 WHEN 0 THEN '{"is_static":false,"model":"affine","residual_px":4.2126}' WHEN 1 THEN '{"model":"projective","per_frame":"lots"}' ELSE 'null' END || ',"engine":"e","warnings":["given"]}' END"""


@query("normalize_preprocess", f"""WITH r AS (SELECT o_orderkey AS doc_id, {RAW_PRE} AS raw FROM orders), j AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM r),
    x AS (SELECT doc_id, coalesce(json_type(j) = 'OBJECT', false) AS obj, coalesce(json_type(j, '$.mask') = 'OBJECT', false) AS mk, lower(json_extract_string(j, '$.mask.encoding')) AS enc,
        coalesce(json_type(j, '$.mask.w') IN ('UBIGINT', 'BIGINT') AND json_type(j, '$.mask.h') IN ('UBIGINT', 'BIGINT'), false) AS ints, j, coalesce(json_type(j, '$.camera') = 'OBJECT', false) AS cam,
        lower(coalesce(json_extract_string(j, '$.camera.model'), 'none')) AS model FROM j)
    SELECT doc_id, CASE WHEN mk AND enc = 'rle' AND ints THEN CAST(json_extract_string(j, '$.mask.h') AS BIGINT) END AS mask_h, CASE WHEN mk AND enc = 'rle' AND ints THEN least(1e0, CAST(json_extract_string(j, '$.mask.coverage') AS DOUBLE)) END AS coverage,
    CASE WHEN cam AND model = 'affine' THEN 'affine' ELSE 'none' END AS model, coalesce(CASE WHEN cam THEN json_extract_string(j, '$.camera.is_static') <> 'false' END, true) AS is_static, round(coalesce(CAST(json_extract_string(j, '$.camera.residual_px') AS DOUBLE), 0e0), 3) AS residual_px,
    (CASE WHEN obj THEN 1 ELSE 1 END) + (CASE WHEN obj AND mk AND enc <> 'rle' THEN 1 WHEN obj AND mk AND NOT ints THEN 1 ELSE 0 END) + (CASE WHEN cam AND model NOT IN ('none', 'affine', 'homography') THEN 1 ELSE 0 END) AS warnings,
    CASE WHEN NOT obj OR doc_id % 4 = 1 THEN '0.0,0.0,1.0,1.0' WHEN doc_id % 4 = 0 THEN '0.8,0.1,0.2,0.2' WHEN doc_id % 4 = 2 THEN '0.2,0.2,0.8,0.8' ELSE '0.1,0.2,0.3,0.4' END AS seed FROM x""")
def normalize_preprocess(spark, sf):
    d = ct.normalize_preprocess(_raw(spark, sf, RAW_PRE))
    return d.select("doc_id", F.col("mask.h").alias("mask_h"), F.col("mask.coverage").alias("coverage"), F.col("camera.model").alias("model"), F.col("camera.is_static").alias("is_static"),
                    F.col("camera.residual_px").alias("residual_px"), F.size("warnings").cast("int").alias("warnings"), F.array_join(F.transform("seed_bbox", lambda v: v.cast("string")), ",").alias("seed"))


RAW_SKEL = """CASE o_orderkey % 30 WHEN 0 THEN '7' ELSE '{"subject":"' || CASE o_orderkey % 4 WHEN 0 THEN 'pose' WHEN 1 THEN 'hands' WHEN 2 THEN 'face' ELSE 'tail' END || '","viewpoint":"' || CASE o_custkey % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'top' ELSE 'side' END
    || '","fps":' || CASE o_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '11.98801' WHEN 2 THEN '"x"' ELSE '15' END || ',"confidence":' || CASE o_orderkey % 3 WHEN 0 THEN '1.7' WHEN 1 THEN '0.87' ELSE 'null' END
    || ',"frames":[[1],null,[2],[]],"flags":["ok","interp","ok","gap"]' || CASE o_orderkey % 5 WHEN 0 THEN ',"total":40,"detected":39' ELSE '' END || CASE o_custkey % 4 WHEN 0 THEN ',"confidence_of":"generation_only"' WHEN 1 THEN ',"confidence_of":"vibes"' ELSE '' END || '}' END"""


@query("normalize_skeleton", f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 30 = 0 THEN 'pose' ELSE CASE o_orderkey % 4 WHEN 1 THEN 'hands' WHEN 2 THEN 'face' ELSE 'pose' END END AS subject,
    CASE WHEN o_orderkey % 30 = 0 THEN 'unknown' ELSE CASE o_custkey % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'unknown' ELSE 'side' END END AS viewpoint,
    CASE WHEN o_orderkey % 30 <> 0 AND o_custkey % 5 = 1 THEN 11.988e0 ELSE 15e0 END AS fps, CASE WHEN o_orderkey % 30 = 0 THEN 0e0 ELSE CASE o_orderkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.87e0 ELSE 0e0 END END AS confidence,
    CASE WHEN o_orderkey % 30 = 0 THEN 'mean_visibility' WHEN o_custkey % 4 = 0 THEN 'generation_only' ELSE CASE o_orderkey % 4 WHEN 1 THEN 'handedness_score' WHEN 2 THEN 'detection_ratio' ELSE 'mean_visibility' END END AS confidence_of,
    CAST(CASE WHEN o_orderkey % 30 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN 40 ELSE 4 END AS BIGINT) AS total, CAST(CASE WHEN o_orderkey % 30 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN 39 ELSE 2 END AS BIGINT) AS detected,
    CAST(CASE WHEN o_orderkey % 30 = 0 THEN 0 ELSE 1 END AS BIGINT) AS interpolated, CASE WHEN o_orderkey % 30 = 0 THEN 1 ELSE (CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END) + (CASE WHEN o_custkey % 3 = 1 THEN 1 ELSE 0 END) END AS warnings FROM orders""")
def normalize_skeleton(spark, sf):
    d = ct.normalize_skeleton(_raw(spark, sf, RAW_SKEL))
    return d.select("doc_id", "subject", "viewpoint", "fps", "confidence", "confidence_of", "total", "detected", "interpolated", F.size("warnings").alias("warnings"))


# ---------------------------------------------------------------- swatches: a good one of each kind, then one thing broken

BREAKS = {  # kind, case -> rules that must fire
    ("texture", 1): "version is not 1", ("texture", 2): "applicator does not fit the kind", ("texture", 3): "applicator outside the list", ("texture", 4): "fps outside 0 to 240",
    ("texture", 5): "confidence outside 0 to 1", ("texture", 6): "confidence without meaning", ("texture", 7): "dial without number: driftY", ("texture", 8): "texture without common motion",
    ("texture", 9): "texture without tracks", ("texture", 10): "tracks of several lengths", ("texture", 11): "frames differ from the tracks' length", ("texture", 12): "path part out of place",
    ("texture", 13): "stride below 1", ("texture", 14): "class outside the list",
    ("skeleton", 1): "skeleton without pose", ("skeleton", 2): "pose without frames", ("skeleton", 3): "pose subject outside the list", ("skeleton", 4): "pose without joint names",
    ("path", 1): "path with fewer than 2 points", ("path", 2): "frames differ from the path's length", ("path", 3): "path without its object's label", ("path", 4): "path without summary",
    ("path", 5): "texture part out of place: params", ("path", 6): "path point with other than three numbers", ("path", 7): "path part missing",
}


def _swatches(spark, sf):
    o = table(spark, sf, "orders")
    kinds = F.array(*[F.lit(k) for k in dims.SWATCH_KINDS])
    d = o.select(F.col("o_orderkey").alias("id"), F.get(kinds, F.pmod("o_custkey", F.lit(3))).alias("kind"), F.pmod("o_orderkey", F.lit(16)).alias("case"))
    case = lambda kind, n: (F.col("kind") == kind) & (F.col("case") == n)
    tex, ske, pth = (F.col("kind") == k for k in dims.SWATCH_KINDS)
    amp = F.pmod("id", F.lit(100)) / 100
    params = F.map_from_arrays(F.array(*[F.lit(p) for p in dims.PARAM_KEYS]), F.array(*[amp * (i + 1) / 8 for i in range(8)]))
    params = F.when(case("texture", 7), F.map_filter(params, lambda k, v: k != "driftY")).otherwise(params)
    point = F.array(F.lit(0.1), F.lit(0.2))
    track = F.array_repeat(point, 3)
    tracks = F.when(case("texture", 9), F.array().cast("array<array<array<double>>>")).when(case("texture", 10), F.array(track, F.array_repeat(point, 2))).otherwise(F.array(track, track))
    pose = F.struct(F.lit("skeleton").alias("kind"), F.when(case("skeleton", 3), "tail").otherwise("pose").alias("subject"),
                    F.when(case("skeleton", 2), F.array().cast("array<string>")).otherwise(F.array(F.lit("f"))).alias("frames"),
                    F.when(case("skeleton", 4), F.array().cast("array<string>")).otherwise(F.array(F.lit("nose"))).alias("joints"))
    pt = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    path = F.struct(F.when(case("path", 3), "").otherwise("boat").alias("label"), F.when(case("path", 1), F.array(pt)).when(case("path", 6), F.array(pt, point)).otherwise(F.array(pt, pt, pt)).alias("points"),
                    F.when(~case("path", 4), F.create_map(F.lit("dx"), F.lit(0.1))).alias("travel"))
    return d.select(
        "id", "case", F.when(case("texture", 1), 99).otherwise(1).alias("schema_version"), "kind", F.when(case("texture", 14), "wobble").otherwise("").alias("class"),
        F.when(case("texture", 2), "path_travel").when(case("texture", 3), "interpretive").otherwise(dims.lookup(F.col("kind"), dims.KIND_DEFAULT)).alias("applicator"), F.lit("e").alias("engine"),
        F.when(case("texture", 4), 0.0).otherwise(30.0).alias("fps"), F.when(case("texture", 11) | case("path", 2), 999).otherwise(3).cast("long").alias("frames"),
        F.when(case("texture", 5), 1.4).otherwise(amp).alias("confidence"), F.when(case("texture", 6), "").otherwise("x").alias("confidence_of"),
        F.when(tex | case("path", 5), params).alias("params"), F.when(tex & ~case("texture", 8), F.struct(F.lit(0.1).alias("dx"), F.lit(0.2).alias("dy"))).alias("bulk"), F.when(tex, tracks).alias("tracks"),
        F.when(case("texture", 13), 0).otherwise(1).alias("track_stride"), F.when(ske & ~case("skeleton", 1), pose).alias("pose"), F.when((pth & ~case("path", 7)) | case("texture", 12), path).alias("path"), F.array().cast("array<string>").alias("warnings"))


SW = "SELECT o_orderkey AS id, (['texture', 'skeleton', 'path'])[CAST(o_custkey % 3 + 1 AS INTEGER)] AS kind, o_orderkey % 16 AS cs FROM orders"


def _cases() -> str:
    rows = ", ".join("('{}', {}, '{}')".format(k, n, t.replace("'", "''")) for (k, n), t in BREAKS.items())
    return f"SELECT * FROM (VALUES {rows}) q(kind, cs, err)"


@query("validate_swatch", f"WITH s AS ({SW}), b AS ({_cases()}) SELECT id, s.kind, coalesce(err, '') AS errors, err IS NULL AS ok FROM s LEFT JOIN b ON b.kind = s.kind AND b.cs = s.cs")
def validate_swatch(spark, sf):
    d = ct.validate_swatch(_swatches(spark, sf))
    return d.select("id", "kind", F.array_join("errors", "; ").alias("errors"), "ok")


@query("normalize_swatch", f"""WITH s AS ({SW}) SELECT id, kind, CASE WHEN kind = 'texture' AND cs IN (3) THEN 'oscillate' WHEN kind = 'texture' THEN 'oscillate' WHEN kind = 'path' THEN 'path_travel' ELSE 'skeletal' END AS applicator,
    CASE WHEN kind = 'texture' AND cs = 4 THEN 15e0 ELSE 30e0 END AS fps, CASE WHEN kind = 'texture' AND cs = 5 THEN 1e0 ELSE round(id % 100 / 100e0, 3) END AS confidence, CASE WHEN kind = 'texture' AND cs = 6 THEN 'gated_motion_amplitude' ELSE 'x' END AS confidence_of,
    CASE WHEN kind = 'texture' THEN 8 ELSE 0 END AS dials, CASE WHEN kind = 'texture' AND cs IN (2, 3, 7, 14) THEN 1 ELSE 0 END AS warnings FROM s""")
def normalize_swatch(spark, sf):
    d = ct.normalize_swatch(_swatches(spark, sf))
    return d.select("id", "kind", "applicator", "fps", "confidence", "confidence_of", F.coalesce(F.size("params"), F.lit(0)).alias("dials"), F.size("warnings").alias("warnings"))


@query("swatch_applicator", """SELECT o_orderkey AS id, CASE WHEN kind NOT IN ('texture', 'skeleton', 'path') THEN '' WHEN kind = 'texture' THEN CASE cls WHEN 'cloth' THEN 'wave' WHEN 'fluid' THEN 'flow_field' WHEN 'flock' THEN 'flock_drift' ELSE 'oscillate' END
    WHEN kind = 'skeleton' THEN 'skeletal' ELSE 'path_travel' END AS applicator FROM (SELECT o_orderkey, (['texture', 'skeleton', 'path', 'vibes'])[CAST(o_orderkey % 4 + 1 AS INTEGER)] AS kind,
    (['articulated', 'cloth', 'fluid', 'flock', 'rigid_path', 'oscillation', ''])[CAST(o_custkey % 7 + 1 AS INTEGER)] AS cls FROM orders)""")
def swatch_applicator(spark, sf):
    pick = lambda vals, c, n: F.get(F.array(*[F.lit(v) for v in vals]), F.pmod(c, F.lit(n)))
    o = table(spark, sf, "orders").select("o_orderkey", pick(("texture", "skeleton", "path", "vibes"), "o_orderkey", 4).alias("k"), pick((*dims.MOTION_CLASSES, ""), "o_custkey", 7).alias("c"))
    return o.select(F.col("o_orderkey").alias("id"), ct.swatch_applicator(F.col("k"), F.col("c")).alias("applicator"))


THIN = {"tr": TRACKS, "strd": "SELECT clip, CAST(greatest(1, ceil((max(t) + 1) / 20e0)) AS BIGINT) AS stride FROM tr GROUP BY clip",
        "thin": "SELECT clip, gy, gx, t // stride AS i, stride, round(x, 3) + 0e0 AS x, round(y, 3) + 0e0 AS y, round(20e0 / stride, 3) AS fps FROM tr JOIN strd USING (clip) WHERE t % stride = 0"}


@query("thin_tracks", with_views("SELECT * FROM thin", ["v_cells"], THIN))
def thin_tracks(spark, sf):
    t = fl.grid_tracks(v_cells(spark, sf), v_clips(spark, sf)).withColumn("fps", F.lit(20.0))
    return ct.thin_tracks(t, cap=20, fps="fps").select("clip", "gy", "gx", "i", "stride", "x", "y", "fps")


# ---------------------------------------------------------------- verdicts

RAW_JUDGE = """CASE o_orderkey % 25 WHEN 0 THEN '"looks fine"' ELSE '{"verdict":"' || CASE o_orderkey % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'TUNE' WHEN 2 THEN 'wrong_class' WHEN 3 THEN 'meh' ELSE 'tune' END || '","score":' || CASE o_custkey % 4 WHEN 0 THEN '1.4' WHEN 1 THEN '"0.5"' WHEN 2 THEN '"x"' ELSE '0.' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') END
    || ',"axes":{"speed":0.2' || CASE o_orderkey % 3 WHEN 0 THEN ',"grace":0.5' ELSE '' END || '},"deltas":{' || CASE o_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '"amplitude":5.0' WHEN 2 THEN '"wobbliness":0.5,"amplitude":0.1' WHEN 3 THEN '"direction":-90,"frequency":0.3' WHEN 4 THEN '"driftY":0' ELSE '"damping":-0.1,"phaseSpread":"0.15"' END
    || '},"critique":"c' || CAST(o_custkey AS STRING) || '","observations":["a"," "]}' END"""
JUDGE = {"jr": "SELECT o_orderkey AS doc_id, o_custkey, o_orderkey % 25 <> 0 AS obj, CASE WHEN o_orderkey % 25 = 0 THEN 'tune' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'good' WHEN 2 THEN 'wrong_class' ELSE 'tune' END END AS verdict FROM orders",
         "jd": """SELECT *, CASE WHEN NOT obj THEN 0e0 ELSE CASE o_custkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 WHEN 2 THEN 0e0 ELSE (o_custkey % 1000) / 1000e0 END END AS score, obj AND verdict <> 'good' AS act, o_custkey % 6 AS d FROM jr""",
         "jn": """SELECT doc_id, verdict, score, CASE WHEN act AND d IN (1, 2) THEN CASE d WHEN 1 THEN 0.2e0 ELSE 0.1e0 END END AS d_amplitude, CASE WHEN act AND d = 3 THEN -45e0 END AS d_direction, CASE WHEN act AND d = 3 THEN 0.3e0 END AS d_frequency,
             CASE WHEN act AND d = 5 THEN -0.1e0 END AS d_damping, CASE WHEN act AND d = 5 THEN 0.15e0 END AS d_phase,
             CASE WHEN NOT obj THEN 1 ELSE (CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN d IN (1, 2, 3) THEN 1 ELSE 0 END) + (CASE WHEN verdict = 'tune' AND d IN (0, 4) THEN 1 ELSE 0 END) + (CASE WHEN verdict = 'good' AND d NOT IN (0, 4) THEN 1 ELSE 0 END) END AS warnings, obj, d FROM jd"""}


def _judged(spark, sf):
    return ct.normalize_judgement(_raw(spark, sf, RAW_JUDGE))


@query("judgement_facts", with_views("""SELECT doc_id, verdict, CASE WHEN doc_id % 3 = 1 THEN 'match_to_reference' ELSE 'class_plausibility' END AS score_of, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 7 END AS BIGINT) AS frames_judged FROM jn""", [], JUDGE))
def judgement_facts(spark, sf):
    i = F.col("doc_id")
    raw = _raw(spark, sf, RAW_JUDGE).withColumn("of", F.when(i % 3 == 1, "Match_To_Reference").when(i % 3 == 2, "vibes")).withColumn("shown", F.when(i % 4 == 0, "-3").otherwise((i % 7).cast("string")))
    return ct.normalize_judgement(raw, score_of="of", frames="shown").select("doc_id", "verdict", "score_of", "frames_judged")


@query("normalize_judgement", with_views("SELECT doc_id, verdict, score, d_amplitude, d_direction, d_frequency, d_damping, d_phase, warnings, CASE WHEN obj THEN 1 ELSE 0 END AS axes FROM jn", [], JUDGE))
def normalize_judgement(spark, sf):
    at = lambda k: F.try_element_at("deltas", F.lit(k))
    return _judged(spark, sf).select("doc_id", "verdict", "score", at("amplitude").alias("d_amplitude"), at("direction").alias("d_direction"), at("frequency").alias("d_frequency"),
                                     at("damping").alias("d_damping"), at("phaseSpread").alias("d_phase"), F.size("warnings").alias("warnings"), F.size("axes").alias("axes"))


@query("validate_judgement", with_views("""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'score without meaning' || CASE WHEN bare THEN '; ' ELSE '' END ELSE '' END || CASE WHEN bare THEN 'verdict tune without offsets' ELSE '' END AS errors FROM (
    SELECT *, verdict = 'tune' AND (NOT obj OR d IN (0, 4)) AS bare FROM jn)""", [], JUDGE))
def validate_judgement(spark, sf):
    d = _judged(spark, sf).withColumn("score_of", F.when(F.col("doc_id") % 4 == 1, "vibes").otherwise("class_plausibility")).withColumn("frames_judged", F.lit(8))
    return ct.validate_judgement(d).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query("apply_deltas", with_views("""SELECT doc_id, id, round(least(1e0, p_amp + coalesce(d_amplitude, 0e0)), 4) AS amplitude, round((p_dir + coalesce(d_direction, 0e0)) - 360 * floor((p_dir + coalesce(d_direction, 0e0)) / 360), 4) AS direction,
    round(least(6e0, p_freq + coalesce(d_frequency, 0e0)), 4) AS frequency, round(greatest(0e0, p_damp + coalesce(d_damping, 0e0)), 4) + 0e0 AS damping, CASE WHEN p_amp + coalesce(d_amplitude, 0e0) > 1 OR (d_damping IS NOT NULL AND p_damp + d_damping < 0) OR (d_phase IS NOT NULL AND p_ph + d_phase > 1) THEN 1 ELSE 0 END AS notes FROM jn
    JOIN (VALUES """ + ", ".join(f"({i}, '{p[0]}', {p[2]}e0, {p[3]}e0, {p[1]}e0, {p[5]}e0, {p[6]}e0)" for i, p in enumerate(dims.PRESETS)) + ") q(k, id, p_amp, p_dir, p_freq, p_damp, p_ph) ON k = doc_id % 9", [], JUDGE))
def apply_deltas(spark, sf):
    ids = F.array(*[F.lit(p[0]) for p in dims.PRESETS])
    j = _judged(spark, sf).select("doc_id", "deltas", F.get(ids, F.pmod("doc_id", F.lit(9))).alias("id"))
    p = dims.presets(spark).select("id", F.map_from_arrays(F.array(*[F.lit(k) for k in dims.PARAM_KEYS]), F.array(*[F.col(k) for k in dims.PARAM_KEYS])).alias("params"))
    d = ct.apply_deltas(j.join(F.broadcast(p), "id"))
    at = lambda k: fixed(F.try_element_at("next_params", F.lit(k)), 4).alias(k)
    return d.select("doc_id", "id", at("amplitude"), at("direction"), at("frequency"), at("damping"), F.size("notes").alias("notes"))


@query("judge_policy", with_views("""SELECT session, i, round(gain, 4) + 0e0 AS gain, reason IS NULL AS go, coalesce(reason, 'still gaining') AS reason FROM (SELECT *, CASE WHEN verdict = 'wrong_class' THEN 'other applicator needed' WHEN score >= 0.8e0 THEN 'score is high enough' WHEN verdict = 'good' THEN 'judged good'
    WHEN i + 1 >= 3 THEN 'no passes left' WHEN NOT has_deltas THEN 'nothing to change' WHEN gain < 0.03e0 THEN 'too little gain' END AS reason FROM (SELECT *, score - lag(score) OVER (PARTITION BY session ORDER BY i) AS gain FROM v_hist))""", ["v_hist"]))
def judge_policy(spark, sf):
    return ct.judge_policy(v_hist(spark, sf)).select("session", "i", fixed(F.col("gain"), 4).alias("gain"), "go", "reason")


@query("judge_best", with_views("SELECT session, i AS best, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, i) AS rn FROM v_hist) WHERE rn = 1", ["v_hist"]))
def judge_best(spark, sf):
    return ct.judge_best(v_hist(spark, sf)).select("session", "best", F.round("score", 4).alias("score"))


# ---------------------------------------------------------------- labels and matching

RAW_LABELS = """CASE o_orderkey % 30 WHEN 0 THEN 'oops' ELSE '{"labels":["cloth",{"id":"L1","label":"flag","motion_class":"' || CASE o_orderkey % 5 WHEN 0 THEN 'cloth' WHEN 1 THEN 'NULL' WHEN 2 THEN 'wobble' WHEN 3 THEN ' Fluid' ELSE 'static' END || '","confidence":' || CASE o_custkey % 3 WHEN 0 THEN '4.2' WHEN 1 THEN '"high"' ELSE '0.' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') END
    || '},{"id":"L9","motion_class":"cloth"},{"id":"L1","label":"second","motion_class":"fluid"},{"id":"L2","motion_class":"flock"}]}' END"""


def _labels(spark, sf):
    d = _raw(spark, sf, RAW_LABELS)
    layers = d.select("doc_id", F.explode(F.array(*[F.lit(x) for x in ("L1", "L2", "L4")])).alias("id"))
    return ct.normalize_layer_labels(d, layers)


@query("normalize_layer_labels", """SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, 'L1' AS id, 'flag' AS label, CASE o_orderkey % 5 WHEN 0 THEN 'cloth' WHEN 3 THEN 'fluid' ELSE '' END AS motion_class, CASE o_orderkey % 5 WHEN 0 THEN 'wave' WHEN 3 THEN 'flow_field' ELSE '' END AS applicator,
    CASE WHEN o_orderkey % 5 IN (0, 3) THEN 'mesh' ELSE 'rigid' END AS deforms, CASE o_custkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 ELSE (o_custkey % 100) / 100e0 END AS confidence FROM orders WHERE o_orderkey % 30 <> 0
    UNION ALL SELECT o_orderkey, 4, 'L2', '', 'flock', 'flock_drift', 'rigid', 0.5e0 FROM orders WHERE o_orderkey % 30 <> 0""")
def normalize_layer_labels(spark, sf):
    return _labels(spark, sf)[0].drop("notes")


@query("layer_label_notes", """SELECT o_orderkey AS doc_id, id, note FROM orders JOIN (VALUES ('', 'left out: label without fields', 0), ('L9', 'left out: no such layer', 0), ('L1', 'second label left out', 0), ('L4', 'has no label', 0), ('L1', 'no such motion class, taken as none', 2)) q(id, note, need) ON need = 0 OR o_orderkey % 5 = 2 WHERE o_orderkey % 30 <> 0
    UNION ALL SELECT o_orderkey, id, 'has no label' FROM orders CROSS JOIN (VALUES ('L1'), ('L2'), ('L4')) q(id) WHERE o_orderkey % 30 = 0""")
def layer_label_notes(spark, sf):
    return _labels(spark, sf)[1]


@query("known_ids", """SELECT 'known' AS what, count(*) AS n FROM lineitem WHERE l_orderkey % 5 > 0 UNION ALL SELECT 'unknown', count(*) FROM lineitem WHERE l_orderkey % 5 = 0 UNION ALL
    SELECT 'missing', count(*) FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def known_ids(spark, sf):
    labels = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    layers = table(spark, sf, "orders").filter("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("id"))
    parts = ct.known_ids(labels, layers, [])
    named = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n") for w, p in zip(("known", "unknown", "missing"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


MATCH = {"sw": "SELECT s_suppkey AS idx, s_nationkey AS class, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier",
         "lb": "SELECT *, row_number() OVER (PARTITION BY class ORDER BY confidence DESC, pos) AS rn FROM (SELECT c_custkey AS pos, c_custkey AS id, c_nationkey AS class, greatest(0e0, least(1e0, c_acctbal / 10000e0)) AS confidence FROM customer) WHERE confidence >= 0.35e0"}


def _match(spark, sf):
    sw = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").cast("string").alias("class"))
    lb = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("class"),
                                                                          F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000)).alias("confidence"))
    return mt.match_to_layers(sw, lb)


@query("match_to_layers", with_views("SELECT idx, CAST(class AS VARCHAR) AS class, id, round(confidence, 4) AS confidence FROM sw JOIN lb USING (class, rn)", [], MATCH))
def match_to_layers(spark, sf):
    return _match(spark, sf)[0].withColumn("confidence", F.round("confidence", 4))


@query("match_unmatched", with_views("SELECT idx, CAST(class AS VARCHAR) AS class FROM sw WHERE idx NOT IN (SELECT idx FROM sw JOIN lb USING (class, rn))", [], MATCH))
def match_unmatched(spark, sf):
    return _match(spark, sf)[1]


TRUTH = "SELECT clip, 1.0e0 + clip AS tf, 20 * clip AS td FROM v_clips"
CHECKS = {**dial_steps(), "tru": TRUTH, "chk": """SELECT clip, 'frequency' AS "check", abs(frequency - tf) / tf < 0.1e0 AS passed FROM dials JOIN tru USING (clip) UNION ALL
    SELECT clip, 'direction', abs(((direction - td + 90) - 180 * floor((direction - td + 90) / 180)) - 90) <= 8 FROM dials JOIN tru USING (clip) UNION ALL
    SELECT clip, 'phaseSpread high', "phaseSpread" > 0.5e0 FROM dials WHERE clip % 2 = 0 UNION ALL SELECT clip, 'phaseSpread low', "phaseSpread" < 0.25e0 FROM dials WHERE clip % 2 = 1 UNION ALL
    SELECT clip, 'turbulence high', turbulence > 0.5e0 FROM dials UNION ALL SELECT clip, 'amplitude zero', amplitude < 0.05e0 FROM dials WHERE clip = 3"""}


def _scored(spark, sf):
    dials = fl.distill(v_cells(spark, sf), v_clips(spark, sf))
    truth = v_clips(spark, sf).select("clip", (F.col("clip") + 1.0).alias("frequency"), (F.col("clip") * 20).alias("direction"), F.when(F.col("clip") % 2 == 0, "high").otherwise("low").alias("phase_spread"),
                                      F.lit("high").alias("turbulence"), F.when(F.col("clip") == 3, "zero").alias("amplitude"))
    return mt.score(dials, truth, ["clip"])


@query("truth_score", with_views("SELECT * FROM chk", ["v_cells", "v_clips"], CHECKS))
def truth_score(spark, sf):
    return _scored(spark, sf)


@query("quality_report", with_views("SELECT clip, count(*) FILTER (WHERE passed) AS passed, count(*) AS total FROM chk GROUP BY ROLLUP (clip)", ["v_cells", "v_clips"], CHECKS))
def quality_report(spark, sf):
    return mt.quality_report(_scored(spark, sf), ["clip"])


@query("nearest", """SELECT idx, bid, round(d, 4) AS distance FROM (SELECT o_orderkey AS idx, p_partkey AS bid, sqrt((o_totalprice / 997 - p_retailprice) ** 2 + (o_custkey % 50 - p_size) ** 2) AS d, row_number() OVER (PARTITION BY o_orderkey ORDER BY (o_totalprice / 997 - p_retailprice) ** 2 + (o_custkey % 50 - p_size) ** 2, p_partkey) AS rn
    FROM orders JOIN part ON o_custkey % 4 = p_partkey % 4) WHERE rn = 1""")
def nearest(spark, sf):
    a = table(spark, sf, "orders").select((F.col("o_custkey") % 4).alias("g"), F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 997).alias("ax"), (F.col("o_custkey") % 50).cast("double").alias("ay"))
    b = table(spark, sf, "part").select((F.col("p_partkey") % 4).alias("g"), F.col("p_partkey").alias("bid"), F.col("p_retailprice").alias("bx"), F.col("p_size").cast("double").alias("by_"))
    return mt.nearest(a, b, ["g"], "idx", "bid").select("idx", "bid", F.round("distance", 4).alias("distance"))


# ---------------------------------------------------------------- names, media, layer trees

NAMES = "CASE p_partkey % 12 WHEN 0 THEN 'Left_Hand-2' WHEN 1 THEN 'RightLeg' WHEN 2 THEN 'Handle' WHEN 3 THEN 'Leg' WHEN 4 THEN 'Torso' WHEN 5 THEN 'l_forearm copy 3' WHEN 6 THEN 'R-Shoe.1' WHEN 7 THEN 'leftUpperArm' WHEN 8 THEN 'RIGHT_Knee' WHEN 9 THEN 'arm' ELSE p_name END"
PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-.]+', ' ', 'g')), '\b(copy|copie?s?)\b', ' ', 'g'), '\s+\d+\s*$', ' ', 'g'), '\s+', ' ', 'g'))"


@query("limb_role", f"""SELECT id, CASE WHEN NOT torso THEN part || '-' || side END AS role, CASE WHEN torso THEN 'torso-like name' WHEN part IS NOT NULL AND side IS NULL THEN 'no left or right' END AS skipped FROM (SELECT id, regexp_matches(n, '{nm.TORSO_WORDS}') AS torso,
    CASE WHEN regexp_matches(n, '{nm.ARM_WORDS}') THEN 'arm' WHEN regexp_matches(n, '{nm.LEG_WORDS}') THEN 'leg' END AS part, CASE WHEN regexp_matches(n, '{nm.LEFT_WORDS}') THEN 'l' WHEN regexp_matches(n, '{nm.RIGHT_WORDS}') THEN 'r' END AS side
    FROM (SELECT id, {PLAIN} AS n FROM (SELECT p_partkey AS id, {NAMES} AS name FROM part)))""")
def limb_role(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), nm.limb_role(F.expr(NAMES)).alias("r"))
    return p.select("id", "r.role", "r.skipped")


ESC = "CASE p_partkey % 4 WHEN 0 THEN p_name || '_x5F_' || p_brand WHEN 1 THEN '_x41__x42_' || p_name WHEN 2 THEN 'caf_xE9_ _x4e00_' || p_type ELSE p_name || '_x_' END"


@query("decode_escaped_name", """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || '_' || p_brand WHEN 1 THEN 'AB' || p_name WHEN 2 THEN 'café 一' || p_type ELSE p_name || '_x_' END AS name FROM part""")
def decode_escaped_name(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), nm.decode_escaped_name(F.expr(ESC)).alias("name"))


SNIFF = "CASE doc_id % 7 WHEN 0 THEN '/9j/' WHEN 1 THEN 'iVBORw0KGgo' WHEN 2 THEN 'R0lGODlh' ELSE '' END"


@query("decode_data_url", """SELECT doc_id, CASE WHEN doc_id % 5 <> 1 THEN CAST(strlen(text) AS BIGINT) END AS bytes, CASE WHEN doc_id % 5 <> 1 THEN md5(text) END AS digest FROM documents""")
def decode_data_url(spark, sf):
    b64 = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", "")
    sent = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("data:image/png;base64,"), b64)).when(F.col("doc_id") % 5 == 1, F.concat(b64, F.lit("*!"))).otherwise(F.concat(F.lit(" "), b64))
    d = table(spark, sf, "documents").select("doc_id", nm.decode_data_url(sent).alias("b"))
    return d.select("doc_id", F.octet_length("b").cast("long").alias("bytes"), F.md5("b").alias("digest"))


@query("sniff_media", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' END AS media FROM documents""")
def sniff_media(spark, sf):
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("FFD8FF", "89504E470D0A1A0A", "47494638", "5249464600000000" + "57454250", "52494646000000005741564F", "")])
    d = table(spark, sf, "documents")
    return d.select("doc_id", nm.sniff_media(F.concat(F.get(heads, F.pmod("doc_id", F.lit(6))), F.encode("text", "UTF-8"))).alias("media"))


LAYERS = {"lay": """SELECT DISTINCT l_suppkey AS art, 'root' AS id, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS pos, CASE WHEN l_suppkey % 2 = 0 THEN 'scene' ELSE '' END AS name, 1e0 AS w, 1e0 AS h FROM lineitem UNION ALL
    SELECT DISTINCT l_suppkey, 'g' || l_linenumber, 'root', CAST(l_linenumber AS BIGINT), CASE WHEN l_linenumber % 2 = 0 THEN 'group ' || l_linenumber ELSE '' END, CASE WHEN l_linenumber % 3 = 0 THEN 0.99e0 ELSE 0.5e0 END, 0.95e0 FROM lineitem UNION ALL
    SELECT l_suppkey, 'p' || l_linenumber || '-' || l_orderkey, 'g' || l_linenumber, min(l_orderkey) AS pos, 'leaf ' || l_orderkey, CASE WHEN l_orderkey % 9 = 0 THEN 0.99e0 ELSE 0.1e0 END, CASE WHEN l_orderkey % 9 = 0 THEN 0.98e0 ELSE 0.2e0 END FROM lineitem GROUP BY l_suppkey, l_linenumber, l_orderkey"""}


def _layers(spark, sf):
    li = table(spark, sf, "lineitem")
    art, no = F.col("l_suppkey").alias("art"), F.col("l_linenumber")
    s = lambda c: c.cast("string")
    root = li.select(art).distinct().select("art", F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("pos"), F.when(F.col("art") % 2 == 0, "scene").otherwise("").alias("name"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    groups = li.select(art, no.alias("n")).distinct().select("art", F.concat(F.lit("g"), s(F.col("n"))).alias("id"), F.lit("root").alias("parent"), F.col("n").cast("long").alias("pos"),
                                                            F.when(F.col("n") % 2 == 0, F.concat(F.lit("group "), s(F.col("n")))).otherwise("").alias("name"), F.when(F.col("n") % 3 == 0, 0.99).otherwise(0.5).alias("w"), F.lit(0.95).alias("h"))
    big = F.col("l_orderkey") % 9 == 0
    leaf = li.select(art, no.alias("n"), "l_orderkey").distinct().select(
        "art", F.concat(F.lit("p"), s(F.col("n")), F.lit("-"), s(F.col("l_orderkey"))).alias("id"), F.concat(F.lit("g"), s(F.col("n"))).alias("parent"), F.col("l_orderkey").alias("pos"), F.concat(F.lit("leaf "), s(F.col("l_orderkey"))).alias("name"),
        F.when(big, 0.99).otherwise(0.1).alias("w"), F.when(big, 0.98).otherwise(0.2).alias("h"))
    return root.unionByName(groups).unionByName(leaf)


@query("layer_cover", with_views("""SELECT art, 'L' || rank AS label_id, rank, id, name FROM (SELECT *, row_number() OVER (PARTITION BY art ORDER BY p1, p2) AS rank FROM (
    SELECT g.art, g.id, g.name, g.pos AS p1, CAST(-1 AS BIGINT) AS p2 FROM lay g WHERE parent = 'root' AND w * h <= 0.9e0 UNION ALL
    SELECT l.art, l.id, l.name, g.pos, l.pos FROM lay l JOIN lay g ON g.art = l.art AND g.id = l.parent WHERE g.parent = 'root' AND g.w * g.h > 0.9e0 AND l.w * l.h <= 0.9e0)) WHERE rank <= 12""", [], LAYERS))
def layer_cover(spark, sf):
    return mt.layer_cover(_layers(spark, sf))


@query("figure_of", with_views("""SELECT art, id, figure, tier FROM (SELECT art, id, figure, tier, row_number() OVER (PARTITION BY art, id ORDER BY tier, depth) AS rn FROM (
    SELECT u.art, u.id, u.figure, u.depth, CASE WHEN held > 1 AND named THEN 0 WHEN held > 1 THEN 1 WHEN named THEN 2 END AS tier FROM up u JOIN (SELECT art, figure, count(*) AS held FROM up GROUP BY art, figure) USING (art, figure)
    JOIN (SELECT art, id AS figure, name <> '' AS named FROM lay) USING (art, figure)) WHERE tier IS NOT NULL) WHERE rn = 1""", [], {**LAYERS,
    "lmb": "SELECT art, id, parent FROM lay WHERE id LIKE 'p%'", "up": "SELECT art, id, parent AS figure, 1 AS depth FROM lmb UNION ALL SELECT art, id, 'root', 2 FROM lmb"}).replace("SELECT art, id, figure, tier FROM (SELECT art", "SELECT art, id, figure, CAST(tier AS BIGINT) AS tier FROM (SELECT art", 1))
def figure_of(spark, sf):
    lay = _layers(spark, sf)
    return mt.figure_of(lay.filter("id LIKE 'p%'"), lay)


@query("ancestors", with_views("""SELECT art, depth, count(*) AS n FROM (SELECT art, id, CAST(1 AS BIGINT) AS depth FROM lay WHERE parent IS NOT NULL UNION ALL SELECT art, id, 2 FROM lay WHERE id LIKE 'p%') GROUP BY art, depth""", [], LAYERS))
def ancestors(spark, sf):
    return mt.ancestors(_layers(spark, sf)).groupBy("art", "depth").agg(F.count(F.lit(1)).alias("n"))


ROLES = list(dims.LIMB_BONES)
ROLE = "(" + str(ROLES).replace('"', "'") + ")[CAST(l_partkey % 10 + 1 AS INTEGER)]"


@query("limb_chain", f"""WITH l AS (SELECT DISTINCT l_orderkey AS figure, {ROLE} AS role FROM lineitem), up AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{p}')" for c, p in dims.LIMB_PARENT.items())}) q(role, parent)),
    chain AS (SELECT role, parent AS ancestor, CAST(1 AS BIGINT) AS depth FROM up UNION ALL SELECT a.role, b.parent, 2 FROM up a JOIN up b ON b.role = a.parent)
    SELECT l.figure, l.role, ancestor, depth FROM l JOIN chain USING (role) JOIN l o ON o.figure = l.figure AND o.role = ancestor""")
def limb_chain(spark, sf):
    roles = F.array(*[F.lit(x) for x in ROLES])
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("figure"), F.get(roles, F.pmod("l_partkey", F.lit(10))).alias("role")).distinct()
    return mt.limb_chain(l)


@query("reason_list", """SELECT g, n, names || CASE WHEN n > 8 THEN '…' ELSE '' END AS missing FROM (SELECT o_custkey AS g, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) FILTER (WHERE rn <= 8) AS names FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY o_custkey)""")
def reason_list(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"))
    n = o.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    first = se.top_k(o, ["g"], [F.col("id")], 8).groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ", ").alias("names"))
    return n.join(first, "g").select("g", "n", F.concat("names", F.when(F.col("n") > 8, "…").otherwise("")).alias("missing"))
