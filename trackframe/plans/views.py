"""Views that cast the provided tables into the operators' input shapes.

Each view exists twice: here as a DataFrame, and in `VIEW_SQL` as the same definition in ANSI SQL
for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators.series import dense_index

# Fixed geometry of the cell view: a 5 x 5 grid on a 480 x 480 frame at 20 frames a second.
GRID, WIDTH, HEIGHT, FPS = 5, 480, 480, 20.0
# The 13 joints, in order.
JOINTS = ["nose", "l_sho", "r_sho", "l_elb", "r_elb", "l_wri", "r_wri",
          "l_hip", "r_hip", "l_knee", "r_knee", "l_ank", "r_ank"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_rows(df: DataFrame) -> DataFrame:
    """Narrow rows over all tasks: a file of a few MB is one split, however much each row makes work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("clip"), "vec_id", "embedding")
    return dense_index(e, ["clip"], ["vec_id"], F.col("vec_id"))


def v_cells(spark: SparkSession, sf: str) -> DataFrame:
    d = _vectors(spark, sf).select("clip", "t", "embedding", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"))
    gy, gx = F.floor(F.col("i") / 5), F.pmod(F.col("i"), F.lit(5)).cast("long")
    return d.select(
        "clip", "t", gy.alias("gy"), gx.alias("gx"),
        (F.get("embedding", F.col("i")).cast("double") * 8 + F.when(gy == 0, 3.0).otherwise(0.0)).alias("vx"),
        (F.get("embedding", F.col("i") + 25).cast("double") * 8 + F.when(gy == 1, 3.0).otherwise(0.0)).alias("vy"))


def v_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Dense flow on 8 x 8 pixels."""
    d = _vectors(spark, sf).select("clip", "t", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return d.select("clip", "t", F.floor(F.col("i") / 8).alias("y"), F.pmod(F.col("i"), F.lit(8)).cast("long").alias("x"),
                    (F.get("embedding", F.col("i")).cast("double") * 8).alias("vx"),
                    (F.get("embedding", F.pmod(F.col("i") * 7 + 3, F.lit(64))).cast("double") * 8).alias("vy"))


def v_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Normalized boxes, some running off the frame and some too small."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97 / 90.0 - 0.02).alias("bx"),
                    (F.col("o_custkey") % 89 / 89.0).alias("by"), (F.col("o_orderkey") % 83 / 83.0).alias("bw"),
                    (F.col("o_custkey") % 79 / 79.0).alias("bh"))


def v_clips(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("clip")).agg(F.count("vec_id").alias("frames"))
    return e.select("clip", "frames", F.lit(FPS).alias("fps"), F.lit(float(WIDTH)).alias("width"),
                    F.lit(float(HEIGHT)).alias("height"), F.lit(GRID).cast("long").alias("grid"))


def v_signal(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("clip"), F.posexplode("embedding").alias("t", "v")).select(
        "clip", F.col("t").cast("long"), F.lit(64).cast("long").alias("n"), F.col("v").cast("double"))


def v_pixels(spark: SparkSession, sf: str) -> DataFrame:
    s = v_signal(spark, sf)
    return s.filter(F.col("v") > 0.05).select(
        "clip", F.floor(F.col("t") / 8).alias("y"), F.pmod(F.col("t"), F.lit(8)).cast("long").alias("x"))


def v_pose_frames(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("clip", F.col("t").alias("frame"), (F.col("vec_id") % 7 != 0).alias("detected"))


def v_pose(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(j) for j in JOINTS])
    d = (_vectors(spark, sf).filter(F.col("vec_id") % 7 != 0)
         .select("clip", F.col("t").alias("frame"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("j")))

    def at(k: int):
        return F.get("embedding", F.col("j") * 4 + k).cast("double")

    return d.select("clip", "frame", F.get(names, F.col("j")).alias("joint"), at(0).alias("x"), at(1).alias("y"),
                    F.least(F.abs(at(2)) * 8, F.lit(1.0)).alias("vis"), at(3).alias("z"))


def _day(c: str):
    return F.datediff(F.to_date(c), F.lit("2024-01-01").cast("date")).cast("long")


def v_det(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.groupBy(F.col("user_id").alias("clip"), "event_type", _day("ts").alias("t")).agg(
        (F.avg("value") / 503).alias("cx"), (F.avg(k) / 101).alias("cy"),
        (F.count(F.lit(1)) * 0.05).alias("w"), (F.avg(k) / 203).alias("h")).select(
        "clip", F.col("event_type").alias("track_id"), "t", "cx", "cy", "w", "h", F.col("event_type").alias("label"))


def v_day(spark: SparkSession, sf: str) -> DataFrame:
    """One track per user: daily means over all event types."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.groupBy(F.col("user_id").alias("clip"), _day("ts").alias("t")).agg(
        (F.avg("value") / 503).alias("cx"), (F.avg(k) / 101).alias("cy"),
        (F.count(F.lit(1)) * 0.05).alias("w"), (F.avg(k) / 203).alias("h"))


def v_hist(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("session"), "ts", "event_id", "event_type",
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"))
    d = dense_index(e, ["session"], ["ts", "event_id"], F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) * 24 + F.hour("ts"), name="i", block=6)
    verdict = F.when(F.col("event_type") == "signup", "good").when(F.col("event_type") == "error", "wrong_class").otherwise("tune")
    return d.select("session", "i", "event_id", verdict.alias("verdict"), "score", (F.col("event_type") != "view").alias("has_deltas"))


def v_poly(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("clip"), "o_orderkey", "o_totalprice",
        F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("day"))
    d = dense_index(o, ["clip"], ["day", "o_orderkey"], F.col("day"), name="i", block=64)
    return d.select("clip", "i", F.col("day").cast("double").alias("x"), (F.col("o_totalprice") / 997).alias("y"))


# The same views in SQL.
VIEW_SQL = {
    "v_vec": """SELECT CAST(label AS BIGINT) AS clip, vec_id, embedding,
        CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS t FROM embeddings""",
    "v_cells": """SELECT clip, t, CAST(i // 5 AS BIGINT) AS gy, CAST(i % 5 AS BIGINT) AS gx,
        8e0 * CAST(embedding[i + 1] AS DOUBLE) + CASE WHEN i // 5 = 0 THEN 3e0 ELSE 0e0 END AS vx,
        8e0 * CAST(embedding[i + 26] AS DOUBLE) + CASE WHEN i // 5 = 1 THEN 3e0 ELSE 0e0 END AS vy
        FROM v_vec CROSS JOIN (SELECT unnest(range(0, 25)) AS i)""",
    "v_flow": """SELECT clip, t, CAST(i // 8 AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x, 8e0 * CAST(embedding[i + 1] AS DOUBLE) AS vx,
        8e0 * CAST(embedding[(i * 7 + 3) % 64 + 1] AS DOUBLE) AS vy FROM v_vec CROSS JOIN (SELECT unnest(range(0, 64)) AS i)""",
    "v_boxes": """SELECT o_orderkey AS id, (o_orderkey % 97) / 90e0 - 0.02e0 AS bx, (o_custkey % 89) / 89e0 AS by,
        (o_orderkey % 83) / 83e0 AS bw, (o_custkey % 79) / 79e0 AS bh FROM orders""",
    "v_clips": """SELECT CAST(label AS BIGINT) AS clip, count(*) AS frames, 20e0 AS fps, 480e0 AS width, 480e0 AS height,
        CAST(5 AS BIGINT) AS grid FROM embeddings GROUP BY 1""",
    "v_signal": """SELECT vec_id AS clip, CAST(i AS BIGINT) AS t, CAST(64 AS BIGINT) AS n, CAST(embedding[i + 1] AS DOUBLE) AS v
        FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS i)""",
    "v_pixels": """SELECT clip, t // 8 AS y, t % 8 AS x FROM v_signal WHERE v > 0.05e0""",
    "v_pose_frames": """SELECT clip, t AS frame, vec_id % 7 <> 0 AS detected FROM v_vec""",
    "v_pose": """SELECT clip, t AS frame, joint, CAST(embedding[j * 4 + 1] AS DOUBLE) AS x, CAST(embedding[j * 4 + 2] AS DOUBLE) AS y,
        least(1e0, 8e0 * abs(CAST(embedding[j * 4 + 3] AS DOUBLE))) AS vis, CAST(embedding[j * 4 + 4] AS DOUBLE) AS z
        FROM v_vec CROSS JOIN (VALUES """ + ", ".join(f"({i}, '{j}')" for i, j in enumerate(JOINTS)) + """) AS q(j, joint)
        WHERE vec_id % 7 <> 0""",
    "v_det": """SELECT user_id AS clip, event_type AS track_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t,
        avg(value) / 503e0 AS cx, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 101e0 AS cy, count(*) * 0.05e0 AS w,
        avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 203e0 AS h, event_type AS label
        FROM events GROUP BY 1, 2, 3""",
    "v_day": """SELECT user_id AS clip, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t,
        avg(value) / 503e0 AS cx, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 101e0 AS cy, count(*) * 0.05e0 AS w,
        avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 203e0 AS h
        FROM events GROUP BY 1, 2""",
    "v_hist": """SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, event_id,
        CASE event_type WHEN 'signup' THEN 'good' WHEN 'error' THEN 'wrong_class' ELSE 'tune' END AS verdict,
        least(1e0, value / 100e0) AS score, event_type <> 'view' AS has_deltas FROM events""",
    "v_poly": """SELECT o_custkey AS clip, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS BIGINT) AS i,
        CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, o_totalprice / 997e0 AS y FROM orders""",
}
# What each SQL view reads from the others.
VIEW_NEEDS = {"v_cells": ["v_vec"], "v_flow": ["v_vec"], "v_pixels": ["v_signal"], "v_pose_frames": ["v_vec"], "v_pose": ["v_vec"]}


def with_views(body: str, views: list[str], more: dict[str, str] | None = None) -> str:
    """WITH clause of the named views (and what they need), then extra named steps, then the query."""
    steps: dict[str, str] = {}

    def add(name: str) -> None:
        for need in VIEW_NEEDS.get(name, []):
            add(need)
        steps.setdefault(name, VIEW_SQL[name])

    for v in views:
        add(v)
    steps.update(more or {})
    listed = ",\n".join(f"{n} AS ({q})" for n, q in steps.items())
    return f"WITH {listed}\n{body}"
