"""Registered queries that write tables as documents and read them back, with the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.plans.views import table, v_cells, v_flow, v_pose, with_views
from trackframe.session import shared_folder
from trackframe.sources import documents as dc

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def keep(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn
    return keep


@query("motion_documents", with_views("SELECT clip, frame, joint, x, y, vis, z FROM v_pose", ["v_pose"]))
def motion_documents(spark, sf):
    """Pose rows as motion files of 160 frames at most, read back as rows."""
    path = shared_folder(spark, "motions")
    dc.write_motion_json(dc.nest_pose(v_pose(spark, sf)), path)
    clip, first = dc.place_of()
    back = dc.pose_rows(dc.read_motion_json(spark, path, lines=True))
    return back.select(clip.alias("clip"), (first + F.col("frame")).alias("frame"), "joint", "x", "y", "vis", "z")


@query("swatch_documents", with_views("""SELECT clip, t // 160 AS part, dense_rank() OVER (PARTITION BY clip, t // 160 ORDER BY gy, gx) - 1 AS track,
    row_number() OVER (PARTITION BY clip, t // 160, gy, gx ORDER BY t) - 1 AS i, round(vx, 4) + 0e0 AS x, round(vy, 4) + 0e0 AS y, 1 AS track_stride FROM v_cells""", ["v_cells"]))
def swatch_documents(spark, sf):
    """Tracks nested into swatch documents, one a clip and part, written by clip and read back as rows."""
    path = shared_folder(spark, "swatches")
    cells = v_cells(spark, sf).select("clip", F.floor(F.col("t") / dc.PART).alias("part"), "gy", "gx", F.col("t").alias("i"), F.col("vx").alias("x"), F.col("vy").alias("y"), F.lit(1).alias("stride"))
    made = dc.nest_tracks(cells, ["clip", "part"]).withColumn("kind", F.lit("texture"))
    dc.export_swatches(made, path, ["kind"])
    back = dc.read_swatches(spark, path, "clip bigint, part bigint").select("clip", "part", "track_stride", F.posexplode("tracks").alias("track", "_t"))
    rows = back.select("clip", "part", "track_stride", F.col("track").cast("long"), F.posexplode("_t").alias("i", "_p"))
    return rows.select("clip", "part", "track", F.col("i").cast("long"), (F.round(F.col("_p")[0], 4) + 0.0).alias("x"), (F.round(F.col("_p")[1], 4) + 0.0).alias("y"), "track_stride")


@query("joints3d_rows", """SELECT vec_id AS clip, CAST(f AS BIGINT) AS frame, CAST(j AS INTEGER) AS j, CAST(embedding[2 * j + f + 1] AS DOUBLE) AS x, CAST(embedding[2 * j + f + 2] AS DOUBLE) AS y, CAST(NULL AS VARCHAR) AS reason
    FROM embeddings CROSS JOIN (SELECT unnest(range(0, 22)) AS j) CROSS JOIN (SELECT unnest(range(0, 3)) AS f) WHERE vec_id % 5 > 1
    UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, CASE vec_id % 5 WHEN 0 THEN 'expected (T, 22, 3), got (3, 21, 2)' ELSE 'expected (T, 22, 3), got (3, 22, 1)' END FROM embeddings WHERE vec_id % 5 < 2""")
def joints3d_rows(spark, sf):
    """Vectors cut into three frames of joints; clips with a joint or a coordinate too few are named, not read."""
    e = table(spark, sf, "embeddings")
    many = F.when(F.col("vec_id") % 5 == 0, 20).otherwise(21)
    wide = F.when(F.col("vec_id") % 5 == 1, 1).otherwise(2)
    point = lambda f: lambda j: F.slice(F.transform("embedding", lambda v: v.cast("double")), j * 2 + 1 + f, wide)
    frames = F.array(*[F.transform(F.sequence(F.lit(0), many), point(f)) for f in range(3)])
    rows, bad = dc.read_joints3d(e.select(F.col("vec_id").alias("clip"), frames.alias("joints")))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    return rows.select("clip", "frame", "j", "x", "y", none("string", "reason")).unionByName(bad.select("clip", none("bigint", "frame"), none("int", "j"), none("double", "x"), none("double", "y"), "reason"))


@query("extractor_hooks", with_views("SELECT clip, t, y, x, round(vx / 2, 5) + 0e0 AS vx, 'half' AS engine, 'probe error: no weights' AS other FROM v_flow", ["v_flow"]))
def extractor_hooks(spark, sf):
    """The flow table through the registered hook that is available; the registry says why the other is not."""
    def broken() -> tuple[bool, str]:
        raise RuntimeError("no weights")

    hooks = dc.Extractors()
    hooks.register("half", "flow", lambda: (True, ""), lambda: lambda df: df.withColumn("vx", F.col("vx") / 2), default=True)
    hooks.register("large", "flow", broken, lambda: lambda df: df)
    state = {r.name: r for r in hooks.report(spark).collect()}  # one row a hook
    name = next(n for n, r in state.items() if r.available)
    out = hooks.apply(name, "flow", v_flow(spark, sf))
    return out.select("clip", "t", "y", "x", (F.round("vx", 5) + 0.0).alias("vx"), F.lit(name).alias("engine"), F.lit(state["large"].reason).alias("other"))
