"""Dials over tumbling windows of a flow stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.operators.flow import distill_sparse
from trackframe.session import shared_folder
from trackframe.streaming.closing import run_to_end, with_end

WINDOW, LATE = "4 seconds", "2 seconds"


def window_cells(stream: DataFrame, window: str = WINDOW, late: str = LATE) -> DataFrame:
    """Samples of each cell and window, emitted once the watermark has passed the window's end; later rows are dropped.

    A window holds a few seconds of one cell, so the array has a known largest size (rate x window).
    """
    w = stream.withWatermark("ts", late).groupBy("clip", F.window("ts", window).alias("w"), "gy", "gx")
    return w.agg(F.collect_list(F.struct("t", "vx", "vy", "valid")).alias("s")).select("clip", F.col("w.start").alias("start"), "gy", "gx", "s")


def distill_closed(batch: DataFrame, fps: float = 30.0) -> DataFrame:
    """Dials of closed windows; frames are renumbered from each window's first one."""
    rows = batch.select("clip", "start", "gy", "gx", F.explode("s").alias("s")).select("clip", "start", "gy", "gx", "s.*")
    first = rows.groupBy("clip", "start").agg(F.min("t").alias("_t0"))
    rows = rows.join(first, ["clip", "start"]).withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")
    clips = rows.select("clip", "start").distinct().withColumn("fps", F.lit(fps))
    return distill_sparse(rows, clips, by=("clip", "start"))


def distill_windows(stream: DataFrame, fps: float = 30.0, window: str = WINDOW, late: str = LATE) -> DataFrame:
    """Run a flow stream (clip, ts, t, gy, gx, vx, vy, valid) over everything available now and return the dials of
    every window, those open at its end too. Each micro-batch is written before the next starts; a batch retried
    after a failure replaces its own folder."""
    spark = stream.sparkSession
    root = shared_folder(spark, "windows")
    stream, end = with_end(stream, f"{root}/end")

    def write(batch: DataFrame, batch_id: int) -> None:
        distill_closed(batch, fps).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    cells = window_cells(stream, window, late)
    run_to_end(lambda: cells.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").foreachBatch(write), end)
    return spark.read.schema("clip bigint, start timestamp, frequency double, amplitude double, direction double, turbulence double, damping double, phaseSpread double").parquet(f"{root}/out/batch=*")
