"""Ending a finite stream: one last row moves the watermark past everything, so that what waits comes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Event time of the last row: far ahead, but inside the range that pandas keeps in nanoseconds.
END = "2250-01-01 00:00:00"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_end(stream: DataFrame, folder: str, ts: str = "ts") -> tuple[DataFrame, Callable[[], None]]:
    """`stream` together with a folder that is empty until the returned function writes the last row there.

    That row has nothing but an event time; its null key belongs to no group of the stream.
    """
    spark = stream.sparkSession
    shape = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    spark.createDataFrame([], shape).write.parquet(folder)
    tail = spark.readStream.schema(spark.createDataFrame([], shape).schema).parquet(folder)

    def end() -> None:
        last = [F.lit(END).cast(t).alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in stream.dtypes]
        spark.range(1).select(*last).write.mode("append").parquet(folder)

    return stream.unionByName(tail), end


def run_to_end(writer: Callable[[], DataStreamWriter], end: Callable[[], None]) -> None:
    """Run a query over everything available, then over its end. `writer` gives the query with its checkpoint, twice."""
    for step in (None, end):
        if step:
            step()
        writer().trigger(availableNow=True).start().awaitTermination()


def keyed_state(spark: SparkSession) -> None:
    """Keep state in RocksDB, where the session doesn't name a store: timers and lists need it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, ROCKS)
