"""Continuous queries over a stream of placed frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, value double"
FRAME = "event_id long, ts timestamp_ntz, x0 int, y0 int, x1 int, y1 int, value double"


def frames(events: DataFrame) -> DataFrame:
    """Frames from events, static or streaming: the box follows from the user."""
    x, y = (F.col("user_id") * 37) % 1009, (F.col("user_id") * 91) % 997
    return events.select("event_id", "ts", x.cast("int").alias("x0"), y.cast("int").alias("y0"), (x + 9).cast("int").alias("x1"), (y + 9).cast("int").alias("y1"), "value")


def within(stream: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """What a registered box sees: a stateless filter, so it needs no watermark and no state store."""
    return stream.filter((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))


def register(spark: SparkSession, folder: str, box: tuple[int, int, int, int], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands every new batch of frames from a folder of Parquet files that meet the box to `sink`."""
    seen = within(spark.readStream.schema(FRAME).parquet(folder), *box)
    writer = seen.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key of an append-only table."""
    other = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*other), "version").alias("v")).select(*keys, "v.*")


def replay(spark: SparkSession, path: str, schema: str, box: tuple[int, int, int, int], out: str, checkpoint: str) -> DataFrame:
    """Runs a registered box over all events that a folder, or a single file, holds now, and gives what it saw. The stream
    appends to a table, and its checkpoint keeps it from seeing a file twice, also after a failure."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    source = spark.readStream.schema(schema)
    events = source.parquet(path) if whole else source.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    seen = within(frames(events), *box)
    query = seen.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(seen.schema).parquet(out)


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events and the sum of their values by hour, static or streaming; a stream waits for late events so long."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    by_hour = stamped.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("frames"), F.sum("value").alias("total"))
    return by_hour.select(F.col("w.start").alias("hour"), "frames", "total")
