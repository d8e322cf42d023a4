"""Extensions over event streams: windowed counts with late data, and live budgets. The batch engine has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.sources.scratch import Workspace

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, event_type, n, total: tumbling windows; events later than `late` are out, older windows are closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain what is there, into a table in the shared folder. Mode complete drops no row as late and leaves no window out."""
    spark = stream.sparkSession
    work = Workspace(spark, "stream")
    if mode == "complete":  # each trigger gives the whole result; the last stays
        spark.createDataFrame([], stream.schema).write.parquet(f"{work.path}/out")
        keep = lambda df, _: df.write.mode("overwrite").parquet(f"{work.path}/out")
        stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{work.path}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{work.path}/out")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{work.path}/state").trigger(availableNow=True).start(f"{work.path}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work.path}/out")
