"""Corpus lines as a stream: counts by reason that grow as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import new_path
from ..sources.lines import corpus_records


def line_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumnRenamed("value", "line")


def reason_counts(lines: DataFrame) -> DataFrame:
    """reason ("valid" for valid lines), n. The state has one row per reason."""
    return corpus_records(lines).groupBy(F.coalesce(F.split("reason", ":")[0], F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of events by window and type; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_once(counts: DataFrame, name: str) -> StreamingQuery:
    """Process what is there into a memory table, offsets kept in the shared folder."""
    spark = counts.sparkSession
    query = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", new_path(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
