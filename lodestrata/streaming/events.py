"""Streams of events: an extension beyond batch operators.  The same transformations run on a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs times with a zone; a static table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts",
        late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values per type and window; later than `late` is dropped in a stream."""
    source = _marked(events, late)
    return source.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias(
        "total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no more than a gap apart."""
    source = _marked(events, late)
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def newest_request(requests: DataFrame, by: str, at: str, unique: str) -> DataFrame:
    """The request of each project that counts: the newest; earlier ones are superseded."""
    return requests.groupBy(by).agg(F.max_by(unique, F.struct(at, unique)).alias("newest"), (F.count("*") - 1).alias(
        "superseded"))
