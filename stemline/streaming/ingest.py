"""Scans as they arrive, and running tallies of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of a folder, each read once, as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def run_rounds(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """handle(batch, number) for all that has arrived, then stop; a restart goes on after the last batch that ended."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def class_counts(points: DataFrame) -> DataFrame:
    """Running counts per scan and class."""
    return points.groupBy("scan_id", "semantic_pred").agg(F.count(F.lit(1)).alias("n"))


def windowed_events(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time; what is later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def running_votes(votes: DataFrame) -> DataFrame:
    """Votes per point and class so far, from a stream of (scan_id, point_id, vote)."""
    return votes.groupBy("scan_id", "point_id", "vote").agg(F.count(F.lit(1)).alias("n"))


def best_scores(scored: DataFrame) -> DataFrame:
    """The best-scored mask of each point so far, the smaller id on a tie, from a stream of (scan_id, point_id, mask_id, score)."""
    return scored.groupBy("scan_id", "point_id").agg(F.max("score").alias("score"), F.max_by("mask_id", F.struct("score", -F.col("mask_id"))).alias("mask_id"))


def tailed_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(epoch, key, n, mean): running statistics of training logs, one JSON object a line, as their files arrive."""
    m = F.from_json("value", "map<string,string>")
    rows = spark.readStream.text(folder).withColumn("m", m).where(F.size("m") > 1)
    rows = rows.select(F.try_element_at("m", F.lit("epoch")).cast("int").alias("epoch"), F.explode("m").alias("key", "text"))
    rows = rows.select("epoch", "key", F.col("text").try_cast("double").alias("value")).where("value is not null and key <> 'epoch'")
    return rows.groupBy("epoch", "key").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def pending(incoming: DataFrame, written: DataFrame, key: str = "scan_id") -> DataFrame:
    """Rows of a batch whose output isn't there yet: what a restart, or a second delivery, has done before is left alone."""
    return incoming.join(written.select(key).distinct(), key, "left_anti")
