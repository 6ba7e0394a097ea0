"""Incremental jobs with Structured Streaming; every one can be stopped and started again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import incremental, keywords, labels
from quern.operators.incremental import Target


def new_repositories(stream: DataFrame, name: str = "full_name") -> DataFrame:
    """Each repository of a listing once, in whatever spelling, over the whole life of the stream."""
    return stream.select(incremental.full_name(name).alias("full_name"), *[c for c in stream.columns if c != "full_name"]).where(F.col("full_name").isNotNull()).dropDuplicates(["full_name"])


def crawl(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Takes new or changed repositories out of each batch of listings and publishes them in the target table.

    The target is the state: a batch that is run again after a failure finds
    its rows there and adds nothing.
    """

    def batch(df: DataFrame, _: int) -> None:
        t = Target(df.sparkSession, target)
        rows = df.select(incremental.full_name("full_name").alias("k"), F.col("updated_at").alias("v"))
        fresh = t.pending(rows, "k", "v").select(F.col("k").alias("source_key"), F.col("v").alias("source_version"))
        if not fresh.isEmpty():
            t.publish(fresh)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_files(stream: DataFrame) -> DataFrame:
    """Scores of arriving files: a projection, so it needs no state."""
    f = keywords.features(stream)
    return keywords.file_scores(f).select("repo_name", "file_path", "total_score", "normalized_score", "severity_level", "is_malicious")


def status_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Changes of status in windows of event time; what comes later than ``late`` is left out by the watermark."""
    return events.withColumn("last_updated", F.col("last_updated").cast("timestamp")).withWatermark("last_updated", late).groupBy(F.window("last_updated", width).alias("window"), "status").agg(F.count("*").alias("changes"), F.approx_count_distinct("repo_name").alias("repos")).select("window.start", "window.end", "status", "changes", "repos")


def status_table(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The latest status of each repository, upserted batch by batch."""

    def batch(df: DataFrame, _: int) -> None:
        t = Target(df.sparkSession, target)
        new = labels.latest(df, ["repo_name"], "last_updated", ["status", "error_message"])
        rows = t.newer(new.withColumns({"source_key": F.col("repo_name"), "source_version": F.col("last_updated")}))
        if not rows.isEmpty():
            t.publish(rows)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's parquet files as a stream; further files of the folder are read as they come."""
    import os

    at = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(at).schema
    if os.path.isdir(at):
        return spark.readStream.schema(schema).parquet(at)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
