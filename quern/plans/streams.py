"""Streaming queries: run to the end of what is there, their results as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.plans import labelling
from quern.session import own_dir
from quern.streaming import jobs


def _run(df, mode="append"):
    spark = df.sparkSession
    base = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def stream_new_repositories(spark, d):
    return _run(jobs.new_repositories(jobs.table_stream(spark, d, "search_items").select("full_name")))


def stream_file_scores(spark, d):
    s = jobs.score_files(jobs.table_stream(spark, d, "files"))
    return _run(s).select("repo_name", "file_path", F.round("total_score", 4).alias("total_score"), "severity_level", "is_malicious").distinct()


def stream_status_table(spark, d):
    base = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = jobs.table_stream(spark, d, "events")
    m = F.create_map(*[F.lit(x) for kv in labelling.STATUS.items() for x in kv])
    log = e.select(F.concat(F.lit("repo"), F.col("user_id")).alias("repo_name"), m[F.col("event_type")].alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"), F.col("ts").alias("last_updated"))
    jobs.status_table(log, f"{base}/target", f"{base}/checkpoint").awaitTermination()
    from quern.operators.incremental import Target

    return Target(spark, f"{base}/target").read().select("repo_name", "status", "error_message")


def stream_status_windows(spark, d):
    """Hourly counts of status changes; the last window stays open, as the watermark hasn't passed it."""
    e = jobs.table_stream(spark, d, "events")
    m = F.create_map(*[F.lit(x) for kv in labelling.STATUS.items() for x in kv])
    log = e.select(F.concat(F.lit("repo"), F.col("user_id")).alias("repo_name"), m[F.col("event_type")].alias("status"), F.col("ts").alias("last_updated"))
    return _run(jobs.status_counts(log)).select("start", "end", "status", "changes")


QUERIES = {f.__name__: f for f in (stream_new_repositories, stream_file_scores, stream_status_table, stream_status_windows)}

from quern.plans.data_core import _full  # noqa: E402
from quern.plans import sql as S  # noqa: E402

SQL = {
    "stream_new_repositories": f"SELECT DISTINCT {_full('full_name')} AS full_name FROM search_items WHERE {_full('full_name')} LIKE '%/%'",
    "stream_file_scores": f"WITH {S.MATCHES}, {S.scores(S.rule_names('found'))} SELECT repo_name, file_path, round(total_score, 4) AS total_score, {S.LEVEL.format(s='normalized_score')} AS severity_level, normalized_score >= 40 OR len(critical) >= 2 AS is_malicious FROM scored",
    "stream_status_table": labelling.SQL["status_latest"],
    # windows that the watermark, ten minutes behind the last event, has passed
    "stream_status_windows": f"WITH {labelling._STATUS} SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", status, count(*) AS changes FROM log WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM log) GROUP BY ALL",
}
