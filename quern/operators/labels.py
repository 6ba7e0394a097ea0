"""Labels: upserts, verdicts from scan reports and reviewers, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Sequence[str], version: str, columns: Sequence[str]) -> DataFrame:
    """One row for each key: that of the latest version, of equal ones the greatest row. Null versions are the oldest.

    An aggregation, so equal keys are combined before the shuffle.
    """
    return df.groupBy(*key).agg(F.max(F.struct(version, *columns)).alias("last")).select(*key, *[F.col(f"last.{c}").alias(c) for c in (version, *columns)])


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, one for each key (the least row)."""
    fresh = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("r")).select(key, "r.*") if len(new.columns) > 1 else new.distinct()
    return old.unionByName(fresh.join(old.select(key), key, "left_anti").select(*old.columns))


REPORT = "data STRUCT<attributes: STRUCT<stats: MAP<STRING, INT>, results: MAP<STRING, STRUCT<category: STRING, result: STRING>>, sha256: STRING, status: STRING>>"
MALICIOUS, TOGETHER = 3, 5


def parsed_report(report: str) -> list[Column]:
    """Counts, engines, verdict and detections of a scan report; an unreadable report gives zeros and no verdict."""
    a = F.from_json(report, REPORT)["data"]["attributes"]
    stats = F.coalesce(a["stats"], F.create_map().cast("map<string,int>"))
    count = lambda k: F.coalesce(F.try_element_at(stats, F.lit(k)), F.lit(0))
    found = F.filter(F.map_entries(F.coalesce(a["results"], F.create_map().cast("map<string,struct<category:string,result:string>>"))), lambda e: e["value"]["category"].isin("malicious", "suspicious"))
    names = F.array_sort(F.transform(found, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"]["result"], F.lit("Unknown")))))
    mal, sus = count("malicious"), count("suspicious")
    return [mal.alias("malicious"), sus.alias("suspicious"), count("harmless").alias("harmless"), count("undetected").alias("undetected"), F.aggregate(F.map_values(stats), F.lit(0), lambda x, y: x + y).alias("engines"), ((mal >= MALICIOUS) | (mal + sus >= TOGETHER)).alias("is_malicious"), F.array_join(names, "\n").alias("detections")]


def verdict(malicious: str, suspicious: str) -> Column:
    return (F.col(malicious) >= MALICIOUS) | (F.col(malicious) + F.col(suspicious) >= TOGETHER)


def parsed_reply(reply: Column) -> tuple[Column, Column]:
    """(score, reasoning) of a reviewer's reply: JSON, fenced or not; an unreadable reply scores 0 with its whole text."""
    bare = F.trim(F.replace(F.replace(F.trim(reply), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    v = F.try_parse_json(bare)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    score = F.when(is_object, F.coalesce(F.try_variant_get(v, "$.score", "double"), F.lit(0.0))).otherwise(0.0)
    reasoning = F.when(is_object, F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit(""))).otherwise(F.coalesce(reply, F.lit("Analysis failed")))
    return score, reasoning


def consensus(turns: DataFrame) -> DataFrame:
    """repo_name, rounds, agent1_score, agent2_score, consensus: the mean of the two agents' last scores."""
    score, _ = parsed_reply(F.col("reply"))
    t = turns.select("repo_name", "round", "agent", score.alias("score"))
    last = lambda n: F.coalesce(F.max_by("score", F.when(F.col("agent") == n, F.col("round"))), F.lit(0.0))
    return t.groupBy("repo_name").agg((F.max("round") + 1).alias("rounds"), last(1).alias("agent1_score"), last(2).alias("agent2_score")).withColumn("consensus", (F.col("agent1_score") + F.col("agent2_score")) / 2)


def repo_labels(labels: DataFrame) -> DataFrame:
    """Per repository the files' verdicts and their weighted mean: (10 malicious + 5 suspicious) / files."""
    l = labels.groupBy("repo_name").agg(F.count("*").alias("total_files"), F.count_if("is_malicious").alias("malicious_files"), F.count_if(~F.coalesce("is_malicious", F.lit(False)) & (F.col("vt_suspicious_count") > 0)).alias("suspicious_files"))
    l = l.withColumn("clean_files", F.col("total_files") - F.col("malicious_files") - F.col("suspicious_files"))
    return l.withColumn("file_level_score", (10.0 * F.col("malicious_files") + 5.0 * F.col("suspicious_files")) / F.greatest("total_files", F.lit(1)))


def shown(score: Column) -> Column:
    """Two decimals; N/A for null and for zero, as the report tool shows it."""
    return F.when(score.isNull() | (score == 0), "N/A").otherwise(F.format_string("%.2f", F.bround(score, 2)))
