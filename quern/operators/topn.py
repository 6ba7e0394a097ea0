"""Top N rows of every group, however large a group is.

Hot-cold split: exact counts of the groups decide; which groups are heavy is
told to the rows by a bitmap of one size, however many there are. Rows of light groups go
through an ordinary window. Rows of heavy groups are range-sorted by (group,
order), each range keeps its own first N of every group (the range number is
the salt), and only those survivors meet in one window per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.bitmap import marked
from quern.session import durable, width


def latest_score(scores: DataFrame) -> DataFrame:
    """One row (repo_name, file_path, normalized_score) of each file: that of its latest analysis.

    A null date is older than any other. Of rows with equal latest dates the
    greatest score counts, a null score below all. Rows with a null repo_name
    belong to no repository and are left out; a null file_path is a path of
    its own.
    """
    one = F.max(F.struct("analysis_date", "normalized_score"))
    return (
        scores.where(F.col("repo_name").isNotNull())
        .groupBy("repo_name", "file_path")
        .agg(one.alias("last"))
        .select("repo_name", "file_path", F.col("last.normalized_score").alias("normalized_score"))
    )


def top_n(df: DataFrame, group: str, order: Sequence[Column], n: int, heavy_rows: int = 10_000) -> DataFrame:
    """The first ``n`` rows of every value of ``group`` by ``order``, with their ``rank`` from 1.

    ``order`` should be a total order, else rows equal in it come in any
    order. A null group is a group. ``n`` below 1 and an empty table give no
    rows. ``rank`` replaces a column of that name. Groups of more than
    ``heavy_rows`` rows take the salted path; the result doesn't depend on
    that, so a group that the bitmap takes for heavy by mistake is no fault.
    """
    df = df.drop("rank")
    if n < 1:
        return df.limit(0).withColumn("rank", F.lit(0))
    hot = durable(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy_rows))
    if hot.isEmpty():
        return ranked(df, [group], order, n)
    split = marked(df, hot, group, "_g", name="_hot")
    cold = ranked(split.where(~F.col("_hot")), [group], order, n)
    ranges = (
        split.where(F.col("_hot"))
        .repartitionByRange(width(df.sparkSession), F.col(group), *order)
        .withColumn("_range", F.spark_partition_id())
    )
    survivors = ranked(ranges, [group, "_range"], order, n).drop("rank", "_range")
    return cold.drop("_hot").unionByName(ranked(survivors, [group], order, n).drop("_hot"))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Window with a limit that Spark also applies before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_values(df: DataFrame, group: str, value: str, n: int, name: str = "first") -> DataFrame:
    """``group`` and an array of its least ``n`` different values, sorted; groups of nulls alone are left out. No group is collected beyond its first ``n``."""
    one = df.select(group, value).where(F.col(value).isNotNull()).distinct()
    return ranked(one, [group], [F.col(value).asc()], n).groupBy(group).agg(F.array_sort(F.collect_list(value)).alias(name))


def top_files(scores: DataFrame, n: int = 5, heavy_rows: int = 10_000) -> DataFrame:
    """The ``n`` highest-scoring files of every repository, ties by file_path (code points).

    Scores that are null or NaN are left out after the latest analysis was
    taken. A null path sorts first.
    """
    rows = latest_score(scores).where(F.col("normalized_score").isNotNull() & ~F.isnan("normalized_score"))
    return top_n(durable(rows), "repo_name", [F.col("normalized_score").desc(), F.col("file_path").asc()], n, heavy_rows)
