from datetime import datetime

from pyspark.sql import functions as F

from quern.operators import topn

S = "repo_name string, file_path string, normalized_score double, analysis_date timestamp"


def test_latest_ties_nulls(spark):
    d = [datetime(2024, 1, i) for i in range(1, 6)]
    rows = [("a", "x", 9.0, d[0]), ("a", "x", 1.0, d[1]), ("a", "y", 1.0, d[1]), ("a", "y", 1.0, d[1]), ("a", "B", 1.0, None), ("a", None, 1.0, d[0]), ("a", "z", None, d[3]), ("a", "z", 5.0, d[0]), ("a", "w", float("nan"), d[0]), (None, "q", 4.0, d[0]), ("b", "é", 2.0, d[0])]
    df = spark.createDataFrame(rows, S).withColumn("rank", F.lit("clash"))
    for heavy in (1, 100):
        got = [tuple(r) for r in topn.top_files(df, 3, heavy).orderBy("repo_name", "rank").collect()]
        assert got == [("a", None, 1.0, 1), ("a", "B", 1.0, 2), ("a", "x", 1.0, 3), ("b", "é", 2.0, 1)]
    assert topn.top_files(df.limit(0)).count() == 0
    assert topn.top_files(df, 0).count() == 0


def test_hot_equals_cold(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.xxhash64("id") % 7).alias("s"), "id")
    order = [F.col("s").desc(), F.col("id").asc()]
    a = {tuple(r) for r in topn.top_n(df, "g", order, 20, 1000).collect()}
    b = {tuple(r) for r in topn.top_n(df, "g", order, 20, 10**9).collect()}
    assert a == b and len(a) == 51 * 20
    nulls = df.withColumn("g", F.when(F.col("g") != "hot", F.col("g")))
    a, b = ({tuple(r) for r in topn.top_n(nulls, "g", order, 20, heavy).collect()} for heavy in (1000, 10**9))
    assert a == b and len(a) == 51 * 20


def test_plan_limits_before_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = topn.ranked(df, ["g"], [F.col("id").desc()], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
