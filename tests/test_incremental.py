from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.operators import incremental as inc


@pytest.mark.parametrize("given,name", [("A/b", "a/b"), (" a/b.git ", "a/b"), ("https://code.example/A/B/", "a/b"), ("a_b_c", "a/b_c"), ("a/b_c", "a/b_c"), ("a-x_b.c", "a-x/b.c"), ("a/b/.git", "a/b"), ("", None), ("   ", None), ("a", None), (None, None), ("_b", None)])
def test_names(spark, given, name):
    assert spark.createDataFrame([(given,)], "n string").select(inc.full_name("n")).first()[0] == name


def test_next_crawl(spark, tmp_path):
    t_ = lambda i: datetime(2024, 2, i)
    t = [datetime(2024, 1, i) for i in range(1, 9)]
    items = spark.createDataFrame([("a/new", t[0]), ("a/new", t[0]), ("A/old.git", t[3]), ("a/old", t[1]), ("a/same", t[2]), ("a/never", None), ("a/nover", None), ("a/failed", t[1]), (None, t[1])], "full_name string, updated_at timestamp").withColumn("key", F.lit(1))
    crawled = spark.createDataFrame([("a_old", t[2], t[4]), ("a/same", t[2], t[4]), ("a/same", t[0], t[5]), ("a/nover", t[1], t[2]), ("a/failed", t[6], None), (None, t[1], t[1])], "repo_name string, source_updated_at timestamp, crawled_at timestamp")
    def target(rows, at):
        t = inc.Target(spark, f"file://{tmp_path}/{at}")
        t.publish(inc.finished(rows))
        return t

    t = target(crawled, "t")
    got = sorted(r[0] for r in inc.next_crawl(items, t).collect())
    assert got == ["a/failed", "a/never", "a/new", "a/old"]
    assert inc.next_crawl(items, target(crawled.limit(0), "e")).count() == 6 and inc.next_crawl(items, inc.Target(spark, f"file://{tmp_path}/none")).count() == 6
    assert inc.next_crawl(items.limit(0), t).count() == 0
    # what is crawled is published and not taken again, until it changes
    t.publish(inc.next_crawl(items, t).select(F.col("full_name").alias("source_key"), F.col("version").alias("source_version")))
    assert inc.next_crawl(items, t).count() == 0
    later = items.union(spark.createDataFrame([("A/Old", t_(8), 1)], items.schema))
    assert [tuple(r) for r in inc.next_crawl(later, inc.Target(spark, f"file://{tmp_path}/t")).collect()] == [("a/old", t_(8))]


def test_target_survives_a_failure(spark, tmp_path):
    target = inc.Target(spark, f"file://{tmp_path}/t")
    source = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), (None, 1)], "k string, v int")
    done = lambda rows: rows.select(F.col("k").alias("source_key"), F.col("v").alias("source_version"), F.upper("k").alias("out"))
    assert target.read() is None
    target.publish(done(target.pending(source, "k", "v")))
    assert target.pending(source, "k", "v").count() == 0
    more = source.union(spark.createDataFrame([("b", 3), ("c", 1)], "k string, v int"))
    with pytest.raises(Exception):
        target.publish(done(target.pending(more, "k", "v")).withColumn("out", F.raise_error(F.lit("lost"))))
    assert target.read().count() == 2
    target.publish(done(target.pending(more, "k", "v")))
    assert sorted(map(tuple, target.read().select("source_key", "source_version").collect())) == [("a", 1), ("b", 3), ("c", 1)]


def test_failure_between_writing_and_publishing(spark, tmp_path, monkeypatch):
    target = inc.Target(spark, f"file://{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(x, "source_key string, source_version int")
    target.publish(rows(("a", 1)))

    def lost(self, *_):
        raise OSError("executor and driver are gone")

    with monkeypatch.context() as m:
        m.setattr(inc.Target, "_swap", lost)
        with pytest.raises(OSError):
            target.publish(rows(("b", 1)))
    again = inc.Target(spark, f"file://{tmp_path}/t")
    assert again.current() == 1 and again.read().count() == 1
    source = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert [tuple(r) for r in again.pending(source, "k", "v").collect()] == [("b", 1)]
    again.publish(rows(("b", 1)))
    again.vacuum(1)
    assert sorted(r.source_key for r in again.read().collect()) == ["a", "b"] and len(list((tmp_path / "t").glob("rows-*"))) == 2


def test_the_second_of_two_runs_loses_nothing_of_the_first(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "source_key string, source_version int")
    one, two = (inc.Target(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.publish(rows(("a", 1)))
    with pytest.raises(inc.Conflict):
        two.publish(rows(("b", 1)))
    two.read()
    two.publish(rows(("b", 1), (None, 2)))
    assert sorted(map(str, (r.source_key for r in one.read().collect()))) == ["None", "a", "b"] and one.read(1).count() == 1


def test_many_versions_become_one_folder(spark, tmp_path):
    t = inc.Target(spark, f"file://{tmp_path}/t", most_folders=3)
    for i in range(6):
        t.publish(spark.createDataFrame([(f"k{i % 2}", i, "x")], "source_key string, source_version int, out string"))
    assert t.current() == 6 and len(t.folders(6)) < 4
    assert {(r.source_key, r.source_version) for r in t.read().collect()} == {("k0", 4), ("k1", 5)}
    new = spark.createDataFrame([("k0", 3, "z"), ("k1", 5, "y"), ("k2", 0, "x"), (None, 0, "x")], "source_key string, source_version int, out string")
    assert {(r.source_key, r.out) for r in t.newer(new).collect()} == {("k1", "y"), ("k2", "x"), (None, "x")}
