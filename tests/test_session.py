import os
from types import SimpleNamespace

from quern import session


def test_the_sessions_folder_is_read():
    stub = lambda value: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: value if k == "spark.checkpoint.dir" else d))
    assert session.shared_dir(stub("hdfs://a/b/")) == "hdfs://a/b"
    own = stub(None)
    assert session.shared_dir(own).startswith("file://") and session.shared_dir(own) == session.shared_dir(own)


def test_durable_and_clean(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    df = session.durable(spark.range(10))
    assert df.count() == 10 and all(str(tmp_path) in f for f in df.inputFiles())
    session.clean(spark)
    assert not os.path.exists(session.own_dir(spark).removeprefix("file://"))


def test_durable_keeps_the_schema_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b array<string>, c struct<d:double>")
    assert session.durable(df).schema.simpleString() == df.schema.simpleString() and session.durable(df).count() == 0


def test_spread_leaves_wide_tables_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    assert session.spread(spark.range(0, 100, 1, cores * 3)).rdd.getNumPartitions() == cores * 3
