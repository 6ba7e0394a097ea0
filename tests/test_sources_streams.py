import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.operators.incremental import Target
from quern.sources import tables
from quern.streaming import jobs


def test_working_trees(spark, tmp_path):
    base = tmp_path / "ba.s+e"
    for p, c in (("r/a.py", b"x = 1"), ("r/d/b.txt", b"a\x00b"), ("r/c.png", b"\x89PNG"), ("s/x.dat", b"a\x00"), ("s/.git/config", b"no"), ("s/Dockerfile", b"FROM x"), ("s/e.py", b"")):
        os.makedirs((base / p).parent, exist_ok=True)
        (base / p).write_bytes(c)
    got = {(r.repo_name, r.file_path): (r.extension, r.content_type, r.content, r.size) for r in tables.working_trees(spark, str(base)).collect()}
    assert got == {
        ("r", "a.py"): (".py", "text", "x = 1", 5), ("r", "d/b.txt"): (".txt", "text", "a<NULL>b", 3), ("r", "c.png"): (".png", "binary", "<binary file: .png format>", 4),
        ("s", "x.dat"): (".dat", "binary", "<binary file: unknown format .dat>", 2), ("s", "Dockerfile"): (None, "text", "FROM x", 6), ("s", "e.py"): (".py", "text", "", 0),
    }
    assert {r.file_path for r in tables.working_trees(spark, str(base), True).collect()} == {"a.py", "d/b.txt", "Dockerfile", "e.py"}


def test_container_paths(spark, tmp_path):
    for p in ("g/r/b.h5", "g/r/a.h5", "g/s/x.txt", "h/r/c.h5"):
        os.makedirs((tmp_path / p).parent, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = sorted((r.group_name, r.repo_name, r.path.rsplit("/", 1)[1]) for r in tables.container_paths(spark, str(tmp_path)).collect())
    assert got == [("g", "r", "a.h5"), ("h", "r", "c.h5")]
    assert [tuple(r) for r in tables.without_container(spark, str(tmp_path)).collect()] == [("g", "s")]


def test_container_files(spark, tmp_path):
    h5py = pytest.importorskip("h5py")
    with h5py.File(tmp_path / "a.h5", "w") as h:
        g = h.create_group("codebase/files/a_dot_py")
        for k, v in (("path", "a.py"), ("extension", ".py"), ("content", "x"), ("content_type", "text"), ("size", 1)):
            g[k] = v
    df = spark.createDataFrame([("r", str(tmp_path / "a.h5")), ("s", str(tmp_path / "none.h5"))], "repo_name string, path string")
    assert [tuple(r) for r in tables.container_files(df).collect()] == [("r", "a.py", ".py", 1, "x", "text")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, "g"), ("s", 2, "h")], "repo_name string, n int, group_name string")
    tables.write_repositories(df, f"{tmp_path}/w")
    tables.write_repositories(df.where("group_name = 'g'").withColumn("n", F.lit(9)), f"{tmp_path}/w")
    assert {(r.repo_name, r.n) for r in spark.read.parquet(f"{tmp_path}/w").collect()} == {("r", 9), ("s", 2)}
    tables.export_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/c").count() == 2
    up = lambda rows: tables.upsert(spark, f"file://{tmp_path}/u", spark.createDataFrame(rows, "k string, v int, x string"), ["k"], "v")
    up([("a", 1, "old"), ("b", 1, "b")])
    up([("a", 2, "new"), ("b", 0, "late")])
    assert {(r.k, r.x) for r in Target(spark, f"file://{tmp_path}/u").read().collect()} == {("a", "new"), ("b", "b")}


def test_subset_metadata_and_commit_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a", "x.py", "1"), ("b", "y.go", "2")], "repo_name string, file_path string, content string")
    repos = spark.createDataFrame([], "repo_name string, repo_info string")
    for text in ("1", "later"):  # a second run leaves what is there
        tables.write_subset(files.withColumn("content", F.lit(text)), repos, ["Python"], f"{tmp_path}/s")
    tables.write_subset(files, repos, ["Python", "Go"], f"{tmp_path}/s")
    assert {(r.repo_name, r.content) for r in spark.read.parquet(f"{tmp_path}/s").collect()} == {("a", "1"), ("b", "2")}
    meta = spark.createDataFrame([("a", "g", None, 7)], "repo_name string, group_name string, repo_info string, watchers int")
    tables.write_metadata(meta, f"{tmp_path}/m")
    assert json.loads(spark.read.parquet(f"{tmp_path}/m").first().repo_info) == {"watchers": 7}
    commits = spark.createDataFrame([("g", "a", "s2", "2024-01-02"), ("g", "a", "s1", "2024-01-01")], "group_name string, repo_name string, sha string, commit_date string")
    tables.write_commits(commits, f"{tmp_path}/c")
    assert {(r.repo_name, json.loads(r.commit_data)["commit_date"]) for r in spark.read.parquet(f"{tmp_path}/c").collect()} == {("a", "2024-01-02"), ("a", "2024-01-01")}


def test_listing_source_and_crawl(spark, tmp_path):
    def page(slice_, n, *items):
        os.makedirs(tmp_path / "l" / slice_, exist_ok=True)
        (tmp_path / "l" / slice_ / f"page-{n}.json").write_text(json.dumps({"items": [{"full_name": a, "updated_at": b} for a, b in items]}))

    page("2024-05-01", 1, ("A/x", "2024-05-02"), ("a/y", "2024-05-03"))
    page("2024-05-01", 2, ("a/x.git", "2024-05-09"))
    page("2024-04-01", 1, ("a/z", None))
    spark.dataSource.register(tables.ListingPages)
    assert spark.read.format("listing_pages").option("path", str(tmp_path / "l")).load().count() == 4
    some = lambda **o: sorted((r.slice, r.page) for r in spark.read.format("listing_pages").options(path=str(tmp_path / "l"), **o).load().select("slice", "page").distinct().collect())
    assert some(per_page=3) == [("2024-04-01", 1), ("2024-05-01", 1)] and some(per_page=2, horizon="2024-04-15") == [("2024-05-01", 1), ("2024-05-01", 2)]
    stream = lambda: spark.readStream.format("listing_pages").option("path", str(tmp_path / "l")).load()
    for _ in range(2):  # a second run adds nothing
        jobs.crawl(stream(), f"file://{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
        got = {(r.source_key, r.source_version) for r in Target(spark, f"file://{tmp_path}/t").read().collect()}
        assert {k for k, _ in got} <= {"a/x", "a/y", "a/z"} and ("a/y", "2024-05-03") in got
    page("2024-03-01", 1, ("a/w", "2024-03-03"))
    jobs.crawl(stream(), f"file://{tmp_path}/t", f"{tmp_path}/c").awaitTermination()


def test_status_windows_leave_late_rows_out(spark, tmp_path):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    schema = "repo_name string, status string, last_updated timestamp"
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "ok", t(1)), ("b", "ok", t(1, 30)), ("a", "failed", t(2))], schema).coalesce(1).write.mode("append").parquet(src)
    out = jobs.status_counts(spark.readStream.schema(schema).parquet(src))

    def run():
        out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/o").trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([("c", "ok", t(9))], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("d", "ok", t(1, 5))], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    got = {(r.start.hour, r.status): r.changes for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert got[(1, "ok")] == 2 and got[(2, "failed")] == 1
