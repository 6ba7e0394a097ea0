"""Sources and sinks of repository tables.

Parquet is the canonical form. Folders of working trees, containers and the
search listing are read into the same tables; results are written partitioned,
upserted by version, or exported.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from quern import dims
from quern.functions import text
from quern.operators import labels, languages

FILES = "repo_name string, file_path string, extension string, size bigint, content string, content_type string"
REPO_FILES = ["repo_name", "file_path", "extension", "size", "content", "content_type"]


def _opened(path: str):
    """(file system, path in it) of a path or URI; any that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def empty_files(spark: SparkSession, base: str) -> DataFrame:
    """repo_name, file_path of the files of length 0, which Spark's own listing leaves out. Each repository's folder is listed by a task."""

    def walk(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        for b in batches:
            system, root = _opened(base.rstrip("/"))
            rows = [(r, f.path[len(f"{root}/{r}/") :]) for r in b["repo_name"] for f in system.get_file_info(fs.FileSelector(f"{root}/{r}", recursive=True)) if f.is_file and f.size == 0]
            yield pd.DataFrame(rows, columns=["repo_name", "file_path"])

    from pyarrow import fs

    system, root = _opened(base.rstrip("/"))
    repos = [(x.base_name,) for x in system.get_file_info(fs.FileSelector(root)) if not x.is_file]
    return spark.createDataFrame(repos, "repo_name string").mapInPandas(walk, "repo_name string, file_path string")


def working_trees(spark: SparkSession, base: str, only_code: bool = False) -> DataFrame:
    """``files`` of ``<base>/<repo>/...`` folders, empty ones among them, classified by suffix and content.

    Bytes that are no UTF-8 are replaced. With ``only_code``, files of the
    working-tree suffixes and bare names as Dockerfile.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    inside = F.regexp_replace("path", r"^.*?/\Q" + base.rstrip("/").split("/")[-1].replace("\\E", "\\E\\\\E\\Q") + r"\E/", "")
    f = raw.select(F.substring_index(inside, "/", 1).alias("repo_name"), F.regexp_replace(inside, "^[^/]*/", "").alias("file_path"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    f = f.unionByName(empty_files(spark, base).select("repo_name", "file_path", F.lit(0).cast("bigint").alias("size"), F.lit("").alias("content")))
    f = f.where(~F.concat(F.lit("/"), "file_path").contains("/.git/"))
    if only_code:
        f = f.where(text.suffix("file_path").isin(dims.WORKING_TREE) | text.basename("file_path").isin("dockerfile", "makefile", "cmakelists.txt", "license", "readme"))
    kind, stored = languages.classified()
    return f.select("repo_name", "file_path", F.nullif(text.suffix("file_path"), F.lit("")).alias("extension"), "size", stored.alias("content"), kind.alias("content_type"))


def container_paths(spark: SparkSession, base: str, pattern: str = "*.h5") -> DataFrame:
    """group_name, repo_name, path: the first container (by name) of each ``<base>/<group>/<repo>/``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(base).select("path")
    parts = F.split("path", "/")
    return found.groupBy(F.element_at(parts, -3).alias("group_name"), F.element_at(parts, -2).alias("repo_name")).agg(F.min("path").alias("path"))


def without_container(spark: SparkSession, base: str, pattern: str = ".h5") -> DataFrame:
    """group_name, repo_name of the folders ``<base>/<group>/<repo>/`` that hold files but no container. Only names are listed."""
    parts = F.split("path", "/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    return found.groupBy(F.element_at(parts, -3).alias("group_name"), F.element_at(parts, -2).alias("repo_name")).agg(F.count_if(F.endswith("path", F.lit(pattern))).alias("n")).where("n = 0").drop("n")


def _containers(paths: DataFrame, rows_of, columns: list[str], schema: str) -> DataFrame:
    """Rows of each container, wherever it lies; one that can't be read has none. Needs h5py on the executors."""

    def read(batches: Iterator) -> Iterator:
        import h5py
        import pandas as pd

        for b in batches:
            for repo, path in zip(b["repo_name"], b["path"]):
                try:
                    system, at = _opened(path)
                    with system.open_input_file(at) as raw, h5py.File(raw, "r") as h:
                        rows = list(rows_of(repo, h))
                except (OSError, KeyError, ValueError):
                    continue
                yield pd.DataFrame(rows, columns=columns)

    return paths.select("repo_name", "path").mapInPandas(read, schema)


def _text(group, name: str) -> str | None:
    return group[name][()].decode("utf-8", "ignore") if name in group else None


def container_files(paths: DataFrame, only_code: bool = False) -> DataFrame:
    """``files`` of HDF5 containers; with ``only_code``, text files with a code suffix."""

    def rows_of(repo, h):
        for g in h["codebase/files"].values():
            yield repo, _text(g, "path"), _text(g, "extension"), int(g["size"][()]), _text(g, "content"), _text(g, "content_type")

    f = _containers(paths, rows_of, REPO_FILES, FILES)
    return f.where((F.col("content_type") == "text") & text.suffix("file_path").isin(dims.CODE)) if only_code else f


def container_documents(paths: DataFrame) -> DataFrame:
    """repo_name, repo_info and commits_data (JSON texts) of HDF5 containers, without their files."""

    def rows_of(repo, h):
        yield repo, _text(h["metadata"], "repo_info") if "metadata" in h else None, _text(h["commits"], "commits_data") if "commits" in h else None

    return _containers(paths, rows_of, ["repo_name", "repo_info", "commits_data"], "repo_name string, repo_info string, commits_data string")


def language_subset(files: DataFrame, repos: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the repositories whose language is wanted."""
    keep = languages.repo_languages(repos, files).where(F.col("language").isin(wanted)).select("repo_name")
    return files.join(keep, "repo_name", "left_semi")


def write_subset(files: DataFrame, repos: DataFrame, wanted: list[str], path: str) -> None:
    """Writes ``language_subset`` by repository; repositories that are there already are left as they are, so it can be run again."""
    spark, chosen = files.sparkSession, language_subset(files, repos, wanted)
    try:
        there = spark.read.parquet(path).select("repo_name").distinct()
        chosen = chosen.join(there, "repo_name", "left_anti")
    except AnalysisException:  # nothing written yet
        pass
    chosen.write.mode("append").partitionBy("repo_name").parquet(path)


def write_metadata(repos: DataFrame, path: str) -> None:
    """Typed columns by group; a member that is no column goes into ``repo_info`` as JSON."""
    typed = ["repo_name", "group_name", "created_at", "repo_info", "language", "stars", "forks", "size", "repo_created_at", "repo_updated_at"]
    more = [c for c in repos.columns if c not in typed]
    df = repos.withColumn("repo_info", F.coalesce("repo_info", F.to_json(F.struct(*more)))) if more and "repo_info" in repos.columns else repos
    write_repositories(df.select(*[c for c in typed if c in df.columns]), path)


def write_commits(commits: DataFrame, path: str) -> None:
    """A row for each commit by group, its members as one JSON object (commit_data); a repository's list is never held by one row."""
    members = [c for c in commits.columns if c not in ("repo_name", "group_name")]
    write_repositories(commits.select("group_name", "repo_name", "sha", F.to_json(F.struct(*members)).alias("commit_data")).sortWithinPartitions("repo_name", "sha"), path)


def log_lines(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Lines of log files that name a repository."""
    return spark.read.text(path).where(F.contains("value", F.lit(repo)))


def write_repositories(df: DataFrame, path: str) -> None:
    """Partitioned by group; a run replaces the groups it holds and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group_name").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], version: str) -> None:
    """Publishes those of ``rows`` that are later than the table's row of their key, as a new version of the table (see incremental.Target). ``written_at`` says when."""
    from quern.operators.incremental import Target

    t = Target(spark, path)
    columns = [c for c in rows.columns if c not in (*key, version)]
    latest = labels.latest(rows, key, version, columns).withColumns({"source_key": F.to_json(F.struct(*key)), "source_version": F.col(version)})
    t.publish(t.newer(latest).withColumn("written_at", F.current_timestamp()))


class ListingPages(DataSource):
    """The paged listing of a search, sliced by date: JSON files ``page-<n>.json`` in ``<path>/<slice>/``.

    Batch: all pages. Stream: the offset is (slice, page); each batch reads
    the next page that exists, newest slice first, so a restart goes on where
    the last finished batch ended. Options: ``per_page`` - a page with fewer
    items ends its slice; ``horizon`` - slices before this date are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return "full_name string, page int, slice string, updated_at string"

    def reader(self, schema):
        return ListingReader(self.options)

    def simpleStreamReader(self, schema):
        return ListingStream(self.options)


def listing(options: dict) -> list[tuple[str, int]]:
    """(slice, page) of all pages: newest slice first, pages upwards."""
    from pyarrow import fs

    path, horizon, per_page = options["path"], options.get("horizon", ""), int(options.get("per_page", 0))
    system, root = _opened(path)
    slices = sorted((x.base_name for x in system.get_file_info(fs.FileSelector(root)) if not x.is_file and x.base_name >= horizon), reverse=True)
    out = []
    for s in slices:
        names = [x.base_name for x in system.get_file_info(fs.FileSelector(f"{root}/{s}"))]
        for n in sorted(int(f[5:-5]) for f in names if f.startswith("page-") and f.endswith(".json")):
            out.append((s, n))
            if per_page and len(page_rows(path, s, n)) < per_page:
                break
    return out


def page_rows(path: str, slice_: str, page: int) -> list[tuple]:
    system, root = _opened(path)
    with system.open_input_stream(f"{root}/{slice_}/page-{page}.json") as f:
        return [(x.get("full_name"), page, slice_, x.get("updated_at")) for x in json.loads(f.read()).get("items", [])]


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(x) for x in listing(self.options)]

    def read(self, partition):
        yield from page_rows(self.options["path"], *partition.value)


class ListingStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.path = dict(options), options["path"]

    def initialOffset(self) -> dict:
        return {"slice": "", "page": 0}

    def after(self, start: dict) -> list[tuple[str, int]]:
        pages = listing(self.options)
        return [x for x in pages if not start["slice"] or x[0] < start["slice"] or (x[0] == start["slice"] and x[1] > start["page"])]

    def read(self, start: dict):
        nxt = self.after(start)[:1]
        if not nxt:
            return iter([]), start
        s, n = nxt[0]
        return iter(page_rows(self.path, s, n)), {"slice": s, "page": n}

    def readBetweenOffsets(self, start: dict, end: dict):
        rows = []
        for s, n in self.after(start):
            if s < end["slice"] or (s == end["slice"] and n > end["page"]):
                break
            rows += page_rows(self.path, s, n)
        return iter(rows)
