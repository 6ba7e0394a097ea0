"""Only new or changed records: the target is the state.

Every output row stores the key and the version of the source record it was
made from. The next run takes the source records that no finished target row
covers (an anti-join), so a run that failed leaves nothing to undo: what it
did not publish is taken again, what it published is not. A version of a
target is published by one atomic move that fails if another run was first.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOST = "https://code.example/"


def full_name(name: Column | str) -> Column:
    """Lower-case ``owner/repo`` of a name in any spelling; null if it has no owner or no repository.

    Outer blanks, the host, a trailing slash or ``.git`` (in any order, any
    number of times) and case are taken off; the folder form ``owner_repo``
    splits at its first ``_``, as an owner never holds one.
    """
    n = F.lower(F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"^\s+|\s+$", ""))
    n = F.regexp_replace(n, "^" + HOST.replace(".", r"\."), "")
    n = F.regexp_replace(n, r"(\.git|/|\s)+$", "")
    n = F.regexp_replace(n, r"^/+", "")
    n = F.when(n.contains("/"), n).otherwise(F.regexp_replace(n, "^([^_]+)_", "$1/"))
    return F.when(n.rlike("^[^/]+/.+$"), n)


def versions(rows: DataFrame, key: Column, version: Column) -> DataFrame:
    """(key, version): the greatest version of each key; rows with a null key are left out."""
    return rows.select(key.alias("key"), version.alias("version")).where(F.col("key").isNotNull()).groupBy("key").agg(F.max("version").alias("version"))


def finished(crawled: DataFrame) -> DataFrame:
    """source_key and source_version of the repositories that were crawled to the end (crawled_at not null): the rows of the crawl's target."""
    return versions(crawled.where(F.col("crawled_at").isNotNull()), full_name("repo_name"), F.col("source_updated_at")).select(F.col("key").alias("source_key"), F.col("version").alias("source_version"))


def next_crawl(search_items: DataFrame, target: "Target") -> DataFrame:
    """full_name and version of the repositories the next crawl must take: those listed that the target lacks or has in an older version.

    The saved position isn't used: listings behind it may be undone. A null
    version is pending only if the target lacks the key; a target row whose
    version is null covers every version.
    """
    listed = versions(search_items, full_name("full_name"), F.col("updated_at"))
    return target.pending(listed, "key", "version").select(F.col("key").alias("full_name"), "version")


class Conflict(RuntimeError):
    """Another run has published since the version that this one read."""


class Target:
    """A table that is its own state: rows with source_key and source_version, in versions that are published atomically.

    A version is a manifest ``versions/<n>.json`` that names the folders of
    its rows. ``publish`` writes the new rows alone into a folder of their own
    and then moves the manifest of the next version into place, which fails
    if there is one already: of two runs that read one version the second
    gets a ``Conflict`` and loses nothing of the first. A failure before the
    move leaves the old version current and a folder that no version names.
    Of several rows of a key that of the latest version counts. After
    ``most_folders`` versions a publication rewrites the table as one folder;
    ``vacuum`` deletes what the latest versions don't need.
    """

    def __init__(self, spark: SparkSession, path: str, most_folders: int = 16):
        self.spark, self.path, self.most_folders = spark, path.rstrip("/"), most_folders
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self.base = self.current()

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int:
        """The number of the current version; 0 before the first."""
        return max(self._numbers(), default=0)

    def folders(self, version: int) -> list[str]:
        return [] if not version else json.loads(self.spark.read.text(f"{self.path}/versions/{version}.json").first()[0])["folders"]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the current one, which is then the base of the next publication. None before the first."""
        if version is None:
            version = self.base = self.current()
        folders = self.folders(version)
        if not folders:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/{f}").withColumn("__at", F.lit(i)) for i, f in enumerate(folders)]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if len(folders) == 1:
            return every.drop("__at")
        last = every.groupBy(F.col("source_key").alias("__key")).agg(F.max("__at").alias("__last"))
        return every.join(last, F.col("source_key").eqNullSafe(F.col("__key")) & (F.col("__at") == F.col("__last"))).drop("__at", "__key", "__last")

    def pending(self, source: DataFrame, key: str, version: str) -> DataFrame:
        """Rows of ``source`` (one for each key: its greatest version) that the target lacks or has in an older version."""
        last = source.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct(*source.columns), F.struct(version)).alias("row"))
        rows = last.select("row.*")
        old = self.read()
        if old is None:
            return rows
        t = old.select(F.col("source_key").alias("_k"), F.col("source_version").alias("_v"))
        return rows.join(t, (rows[key] == F.col("_k")) & (rows[version].isNull() | F.col("_v").isNull() | (rows[version] <= F.col("_v"))), "left_anti")

    def newer(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` (one for each source_key) that the target lacks or that are greater than its row, by source_version and then all other columns."""
        old = self.read()
        if old is None:
            return rows
        columns = ["source_version", *[c for c in rows.columns if not c.startswith("source_")]]
        t = old.select(F.col("source_key").alias("_k"), F.struct(*columns).alias("_r"))
        return rows.join(t, rows["source_key"].eqNullSafe(F.col("_k")) & (F.col("_r") >= F.struct(*[rows[c] for c in columns])), "left_anti")

    def publish(self, rows: DataFrame) -> int:
        """Adds ``rows`` (one for each source_key, with source_version) to the version last read; returns the new version."""
        folders, number, name = self.folders(self.base), self.base + 1, f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        folders.append(name)
        if len(folders) > self.most_folders:
            again = [self.spark.read.parquet(f"{self.path}/{name}")]
            old = self.read(self.base)
            kept = old.join(again[0].select(F.col("source_key").alias("_k")), F.col("source_key").eqNullSafe(F.col("_k")), "left_anti")
            whole = f"rows-{uuid.uuid4().hex}"
            kept.unionByName(again[0], allowMissingColumns=True).write.parquet(f"{self.path}/{whole}")
            folders = [whole]
        self._swap(number, folders)
        self.base = number
        return number

    def _swap(self, number: int, folders: list[str]) -> None:
        self._fs.mkdirs(self._path(f"{self.path}/versions"))
        fresh = self._path(f"{self.path}/versions/{number}-{uuid.uuid4().hex}.fresh")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps({"version": number, "folders": folders}).encode()))
        out.close()
        try:
            self._context.rename(fresh, self._path(f"{self.path}/versions/{number}.json"), self._keep)
        except Py4JJavaError as e:
            self._fs.delete(fresh, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {number} of {self.path} is another run's") from e
            raise

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the latest ``keep`` versions and what only those need. No other run may be publishing or reading an older version."""
        numbers = self._numbers()
        named = {f for n in numbers[-keep:] for f in self.folders(n)}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/versions/{n}.json"), False)
        for f in self._fs.listStatus(self._path(self.path)):
            if f.getPath().getName().startswith("rows-") and f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)
