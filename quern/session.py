"""Session, table loading and durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the setting is missing and all runs on one machine, as in
    tests, a temporary folder is taken; on a cluster it must be set.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "local").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark, "_quern_dir", None)
    if own is None:
        own = spark._quern_dir = "file://" + tempfile.mkdtemp(prefix="quern-")
    return own


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage; an executor that is lost later costs nothing but the
    reading of its files by another one. Parquet rather than checkpoint():
    compressed and columnar, so that later readers prune columns.
    """
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete all that ``durable`` wrote in this application, once no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def own_dir(spark: SparkSession) -> str:
    """The application's part of the shared folder. It is deleted when the driver's Python ends; what a lost driver leaves lies under its application's id."""
    if not getattr(spark, "_quern_cleans", False):
        spark._quern_cleans = True
        atexit.register(_clean_at_exit, spark)
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}"


def _clean_at_exit(spark: SparkSession) -> None:
    try:
        clean(spark)
    except Exception:  # the session was stopped before: nothing can be deleted through it
        pass


def width(spark: SparkSession, at_least: int = 12) -> int:
    """Partitions for work spread by hand: those of a shuffle, at least ``at_least``."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where a table of few files would keep most of them idle.

    For costly work on each row. A table with at least half as many partitions
    as there are cores stays as it is, so large inputs are never shuffled here.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)
