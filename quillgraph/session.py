"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quillgraph", cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benches; on a cluster pass your own session instead."""
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate data: the one the cluster names, else a folder beside the warehouse.

    The fallback is removed when the session's JVM ends.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        own = f"{warehouse}/_scratch/{sc.applicationId}"
        fs, path = _file_system(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc.setCheckpointDir(own)
    elif named and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object, so any store that Spark reaches will do."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back, without its lineage.

    The table has its true size, so the next join may broadcast it when it is small and shuffles it when
    it is not. (A checkpoint would keep the plan's estimate, and in a loop that joins a state with
    itself the estimate squares every round.)
    """
    path = scratch_path(df.sparkSession, "state")
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.__dict__["_scratch"] = path
    return stored


def cut_bucketed(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """`cut` into a table bucketed by `keys`, which joins on them don't shuffle. The catalogue forgets its name at once, the files stay."""
    spark = df.sparkSession
    path, name = scratch_path(spark, "buckets"), f"buckets_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, *keys).option("path", path).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: only its entry goes
    stored.__dict__["_scratch"] = path
    return stored


def forget(df: DataFrame) -> None:
    """Delete the table behind a frame that `cut` returned, once a later one has been written from it."""
    path = df.__dict__.pop("_scratch", None)
    if path:
        drop_path(df.sparkSession, path)


def keep_partitioned(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Reliable checkpoint of `df`, partitioned and sorted by `keys` in a way that later joins can rely on.

    An adaptive plan does not tell its partitioning, so the stored rows are dealt out in a session of their own that
    plans without it; settings of the caller's session stay as they are.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, "edges")
    df.write.parquet(path)
    aside = spark.newSession()
    aside.conf.set("spark.sql.adaptive.enabled", "false")
    kept = aside.read.schema(df.schema).parquet(path).repartition(parts, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    drop_path(spark, path)
    return kept


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path for an intermediate table, in the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core for a table with fewer splits than cores (one small file); a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
