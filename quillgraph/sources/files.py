"""File formats of the citation data set, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

EDGE_SCHEMA = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of two ids."""
    return spark.read.schema(EDGE_SCHEMA).csv(path)


def read_nodes(spark: SparkSession, path: str, inclusive: bool = False) -> DataFrame:
    """Ids 0..n-1 from a file holding n; `inclusive` also gives the surplus id n."""
    n = spark.read.schema("n bigint").csv(path).first()["n"]
    return spark.range(0, n + 1 if inclusive else n)


def read_positional(spark: SparkSession, path: str, column: str, kind: str = "int") -> DataFrame:
    """id, column: headerless one-column files whose 0-based line number is the key.

    Lines are numbered inside each file split and shifted by the lines of earlier splits, so a large
    file is read in parallel. Files of a folder count in name order. A blank or unreadable line is null
    and keeps its number.
    """
    lines = spark.read.text(path).select(
        F.trim("value").try_cast(kind).alias(column),
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__seq"))
    here = F.row_number().over(Window.partitionBy("__file", "__start").orderBy("__seq")) - 1
    sizes = lines.groupBy("__file", "__start").agg(F.count("*").alias("__n"))  # one row per split
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("__file", "__start", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    return lines.withColumn("__here", here).join(shift, ["__file", "__start"]).select(
        (F.col("__shift") + F.col("__here")).alias("id"), column)


def read_csv_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; column names may hold blanks."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_titles_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated paper_id, title, abstract without header or quoting; a quote inside is escaped with one backslash."""
    parts = spark.read.text(path).select(F.split("value", "\t", 3).alias("p"))
    return parts.select(F.col("p")[0].try_cast("bigint").alias("paper_id"),
                        *[F.regexp_replace(F.get("p", F.lit(i)), r'\\"', '"').alias(c) for i, c in ((1, "title"), (2, "abstract"))])


def write_titles_tsv(df: DataFrame, path: str) -> None:
    """The same format from paper_id, title, abstract; tabs and line ends become blanks, quotes not yet escaped are escaped."""
    texts = [F.regexp_replace(F.regexp_replace(c, r"[\t\r\n]", " "), r'(?<!\\)"', r'\\"') for c in ("title", "abstract")]
    df.select(F.concat_ws("\t", F.col("paper_id").cast("string"), *texts).alias("value")).write.text(path)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, partitions: int | None = None,
               key: str | None = None) -> DataFrame:
    """Parquet with an explicit schema, spread over `partitions` by `key` when asked.

    A table that is read in more splits than that is spread over as many partitions as splits, so that no task's share grows with the table.
    """
    df = spark.read.schema(schema).parquet(path)
    if not partitions:
        return df
    parts = max(partitions, df.rdd.getNumPartitions())
    return df.repartition(parts, key) if key else df.repartition(parts)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Overwrite `path` and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_edges(df: DataFrame, path: str) -> None:
    """Flat edge list with header for external viewers."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_scalar(df: DataFrame, path: str) -> None:
    """One-row result as a small CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path)


def on_disk(df: DataFrame) -> DataFrame:
    """Cache a reused frame on disk only; call unpersist() on it when done."""
    return df.persist(StorageLevel.DISK_ONLY)
