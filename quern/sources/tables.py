"""Reading and laying out Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.joins import estimated_bytes
from quern.session import is_kept, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Files, directories or globs; partition columns come from key=value folders."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def folder(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files under a folder, with columns of its key=value folders; other files, such as a
    table's metadata, are passed over."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)


def with_row_index(df: DataFrame, name: str = "file_row_number") -> DataFrame:
    """Position in its file of each row, straight off a file scan."""
    return df.select("*", F.col("_metadata.row_index").alias(name))


def files_for(df: DataFrame, file_bytes: int = 128 << 20) -> int:
    """How many files of about that size the table makes, by Spark's estimate of its size."""
    return max(1, -(-estimated_bytes(df) // file_bytes))


def write_sorted(df: DataFrame, path: str, by: str, files: int | None = None, rows_per_page: int = 1024) -> None:
    """A layout whose page and row-group bounds are narrow in one column: files follow each other in its
    order. files: by the table's size, if not given."""
    (
        df.repartitionByRange(files or files_for(df), by)
        .sortWithinPartitions(by)
        .write.mode("overwrite")
        .option("parquet.page.row.count.limit", str(rows_per_page))
        .option("parquet.block.size", str(8 << 20))
        .parquet(path)
    )


def write_by_month(df: DataFrame, path: str, date: str) -> None:
    """Folders month=YYYY-MM. Tasks take stretches of time, so that a month of many rows goes to many tasks
    and one of few gets few files."""
    month = F.date_format(F.col(date), "yyyy-MM")
    df.withColumn("month", month).repartitionByRange(files_for(df), "month", date).write.mode("overwrite").partitionBy("month").parquet(path)


def laid_out(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """Path of a layout of a table that is written once a session and then only read."""
    done = _layouts.setdefault(spark.sparkContext.applicationId, {})
    if not is_kept(spark, done.get((name, source), "")):
        path = shared_path(spark, f"layout-{name}")
        write(path)
        done[name, source] = path
    return done[name, source]


_layouts: dict[str, dict[tuple[str, str], str]] = {}
