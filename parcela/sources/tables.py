"""Reading listings from tables and files, and finding which there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Columns of a stored table that training does not read.
RUN_COLUMNS = ("_id", "batch_id", "scraped_at", "embedding")


def read_listings(spark: SparkSession, path: str, exclude: Sequence[str] = RUN_COLUMNS) -> DataFrame:
    """A stored listings table without the excluded fields."""
    return spark.read.parquet(path).drop(*exclude)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """Headed CSV. Without a schema the types are inferred, which reads the file twice."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def newest_file(spark: SparkSession, pattern: str) -> str | None:
    """Path of the newest file matching a glob, None if there is none."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(pattern)
    matches = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    newest = max(matches, key=lambda s: (s.getModificationTime(), str(s.getPath())), default=None)
    return str(newest.getPath()) if newest is not None else None


def load_listings(spark: SparkSession, table: str | None, csv_pattern: str, fallback_csv: str,
                  schema: T.StructType | str | None = None) -> tuple[DataFrame, str]:
    """Listings and the name of the source used: the table if it can be read,
    else the newest matching CSV (comma), else the fixed CSV (semicolon)."""
    if table is not None:
        try:
            return read_listings(spark, table), "table"
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    newest = newest_file(spark, csv_pattern)
    if newest is not None:
        return read_csv(spark, newest, schema), newest.rsplit("/", 1)[-1]
    return read_csv(spark, fallback_csv, schema, sep=";"), "fallback"


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Names and kinds of the catalogue's tables and views."""
    found = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(found, "name string, kind string, temporary boolean")


def scan_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All points with the wanted payload; Spark's partitions are the pages."""
    return df.select(*columns)


def save_bundle(train: DataFrame, test: DataFrame, transforms, path: str) -> None:
    """Prepared rows and the fitted transforms that made them."""
    train.write.parquet(f"{path}/train")
    test.write.parquet(f"{path}/test")
    transforms.write().save(f"{path}/transforms")


def load_bundle(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    transforms = PipelineModel.load(f"{path}/transforms")
    return spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test"), transforms
