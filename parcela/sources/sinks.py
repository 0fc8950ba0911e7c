"""Writing listings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import counted, first_of_hashed, hashed_keys, key_hash, plain_key, unseen_rows, without_stored
from ..session import materialize, scratch_scope


# Conditions of a path that is missing or holds no file.
NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def existing_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored table, or an empty one shaped as ``like``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        # Only a table that isn't there yet is empty; an unreadable one is an error.
        if error.getCondition() not in NOTHING_THERE:
            raise
        return spark.createDataFrame([], like.schema)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Plain insert of one or many rows."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


# Key ranges of a new keyed table. A table keeps the number it began with: it
# stands in the name of the partition column.
KEY_PREFIXES = 64
_PREFIX = "key_prefix_of_"


def _prefix_column(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if c.startswith(_PREFIX)), None)


def key_prefix(key: str, prefix_column: str) -> Column:
    """The key range of a row; null is a key."""
    return _prefix_of(key_hash(key), prefix_column)


def _prefixes(prefix_column: str) -> int:
    return int(prefix_column.removeprefix(_PREFIX))


def _prefix_of(hashed: Column, prefix_column: str) -> Column:
    return F.pmod(hashed, F.lit(_prefixes(prefix_column))).cast("int")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a keyed table."""
    rows = spark.read.parquet(path)
    return rows.drop(*[c for c in rows.columns if c.startswith(_PREFIX)])


def keys_in_reach(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The part of a keyed table that may hold the batch's keys: only the
    partitions of their prefixes are read."""
    column = _prefix_column(target.columns)
    if column is None:
        return target
    # At most as many values as a table has prefixes.
    return target.filter(F.col(column).isin([r[0] for r in batch.select(key_prefix(key, column)).distinct().collect()]))


def insert_if_absent(batch: DataFrame, path: str, key: str = "_id", order: Sequence[Column] = (),
                     partition_by: Sequence[str] = ("OPERATION_TYPE",), prefixes: int = KEY_PREFIXES,
                     finish: Callable[[DataFrame], DataFrame] | None = None, copy: bool = True) -> None:
    """Append the rows whose key is not stored yet; stored rows always win.

    The table is partitioned by a hash prefix of the key, so a batch reads the
    keys of its own prefixes only, and rows and keys are committed by one write.
    Running the same batch again adds nothing. A table that was stored without
    prefixes is read and continued as it is. The batch is written once to the
    shared folder, since its keys are read before its rows, and the copies are
    deleted at the end; ``copy`` off says that it reads a stored table anyway.
    ``finish`` adds columns that follow from the rest of their row. It gets the
    rows that are stored, after the last shuffle, so wide columns are made once
    and never moved. Read the table with ``read_keyed``.
    """
    spark = batch.sparkSession
    with scratch_scope(spark):
        batch = materialize(batch, "batch") if copy else batch
        target = existing_table(spark, path, batch)
        stored = _prefix_column(target.columns)
        column = stored or f"{_PREFIX}{prefixes}"
        new = not stored and (not target.columns or target.isEmpty())
        if new or plain_key(batch, target, key):
            keys = hashed_keys(batch, key)
            found = counted(keys, *([F.collect_set(_prefix_of(F.col("_hash"), stored)).alias("prefixes")] if stored else []))
            fresh = first_of_hashed(batch, keys, found.again, key, order)
            if not new:
                # At most as many values as a table has prefixes.
                reach = target.filter(F.col(stored).isin(found.prefixes)) if stored else target
                fresh = without_stored(fresh, keys, found.n, reach, key, (stored, _prefixes(stored)) if stored else None)
        else:
            fresh = unseen_rows(batch, keys_in_reach(target, batch, key), key, order)
        by = [c for c in partition_by if c in batch.columns]
        if stored or new:
            by = [column, *by]
            # One file for each prefix and partition. The writer wants its rows in
            # that order: they are sorted before ``finish`` makes them wide.
            fresh = fresh.withColumn(column, key_prefix(key, column)).repartition(*by).sortWithinPartitions(*by)
        append_rows(finish(fresh) if finish else fresh, path, by)
