"""Duplicates and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import half_even
from ..session import small_or_stored
from .quantiles import quantiles

SOURCE_KEYS = ("SOURCE", "WEB_PROPERTY_CODE")


def content_order(df: DataFrame) -> list[Column]:
    """Sort keys from the whole row; columns of a type without order are left out."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return [F.xxhash64(*plain)] if plain else []


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Spark keeps one row per key and task before
    the shuffle (WindowGroupLimit), so a hot key does not load one task. Rows that
    ``order`` leaves equal go by a hash of their content, whatever the partitioning."""
    order = [*order, *content_order(df)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedup_latest(df: DataFrame, keys: Sequence[str] = SOURCE_KEYS, time: str = "scraped_at",
                 tie: str = "_id") -> DataFrame:
    """The newest row of each key; ``tie`` (descending) decides equal times."""
    return first_per_key(df, keys, [F.desc_nulls_last(time), F.desc_nulls_last(tie)])


def duplicate_groups(df: DataFrame, keys: Sequence[str] = SOURCE_KEYS, time: str = "scraped_at") -> DataFrame:
    """Keys held by more than one row, with their count and latest time."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("count"), F.max(time).alias("latest_scrape"))
    return groups.filter("count > 1")


def duplicate_members(df: DataFrame, keys: Sequence[str] = SOURCE_KEYS, id_col: str = "_id",
                      time: str = "scraped_at") -> DataFrame:
    """The ids of each duplicate group, one row per id: a list per group would
    not fit one row for a hot key. AQE splits a hot key's partition."""
    # A struct is never null and equals one with the same nulls, so the join deals
    # rows by the very key the groups are dealt by.
    keyed = df.withColumn("_key", F.struct(*keys))
    groups = duplicate_groups(keyed, ["_key"], time)
    return keyed.select("_key", *keys, id_col).join(groups, "_key").select(*keys, id_col, "count", "latest_scrape")


def dedup_report(df: DataFrame, keys: Sequence[str] = SOURCE_KEYS, time: str = "scraped_at") -> DataFrame:
    """Rows deduplication removes and the groups it touches."""
    return duplicate_groups(df, keys, time).agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("deleted_count"),
        F.count("*").alias("groups_processed"),
    )


def group_limits(df: DataFrame, columns: Sequence[str], by: Sequence[str], q: float = 0.99,
                 method: str = "cells") -> DataFrame:
    """Per group and field, the limit above which values are capped."""
    found = quantiles(df, columns, [q], by, method)
    return found.select(*by, "field", "n", F.element_at("quantiles", 1).alias("limit"))


def limits_wide(limits: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group with a limit column per field, for joining to rows.

    Runs the limits job and hands back a side of known size.
    """
    spread = limits.groupBy(*by).agg(*[
        F.max(F.when(F.col("field") == c, F.col("limit"))).alias(f"_limit_{c}") for c in columns
    ])
    return small_or_stored(spread)


def _with_limits(df: DataFrame, wide: DataFrame, by: Sequence[str]) -> DataFrame:
    side = wide.withColumnsRenamed({b: f"_by_{b}" for b in by})
    same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    return df.join(side, same, "left").drop(*[f"_by_{b}" for b in by])


def _number(c: str) -> Column:
    """The value, null if it is NaN: Spark orders NaN above every number."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _raised(c: str) -> Column:
    return F.greatest(_number(c), F.when(_number(c).isNotNull(), F.lit(0.0)))


def cap_with(df: DataFrame, wide: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Negatives become 0, then values above the group's limit become the limit."""
    joined = _with_limits(df, wide, by)
    capped = {
        # least() and greatest() skip nulls, so missing values and NaN are kept apart.
        c: F.when(_number(c).isNotNull(), F.least(_raised(c), F.col(f"_limit_{c}"))).otherwise(F.col(c).cast("double"))
        for c in columns
    }
    return joined.withColumns(capped).select(*df.columns)


def cap_by_group(df: DataFrame, columns: Sequence[str] = ("PRICE",),
                 by: Sequence[str] = ("OPERATION_TYPE", "PROPERTY_TYPE"),
                 q: float = 0.99, method: str = "cells") -> DataFrame:
    """Cap ``columns`` at the group's quantile. The limits are read before
    negatives are raised, and are computed for all columns in one pass."""
    wide = limits_wide(group_limits(df, columns, by, q, method), columns, by)
    return cap_with(df, wide, columns, by)


def capping_report(df: DataFrame, columns: Sequence[str] = ("PRICE",),
                   by: Sequence[str] = ("OPERATION_TYPE", "PROPERTY_TYPE"),
                   q: float = 0.99, scale: int = 0, method: str = "cells") -> DataFrame:
    """Per group and field: the limit, negatives raised and values capped."""
    wide = limits_wide(group_limits(df, columns, by, q, method), columns, by)
    return report_with(df, wide, columns, by, scale)


def report_with(df: DataFrame, wide: DataFrame, columns: Sequence[str], by: Sequence[str], scale: int = 0) -> DataFrame:
    """The capping report of limits that are already known."""
    columns, by = list(columns), list(by)
    counts = _with_limits(df.select(*by, *columns), wide, by).groupBy(*by).agg(*[
        F.struct(
            F.lit(c).alias("field"),
            half_even(F.first(f"_limit_{c}"), scale).alias("p99"),
            F.count_if(F.col(c) < 0).alias("negatives_fixed"),
            F.count_if(_raised(c) > F.col(f"_limit_{c}")).alias("capped_above_p99"),
        ).alias(f"r_{i}") for i, c in enumerate(columns)
    ])
    fields = F.array(*[f"r_{i}" for i in range(len(columns))])
    return counts.select(*by, F.inline(fields)).filter("p99 IS NOT NULL")
