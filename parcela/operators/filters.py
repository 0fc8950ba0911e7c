"""Projections, code decoding, filters and row rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import to_number
from ..schema import ANTIQUITY_LABELS, APARTMENT_TYPES, BATCH_ID_FORMAT, FeatureSpec, OPERATION_LABELS, PROPERTY_LABELS


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def label_of(code: Column | str, labels: Mapping[int, str]) -> Column:
    """Label of a code; null for an unknown or missing code."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    number = (F.col(code) if isinstance(code, str) else code).try_cast("int")
    return F.try_element_at(F.create_map(*pairs), number)


def decode_labels(
    df: DataFrame,
    property_type: str = "property_type_id",
    operation_type: str = "operation_type_id",
    antiquity: str = "antiquity",
) -> DataFrame:
    """Add the three label columns for the portal's codes."""
    return df.withColumns({
        "PROPERTY_TYPE": label_of(property_type, PROPERTY_LABELS),
        "OPERATION_TYPE": label_of(operation_type, OPERATION_LABELS),
        "ANTIQUITY": label_of(antiquity, ANTIQUITY_LABELS),
    })


def stamp_batch(df: DataFrame, at: Column) -> DataFrame:
    """Mark every row with the time and the id of the run."""
    return df.withColumns({"scraped_at": at, "batch_id": F.date_format(at, BATCH_ID_FORMAT)})


def select_features(df: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    return df.select(*spec.all)


def is_nan(df: DataFrame, c: str) -> Column:
    """Whether a column of ``df`` holds NaN; only fractions can."""
    return F.isnan(c) if df.schema[c].dataType.typeName() in ("double", "float") else F.lit(False)


def listing_filter(
    df: DataFrame,
    eq: Mapping[str, object] | None = None,
    ge: Mapping[str, object] | None = None,
    le: Mapping[str, object] | None = None,
) -> DataFrame:
    """Equality and range bounds. A bound of None is not applied; zero is."""
    conditions = [F.col(c) == v for c, v in (eq or {}).items() if v is not None]
    # NaN is above every number in Spark, but within no bound.
    conditions += [(F.col(c) >= v) & ~is_nan(df, c) for c, v in (ge or {}).items() if v is not None]
    conditions += [F.col(c) <= v for c, v in (le or {}).items() if v is not None]
    return df.filter(all_of(conditions)) if conditions else df


def search_filter(df: DataFrame, property_type: str | None = None, min_price: float | None = None,
                  max_price: float | None = None, min_area: float | None = None) -> DataFrame:
    """The conditions of a search request. An empty type means any type."""
    return listing_filter(
        df, eq={"PROPERTY_TYPE": property_type or None},
        ge={"PRICE": min_price, "AREA": min_area}, le={"PRICE": max_price},
    )


def within_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows inside every closed range."""
    return df.filter(all_of([F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()]))


def is_number(c: str) -> Column:
    """The field is present and numeric."""
    return to_number(c).isNotNull()


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every column; NaN counts as missing. Written as
    plain conditions, so the null checks reach the file scan."""
    kinds = dict(df.dtypes)
    floats = [c for c in columns if kinds[c] in ("double", "float")]
    return df.filter(all_of([F.col(c).isNotNull() for c in columns] + [~F.isnan(c) for c in floats]))


def erroneous_rules() -> dict[str, Column]:
    """Rules for the cleaning job. The bounds 0, 100 thousand, 400 and 20 million:

    an apartment is deleted beyond them, or at an area of exactly zero.
    """
    apartment = F.col("PROPERTY_TYPE").isin(APARTMENT_TYPES)
    return {
        "floor_202": F.col("FLOOR") == 202,
        "stratum_101": F.col("STRATUM") == 101,
        "area_not_positive": apartment & (F.col("AREA") <= 0),
        "area_over_400": apartment & (F.col("AREA") > 400) & ~F.isnan("AREA"),
        "price_under_100k": apartment & (F.col("PRICE") < 100_000),
        "price_over_20m": apartment & (F.col("PRICE") > 20_000_000) & ~F.isnan("PRICE"),
    }


def is_erroneous(rules: Mapping[str, Column] | None = None) -> Column:
    """True if any rule holds; a rule on a missing value does not hold."""
    rules = erroneous_rules() if rules is None else rules
    return any_of([F.coalesce(rule, F.lit(False)) for rule in rules.values()])


def drop_erroneous(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    return df.filter(~is_erroneous(rules))


def erroneous_report(df: DataFrame, by: Sequence[str] = ("OPERATION_TYPE",),
                     rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows the rules delete, per table of the operation."""
    return df.groupBy(*by).agg(F.count_if(is_erroneous(rules)).alias("deleted"))


def training_filter(df: DataFrame) -> DataFrame:
    """Rows fit for training: the apartment bounds are open here, unlike the
    cleaning rules, so 100 thousand, 400 and 20 million are removed."""
    apartment = F.col("PROPERTY_TYPE").isin(APARTMENT_TYPES)
    plausible = (
        (F.col("AREA") > 0) & (F.col("AREA") < 400)
        & (F.col("PRICE") > 100_000) & (F.col("PRICE") < 20_000_000)
    )
    return df.filter(
        (F.col("FLOOR") != 202) & (F.col("STRATUM") != 101)
        & (~F.coalesce(apartment, F.lit(False)) | plausible)
    )


def fill_categories(df: DataFrame, columns: Sequence[str], number: float = 999, text: str = "No se sabe") -> DataFrame:
    """Replace null categories by a value of their type."""
    kinds = dict(df.dtypes)
    values = {c: text if kinds[c] == "string" else number for c in columns}
    return df.na.fill(values)


def training_rows(df: DataFrame, spec: FeatureSpec = FeatureSpec(), order: str = "drop_first",
                  keep: Sequence[str] = ()) -> DataFrame:
    """Target and features (and ``keep``) of the rows used for training.

    "drop_first" removes incomplete rows before the category fill (which then
    has nothing to do); "fill_first" keeps rows whose only gap is a category.
    """
    rows = df.select(*keep, *spec.all)
    if order == "drop_first":
        return training_filter(drop_incomplete(rows, spec.all))
    if order == "fill_first":
        return drop_incomplete(training_filter(fill_categories(rows, spec.categorical)), spec.all)
    raise ValueError(f"unknown order {order!r}")
