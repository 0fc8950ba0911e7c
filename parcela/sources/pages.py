"""Stored search-result pages to listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import to_number
from ..operators.filters import label_of
from ..schema import (
    ANTIQUITY_LABELS, LINK_PREFIX, LISTING_COLUMNS, OPERATION_LABELS, PAGE, PROPERTY_LABELS, ROWS_PER_PAGE, SOURCE_NAME,
)

# Listing column -> field of the page's listing, for plain numbers.
_NUMBERS = {
    "PRICE": "price.amount", "PRICE_ADMIN_INCLUDED": "price.admin_included", "AREA": "m2",
    "LATITUDE": "latitude", "LONGITUDE": "longitude", "BUILT_AREA": "m2Built", "PRIVATE_AREA": "m2apto",
    "GARAGE": "garage", "BATHROOMS": "bathrooms", "ROOMS": "rooms", "FLOOR": "floor",
    "STRATUM": "stratum", "BEDROOMS": "bedrooms",
}


def parse_pages(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Add ``page`` (the parsed response) and ``ok`` (it holds a hit list)."""
    return df.withColumn("page", F.from_json(json_col, PAGE)).withColumn("ok", F.col("page.hits.hits").isNotNull())


def total_hits(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Add ``total_hits``: the total the response states, -1 if it has none."""
    value = F.get_json_object(json_col, "$.hits.total.value").try_cast("bigint")
    return df.withColumn("total_hits", F.coalesce(value, F.lit(-1)))


def page_count(hits: Column | str, rows: int = ROWS_PER_PAGE) -> Column:
    return F.ceil((F.col(hits) if isinstance(hits, str) else hits) / F.lit(rows))


def page_list(df: DataFrame, hits: str = "total_hits", rows: int = ROWS_PER_PAGE) -> DataFrame:
    """One row per page to fetch: 1 .. page count (none for no hits)."""
    pages = page_count(hits, rows)
    numbers = F.when(pages >= 1, F.sequence(F.lit(1), F.greatest(pages, F.lit(1)).cast("int")))
    return df.withColumn("page_no", F.explode(numbers))


def flatten_pages(df: DataFrame, json_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Listings and page states in one parse: after the ``keep`` columns ``ok``
    (the page holds a hit list), ``page_start`` (one row per page has it),
    ``is_listing``, ``position`` on the page and the columns LISTING_COLUMNS. A
    page without listings has one row, which is none."""
    # The outer form adds no size filter, for which the JSON would be parsed again.
    hits = parse_pages(df, json_col).select(*keep, "ok", F.posexplode_outer("page.hits.hits").alias("position", "hit"))
    item = lambda f: F.col(f"hit._source.listing.{f}")
    columns = {c: to_number(item(f)) for c, f in _NUMBERS.items()} | {
        "SOURCE": F.lit(SOURCE_NAME),
        "WEB_PROPERTY_CODE": item("id"),
        # Some responses state the flag as true or false.
        "PRICE_ADMIN_INCLUDED": F.coalesce(
            to_number(item("price.admin_included")),
            item("price.admin_included").try_cast("boolean").cast("double")),
        "ANTIQUITY": label_of(item("antiquity"), ANTIQUITY_LABELS),
        "CONSTRUCTION_YEAR": item("construction_year").try_cast("int"),
        "PROPERTY_TYPE": label_of(item("property_type_id"), PROPERTY_LABELS),
        "OPERATION_TYPE": label_of(item("operation_type_id"), OPERATION_LABELS),
        "DESCRIPTION": item("description"),
        "LINK": F.concat(F.lit(LINK_PREFIX), item("link")),
    }
    return hits.select(
        *keep, "ok", (F.coalesce("position", F.lit(0)) == 0).alias("page_start"),
        F.col("hit._source.listing").isNotNull().alias("is_listing"), "position", *[columns[c].alias(c) for c in LISTING_COLUMNS])


def flatten_listings(df: DataFrame, json_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per listing of the pages, with columns LISTING_COLUMNS after the
    ``keep`` columns and ``position`` on the page. Pages that cannot be parsed
    yield nothing."""
    return flatten_pages(df, json_col, keep).filter("is_listing").select(*keep, "position", *LISTING_COLUMNS)
