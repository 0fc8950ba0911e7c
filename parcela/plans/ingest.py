"""Ingest of stored pages: flatten, key, embed, insert if absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import normalize_text, uuid5_dns
from ..operators.embedding import embed_text
from ..operators.filters import stamp_batch
from ..operators.stats import compare_signatures, scrape_signature
from ..schema import BATCH_ID_FORMAT
from ..session import materialize, scratch_scope
from ..sources.pages import flatten_listings, flatten_pages
from ..sources.sinks import existing_table, insert_if_absent


def keyed(rows: DataFrame) -> DataFrame:
    """Flattened listings with key and clean text."""
    return rows.withColumn("_id", uuid5_dns("WEB_PROPERTY_CODE")).withColumn("DESCRIPTION", normalize_text("DESCRIPTION"))


def prepared(rows: DataFrame, at: Column, embed: bool = True, **embedding) -> DataFrame:
    """Flattened listings with key, clean text, vector and batch stamp."""
    rows = keyed(rows)
    if embed:
        rows = embed_text(rows, "DESCRIPTION", **embedding)
    return stamp_batch(rows, at)


def store_listings(rows: DataFrame, target: str, at: Column, order: Sequence[Column], embed: bool = True,
                   copy: bool = True, **embedding) -> None:
    """Insert flattened listings that are not stored yet, prepared as by
    ``prepared``. Vector and stamp are made for the rows that are stored, as these
    are written. A caller's model runs before the insert, on all cores."""
    rows = keyed(rows)
    if embed and embedding.get("make_model") is not None:
        rows, embed, copy = embed_text(rows, "DESCRIPTION", **embedding), False, True

    def finish(fresh: DataFrame) -> DataFrame:
        return stamp_batch(embed_text(fresh, "DESCRIPTION", share=False, **embedding) if embed else fresh, at)

    insert_if_absent(rows, target, order=order, finish=finish, copy=copy)


def prepare_listings(pages: DataFrame, at: Column, json_col: str = "value", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Rows ready to be stored, from pages of raw JSON."""
    return prepared(flatten_listings(pages, json_col, keep), at, **options)


def ingest_listings(pages: DataFrame, requests: DataFrame, target: str, at: Column | None = None,
                    signatures: str | None = None, json_col: str = "value", **options) -> DataFrame:
    """Store the pages' listings, then sign the run and compare it.

    pages: operation, property and the JSON; requests: operation, property,
    position. Returns the run's signature beside the run before it; signatures
    are kept in ``signatures`` if given. The pages are parsed once: listings and
    page states are parts of one stored table, which is deleted at the end.
    """
    spark = pages.sparkSession
    if at is None:
        # One instant for the whole run.
        at = F.lit(spark.sql("SELECT current_timestamp()").first()[0])
    keys = ("operation", "property")
    stamp = spark.range(1).select(F.date_format(at, BATCH_ID_FORMAT)).first()[0]
    with scratch_scope(spark):
        flat = materialize(flatten_pages(pages, json_col, keys), "pages")
        rows = flat.filter("is_listing").drop("ok", "page_start", "is_listing", "position")
        store_listings(rows.drop(*keys), target, at, [F.asc("WEB_PROPERTY_CODE")], copy=False, **options)
        states = flat.filter("page_start").select(*keys, "ok")
        signed = materialize(scrape_signature(requests, states, rows, stamp), "signature", lasting=True)
    if signatures is None:
        return compare_signatures(signed)
    before = existing_table(spark, signatures, signed)
    known = before.filter(F.col("timestamp") == stamp).limit(1).count()
    if not known:
        signed.write.mode("append").parquet(signatures)
    history = spark.read.schema(signed.schema).parquet(signatures)
    return compare_signatures(history).filter(F.col("timestamp") == stamp)
