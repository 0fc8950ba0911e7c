"""Listings for a request in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.embedding import embed_query
from ..operators.filters import search_filter
from ..operators.search import filtered_first, vector_topk


def recommend(df: DataFrame, text: str | None, k: int = 10, property_type: str | None = None,
              min_price: float | None = None, max_price: float | None = None, min_area: float | None = None,
              vector: str = "embedding", id_col: str = "_id", **embedding) -> DataFrame:
    """The ``k`` listings within the bounds that are nearest to a text, with
    ``score``. Without words, or on a table without vectors, the first ``k`` by
    key come back with a null score. ``embedding`` must be the options the stored
    vectors were made with.
    """
    rows = search_filter(df, property_type, min_price, max_price, min_area)
    if not (text or "").strip() or vector not in df.columns:
        return filtered_first(rows, id_col, k).withColumn("score", F.lit(None).cast("double"))
    return vector_topk(rows, embed_query(df.sparkSession, text, **embedding), k, vector, id_col)
