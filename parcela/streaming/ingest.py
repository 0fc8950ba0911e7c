"""Continuous ingest of page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import store_listings
from ..session import scratch_scope
from ..sources.pages import flatten_listings


def stream_pages(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of page files, one JSON response per line."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def start_ingest(pages: DataFrame, target: str, checkpoint: str, trigger: dict | None = None,
                 json_col: str = "value", **options) -> StreamingQuery:
    """Insert each micro-batch's unseen listings into ``target``.

    A batch that is run again after a failure finds its rows stored and adds
    nothing, so every listing is stored once. A batch leaves no copies behind.
    ``trigger`` is passed to Spark; the default handles what is there and stops.
    """
    def insert(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            rows = flatten_listings(batch, json_col).drop("position")
            store_listings(rows, target, F.current_timestamp(), [F.asc("WEB_PROPERTY_CODE"), F.asc("LINK")], **options)

    writer = pages.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
