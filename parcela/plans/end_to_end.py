"""Ingest, clean and train in one Spark application."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.models import TrainedModel, save_model, train_price_model
from ..session import materialize
from ..sources.sinks import read_keyed
from .clean import clean_listings
from .ingest import ingest_listings


@dataclass
class JobConfig:
    target: str
    model_root: str
    signatures: str | None = None
    kind: str = "xgboost"
    json_col: str = "value"
    ingest: dict = field(default_factory=dict)
    training: dict = field(default_factory=dict)


@dataclass
class JobResult:
    signature: DataFrame
    cleaned: DataFrame
    trained: TrainedModel
    version: int


def run_end_to_end(spark: SparkSession, pages: DataFrame, requests: DataFrame, cfg: JobConfig) -> JobResult:
    """The stored table is never overwritten: cleaning writes a new copy, which
    training reads. Vectors aren't copied: ``cleaned`` has them from the table, as
    it is when the job reads it."""
    signature = ingest_listings(pages, requests, cfg.target, signatures=cfg.signatures,
                                json_col=cfg.json_col, **cfg.ingest)
    cleaned = clean_listings(read_keyed(spark, cfg.target))
    trained = train_price_model(materialize(cleaned.drop("embedding"), "cleaned"), cfg.kind, **cfg.training)
    return JobResult(signature, cleaned, trained, save_model(trained, cfg.model_root))
