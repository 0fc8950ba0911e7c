"""The cleaning job: delete wrong rows, then cap prices and numeric fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators.cleaning import cap_with, dedup_latest, dedup_report, group_limits, limits_wide, report_with
from ..operators.filters import drop_erroneous
from ..operators.stats import removal_report
from ..schema import CAPPED_FIELDS
from ..session import materialize


@dataclass
class CleanResult:
    """Cleaned rows and the counts of each step."""
    rows: DataFrame
    deduplicated: DataFrame | None
    removed: DataFrame
    capped: DataFrame


def clean_with_reports(df: DataFrame, dedup: bool = False, tie: str = "_id",
                       rules: Mapping[str, Column] | None = None, fields: Sequence[str] = CAPPED_FIELDS,
                       by: Sequence[str] = ("OPERATION_TYPE", "PROPERTY_TYPE"), method: str = "cells",
                       scale: int = 2) -> CleanResult:
    """Cleaned listings with the steps' reports. Limits are taken after the
    deletion, for the price and all fields together: no field's limit depends on
    another. They are computed once, for the rows and the report. Deduplicated
    rows are written once, since limits and rows are read apart."""
    groups = dedup_report(df) if dedup else None
    if dedup:
        df = materialize(dedup_latest(df, tie=tie), "dedup")
    kept = drop_erroneous(df, rules)
    columns = ["PRICE", *[f for f in fields if f in df.columns]]
    wide = limits_wide(group_limits(kept, columns, by, method=method), columns, by)
    return CleanResult(cap_with(kept, wide, columns, by), groups, removal_report(df, kept), report_with(kept, wide, columns, by, scale))


def clean_listings(df: DataFrame, **options) -> DataFrame:
    """Only the rows of ``clean_with_reports``."""
    return clean_with_reports(df, **options).rows
