"""The physical plan of a DataFrame as text."""

from pyspark.sql import DataFrame


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
