"""Market statistics, data profiles and run signatures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import half_up
from ..schema import OPERATIONS
from ..session import local_rows
from .quantiles import quantiles, quantiles_and_cells

PROFILE_PROBABILITIES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _side_by_side(keys: Sequence[str], *parts: DataFrame) -> DataFrame:
    """Merge aggregates of the same groups into one row per group. Each part has
    one row per group and columns of its own, so no join is needed."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in keys])


def market_stats(df: DataFrame, operations: Sequence[str] = OPERATIONS) -> DataFrame:
    """Count, mean price and mean area per operation; an empty one shows zeros."""
    found = df.groupBy("OPERATION_TYPE").agg(
        F.count("*").alias("total_properties"),
        F.avg("PRICE").alias("avg_price"),
        F.avg("AREA").alias("avg_area"),
    )
    wanted = local_rows(df.sparkSession, [(o,) for o in operations], "OPERATION_TYPE string")
    empty = F.col("total_properties").isNull()
    return wanted.join(found, "OPERATION_TYPE", "left").select(
        "OPERATION_TYPE",
        F.coalesce("total_properties", F.lit(0)).alias("total_properties"),
        F.when(empty, F.lit(0.0)).otherwise(F.col("avg_price")).alias("avg_price"),
        F.when(empty, F.lit(0.0)).otherwise(F.col("avg_area")).alias("avg_area"),
    )


def dashboard_summary(df: DataFrame, sale: str = "Venta", rent: str = "Arriendo") -> DataFrame:
    """The four dashboard figures: all listings, mean sale price in millions,
    mean rent in thousands, mean area of listings for sale."""
    of = lambda op, c: F.avg(F.when(F.col("OPERATION_TYPE") == op, F.col(c)))
    card = lambda value, unit: half_up(F.coalesce(value, F.lit(0.0)) / unit)
    return df.agg(
        F.count_if(F.col("OPERATION_TYPE").isin(sale, rent)).alias("total_properties"),
        card(of(sale, "PRICE"), 1_000_000.0).alias("sale_price_millions"),
        card(of(rent, "PRICE"), 1_000.0).alias("rent_price_thousands"),
        card(of(sale, "AREA"), 1.0).alias("sale_area"),
    )


def price_by_group(df: DataFrame, by: Sequence[str] = ("PROPERTY_TYPE",), price: str = "PRICE") -> DataFrame:
    """Mean, count, lowest and highest price per group, dearest first."""
    return df.groupBy(*by).agg(
        F.avg(price).alias("avg_price"), F.count("*").alias("count"),
        F.min(price).alias("min_price"), F.max(price).alias("max_price"),
    ).orderBy(F.desc_nulls_last("avg_price"), *by)


def row_counts(df: DataFrame, condition: Column, by: Sequence[str] = ()) -> DataFrame:
    """All rows and the rows that meet a condition."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(condition).alias("matching"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_last(column))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls (and NaN) per column, as count and percentage, in one pass."""
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    missing = {
        c: F.count_if(F.col(c).isNull() | F.isnan(c)) if kinds[c] in ("double", "float") else F.count_if(F.col(c).isNull())
        for c in columns
    }
    wide = df.agg(F.count("*").alias("_rows"), *[m.alias(f"n_{i}") for i, m in enumerate(missing.values())])
    lines = [F.struct(F.lit(c).alias("field"), F.col(f"n_{i}").alias("nulls")) for i, c in enumerate(columns)]
    return wide.select("_rows", F.inline(F.array(*lines))).select(
        "field", "nulls",
        F.when(F.col("_rows") > 0, F.col("nulls") * 100.0 / F.col("_rows")).alias("null_pct"),
    )


def numeric_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), method: str = "cells",
                    probabilities: Sequence[float] = PROFILE_PROBABILITIES) -> DataFrame:
    """Count, mean, sample deviation, extremes and percentiles per column."""
    columns, by = list(columns), list(by)
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    wide = df.groupBy(*by).agg(*[
        F.struct(
            F.lit(c).alias("field"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"),
        ).alias(f"m_{i}") for i, (c, v) in enumerate(clean.items())
    ])
    moments = wide.select(*by, F.inline(F.array(*[f"m_{i}" for i in range(len(columns))])))
    found = quantiles(df, columns, probabilities, by, method)
    keys = [*by, "field"]
    joined = _side_by_side(keys, moments, found)
    names = [f"p{p * 100:g}".replace(".", "_") for p in probabilities]
    return joined.select(
        *keys, F.coalesce("n", F.lit(0)).alias("count"), "mean", "std", "min",
        *[F.try_element_at("quantiles", F.lit(i + 1)).alias(name) for i, name in enumerate(names)], "max",
    )


def removal_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows removed between two tables, and their share of the first."""
    both = before.select(F.lit(1).alias("before")).unionAll(after.select(F.lit(0).alias("before")))
    n_before = F.count_if(F.col("before") == 1)
    removed = n_before - F.count_if(F.col("before") == 0)
    return both.agg(
        removed.alias("removed"),
        F.when(n_before > 0, removed * 100.0 / F.nullif(n_before, F.lit(0))).alias("removed_pct"),
    )


def histogram(df: DataFrame, column: str, bins: int | str = "auto") -> DataFrame:
    """Rows per equal-width bin between the column's extremes, empty bins too.

    "auto" takes the narrower of the Sturges and the Freedman-Diaconis width,
    as numpy's histogram does. Reads the extremes first, then counts.
    """
    v = F.col(column).cast("double")
    rows = df.select(F.when(~F.isnan(v), v).alias("v")).filter("v IS NOT NULL")
    extent = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, n = extent["lo"], extent["hi"], extent["n"]
    schema = "bin int, lower double, upper double, count bigint"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    count = auto_bins(rows, lo, hi, n) if bins == "auto" else int(bins)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / count
    slot = F.least(F.floor((F.col("v") - lo) / width), F.lit(count - 1)).cast("int")
    counted = rows.groupBy(slot.alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(count).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def auto_bins(rows: DataFrame, lo: float, hi: float, n: int) -> int:
    """Number of bins for the values in column ``v``."""
    if hi == lo:
        return 1
    row = quantiles(rows, ["v"], [0.25, 0.75]).first()
    spread = hi - lo
    sturges = spread / (math.log2(n) + 1.0)
    freedman = 2.0 * (row["quantiles"][1] - row["quantiles"][0]) / n ** (1.0 / 3.0)
    # No finer than twice the square-root rule, whatever the quartiles say.
    width = min(max(freedman, spread / math.sqrt(n) / 2.0), sturges)
    return max(1, math.ceil(spread / width))


def log_quantiles(df: DataFrame, category: str, price: str = "PRICE", method: str = "cells") -> DataFrame:
    """Quartiles and extremes of the log price per category (price above 0)."""
    logs = df.filter(F.col(price) > 0).select(category, F.ln(price).alias("log_price"))
    found = quantiles(logs, ["log_price"], [0.0, 0.25, 0.5, 0.75, 1.0], [category], method)
    names = ["min", "q1", "median", "q3", "max"]
    return found.select(category, F.col("n").alias("count"),
                        *[F.element_at("quantiles", i + 1).alias(x) for i, x in enumerate(names)])


def extreme_rows(df: DataFrame, column: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Ids and values of the lowest and the highest row; nulls do not compete.
    Among equals the lowest takes the smallest id, the highest the largest."""
    present = df.filter(F.col(column).isNotNull())
    pair = F.struct(F.col(column).alias("value"), F.col(tie).alias("id"))
    return present.groupBy(*by).agg(F.min(pair).alias("lo"), F.max(pair).alias("hi")).select(
        *by, F.col("lo.value").alias("min_value"), F.col("lo.id").alias("min_id"),
        F.col("hi.value").alias("max_value"), F.col("hi.id").alias("max_id"),
    )


def scrape_signature(requests: DataFrame, pages: DataFrame, listings: DataFrame, timestamp: str) -> DataFrame:
    """One row per scraped (operation, property) of a run.

    requests: operation, property, position (order within the run).
    pages: operation, property, ok. listings: operation, property (as
    requested), PROPERTY_TYPE, PRICE. A property's figures cover what the run
    has seen of its operation so far, so types found under an earlier request
    count; a request before the operation's first listing has no row.
    """
    fetched = pages.groupBy("operation", "property").agg(
        F.count_if(F.col("ok")).alias("pages_success"), F.count_if(~F.col("ok")).alias("pages_failed")
    )
    # One row per request and type found; then a running total along the run.
    parts = listings.groupBy("operation", "property", "PROPERTY_TYPE").agg(
        F.count("*").alias("n"), F.sum("PRICE").alias("price_sum"), F.count("PRICE").alias("price_n")
    ).join(requests, ["operation", "property"]).select("operation", "position", F.col("PROPERTY_TYPE").alias("type"), "n", "price_sum", "price_n")
    # A request stands in the run as a row of its own type that adds nothing.
    asked = requests.select("operation", "position", F.col("property").alias("type"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("price_sum"),
                            F.lit(0).alias("price_n"), F.col("property").alias("request"))
    run = parts.withColumn("request", F.lit(None).cast("string")).unionByName(asked)
    up_to = lambda *by: Window.partitionBy(*by).orderBy("position").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = up_to("operation", "type")
    totals = run.select(
        "operation", "request", "position", F.sum("n").over(own).alias("total_properties"),
        (F.sum("price_sum").over(own) / F.nullif(F.sum("price_n").over(own), F.lit(0))).alias("mean_price"),
        F.sum("n").over(up_to("operation")).alias("_seen"),
    ).filter("request IS NOT NULL AND _seen > 0").select("operation", F.col("request").alias("property"), "total_properties", "mean_price")
    done, failed = F.coalesce("pages_success", F.lit(0)), F.coalesce("pages_failed", F.lit(0))
    return totals.join(fetched, ["operation", "property"], "left").select(
        F.lit(timestamp).alias("timestamp"), "property", "operation",
        done.alias("pages_success"), failed.alias("pages_failed"),
        F.when(done + failed > 0, done / F.nullif(done + failed, F.lit(0)) * 100.0).alias("success_rate"),
        "total_properties", "mean_price",
    )


def compare_signatures(signatures: DataFrame) -> DataFrame:
    """Each signature beside the run before it; a first run has null changes."""
    run = Window.partitionBy("operation", "property").orderBy("timestamp")
    change = lambda c: (F.col(c) - F.lag(c).over(run)).alias(f"{c}_change")
    return signatures.select(
        *signatures.columns, F.lag("timestamp").over(run).alias("previous_timestamp"),
        change("total_properties"), change("mean_price"), change("success_rate"),
    )


def regression_metrics(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred",
                       by: Sequence[str] = (), method: str = "cells") -> DataFrame:
    """Error measures of predictions, as fractions and in units of the target.

    A true value of zero makes the percentage error infinite (undefined if the
    prediction is zero too, and then the median is NaN), as numpy has it.
    """
    by = list(by)
    y, z = F.col(truth).cast("double"), F.col(predicted).cast("double")
    gap = F.abs(y - z)
    ape = F.when(y != 0.0, gap / F.nullif(F.abs(y), F.lit(0.0))).when(gap == 0.0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    rows = df.filter(y.isNotNull() & z.isNotNull()).select(
        *by, y.alias("y"), (y - z).alias("residual"), ape.alias("ape"),
        # Fixed value: the smallest divisor of the mean percentage error.
        (gap / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))).alias("guarded_ape"),
    )
    square = F.col("residual") * F.col("residual")
    if method == "cells":
        # Sums and first counts of the percentage errors come from one scan.
        middle, cells = quantiles_and_cells(rows, "ape", [0.5], by, [
            F.count_if(F.col("y") == 0.0).alias("zero_truth"), F.max(F.isnan("ape")).alias("undefined"),
            F.sum("guarded_ape").alias("s_ape"), F.sum(F.abs("residual")).alias("s_abs"), F.sum(square).alias("s_square"),
            F.max(F.abs("residual")).alias("max_error"),
            F.avg("y").alias("m_y"), F.var_pop("y").alias("v_y"), F.avg("residual").alias("m_r"), F.var_pop("residual").alias("v_r"),
        ])
        # Variances are put together from those within the cells and between them.
        whole = Window.partitionBy(*by)
        mean = lambda c: F.sum(F.col("n") * F.col(c)).over(whole) / F.sum("n").over(whole)
        cells = cells.withColumns({"all_y": mean("m_y"), "all_r": mean("m_r")})
        total = lambda c: F.sum(c) / F.sum("n")
        spread = lambda v, m, a: F.sum(F.col("n") * (F.col(v) + (F.col(m) - F.col(a)) * (F.col(m) - F.col(a)))) / F.sum("n")
        sums = cells.groupBy(*by).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("zero_truth"), F.lit(0)).alias("zero_truth"), F.max("undefined").alias("undefined"),
            total("s_ape").alias("MAPE"), total("s_abs").alias("MAE"), total("s_square").alias("mse"),
            spread("v_y", "m_y", "all_y").alias("var_y"), spread("v_r", "m_r", "all_r").alias("var_r"),
            F.max("all_r").alias("mean_residual"), F.max("max_error").alias("max_error"),
        ).withColumn("std_residual", F.sqrt("var_r"))
    else:
        middle = quantiles(rows, ["ape"], [0.5], by, method)
        sums = rows.groupBy(*by).agg(
            F.count("*").alias("n"), F.count_if(F.col("y") == 0.0).alias("zero_truth"),
            F.max(F.isnan("ape")).alias("undefined"),
            F.avg("guarded_ape").alias("MAPE"), F.avg(F.abs("residual")).alias("MAE"), F.avg(square).alias("mse"),
            F.var_pop("y").alias("var_y"), F.var_pop("residual").alias("var_r"),
            F.avg("residual").alias("mean_residual"), F.stddev_pop("residual").alias("std_residual"),
            F.max(F.abs("residual")).alias("max_error"),
        )
    middle = middle.select(*by, F.element_at("quantiles", 1).alias("median_ape"))
    explained = lambda part: F.when(F.col("var_y") > 0.0, 1.0 - part / F.nullif(F.col("var_y"), F.lit(0.0))).otherwise(
        F.when(part == 0.0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return _side_by_side(by, sums, middle).filter("n IS NOT NULL").select(
        *by, "n", "zero_truth", "MAPE",
        F.when(F.col("undefined"), F.lit(float("nan"))).otherwise(F.col("median_ape")).alias("MDAPE"),
        explained(F.col("mse")).alias("R2"), explained(F.col("var_r")).alias("explained_variance"),
        "MAE", F.sqrt("mse").alias("RMSE"), "mean_residual", "std_residual", "max_error",
    )


def best_model(metrics: DataFrame, score: str = "MDAPE", name: str = "model") -> DataFrame:
    """The row with the lowest score."""
    return metrics.orderBy(F.asc_nulls_last(score), name).limit(1)
