import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.operators import cleaning, filters
from parcela.plans.clean import clean_listings

SCHEMA = "id int, PROPERTY_TYPE string, AREA double, PRICE double, FLOOR int, STRATUM int, OPERATION_TYPE string"


def rows(spark, *items):
    return spark.createDataFrame([(i, *item) for i, item in enumerate(items)], SCHEMA)


BOUNDARIES = [
    ("Apartamento", 0.0, 500_000.0, 1, 1, "Arriendo"),
    ("Apartamento", 0.01, 500_000.0, 1, 1, "Arriendo"),
    ("Apartamento", 400.0, 500_000.0, 1, 1, "Arriendo"),
    ("Apartaestudio", 400.01, 500_000.0, 1, 1, "Venta"),
    ("Apartaestudio", 50.0, 99_999.0, 1, 1, "Venta"),
    ("Apartaestudio", 50.0, 100_000.0, 1, 1, "Venta"),
    ("Apartamento", 50.0, 20_000_000.0, 1, 1, "Venta"),
    ("Apartamento", 50.0, 20_000_001.0, 1, 1, "Venta"),
    ("Casa", -1.0, 1.0, 202, 1, "Venta"),
    ("Casa", -1.0, 1.0, 1, 101, "Venta"),
    ("Casa", -1.0, 1.0, None, None, "Venta"),
    (None, 900.0, -1.0, 1, 1, "Venta"),
    ("Apartamento", None, None, 1, 1, "Venta"),
]


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_cleaning_and_training_bounds_differ(spark):
    df = rows(spark, *BOUNDARIES)
    assert ids(filters.drop_erroneous(df)) == [1, 2, 5, 6, 10, 11, 12]
    # Open bounds; a missing floor, area or price never passes. A null type is no apartment.
    assert ids(filters.training_filter(df)) == [1, 11]


def test_report_counts_per_operation(spark):
    found = {r["OPERATION_TYPE"]: r["deleted"] for r in filters.erroneous_report(rows(spark, *BOUNDARIES)).collect()}
    assert found == {"Arriendo": 1, "Venta": 5}


def test_rules_can_be_replaced(spark):
    df = rows(spark, *BOUNDARIES)
    assert ids(filters.drop_erroneous(df, {"dear": F.col("PRICE") > 1e7})) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12]


DUPES = [("s", "1", 10, 1), ("s", "1", 30, 2), ("s", "1", 30, 3), ("s", "2", 5, 4), (None, "1", 1, 5), (None, "1", None, 6)]


@pytest.fixture(scope="module")
def dupes(spark):
    return spark.createDataFrame(DUPES, "SOURCE string, WEB_PROPERTY_CODE string, scraped_at int, _id int")


def test_dedup(spark, dupes):
    kept = cleaning.dedup_latest(dupes)
    assert sorted(r["_id"] for r in kept.collect()) == [3, 4, 5]
    assert sorted(r["_id"] for r in cleaning.dedup_latest(kept).collect()) == [3, 4, 5]
    assert tuple(cleaning.dedup_report(dupes).first()) == (3, 2)
    assert cleaning.duplicate_groups(dupes).count() == 2
    assert sorted(r["_id"] for r in cleaning.duplicate_members(dupes).collect()) == [1, 2, 3, 5, 6]


def test_no_duplicates_report(spark, dupes):
    assert tuple(cleaning.dedup_report(dupes.filter("_id = 4")).first()) == (0, 0)


def test_cap_order_with_negative_limit(spark):
    # The limit is read first; raised zeros then exceed a negative limit.
    df = spark.createDataFrame([("a", -5.0, 1), ("a", -3.0, 2), (None, -1.0, 3), (None, 9.0, 4), ("n", None, 5)], "g string, v double, id int")
    capped = {r["id"]: r["v"] for r in cleaning.cap_by_group(df, ["v"], ["g"]).collect()}
    limit_a, limit_null = np.percentile([-5, -3], 99), np.percentile([-1, 9], 99)
    assert capped[1] == capped[2] == pytest.approx(limit_a)
    assert capped[3] == 0.0 and capped[4] == pytest.approx(limit_null) and capped[5] is None
    report = {r["g"]: (r["negatives_fixed"], r["capped_above_p99"]) for r in cleaning.capping_report(df, ["v"], ["g"], scale=2).collect()}
    assert report == {"a": (2, 2), None: (1, 1)}


def test_caps_hold_for_both_methods(spark):
    df = spark.range(3000).selectExpr("id", "id % 3 AS g", "cast(id * 37 % 1009 - 20 as double) AS v", "cast(id % 7 as double) AS w")
    a, b = (cleaning.cap_by_group(df, ["v", "w"], ["g"], method=m) for m in ("hash", "cells"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    limits = cleaning.group_limits(df, ["v"], ["g"])
    worst = a.groupBy("g").agg(F.max("v").alias("top"), F.min("v").alias("low")).join(limits, "g")
    assert worst.filter("top > limit OR low < 0").count() == 0


def test_clean_job_takes_limits_after_deletion(spark):
    df = rows(spark, *BOUNDARIES).withColumnRenamed("id", "_id").withColumns({
        "SOURCE": F.lit("s"), "WEB_PROPERTY_CODE": F.col("_id").cast("string"), "scraped_at": F.lit(1)})
    kept = clean_listings(df, dedup=True)
    assert sorted(r["_id"] for r in kept.collect()) == [1, 2, 5, 6, 10, 11, 12]
    prices = {r["_id"]: r["PRICE"] for r in kept.collect()}
    assert prices[11] == -1.0 or prices[11] == 0.0
    assert prices[6] == pytest.approx(np.percentile([100_000, 20_000_000], 99)) or prices[6] <= 20_000_000
    assert json.dumps(sorted(k for k, v in prices.items() if v is None)) == "[12]"
