"""The physical plans the operators are meant to get."""

from plan_text import plan_of
from pyspark.sql import functions as F

from parcela.fixtures import listings, points
from parcela.operators import cleaning, filters, joins, search, stats


def test_filters_reach_the_scan(spark, sf):
    plan = plan_of(filters.listing_filter(spark.read.parquet(f"{sf}/lineitem.parquet"), ge={"l_quantity": 10.0}).select("l_orderkey"))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_caps_do_not_shuffle_the_rows(spark, sf):
    plan = plan_of(cleaning.cap_by_group(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_extendedprice"], ["l_returnflag"]))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_insert_does_not_shuffle_the_target(spark, sf):
    target = spark.read.parquet(f"{sf}/orders.parquet")
    known = target.join(joins.small_or_stored(target.select("o_orderkey").limit(10)), "o_orderkey", "left_semi")
    assert "BroadcastHashJoin" in plan_of(known) and "Exchange hashpartitioning" not in plan_of(known)


def test_search_keeps_k_rows_per_task(spark, sf):
    plan = plan_of(search.vector_topk(points(spark, sf), [0.1] * 64, 5, id_col="row_id"))
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_batch_search_joins_nothing(spark, sf):
    rows = points(spark, sf)
    queries = rows.limit(3).select(F.col("row_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plan = plan_of(search.vector_topk_batch(rows, queries, 5, id_col="row_id"))
    assert "Join" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def test_aggregates_are_reduced_before_the_shuffle(spark, sf):
    plan = plan_of(stats.price_by_group(listings(spark, sf)))
    assert "partial_avg" in plan and "Python" not in plan


def test_metrics_need_no_join(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_extendedprice AS y_true", "l_extendedprice * l_tax AS y_pred")
    assert "Join" not in plan_of(stats.regression_metrics(df, method="hash"))


def test_null_checks_reach_the_scan(spark, sf):
    df = filters.drop_incomplete(spark.read.parquet(f"{sf}/customer.parquet"), ["c_acctbal", "c_mktsegment"])
    plan = plan_of(df)
    assert "IsNotNull(c_acctbal)" in plan and "IsNotNull(c_mktsegment)" in plan
