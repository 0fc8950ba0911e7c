"""Requests in words, reports of the cleaning job, groups under null keys."""

from pyspark.sql import functions as F

from parcela.operators import cleaning
from parcela.operators.embedding import embed_text
from parcela.plans.clean import clean_with_reports
from parcela.plans.recommend import recommend

NAMES = "_id int, DESCRIPTION string, PROPERTY_TYPE string, PRICE double, AREA double"


def test_request_in_words_and_without(spark):
    rows = [(1, "casa con jardin", "Casa", 5.0, 50.0), (2, "bodega en zona franca", "Casa", 5.0, 50.0),
            (3, "casa con jardin", "Lote", 5.0, 50.0), (4, None, "Casa", 5.0, 50.0), (5, "casa con jardin", "Casa", 50.0, 50.0)]
    df = embed_text(spark.createDataFrame(rows, NAMES))
    found = recommend(df, "Casa con JARDIN", 10, "Casa", max_price=10).collect()
    assert [r["_id"] for r in found] == [1, 2, 4] and round(found[0].score, 5) == 1.0 and found[2].score is None
    for text, table in ((" ", df), (None, df), ("casa", df.drop("embedding"))):
        plain = recommend(table, text, 2, "Casa").collect()
        assert [(r["_id"], r.score) for r in plain] == [(1, None), (2, None)]


def test_duplicates_under_null_keys_in_one_shuffle_a_side(spark):
    rows = [(1, "a", None), (2, "a", None), (3, None, None), (4, None, None), (5, "b", "x")]
    df = spark.createDataFrame(rows, "_id int, SOURCE string, WEB_PROPERTY_CODE string").withColumn("scraped_at", F.lit(1))
    found = cleaning.duplicate_members(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["_id"], r["count"]) for r in found.collect()) == [(1, 2), (2, 2), (3, 2), (4, 2)]
    assert plan.count("Exchange hashpartitioning") <= 2


def test_reports_match_rows(spark):
    rows = [(i, "Arriendo", "Apartamento", float(10**6 + i), 50.0) for i in range(200)] + [(900, "Arriendo", "Apartamento", 1.0, 50.0)]
    df = spark.createDataFrame(rows, "_id int, OPERATION_TYPE string, PROPERTY_TYPE string, PRICE double, AREA double").withColumns({"FLOOR": F.lit(1), "STRATUM": F.lit(3)})
    done = clean_with_reports(df, fields=())
    kept = {r["_id"]: r.PRICE for r in done.rows.collect()}
    assert done.removed.first().removed == 1 and len(kept) == 200
    changed = sum(kept[i] != p for i, _, _, p, _ in rows if i in kept)
    assert done.capped.first().capped_above_p99 == changed > 0
