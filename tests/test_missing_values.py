"""NaN, null keys and ties."""

from pyspark.sql import functions as F

from parcela.operators import cleaning, features, filters, joins, search
from parcela.sources import sinks

NAN = float("nan")


def test_nan_is_no_price(spark):
    rows = [("A", "Casa", float(i)) for i in range(100)] + [("A", "Casa", NAN), ("A", "Casa", None)]
    df = spark.createDataFrame(rows, "OPERATION_TYPE string, PROPERTY_TYPE string, PRICE double")
    got = [r.PRICE for r in cleaning.cap_by_group(df).collect()]
    assert sum(x is None for x in got) == 1 and sum(x is not None and x != x for x in got) == 1
    assert max(x for x in got if x is not None and x == x) < 99
    assert cleaning.capping_report(df).first()["capped_above_p99"] == 1
    clipped = [r.PRICE for r in features.clip_above(df, "PRICE", 50).collect()]
    assert sum(x is not None and x != x for x in clipped) == 1


def test_nan_is_within_no_bound(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (5.0,)], "PRICE double")
    assert filters.listing_filter(df, ge={"PRICE": 2}).count() == 1
    rows = [("Apartamento", NAN, NAN, 1, 1), ("Apartamento", 500.0, 200_000.0, 1, 1)]
    kept = filters.drop_erroneous(spark.createDataFrame(rows, "PROPERTY_TYPE string, AREA double, PRICE double, FLOOR int, STRATUM int"))
    assert [r.AREA != r.AREA for r in kept.collect()] == [True]


def test_nan_vectors_rank_last_and_are_not_valid(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [NAN, 1.0]), (3, [0.0, 1.0])], "_id int, embedding array<double>")
    assert [r._id for r in search.vector_topk(df, [1.0, 0.5], 3).collect()] == [1, 3, 2]
    assert search.validate_vectors(df, 2).first()["valid"] == 2


def test_a_null_key_is_stored_once(spark, tmp_path):
    batch = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "_id string, n int")
    for _ in range(2):
        sinks.insert_if_absent(batch, str(tmp_path / "t"), order=[F.asc("n")])
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 3]
    merged = joins.upsert(batch.filter("n = 1"), batch.filter("n = 2"), "_id")
    assert [r.n for r in merged.collect()] == [2]


def test_ties_go_by_content(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)], "k string, n int")
    winners = {cleaning.first_per_key(df.repartition(p), ["k"], [F.asc("k")]).first()["n"] for p in (1, 3, 7)}
    assert len(winners) == 1
