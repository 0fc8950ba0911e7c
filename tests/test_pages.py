import json

from pyspark.sql import functions as F

from parcela.operators.filters import decode_labels
from parcela.schema import LISTING_COLUMNS
from parcela.sources import pages


def listing(**over):
    base = dict(id=7, price={"amount": "350000", "admin_included": True}, m2=50, latitude="4.7", longitude="x", antiquity=2,
                construction_year=1999, m2Built=48.5, m2apto=None, garage=1, bathrooms=2, rooms=3, floor=4, property_type_id="2",
                operation_type_id=2, stratum=3, bedrooms=2, description="d", link="/a")
    return {"_source": {"listing": {**base, **over}}}


def page(*hits, total=1):
    return json.dumps({"hits": {"total": {"value": total}, "hits": list(hits)}})


TEXTS = [
    page(listing(), listing(id="8", property_type_id=99, operation_type_id=None, antiquity="5", price={"amount": 1.5})),
    page(total=0),
    '{"hits": {"total": {}}}', '{"message": "no"}', "not json", None,
]


def test_flatten(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "n int, value string")
    rows = pages.flatten_listings(df, keep=("n",)).orderBy("position").collect()
    assert [f for f in rows[0].asDict() if f not in ("n", "position")] == LISTING_COLUMNS
    assert len(rows) == 2
    a, b = rows
    assert (a["WEB_PROPERTY_CODE"], a["PRICE"], a["PRICE_ADMIN_INCLUDED"]) == ("7", 350000.0, 1.0)
    assert (a["LATITUDE"], a["LONGITUDE"], a["PRIVATE_AREA"]) == (4.7, None, None)
    assert (a["PROPERTY_TYPE"], a["OPERATION_TYPE"], a["ANTIQUITY"]) == ("Apartamento", "Arriendo", "De 1 a 8 años")
    assert a["LINK"] == "https://www.fincaraiz.com.co/a"
    assert (b["WEB_PROPERTY_CODE"], b["PROPERTY_TYPE"], b["OPERATION_TYPE"], b["ANTIQUITY"]) == ("8", None, None, "Más de 30 años")


def test_page_state_and_totals(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "n int, value string")
    states = [r["ok"] for r in pages.parse_pages(df).orderBy("n").collect()]
    assert states == [True, True, False, False, False, False]
    totals = [r["total_hits"] for r in pages.total_hits(df).orderBy("n").collect()]
    assert totals == [1, 0, -1, -1, -1, -1]


def test_page_numbers(spark):
    df = spark.createDataFrame([(0,), (1,), (32,), (33,), (-1,)], "total_hits long")
    found = pages.page_list(df).groupBy("total_hits").agg(F.max("page_no"))
    assert dict(map(tuple, found.collect())) == {1: 1, 32: 1, 33: 2}


def test_decode(spark):
    df = spark.createDataFrame([("19", 1, 1), ("7", 3, 0), (None, None, None)], "property_type_id string, operation_type_id int, a int")
    rows = decode_labels(df, antiquity="a").collect()
    assert [(r["PROPERTY_TYPE"], r["OPERATION_TYPE"], r["ANTIQUITY"]) for r in rows] == [
        ("Bodega", "Venta", "Menor a 1 año"), (None, None, None), (None, None, None)]
