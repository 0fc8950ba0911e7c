"""Listing-shaped views of the test tables.

The SQL runs unchanged in Spark and in DuckDB. Rows with known faults are
planted: wrong, missing and extreme values, unknown types, repeated keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LISTINGS_SQL = """
SELECT o_orderkey AS row_id,
  'Portal ' || o_orderstatus AS SOURCE,
  CAST(o_custkey AS STRING) AS WEB_PROPERTY_CODE,
  o_orderdate AS scraped_at,
  CASE WHEN o_orderkey % 97 = 0 THEN -o_totalprice WHEN o_orderkey % 89 = 0 THEN NULL
       ELSE o_totalprice * 60 END AS PRICE,
  CAST(CASE WHEN o_orderkey % 101 = 0 THEN 0 WHEN o_orderkey % 103 = 0 THEN -5
       ELSE 20 + o_custkey % 420 END AS DOUBLE) AS AREA,
  CASE WHEN o_orderkey % 211 = 0 THEN 202 ELSE CAST(o_orderkey % 30 AS INT) END AS FLOOR,
  CASE WHEN o_orderkey % 223 = 0 THEN 101 ELSE CAST(1 + o_orderkey % 6 AS INT) END AS STRATUM,
  CASE o_orderkey % 7 WHEN 0 THEN 'Casa' WHEN 1 THEN 'Apartamento' WHEN 2 THEN 'Apartaestudio'
       WHEN 3 THEN 'Oficina' WHEN 4 THEN 'Local' WHEN 5 THEN 'Bodega' ELSE NULL END AS PROPERTY_TYPE,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Arriendo' ELSE 'Venta' END AS OPERATION_TYPE,
  CAST(CASE WHEN o_orderkey % 107 = 0 THEN -3 WHEN o_orderkey % 109 = 0 THEN NULL
       ELSE 15 + o_custkey * 7 % 380 END AS DOUBLE) AS BUILT_AREA,
  CAST(10 + o_custkey * 3 % 300 AS DOUBLE) AS PRIVATE_AREA,
  CAST(CASE WHEN o_orderkey % 113 = 0 THEN 60 ELSE o_orderkey % 4 END AS DOUBLE) AS GARAGE,
  CAST(CASE WHEN o_orderkey % 127 = 0 THEN -1 ELSE 1 + o_orderkey % 5 END AS DOUBLE) AS BATHROOMS,
  CAST(CASE WHEN o_orderkey % 131 = 0 THEN NULL ELSE 1 + o_custkey % 6 END AS DOUBLE) AS ROOMS,
  CAST(1 + o_custkey % 5 AS DOUBLE) AS BEDROOMS,
  CAST(4.5 AS DOUBLE) + CAST(o_custkey % 1024 AS DOUBLE) / CAST(4096 AS DOUBLE) AS LATITUDE,
  CAST(-74.25 AS DOUBLE) + CAST(o_orderkey % 1024 AS DOUBLE) / CAST(4096 AS DOUBLE) AS LONGITUDE,
  CASE o_custkey % 6 WHEN 1 THEN 'Menor a 1 año' WHEN 2 THEN 'De 1 a 8 años' WHEN 3 THEN 'De 9 a 15 años'
       WHEN 4 THEN 'De 16 a 30 años' WHEN 5 THEN 'Más de 30 años' ELSE NULL END AS ANTIQUITY,
  CASE WHEN o_orderkey % 5 = 0 THEN 'www.ficnaraiz.example/' WHEN o_orderkey % 5 = 1 THEN 'https://ficnaraiz.example/'
       ELSE 'https://fincaraiz.example/' END || CAST(o_orderkey AS STRING) AS LINK
FROM {orders}
"""

# Attributes for the vectors, so that searches can be filtered.
POINTS_SQL = """
SELECT vec_id AS row_id, embedding, label,
  CASE vec_id % 3 WHEN 0 THEN 'Casa' WHEN 1 THEN 'Apartamento' ELSE 'Local' END AS PROPERTY_TYPE,
  CAST(100000 + vec_id * 7919 % 1900000 AS DOUBLE) AS PRICE,
  CAST(20 + vec_id * 31 % 300 AS DOUBLE) AS AREA,
  CAST(vec_id % 4 AS DOUBLE) AS GARAGE,
  CAST(1 + vec_id % 5 AS DOUBLE) AS ROOMS
FROM {embeddings}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTINGS_SQL, orders=table(spark, sf_dir, "orders"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS_SQL, embeddings=table(spark, sf_dir, "embeddings"))


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-result pages made from the orders table: 32 listings per page and
    operation, numbers partly as text, codes partly unknown."""
    orders = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    listing = F.struct(
        key.alias("id"),
        F.struct(F.col("o_totalprice").alias("amount"), (key % 2).alias("admin_included")).alias("price"),
        (20 + cust % 420).alias("m2"),
        F.when(key % 10 == 0, F.lit("n/a")).otherwise(F.format_string("%d.25", key % 90)).alias("latitude"),
        F.format_string(" -%d.5 ", cust % 180).alias("longitude"),
        (key % 7).alias("antiquity"),
        (1950 + key % 75).alias("construction_year"),
        (15 + cust % 380).alias("m2Built"),
        F.when(key % 3 != 0, 10 + cust % 300).alias("m2apto"),
        (key % 4).alias("garage"), (1 + key % 5).alias("bathrooms"), (1 + cust % 6).alias("rooms"),
        (key % 30).alias("floor"),
        (key % 21).cast("string").alias("property_type_id"), (1 + key % 3).alias("operation_type_id"),
        (1 + key % 6).alias("stratum"), (1 + cust % 5).alias("bedrooms"),
        F.concat(F.lit(" Listing\n\n of\u00a0"), "o_orderpriority", F.lit("\u200b")).alias("description"),
        F.concat(F.lit("/listing/"), key).alias("link"),
    )
    hit = F.struct(F.struct(listing.alias("listing")).alias("_source"))
    page = F.floor(key / 32)
    # A page holds 32 listings at most, so the list per page is short.
    grouped = orders.groupBy(page.alias("page_no")).agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), hit.alias("h")))).alias("found"))
    body = F.struct(F.struct(
        F.struct(F.size("found").alias("value")).alias("total"),
        F.transform("found", lambda x: x["h"]).alias("hits"),
    ).alias("hits"))
    return grouped.select("page_no", F.to_json(body).alias("value"))
