"""Queries the driver runs: each applies one operator to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..fixtures import listings, points, stored_pages, table
from ..functions import (
    absolute_link, cosine, dot, flat_vector, norm, normalize_text, or_default, repair_text, to_number, uuid5_dns,
)
from ..operators import cleaning, embedding, features, filters, joins, models, search, stats, vector_index
from ..operators.quantiles import quantiles
from ..plans.clean import clean_listings, clean_with_reports
from ..plans.end_to_end import JobConfig, run_end_to_end
from ..plans.ingest import ingest_listings
from ..plans.recommend import recommend
from ..schema import CAPPED_FIELDS, FeatureSpec
from ..session import materialize, shared_dir, spread
from ..sources import pages, sinks, tables
from ..streaming.ingest import start_ingest, stream_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LISTING_GROUPS = ["OPERATION_TYPE", "PROPERTY_TYPE"]
# Small tree counts: the registered queries show the flow, not the best model.
QUICK = {"xgboost": {"maxIter": 5, "maxDepth": 4}, "lightgbm": {"maxIter": 5, "maxDepth": 5, "minInstancesPerNode": 10},
         "random_forest": {"numTrees": 10, "maxDepth": 6}, "elastic_net": {"regParam": 0.01, "elasticNetParam": 0.5}}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, scale: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), scale) for c in columns})


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parcela-{name}-{uuid.uuid4().hex}"


# --- Sources and sinks ------------------------------------------------------

@query
def flatten_listings(spark, sf):
    return pages.flatten_listings(stored_pages(spark, sf)).drop("position")


@query
def total_hits(spark, sf):
    return pages.total_hits(stored_pages(spark, sf)).select("page_no", "total_hits")


@query
def total_hits_of_events(spark, sf):
    found = pages.total_hits(table(spark, sf, "events"), "props")
    return found.select("event_id", "total_hits", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query
def page_list(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("total_hits"))
    return pages.page_list(counts, rows=4).select("o_custkey", "page_no")


@query
def collection_scan(spark, sf):
    path = scratch(spark, "collection")
    listings(spark, sf).write.parquet(path)
    return tables.read_listings(spark, path, ("row_id", "scraped_at", "LINK", "LATITUDE", "LONGITUDE"))


@query
def csv_round_trip(spark, sf):
    rows = listings(spark, sf).select("row_id", "PRICE", "PROPERTY_TYPE", "ANTIQUITY")
    path = scratch(spark, "csv")
    tables.write_csv(rows, path, sep=";")
    return tables.read_csv(spark, path, rows.schema, sep=";")


@query
def source_fallback(spark, sf):
    rows = listings(spark, sf).select("row_id", "PRICE", "AREA")
    path = scratch(spark, "raw")
    tables.write_csv(rows, f"{path}/properties_1.csv")
    found, used = tables.load_listings(spark, f"{path}/missing", f"{path}/properties_*.csv", f"{path}/none.csv", rows.schema)
    return found.withColumn("source", F.lit(used))


@query
def insert_if_absent(spark, sf):
    rows = listings(spark, sf).select("WEB_PROPERTY_CODE", "row_id", "STRATUM", "OPERATION_TYPE")
    path = scratch(spark, "store")
    first = rows.filter("STRATUM = 1")
    sinks.insert_if_absent(first, path, "WEB_PROPERTY_CODE", [F.asc("row_id")])
    sinks.insert_if_absent(rows, path, "WEB_PROPERTY_CODE", [F.asc("row_id")])
    return sinks.read_keyed(spark, path).select(rows.columns)


@query
def append_rows(spark, sf):
    rows = listings(spark, sf).select("row_id", "PRICE", "OPERATION_TYPE")
    path = scratch(spark, "append")
    for operation in ("Arriendo", "Venta"):
        sinks.append_rows(rows.filter(F.col("OPERATION_TYPE") == operation), path)
    return spark.read.schema(rows.schema).parquet(path)


@query
def upsert_points(spark, sf):
    rows = points(spark, sf).select("row_id", "PROPERTY_TYPE", "PRICE")
    dearer = rows.filter("PROPERTY_TYPE = 'Casa'").withColumn("PRICE", F.col("PRICE") * 2.0)
    added = rows.filter("PROPERTY_TYPE = 'Local'").withColumn("row_id", -1 - F.col("row_id"))
    return joins.upsert(rows, dearer.unionByName(added), "row_id", [F.desc("PRICE")])


@query
def scan_points(spark, sf):
    return tables.scan_points(points(spark, sf), ["row_id", "PRICE", "PROPERTY_TYPE"])


@query
def prepared_bundle(spark, sf):
    rows = filters.training_rows(listings(spark, sf), keep=["row_id"])
    train, test = features.hash_split(rows, "row_id")
    fitted = features.feature_pipeline().fit(train)
    columns = ["row_id", "PRICE", "features"]
    path = scratch(spark, "bundle")
    tables.save_bundle(fitted.transform(train).select(columns), fitted.transform(test).select(columns), fitted, path)
    a, b, _ = tables.load_bundle(spark, path)
    both = a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("rows"))


# --- Projections, filters ---------------------------------------------------

@query
def project_fields(spark, sf):
    return listings(spark, sf).select("row_id", "PRICE", "AREA", "ROOMS", "BATHROOMS", "LINK", "PROPERTY_TYPE")


@query
def select_features(spark, sf):
    return filters.select_features(listings(spark, sf))


@query
def decode_labels(spark, sf):
    codes = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").alias("property_type_id"),
        (F.col("p_size") % 4).alias("operation_type_id"), (F.col("p_size") % 7).alias("antiquity_id"))
    return filters.decode_labels(codes, antiquity="antiquity_id")


@query
def stamp_batch(spark, sf):
    return filters.stamp_batch(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderdate")).drop("o_orderdate")


@query
def search_filter(spark, sf):
    rows = listings(spark, sf).filter("OPERATION_TYPE = 'Arriendo'")
    found = filters.search_filter(rows, "Apartamento", min_price=0, max_price=20_000_000, min_area=60)
    return found.select("row_id", "PRICE", "AREA")


@query
def within_ranges(spark, sf):
    ranges = {"BUILT_AREA": (30, 60), "GARAGE": (2, 3), "BATHROOMS": (2, 3), "ROOMS": (2, 3)}
    return filters.within_ranges(listings(spark, sf), ranges).select("row_id", *ranges)


@query
def drop_erroneous(spark, sf):
    return filters.drop_erroneous(listings(spark, sf)).select("row_id", "PRICE", "AREA", "FLOOR", "STRATUM", "PROPERTY_TYPE")


@query
def erroneous_report(spark, sf):
    return filters.erroneous_report(listings(spark, sf))


@query
def training_rows(spark, sf):
    return filters.training_rows(listings(spark, sf), keep=["row_id"])


@query
def training_rows_fill_first(spark, sf):
    return filters.training_rows(listings(spark, sf), order="fill_first", keep=["row_id"])


@query
def drop_incomplete(spark, sf):
    return filters.drop_incomplete(listings(spark, sf), ["PRICE", "ROOMS", "PROPERTY_TYPE"]).select("row_id", "PRICE", "ROOMS")


@query
def numeric_fields(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"/([^/?#]*)[?#]?[^/]*$", 1).alias("tail"))
    return rows.filter(filters.is_number("tail")).withColumn("number", to_number("tail"))


@query
def trim_columns(spark, sf):
    rows = listings(spark, sf).select("row_id", "AREA", "PRICE").na.drop()
    trim = features.TrimColumns(columns=["AREA", "PRICE", "ABSENT"], quantile=[0.1, 0.05, 0.5], tail=["both", "upper", "lower"])
    return trim.fit(rows).transform(rows)


@query
def drop_null_columns(spark, sf):
    rows = table(spark, sf, "customer").withColumn("low_balance", F.expr("CASE WHEN c_acctbal < 0 THEN c_acctbal END"))
    return features.DropNullColumns(threshold=0.5).fit(rows).transform(rows)


# --- Joins and set operations -----------------------------------------------

@query
def cascade_delete(spark, sf):
    bad = listings(spark, sf).filter(filters.is_erroneous()).select(uuid5_dns("row_id").alias("_id"))
    vectors = points(spark, sf).select("row_id", uuid5_dns("row_id").alias("_id"), "label")
    return joins.cascade_delete(vectors, bad).drop("_id")


@query
def union_listings(spark, sf):
    rows = listings(spark, sf)
    rent = rows.filter("OPERATION_TYPE = 'Arriendo'").select("row_id", "PRICE", "GARAGE")
    sale = rows.filter("OPERATION_TYPE = 'Venta'").select("PRICE", "row_id", "ROOMS")
    return joins.union_listings(rent, sale)


# --- Aggregations -----------------------------------------------------------

@query
def market_stats(spark, sf):
    found = stats.market_stats(listings(spark, sf), ["Arriendo", "Venta", "Permuta"])
    return rounded(found, 4, "avg_price", "avg_area")


@query
def dashboard_summary(spark, sf):
    return stats.dashboard_summary(listings(spark, sf))


@query
def price_by_group(spark, sf):
    return rounded(stats.price_by_group(filters.drop_erroneous(listings(spark, sf))), 4, "avg_price")


@query
def duplicate_groups(spark, sf):
    return cleaning.duplicate_groups(listings(spark, sf))


@query
def duplicate_members(spark, sf):
    return cleaning.duplicate_members(listings(spark, sf), id_col="row_id")


@query
def dedup_report(spark, sf):
    return cleaning.dedup_report(listings(spark, sf))


@query
def group_limits(spark, sf):
    return rounded(cleaning.group_limits(listings(spark, sf), ["PRICE", *CAPPED_FIELDS], LISTING_GROUPS), 4, "limit")


@query
def group_limits_lineitem(spark, sf):
    found = cleaning.group_limits(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], ["l_returnflag", "l_linestatus"])
    return rounded(found, 4, "limit")


@query
def group_limits_by_cells(spark, sf):
    """The plan for large inputs, forced on a small one."""
    found = cleaning.group_limits(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"],
                                  ["l_returnflag", "l_linestatus"], method="cells")
    return rounded(found, 4, "limit")


@query
def capping_report(spark, sf):
    return cleaning.capping_report(listings(spark, sf))


@query
def capping_report_fields(spark, sf):
    return cleaning.capping_report(listings(spark, sf), CAPPED_FIELDS, scale=2)


@query
def scrape_signature(spark, sf):
    events = table(spark, sf, "events")
    operation = F.when(F.col("user_id") % 2 == 0, "Arriendo").otherwise("Venta").alias("operation")
    # Events stand for listings: requested under their type, found as another one for some users.
    found = events.select(
        operation, F.col("event_type").alias("property"),
        F.when(F.col("user_id") % 5 == 0, F.lit("click")).otherwise(F.col("event_type")).alias("PROPERTY_TYPE"),
        F.col("value").alias("PRICE"))
    fetched = events.select(operation, F.col("event_type").alias("property"), (F.col("value") > 1).alias("ok"))
    asked = found.select("operation", "property").distinct().withColumn(
        "position", F.row_number().over(Window.partitionBy("operation").orderBy("property")))
    signed = stats.scrape_signature(asked, fetched, found, "2024-01-01_00-00-00")
    return rounded(signed, 6, "mean_price", "success_rate")


@query
def compare_signatures(spark, sf):
    daily = table(spark, sf, "events").groupBy(
        F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), F.col("event_type").alias("property"),
        F.when(F.col("user_id") % 2 == 0, "Arriendo").otherwise("Venta").alias("operation"),
    ).agg(
        F.count("*").alias("total_properties"), F.avg("value").alias("mean_price"),
        (F.count_if(F.col("value") > 1) * 100.0 / F.count("*")).alias("success_rate"),
    )
    return rounded(stats.compare_signatures(daily), 6, "mean_price", "success_rate", "mean_price_change", "success_rate_change")


@query
def row_counts(spark, sf):
    return stats.row_counts(listings(spark, sf), F.col("PROPERTY_TYPE") == "Casa", ["OPERATION_TYPE"])


@query
def distinct_values(spark, sf):
    return stats.distinct_values(listings(spark, sf), ["PROPERTY_TYPE"])


@query
def value_counts(spark, sf):
    return stats.value_counts(listings(spark, sf), "ANTIQUITY")


@query
def null_profile(spark, sf):
    return rounded(stats.null_profile(listings(spark, sf)), 6, "null_pct")


@query
def numeric_profile(spark, sf):
    found = stats.numeric_profile(listings(spark, sf), ["PRICE", "AREA", "ROOMS"])
    return rounded(found, 4, *[c for c, kind in found.dtypes if kind == "double"])


@query
def numeric_profile_lineitem(spark, sf):
    found = stats.numeric_profile(table(spark, sf, "lineitem"), ["l_extendedprice", "l_discount"], ["l_returnflag"])
    return rounded(found, 4, *[c for c, kind in found.dtypes if kind == "double"])


@query
def removal_report(spark, sf):
    rows = listings(spark, sf)
    return rounded(stats.removal_report(rows, filters.training_rows(rows, order="fill_first")), 6, "removed_pct")


@query
def histogram(spark, sf):
    return rounded(stats.histogram(listings(spark, sf), "PRICE", bins=20), 4, "lower", "upper")


@query
def histogram_auto(spark, sf):
    return rounded(stats.histogram(listings(spark, sf), "AREA"), 4, "lower", "upper")


@query
def log_quantiles(spark, sf):
    return rounded(stats.log_quantiles(listings(spark, sf), "PROPERTY_TYPE"), 6, "min", "q1", "median", "q3", "max")


def _predictions(spark, sf):
    """Two stand-in models on the line items: a flat discount and a flat tax."""
    rows = table(spark, sf, "lineitem")
    label = F.when(F.col("l_linestatus") == "O", "Test").otherwise("Training").alias("Set")
    truth = F.col("l_extendedprice").alias("y_true")
    return [
        rows.select(F.lit("discounted").alias("model"), label, truth, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y_pred")),
        rows.select(F.lit("taxed").alias("model"), label, truth, (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("y_pred")),
    ]


def _metrics_rounded(df):
    return rounded(df, 5, "MAPE", "MDAPE", "R2", "explained_variance", "MAE", "RMSE", "mean_residual", "std_residual", "max_error")


@query
def regression_metrics(spark, sf):
    return _metrics_rounded(stats.regression_metrics(_predictions(spark, sf)[0]))


@query
def compare_models(spark, sf):
    return _metrics_rounded(models.compare_models(_predictions(spark, sf)))


@query
def best_model(spark, sf):
    found = models.compare_models(_predictions(spark, sf)).filter("Set = 'Test'")
    return rounded(stats.best_model(found), 6, "MDAPE").select("model", "Set", "MDAPE")


# --- Windows and caps -------------------------------------------------------

@query
def dedup_latest(spark, sf):
    return cleaning.dedup_latest(listings(spark, sf), tie="row_id").select("row_id", "SOURCE", "WEB_PROPERTY_CODE", "scraped_at", "PRICE")


@query
def cap_prices(spark, sf):
    return rounded(cleaning.cap_by_group(listings(spark, sf)), 4, "PRICE").select("row_id", "OPERATION_TYPE", "PROPERTY_TYPE", "PRICE")


@query
def cap_numeric_fields(spark, sf):
    return rounded(cleaning.cap_by_group(listings(spark, sf), CAPPED_FIELDS), 4, *CAPPED_FIELDS).select("row_id", *CAPPED_FIELDS)


@query
def cap_balances(spark, sf):
    capped = cleaning.cap_by_group(table(spark, sf, "customer"), ["c_acctbal"], ["c_mktsegment"], q=0.95)
    return rounded(capped, 4, "c_acctbal")


# --- Search -----------------------------------------------------------------

def _query_vector(spark, sf):
    """The vector of point 0 is the search request."""
    return table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]


@query
def vector_topk(spark, sf):
    rows = filters.search_filter(points(spark, sf), "Casa", min_price=200_000, max_price=1_800_000, min_area=40)
    found = search.vector_topk(rows, _query_vector(spark, sf), 10, id_col="row_id")
    return rounded(found, 6, "score").select("row_id", "score", "PRICE", "AREA", "PROPERTY_TYPE")


@query
def vector_topk_ranges(spark, sf):
    rows = filters.within_ranges(points(spark, sf), {"PRICE": (100_000, 1_500_000), "ROOMS": (1, 4), "GARAGE": (0, 2)})
    found = search.vector_topk(rows, _query_vector(spark, sf), 12, id_col="row_id", metric="dot")
    return rounded(found, 6, "score").select("row_id", "score")


@query
def vector_topk_batch(spark, sf):
    rows = points(spark, sf)
    asked = rows.select(F.col("row_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rounded(search.vector_topk_batch(rows, asked, 5, id_col="row_id"), 5, "score")


@query
def vector_topk_lsh(spark, sf):
    return search.vector_topk_lsh(points(spark, sf), _query_vector(spark, sf), 10, id_col="row_id").select("row_id", "score")


@query
def indexed_search(spark, sf):
    """Searches in a stored index of 16 cells, 6 of them probed; the recall is
    that of all its searches together, measured against the exact ones."""
    rows = points(spark, sf)
    path = scratch(spark, "index")
    vector_index.learn_cells(rows, path, cells=16)
    # As at ingest: the index grows by appended rows.
    vector_index.add_rows(rows.filter("row_id % 3 = 0"), path)
    vector_index.add_rows(rows.filter("row_id % 3 <> 0"), path)
    asked = rows.filter("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = materialize(vector_index.indexed_topk_batch(spark, path, asked, 10, 6, id_col="row_id"), "found")
    exact = search.vector_topk_batch(rows, asked, 10, id_col="row_id")
    hits = exact.join(found.select("query_id", "row_id", F.lit(1).alias("hit")), ["query_id", "row_id"], "left")
    recall = hits.agg((F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("recall_reached"))
    best = found.filter("rank = 1").select("query_id", F.round("score", 5).alias("top_score"))
    return best.crossJoin(F.broadcast(recall))


@query
def recommend_text(spark, sf):
    """Documents stand for listings; their vectors are stored first, as at ingest."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("PROPERTY_TYPE"))
    stored = materialize(embedding.embed_text(docs, "text"), "described")
    found = recommend(stored, "una casa con vista al mar", 10, "es", id_col="doc_id")
    return rounded(found, 5, "score").select("doc_id", "score")


@query
def filtered_first(spark, sf):
    rows = filters.search_filter(listings(spark, sf), "Apartamento", max_price=20_000_000)
    return search.filtered_first(rows, "row_id", 10).select("row_id", "PRICE", "AREA")


@query
def first_points(spark, sf):
    return search.filtered_first(points(spark, sf), "row_id", 3).select("row_id")


@query
def extreme_rows(spark, sf):
    return stats.extreme_rows(listings(spark, sf), "PRICE", "row_id", ["OPERATION_TYPE"])


@query
def vector_math(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("other", F.reverse("embedding"))
    return rows.select(
        "vec_id", F.round(dot("embedding", "other"), 6).alias("dot"),
        F.round(cosine("embedding", "other"), 6).alias("cosine"), F.round(norm("embedding"), 6).alias("norm"))


@query
def validate_vectors(spark, sf):
    return search.validate_vectors(table(spark, sf, "embeddings"), 64)


@query
def flatten_vectors(spark, sf):
    nested = table(spark, sf, "embeddings").select("vec_id", F.array("embedding").alias("nested"))
    flat = nested.withColumn("flat", flat_vector("nested"))
    return flat.select("vec_id", F.size("flat").alias("width"), F.col("flat")[0].cast("double").alias("first_value"))


# --- Scalar functions -------------------------------------------------------

@query
def normalize_texts(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", normalize_text("text").alias("text"))


@query
def listing_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", uuid5_dns("url").alias("_id"))


@query
def coerce_numbers(spark, sf):
    mixed = F.concat("o_totalprice", F.element_at(F.array(*[F.lit(x) for x in ("", "d", " ", "e2", ",5", "x")]), (F.col("o_orderkey") % 6 + 1).cast("int")))
    return table(spark, sf, "orders").select("o_orderkey", F.round(to_number(mixed), 2).alias("number"))


@query
def repair_links(spark, sf):
    return listings(spark, sf).select("row_id", repair_text("LINK", "ficnaraiz", "fincaraiz").alias("LINK"))


@query
def absolute_links(spark, sf):
    return listings(spark, sf).select("row_id", absolute_link("LINK").alias("LINK"))


@query
def display_defaults(spark, sf):
    return listings(spark, sf).select("row_id", or_default("PROPERTY_TYPE", "Propiedad").alias("PROPERTY_TYPE"))


@query
def fill_categories(spark, sf):
    return filters.fill_categories(listings(spark, sf), ["ANTIQUITY", "PROPERTY_TYPE", "ROOMS"]).select("row_id", "ANTIQUITY", "PROPERTY_TYPE", "ROOMS")


@query
def clip_above(spark, sf):
    return rounded(features.clip_above(table(spark, sf, "lineitem"), "l_extendedprice"), 4, "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query
def log_columns(spark, sf):
    rows = listings(spark, sf).filter("PRICE > 0")
    return rows.select("row_id", F.round(F.log1p("PRICE"), 8).alias("log1p"), F.round(F.ln("PRICE"), 8).alias("ln"),
                       F.round(F.expm1(F.log1p("PRICE")), 2).alias("expm1"))


@query
def scoring_input(spark, sf):
    rows = listings(spark, sf).drop("PRIVATE_AREA").withColumn("ROOMS", F.col("ROOMS").cast("string"))
    return models.prepare_scoring_input(rows).select("row_id", "ROOMS", "BUILT_AREA", "PRIVATE_AREA", "FLOOR", "STRATUM")


@query
def scoring_rejects(spark, sf):
    """Every request, accepted or refused with its reasons, from the two stored parts."""
    rooms = F.when(F.col("row_id") % 7 == 0, F.lit("many")).when(F.col("row_id") % 11 == 0, F.lit("2.5")).otherwise(F.col("ROOMS").cast("string"))
    rows = listings(spark, sf).withColumn("ROOMS", rooms)
    ready, refused = models.split_scoring_input(rows, scratch(spark, "requests"))
    return ready.select("row_id", F.lit(True).alias("accepted"), F.lit("").alias("reasons")).unionByName(
        refused.select("row_id", F.lit(False).alias("accepted"), F.array_join("reasons", "; ").alias("reasons")))


# --- Features and models ----------------------------------------------------

@query
def split_rows(spark, sf):
    train, test = features.hash_split(listings(spark, sf), "row_id")
    both = train.select("row_id", F.lit("train").alias("part")).unionAll(test.select("row_id", F.lit("test").alias("part")))
    return both


@query
def impute_and_scale(spark, sf):
    rows = listings(spark, sf).select("row_id", "ROOMS", "BUILT_AREA", "PRICE")
    scaled = features.NumericScaler(columns=["ROOMS", "BUILT_AREA", "PRICE"]).fit(rows).transform(rows)
    names = ["ROOMS_scaled", "BUILT_AREA_scaled", "PRICE_scaled"]
    return rounded(scaled, 6, *names).select("row_id", *names)


@query
def one_hot(spark, sf):
    from pyspark.ml.functions import vector_to_array

    spec = FeatureSpec(numeric=(), categorical=("ANTIQUITY", "PROPERTY_TYPE"))
    rows = listings(spark, sf)
    fitted = features.feature_pipeline(spec).fit(rows)
    return fitted.transform(rows).select("row_id", F.array_join(F.transform(vector_to_array("features"), lambda x: x.cast("int").cast("string")), "").alias("bits"))


@query
def assembled_features(spark, sf):
    """The whole feature vector: scaled numbers, then the bits of the categories."""
    from pyspark.ml.functions import vector_to_array

    spec = FeatureSpec(numeric=("ROOMS", "BUILT_AREA", "PRICE"), categorical=("ANTIQUITY", "PROPERTY_TYPE"))
    rows = listings(spark, sf)
    vector = features.feature_pipeline(spec).fit(rows).transform(rows).select("row_id", vector_to_array("features").alias("f"))
    numbers = [F.round(F.get("f", F.lit(i)), 6).alias(f"f{i}") for i in range(3)]
    bits = F.transform(F.slice("f", 4, F.size("f") - 3), lambda x: x.cast("int").cast("string"))
    return vector.select("row_id", *numbers, F.array_join(bits, "").alias("bits"))


@query
def target_round_trip(spark, sf):
    rows = listings(spark, sf).filter("PRICE > 0").select("row_id", "PRICE")
    model = features.TargetTransform().fit(rows)
    back = model.inverse(model.transform(rows), "label", "restored")
    return back.select("row_id", F.round("restored", 1).alias("restored"))


@query
def target_scores(spark, sf):
    rows = listings(spark, sf).filter("PRICE > 0").select("row_id", "PRICE")
    return features.TargetTransform().fit(rows).transform(rows).select("row_id", "label")


def _cleaned(spark, sf):
    """Training reads a stored, cleaned table, as in the end-to-end job."""
    return materialize(clean_listings(listings(spark, sf)), "cleaned")


def _trained(kind):
    def run(spark, sf):
        return models.train_price_model(_cleaned(spark, sf), kind, key="row_id", params=QUICK[kind]).metrics

    run.__name__ = f"train_{kind}"
    return run


for _kind in QUICK:
    query(_trained(_kind))


@query
def search_parameters(spark, sf):
    space = {"regParam": ("log", 1e-4, 10.0), "elasticNetParam": ("float", 0.1, 0.9)}
    done = models.train_price_model(_cleaned(spark, sf), "elastic_net", key="row_id", trials=3, folds=3, space=space)
    return done.metrics.withColumn("params", F.lit(repr(sorted(done.params.items()))))


@query
def score_prices(spark, sf):
    rows = listings(spark, sf)
    root = scratch(spark, "models")
    models.save_model(models.train_price_model(_cleaned(spark, sf), "elastic_net", key="row_id", params=QUICK["elastic_net"]), root)
    version, model = models.load_latest(spark, root)
    scored = models.score_prices(model, models.prepare_scoring_input(rows))
    return scored.select("row_id", "predicted_price", F.lit(version).alias("version"))


@query
def embed_text(spark, sf):
    return embedding.embed_text(table(spark, sf, "documents"), "text").select("doc_id", "embedding")


# --- Streaming and jobs -----------------------------------------------------

def _letter_model():
    """A caller's model: counts of some letters, times fixed weights."""
    import numpy as np

    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([[len(t), t.count("a") - 2 * t.count("e"), 0.5 * t.count(" ")] for t in texts], dtype=np.float32)

    return predict


@query
def embed_with_model(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    made = embedding.embed_text(parts, "p_name", make_model=_letter_model)
    return made.select("p_partkey", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(3)])


@query
def stream_ingest(spark, sf):
    path = scratch(spark, "stream")
    stored_pages(spark, sf).select("value").write.text(f"{path}/in")
    feed = stream_pages(spark, f"{path}/in", files_per_batch=4)
    start_ingest(feed, f"{path}/out", f"{path}/state").awaitTermination()
    return sinks.read_keyed(spark, f"{path}/out").select("_id", "WEB_PROPERTY_CODE", "PRICE", "DESCRIPTION", "OPERATION_TYPE")


@query
def clean_job(spark, sf):
    cleaned = clean_listings(listings(spark, sf))
    return rounded(cleaned, 4, "PRICE", *CAPPED_FIELDS).select("row_id", "PRICE", *CAPPED_FIELDS)


@query
def clean_job_removed(spark, sf):
    return rounded(clean_with_reports(listings(spark, sf)).removed, 6, "removed_pct")


@query
def clean_job_capped(spark, sf):
    return clean_with_reports(listings(spark, sf)).capped


@query
def clean_job_with_dedup(spark, sf):
    cleaned = clean_listings(listings(spark, sf), dedup=True, tie="row_id")
    return rounded(cleaned, 4, "PRICE", *CAPPED_FIELDS).select("row_id", "PRICE", *CAPPED_FIELDS)


def _pages_and_requests(spark, sf):
    """Stored pages labelled with the request that fetched them."""
    kinds = F.array(F.lit("Casa"), F.lit("Apartamento"), F.lit("Lote"))
    fetched = stored_pages(spark, sf).select(
        F.when(F.col("page_no") % 2 == 0, "Arriendo").otherwise("Venta").alias("operation"),
        F.element_at(kinds, (F.col("page_no") % 3 + 1).cast("int")).alias("property"), "value")
    asked = fetched.select("operation", "property").distinct().withColumn("position", F.array_position(kinds, F.col("property")))
    return fetched, asked


@query
def ingest_run(spark, sf):
    fetched, asked = _pages_and_requests(spark, sf)
    found = ingest_listings(fetched, asked, scratch(spark, "target"))
    return rounded(found, 4, "mean_price").select("property", "operation", "pages_success", "pages_failed", "total_properties", "mean_price", "previous_timestamp")


@query
def end_to_end(spark, sf):
    fetched, asked = _pages_and_requests(spark, sf)
    path = scratch(spark, "end")
    cfg = JobConfig(f"{path}/listings", f"{path}/models", f"{path}/signatures", "elastic_net",
                    training={"params": QUICK["elastic_net"]})
    done = run_end_to_end(spark, fetched, asked, cfg)
    return done.trained.metrics.withColumn("version", F.lit(done.version))


@query
def quantiles_of_prices(spark, sf):
    found = quantiles(listings(spark, sf), ["PRICE"], [0.0, 0.25, 0.5, 0.75, 1.0], ["PROPERTY_TYPE"])
    spread = [F.round(F.element_at("quantiles", i + 1), 4).alias(f"q{i}") for i in range(5)]
    return found.select("PROPERTY_TYPE", "n", *spread)
