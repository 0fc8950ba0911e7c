"""The same queries in SQL, for a check against DuckDB."""

from __future__ import annotations

from ..fixtures import LISTINGS_SQL, POINTS_SQL
from ..schema import ANTIQUITY_LABELS, CAPPED_FIELDS, LINK_PREFIX, OPERATION_LABELS, PROPERTY_LABELS, SOURCE_NAME

LISTINGS = f"listings AS ({LISTINGS_SQL.format(orders='orders')})"
POINTS = f"points AS ({POINTS_SQL.format(embeddings='embeddings')})"
APARTMENT = "PROPERTY_TYPE IN ('Apartamento', 'Apartaestudio')"
# COALESCE: a rule on a missing value does not hold.
BAD = (
    f"(COALESCE(FLOOR = 202, FALSE) OR COALESCE(STRATUM = 101, FALSE) OR COALESCE({APARTMENT} AND AREA <= 0, FALSE)"
    f" OR COALESCE({APARTMENT} AND AREA > 400, FALSE) OR COALESCE({APARTMENT} AND PRICE < 100000, FALSE)"
    f" OR COALESCE({APARTMENT} AND PRICE > 20000000, FALSE))"
)
SPLIT_PART = """CASE WHEN ('0x' || substr(md5('42|' || COALESCE(CAST(row_id AS VARCHAR), '')), 1, 8))::BIGINT % 10000 < 2000
  THEN 'test' ELSE 'train' END"""
GOOD_TRAINING = (
    f"FLOOR <> 202 AND STRATUM <> 101 AND (NOT COALESCE({APARTMENT}, FALSE)"
    " OR (AREA > 0 AND AREA < 400 AND PRICE > 100000 AND PRICE < 20000000))"
)
NUMERIC = "AREA BUILT_AREA PRIVATE_AREA LATITUDE LONGITUDE FLOOR ROOMS BATHROOMS GARAGE STRATUM BEDROOMS".split()
FEATURES = ["PRICE", *NUMERIC, "ANTIQUITY", "PROPERTY_TYPE"]
METRICS = """
  ROUND(AVG(ABS(y_true - y_pred) / GREATEST(ABS(y_true), 2.220446049250313e-16)), 5) AS MAPE,
  ROUND(quantile_cont(ABS(y_true - y_pred) / ABS(y_true), 0.5), 5) AS MDAPE,
  ROUND(1 - AVG((y_true - y_pred) * (y_true - y_pred)) / VAR_POP(y_true), 5) AS R2,
  ROUND(1 - VAR_POP(y_true - y_pred) / VAR_POP(y_true), 5) AS explained_variance,
  ROUND(AVG(ABS(y_true - y_pred)), 5) AS MAE,
  ROUND(SQRT(AVG((y_true - y_pred) * (y_true - y_pred))), 5) AS RMSE,
  ROUND(AVG(y_true - y_pred), 5) AS mean_residual, ROUND(STDDEV_POP(y_true - y_pred), 5) AS std_residual,
  ROUND(MAX(ABS(y_true - y_pred)), 5) AS max_error"""
PREDICTIONS = """predictions AS (
  SELECT 'discounted' AS model, CASE WHEN l_linestatus = 'O' THEN 'Test' ELSE 'Training' END AS "Set",
         l_extendedprice AS y_true, l_extendedprice * (1 - l_discount) AS y_pred FROM lineitem
  UNION ALL
  SELECT 'taxed', CASE WHEN l_linestatus = 'O' THEN 'Test' ELSE 'Training' END,
         l_extendedprice, l_extendedprice * (1 + l_tax) FROM lineitem)"""


def _case(code: str, labels: dict[int, str]) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items())
    return f"CASE {code} {whens} END"


def _uuid(text: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({text}))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


def _limits(source: str, columns: list[str], by: str, q: float = 0.99) -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, '{c}' AS field, COUNT({c}) AS n, ROUND(quantile_cont({c}, {q}), 4) AS \"limit\""
        f" FROM {source} GROUP BY {by} HAVING COUNT({c}) > 0" for c in columns)


def _capped(source: str, columns: list[str], by: list[str], keep: str, q: float = 0.99) -> str:
    """Negatives to 0, then the group's quantile as the upper bound."""
    keys = ", ".join(by)
    limits = ", ".join(f"quantile_cont({c}, {q}) AS lim_{c}" for c in columns)
    raised = lambda c: f"CASE WHEN s.{c} < 0 THEN 0.0 ELSE s.{c} END"
    values = ", ".join(
        f"ROUND(CASE WHEN {raised(c)} > lim_{c} THEN lim_{c} ELSE {raised(c)} END, 4) AS {c}" for c in columns)
    same = " AND ".join(f"s.{b} IS NOT DISTINCT FROM g.{b}" for b in by)
    return f"""SELECT {keep}{values} FROM {source} s
      JOIN (SELECT {keys}, {limits} FROM {source} GROUP BY {keys}) g ON {same}"""


def _report(columns: list[str], scale: int, views: str = LISTINGS, source: str = "listings") -> str:
    raised = lambda c: f"CASE WHEN s.{c} < 0 THEN 0.0 ELSE s.{c} END"
    parts = [
        f"""SELECT s.OPERATION_TYPE, s.PROPERTY_TYPE, '{c}' AS field, ROUND_EVEN(MAX(lim), {scale}) AS p99,
              COUNT(*) FILTER (WHERE s.{c} < 0) AS negatives_fixed,
              COUNT(*) FILTER (WHERE {raised(c)} > lim) AS capped_above_p99
            FROM {source} s JOIN (SELECT OPERATION_TYPE AS o, PROPERTY_TYPE AS p, quantile_cont({c}, 0.99) AS lim
                                  FROM {source} GROUP BY 1, 2) ON s.OPERATION_TYPE = o AND s.PROPERTY_TYPE IS NOT DISTINCT FROM p
            GROUP BY 1, 2""" for c in columns]
    return f"WITH {views} " + " UNION ALL ".join(parts)


def _profile(source: str, columns: list[str], by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    points = [("p1", .01), ("p5", .05), ("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9), ("p95", .95), ("p99", .99)]
    return " UNION ALL ".join(
        f"SELECT {key}'{c}' AS field, COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std,"
        f" ROUND(MIN({c}), 4) AS min, ROUND(MAX({c}), 4) AS max, "
        + ", ".join(f"ROUND(quantile_cont({c}, {p}), 4) AS {n}" for n, p in points)
        + f" FROM {source}{group}" for c in columns)


def _nulls() -> str:
    names = ("row_id SOURCE WEB_PROPERTY_CODE scraped_at PRICE AREA FLOOR STRATUM PROPERTY_TYPE OPERATION_TYPE BUILT_AREA "
             "PRIVATE_AREA GARAGE BATHROOMS ROOMS BEDROOMS LATITUDE LONGITUDE ANTIQUITY LINK").split()
    return f"WITH {LISTINGS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS field, COUNT(*) - COUNT({c}) AS nulls, ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 6) AS null_pct FROM listings"
        for c in names)


def _listing_columns() -> str:
    return f"""'{SOURCE_NAME}' AS SOURCE, CAST(o_orderkey AS VARCHAR) AS WEB_PROPERTY_CODE, o_totalprice AS PRICE,
      CAST(o_orderkey % 2 AS DOUBLE) AS PRICE_ADMIN_INCLUDED, CAST(20 + o_custkey % 420 AS DOUBLE) AS AREA,
      CASE WHEN o_orderkey % 10 <> 0 THEN CAST((o_orderkey % 90) || '.25' AS DOUBLE) END AS LATITUDE,
      CAST('-' || (o_custkey % 180) || '.5' AS DOUBLE) AS LONGITUDE,
      {_case('o_orderkey % 7', ANTIQUITY_LABELS)} AS ANTIQUITY, CAST(1950 + o_orderkey % 75 AS INT) AS CONSTRUCTION_YEAR,
      CAST(15 + o_custkey % 380 AS DOUBLE) AS BUILT_AREA,
      CASE WHEN o_orderkey % 3 <> 0 THEN CAST(10 + o_custkey % 300 AS DOUBLE) END AS PRIVATE_AREA,
      CAST(o_orderkey % 4 AS DOUBLE) AS GARAGE, CAST(1 + o_orderkey % 5 AS DOUBLE) AS BATHROOMS,
      CAST(1 + o_custkey % 6 AS DOUBLE) AS ROOMS, CAST(o_orderkey % 30 AS DOUBLE) AS FLOOR,
      {_case('o_orderkey % 21', PROPERTY_LABELS)} AS PROPERTY_TYPE, {_case('1 + o_orderkey % 3', OPERATION_LABELS)} AS OPERATION_TYPE,
      CAST(1 + o_orderkey % 6 AS DOUBLE) AS STRATUM, CAST(1 + o_custkey % 5 AS DOUBLE) AS BEDROOMS,
      ' Listing' || chr(10) || chr(10) || ' of' || chr(160) || o_orderpriority || chr(8203) AS DESCRIPTION,
      '{LINK_PREFIX}/listing/' || o_orderkey AS LINK"""


def _on_listings(body: str) -> str:
    return f"WITH {LISTINGS} {body}"


BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
KEYS = "SOURCE, WEB_PROPERTY_CODE"
CLEANED = f"""{LISTINGS}, kept AS (SELECT * FROM listings WHERE NOT {BAD})"""
LATEST = f"""{LISTINGS}, latest AS (SELECT * FROM listings QUALIFY ROW_NUMBER() OVER
  (PARTITION BY {KEYS} ORDER BY scraped_at DESC NULLS LAST, row_id DESC) = 1)"""
DUPLICATES = f"SELECT {KEYS}, COUNT(*) AS count, MAX(scraped_at) AS latest_scrape FROM listings GROUP BY {KEYS} HAVING COUNT(*) > 1"
QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
FIELD_LIST = ", ".join(FEATURES)


def _wide(v: str) -> str:
    return f"CAST({v} AS DOUBLE[])"


def _histogram(column: str, bins: str) -> str:
    """Equal-width bins; ``bins`` is an expression over lo, hi, n, q1, q3."""
    return _on_listings(f""", v AS (SELECT {column} AS v FROM listings WHERE {column} IS NOT NULL),
      e AS (SELECT MIN(v) AS lo, MAX(v) AS hi, COUNT(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v),
      b AS (SELECT lo, hi, CAST({bins} AS INT) AS bins FROM e), w AS (SELECT lo, bins, (hi - lo) / bins AS width FROM b),
      c AS (SELECT LEAST(CAST(FLOOR((v - lo) / width) AS INT), bins - 1) AS bin, COUNT(*) AS count FROM v, w GROUP BY 1),
      every AS (SELECT UNNEST(range(bins))::INT AS bin, lo, width FROM w)
      SELECT every.bin, ROUND(lo + every.bin * width, 4) AS lower, ROUND(lo + (every.bin + 1) * width, 4) AS upper,
        COALESCE(count, 0) AS count FROM every LEFT JOIN c ON c.bin = every.bin""")


ORACLE: dict[str, str] = {
    "flatten_listings": f"SELECT {_listing_columns()} FROM orders",
    "total_hits": "SELECT o_orderkey // 32 AS page_no, COUNT(*) AS total_hits FROM orders GROUP BY 1",
    "total_hits_of_events": "SELECT event_id, -1 AS total_hits, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "page_list": """SELECT o_custkey, UNNEST(range(1, 1 + CAST(CEIL(n / 4.0) AS BIGINT))) AS page_no
      FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1)""",
    "collection_scan": _on_listings("SELECT * EXCLUDE (row_id, scraped_at, LINK, LATITUDE, LONGITUDE) FROM listings"),
    "csv_round_trip": _on_listings("SELECT row_id, PRICE, PROPERTY_TYPE, ANTIQUITY FROM listings"),
    "source_fallback": _on_listings("SELECT row_id, PRICE, AREA, 'properties_1.csv' AS source FROM listings"),
    "append_rows": _on_listings("SELECT row_id, PRICE, OPERATION_TYPE FROM listings"),
    "insert_if_absent": _on_listings(""", first AS (SELECT WEB_PROPERTY_CODE, row_id, STRATUM, OPERATION_TYPE FROM listings WHERE STRATUM = 1
        QUALIFY ROW_NUMBER() OVER (PARTITION BY WEB_PROPERTY_CODE ORDER BY row_id) = 1)
      SELECT * FROM first UNION ALL
      SELECT WEB_PROPERTY_CODE, row_id, STRATUM, OPERATION_TYPE FROM listings
      WHERE WEB_PROPERTY_CODE NOT IN (SELECT WEB_PROPERTY_CODE FROM first)
      QUALIFY ROW_NUMBER() OVER (PARTITION BY WEB_PROPERTY_CODE ORDER BY row_id) = 1"""),
    "upsert_points": f"""WITH {POINTS} SELECT row_id, PROPERTY_TYPE, CASE PROPERTY_TYPE WHEN 'Casa' THEN PRICE * 2 ELSE PRICE END AS PRICE FROM points
      UNION ALL SELECT -1 - row_id, PROPERTY_TYPE, PRICE FROM points WHERE PROPERTY_TYPE = 'Local'""",
    "scan_points": f"WITH {POINTS} SELECT row_id, PRICE, PROPERTY_TYPE FROM points",
    "project_fields": _on_listings("SELECT row_id, PRICE, AREA, ROOMS, BATHROOMS, LINK, PROPERTY_TYPE FROM listings"),
    "select_features": _on_listings(f"SELECT {FIELD_LIST} FROM listings"),
    "decode_labels": f"""SELECT p_partkey, p_size AS property_type_id, p_size % 4 AS operation_type_id, p_size % 7 AS antiquity_id,
      {_case('p_size', PROPERTY_LABELS)} AS PROPERTY_TYPE, {_case('p_size % 4', OPERATION_LABELS)} AS OPERATION_TYPE,
      {_case('p_size % 7', ANTIQUITY_LABELS)} AS ANTIQUITY FROM part""",
    "stamp_batch": "SELECT o_orderkey, o_orderdate AS scraped_at, strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') AS batch_id FROM orders",
    "search_filter": _on_listings("""SELECT row_id, PRICE, AREA FROM listings WHERE OPERATION_TYPE = 'Arriendo'
      AND PROPERTY_TYPE = 'Apartamento' AND PRICE >= 0 AND PRICE <= 20000000 AND AREA >= 60"""),
    "within_ranges": _on_listings("""SELECT row_id, BUILT_AREA, GARAGE, BATHROOMS, ROOMS FROM listings WHERE BUILT_AREA BETWEEN 30 AND 60
      AND GARAGE BETWEEN 2 AND 3 AND BATHROOMS BETWEEN 2 AND 3 AND ROOMS BETWEEN 2 AND 3"""),
    "drop_erroneous": _on_listings(f"SELECT row_id, PRICE, AREA, FLOOR, STRATUM, PROPERTY_TYPE FROM listings WHERE NOT {BAD}"),
    "erroneous_report": _on_listings(f"SELECT OPERATION_TYPE, COUNT(*) FILTER (WHERE {BAD}) AS deleted FROM listings GROUP BY 1"),
    "training_rows": _on_listings(f"SELECT row_id, {FIELD_LIST} FROM listings WHERE {GOOD_TRAINING} AND "
                                  + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)),
    "training_rows_fill_first": _on_listings(f""", filled AS (SELECT * REPLACE (COALESCE(ANTIQUITY, 'No se sabe') AS ANTIQUITY,
        COALESCE(PROPERTY_TYPE, 'No se sabe') AS PROPERTY_TYPE) FROM listings)
      SELECT row_id, {FIELD_LIST} FROM filled WHERE {GOOD_TRAINING} AND """ + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)),
    "drop_incomplete": _on_listings("""SELECT row_id, PRICE, ROOMS FROM listings
      WHERE PRICE IS NOT NULL AND ROOMS IS NOT NULL AND PROPERTY_TYPE IS NOT NULL"""),
    "numeric_fields": r"""SELECT page_id, tail, TRY_CAST(tail AS DOUBLE) AS number FROM
      (SELECT page_id, regexp_extract(url, '/([^/?#]*)[?#]?[^/]*$', 1) AS tail FROM pages) WHERE regexp_full_match(tail, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)')""",
    "trim_columns": _on_listings(""", v AS (SELECT row_id, AREA, PRICE FROM listings WHERE AREA IS NOT NULL AND PRICE IS NOT NULL),
      q AS (SELECT quantile_cont(AREA, 0.1) AS a, quantile_cont(AREA, 0.9) AS b, quantile_cont(PRICE, 0.95) AS c FROM v)
      SELECT v.* FROM v, q WHERE AREA BETWEEN a AND b AND PRICE <= c"""),
    "drop_null_columns": "SELECT * FROM customer",
    "cascade_delete": f"""WITH {LISTINGS}, {POINTS} SELECT row_id, label FROM points
      WHERE row_id NOT IN (SELECT row_id FROM listings WHERE {BAD})""",
    "union_listings": _on_listings("""SELECT row_id, PRICE, GARAGE, NULL::DOUBLE AS ROOMS FROM listings WHERE OPERATION_TYPE = 'Arriendo'
      UNION ALL SELECT row_id, PRICE, NULL::DOUBLE, ROOMS FROM listings WHERE OPERATION_TYPE = 'Venta'"""),
    "market_stats": _on_listings("""SELECT o.op AS OPERATION_TYPE, COUNT(l.row_id) AS total_properties,
        CASE WHEN COUNT(l.row_id) = 0 THEN 0.0 ELSE ROUND(AVG(PRICE), 4) END AS avg_price,
        CASE WHEN COUNT(l.row_id) = 0 THEN 0.0 ELSE ROUND(AVG(AREA), 4) END AS avg_area
      FROM (VALUES ('Arriendo'), ('Venta'), ('Permuta')) o(op) LEFT JOIN listings l ON l.OPERATION_TYPE = o.op GROUP BY 1"""),
    "dashboard_summary": _on_listings("""SELECT COUNT(*) AS total_properties,
        CAST(FLOOR(AVG(PRICE) FILTER (WHERE OPERATION_TYPE = 'Venta') / 1000000 + 0.5) AS BIGINT) AS sale_price_millions,
        CAST(FLOOR(AVG(PRICE) FILTER (WHERE OPERATION_TYPE = 'Arriendo') / 1000 + 0.5) AS BIGINT) AS rent_price_thousands,
        CAST(FLOOR(AVG(AREA) FILTER (WHERE OPERATION_TYPE = 'Venta') + 0.5) AS BIGINT) AS sale_area FROM listings"""),
    "price_by_group": f"""WITH {CLEANED} SELECT PROPERTY_TYPE, ROUND(AVG(PRICE), 4) AS avg_price, COUNT(*) AS count,
      MIN(PRICE) AS min_price, MAX(PRICE) AS max_price FROM kept GROUP BY 1 ORDER BY AVG(PRICE) DESC NULLS LAST""",
    "duplicate_groups": _on_listings(DUPLICATES),
    "duplicate_members": _on_listings(f", d AS ({DUPLICATES}) SELECT l.SOURCE, l.WEB_PROPERTY_CODE, l.row_id, d.count, d.latest_scrape"
                                      " FROM listings l JOIN d ON l.SOURCE = d.SOURCE AND l.WEB_PROPERTY_CODE = d.WEB_PROPERTY_CODE"),
    "dedup_report": _on_listings(f", d AS ({DUPLICATES}) SELECT CAST(COALESCE(SUM(count - 1), 0) AS BIGINT) AS deleted_count, COUNT(*) AS groups_processed FROM d"),
    "dedup_latest": f"WITH {LATEST} SELECT row_id, SOURCE, WEB_PROPERTY_CODE, scraped_at, PRICE FROM latest",
    "group_limits": _on_listings(_limits("listings", ["PRICE", *CAPPED_FIELDS], "OPERATION_TYPE, PROPERTY_TYPE")),
    "group_limits_lineitem": _limits("lineitem", ["l_extendedprice", "l_quantity"], "l_returnflag, l_linestatus"),
    "group_limits_by_cells": _limits("lineitem", ["l_extendedprice", "l_quantity"], "l_returnflag, l_linestatus"),
    "capping_report": _report(["PRICE"], 0),
    "capping_report_fields": _report(CAPPED_FIELDS, 2),
    "cap_prices": _on_listings(_capped("listings", ["PRICE"], ["OPERATION_TYPE", "PROPERTY_TYPE"], "s.row_id, s.OPERATION_TYPE, s.PROPERTY_TYPE, ")),
    "cap_numeric_fields": _on_listings(_capped("listings", CAPPED_FIELDS, ["OPERATION_TYPE", "PROPERTY_TYPE"], "s.row_id, ")),
    "cap_balances": _capped("customer", ["c_acctbal"], ["c_mktsegment"], "s.c_custkey, s.c_name, s.c_nationkey, s.c_mktsegment, ", 0.95),
    "scrape_signature": """WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'Arriendo' ELSE 'Venta' END AS operation, event_type AS property,
        CASE WHEN user_id % 5 = 0 THEN 'click' ELSE event_type END AS kind, value FROM events),
      asked AS (SELECT DISTINCT operation, property FROM e)
      SELECT '2024-01-01_00-00-00' AS timestamp, a.property, a.operation,
        (SELECT COUNT(*) FROM e WHERE e.operation = a.operation AND e.property = a.property AND value > 1) AS pages_success,
        (SELECT COUNT(*) FROM e WHERE e.operation = a.operation AND e.property = a.property AND NOT value > 1) AS pages_failed,
        (SELECT ROUND(100.0 * COUNT(*) FILTER (WHERE value > 1) / COUNT(*), 6) FROM e WHERE e.operation = a.operation AND e.property = a.property) AS success_rate,
        (SELECT COUNT(*) FROM e WHERE e.operation = a.operation AND e.property <= a.property AND kind = a.property) AS total_properties,
        (SELECT ROUND(AVG(value), 6) FROM e WHERE e.operation = a.operation AND e.property <= a.property AND kind = a.property) AS mean_price
      FROM asked a""",
    "compare_signatures": """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS timestamp, event_type AS property,
        CASE WHEN user_id % 2 = 0 THEN 'Arriendo' ELSE 'Venta' END AS operation, COUNT(*) AS total_properties,
        AVG(value) AS mean_price, COUNT(*) FILTER (WHERE value > 1) * 100.0 / COUNT(*) AS success_rate
        FROM events GROUP BY 1, 2, 3)
      SELECT timestamp, property, operation, total_properties, ROUND(mean_price, 6) AS mean_price, ROUND(success_rate, 6) AS success_rate,
        LAG(timestamp) OVER w AS previous_timestamp, total_properties - LAG(total_properties) OVER w AS total_properties_change,
        ROUND(mean_price - LAG(mean_price) OVER w, 6) AS mean_price_change,
        ROUND(success_rate - LAG(success_rate) OVER w, 6) AS success_rate_change
      FROM d WINDOW w AS (PARTITION BY operation, property ORDER BY timestamp)""",
    "row_counts": _on_listings("SELECT OPERATION_TYPE, COUNT(*) AS total, COUNT(*) FILTER (WHERE PROPERTY_TYPE = 'Casa') AS matching FROM listings GROUP BY 1"),
    "distinct_values": _on_listings("SELECT DISTINCT PROPERTY_TYPE FROM listings"),
    "value_counts": _on_listings("SELECT ANTIQUITY, COUNT(*) AS count FROM listings GROUP BY 1"),
    "null_profile": _nulls(),
    "numeric_profile": _on_listings(_profile("listings", ["PRICE", "AREA", "ROOMS"])),
    "numeric_profile_lineitem": _profile("lineitem", ["l_extendedprice", "l_discount"], "l_returnflag"),
    "removal_report": _on_listings(f""", filled AS (SELECT * REPLACE (COALESCE(ANTIQUITY, 'x') AS ANTIQUITY,
        COALESCE(PROPERTY_TYPE, 'x') AS PROPERTY_TYPE) FROM listings),
      c AS (SELECT (SELECT COUNT(*) FROM listings) AS a, (SELECT COUNT(*) FROM filled WHERE {GOOD_TRAINING} AND """
        + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES) + ") AS b) SELECT a - b AS removed, ROUND((a - b) * 100.0 / a, 6) AS removed_pct FROM c"),
    "histogram": _histogram("PRICE", "20"),
    "histogram_auto": _histogram("AREA", "CEIL((hi - lo) / LEAST((hi - lo) / (log2(n) + 1), GREATEST(2 * (q3 - q1) / pow(n, 1 / 3.0), (hi - lo) / sqrt(n) / 2)))"),
    "log_quantiles": _on_listings("""SELECT PROPERTY_TYPE, COUNT(*) AS count, ROUND(MIN(LN(PRICE)), 6) AS min, ROUND(quantile_cont(LN(PRICE), 0.25), 6) AS q1,
      ROUND(quantile_cont(LN(PRICE), 0.5), 6) AS median, ROUND(quantile_cont(LN(PRICE), 0.75), 6) AS q3, ROUND(MAX(LN(PRICE)), 6) AS max
      FROM listings WHERE PRICE > 0 GROUP BY 1"""),
    "quantiles_of_prices": _on_listings("SELECT PROPERTY_TYPE, COUNT(PRICE) AS n, "
        + ", ".join(f"ROUND(quantile_cont(PRICE, {p}), 4) AS q{i}" for i, p in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))) + " FROM listings GROUP BY 1"),
    "regression_metrics": f"WITH {PREDICTIONS} SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE y_true = 0) AS zero_truth, {METRICS} FROM predictions WHERE model = 'discounted'",
    "compare_models": f'WITH {PREDICTIONS} SELECT model, "Set", COUNT(*) AS n, COUNT(*) FILTER (WHERE y_true = 0) AS zero_truth, {METRICS} FROM predictions GROUP BY 1, 2',
    "best_model": f"""WITH {PREDICTIONS} SELECT model, "Set", ROUND(quantile_cont(ABS(y_true - y_pred) / ABS(y_true), 0.5), 6) AS MDAPE
      FROM predictions WHERE "Set" = 'Test' GROUP BY 1, 2 ORDER BY quantile_cont(ABS(y_true - y_pred) / ABS(y_true), 0.5), model LIMIT 1""",
    "vector_topk": f"""WITH {POINTS} SELECT row_id, ROUND(list_cosine_similarity({_wide('embedding')}, {_wide(QUERY_VECTOR)}), 6) AS score, PRICE, AREA, PROPERTY_TYPE
      FROM points WHERE PROPERTY_TYPE = 'Casa' AND PRICE BETWEEN 200000 AND 1800000 AND AREA >= 40
      ORDER BY list_cosine_similarity({_wide('embedding')}, {_wide(QUERY_VECTOR)}) DESC, row_id LIMIT 10""",
    "vector_topk_ranges": f"""WITH {POINTS} SELECT row_id, ROUND(list_dot_product({_wide('embedding')}, {_wide(QUERY_VECTOR)}), 6) AS score
      FROM points WHERE PRICE BETWEEN 100000 AND 1500000 AND ROOMS BETWEEN 1 AND 4 AND GARAGE BETWEEN 0 AND 2
      ORDER BY list_dot_product({_wide('embedding')}, {_wide(QUERY_VECTOR)}) DESC, row_id LIMIT 12""",
    "split_rows": _on_listings(f"SELECT row_id, {SPLIT_PART} AS part FROM listings"),
    "prepared_bundle": _on_listings(f"SELECT {SPLIT_PART} AS part, COUNT(*) AS rows FROM listings WHERE {GOOD_TRAINING} AND "
                                    + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES) + " GROUP BY 1"),
    "vector_topk_batch": f"""WITH s AS (SELECT q.vec_id AS query_id, p.vec_id AS row_id,
        list_cosine_similarity({_wide('p.embedding')}, {_wide('q.embedding')}) AS score FROM embeddings q CROSS JOIN embeddings p),
      r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s)
      SELECT query_id, row_id, CAST(rank AS INT) AS rank, ROUND(score, 5) AS score FROM r WHERE rank <= 5""",
    "indexed_search": "SELECT vec_id AS query_id, CAST(1 AS DOUBLE) AS top_score, TRUE AS recall_reached FROM embeddings WHERE vec_id % 50 = 0",
    "filtered_first": _on_listings("SELECT row_id, PRICE, AREA FROM listings WHERE PROPERTY_TYPE = 'Apartamento' AND PRICE <= 20000000 ORDER BY row_id LIMIT 10"),
    "first_points": "SELECT vec_id AS row_id FROM embeddings ORDER BY vec_id LIMIT 3",
    "extreme_rows": _on_listings("""SELECT OPERATION_TYPE, MIN(PRICE) AS min_value, arg_min(row_id, (PRICE, row_id)) AS min_id,
      MAX(PRICE) AS max_value, arg_max(row_id, (PRICE, row_id)) AS max_id FROM listings WHERE PRICE IS NOT NULL GROUP BY 1"""),
    "vector_math": f"""WITH o AS (SELECT vec_id, {_wide('embedding')} AS a, {_wide('list_reverse(embedding)')} AS b FROM embeddings)
      SELECT vec_id, ROUND(list_dot_product(a, b), 6) AS dot, ROUND(list_cosine_similarity(a, b), 6) AS cosine,
        ROUND(SQRT(list_dot_product(a, a)), 6) AS norm FROM o""",
    "validate_vectors": """SELECT COUNT(*) AS total, COUNT(*) - COUNT(embedding) AS missing, COUNT(*) FILTER (WHERE len(embedding) <> 64) AS wrong_width,
      COUNT(*) FILTER (WHERE list_aggregate(embedding, 'count') < len(embedding)) AS null_entries,
      COUNT(*) FILTER (WHERE list_aggregate(embedding, 'max') = 0 AND list_aggregate(embedding, 'min') = 0) AS all_zero,
      COUNT(*) FILTER (WHERE len(embedding) = 64 AND list_aggregate(embedding, 'count') = 64
        AND NOT (list_aggregate(embedding, 'max') = 0 AND list_aggregate(embedding, 'min') = 0)) AS valid FROM embeddings""",
    "flatten_vectors": "SELECT vec_id, CAST(len(embedding) AS INT) AS width, CAST(embedding[1] AS DOUBLE) AS first_value FROM embeddings",
    "normalize_texts": f"SELECT doc_id, trim(regexp_replace(text, '{BLANKS}', ' ', 'g'), ' ') AS text FROM documents",
    "listing_ids": f"SELECT page_id, {_uuid('url')} AS _id FROM pages",
    "coerce_numbers": """SELECT o_orderkey, ROUND(CASE o_orderkey % 6 WHEN 0 THEN o_totalprice WHEN 2 THEN o_totalprice WHEN 3 THEN o_totalprice * 100 END, 2) AS number FROM orders""",
    "repair_links": _on_listings("SELECT row_id, replace(LINK, 'ficnaraiz', 'fincaraiz') AS LINK FROM listings"),
    "absolute_links": _on_listings("SELECT row_id, CASE WHEN starts_with(LINK, 'http') THEN LINK ELSE 'https://' || LINK END AS LINK FROM listings"),
    "display_defaults": _on_listings("SELECT row_id, COALESCE(NULLIF(PROPERTY_TYPE, ''), 'Propiedad') AS PROPERTY_TYPE FROM listings"),
    "fill_categories": _on_listings("""SELECT row_id, COALESCE(ANTIQUITY, 'No se sabe') AS ANTIQUITY, COALESCE(PROPERTY_TYPE, 'No se sabe') AS PROPERTY_TYPE,
      COALESCE(ROOMS, 999) AS ROOMS FROM listings"""),
    "clip_above": """SELECT l_orderkey, l_linenumber, l_partkey, ROUND(LEAST(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem)), 4)
      AS l_extendedprice FROM lineitem""",
    "log_columns": _on_listings("""SELECT row_id, ROUND(LN(1 + PRICE), 8) AS log1p, ROUND(LN(PRICE), 8) AS ln, ROUND(PRICE, 2) AS expm1 FROM listings WHERE PRICE > 0"""),
    "scoring_input": _on_listings("""SELECT row_id, CAST(ROOMS AS INT) AS ROOMS, COALESCE(BUILT_AREA, 0) AS BUILT_AREA, CAST(0 AS DOUBLE) AS PRIVATE_AREA,
      CAST(FLOOR AS DOUBLE) AS FLOOR, STRATUM FROM listings WHERE AREA IS NOT NULL AND ROOMS IS NOT NULL AND BATHROOMS IS NOT NULL
      AND STRATUM IS NOT NULL AND ANTIQUITY IS NOT NULL AND PROPERTY_TYPE IS NOT NULL"""),
    "impute_and_scale": _on_listings(", f AS (SELECT row_id, " + ", ".join(
        f"COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM listings)) AS {c}" for c in ("ROOMS", "BUILT_AREA", "PRICE"))
        + " FROM listings) SELECT row_id, " + ", ".join(
        f"ROUND(({c} - (SELECT AVG({c}) FROM f)) / (SELECT STDDEV_POP({c}) FROM f), 6) AS {c}_scaled" for c in ("ROOMS", "BUILT_AREA", "PRICE"))
        + " FROM f"),
    "scoring_rejects": _on_listings(f""", q AS (SELECT row_id, concat_ws('; ', {", ".join(f"CASE WHEN {c} IS NULL THEN '{c} is missing' END" for c in
        ("AREA", "LATITUDE", "LONGITUDE"))}, CASE WHEN row_id % 7 = 0 THEN 'ROOMS is not a whole number: many' WHEN row_id % 11 = 0 THEN
        'ROOMS is not a whole number: 2.5' WHEN ROOMS IS NULL THEN 'ROOMS is missing' END, {", ".join(f"CASE WHEN {c} IS NULL THEN '{c} is missing' END"
        for c in ("BATHROOMS", "STRATUM", "BEDROOMS", "ANTIQUITY", "PROPERTY_TYPE"))}) AS reasons FROM listings)
      SELECT row_id, reasons = '' AS accepted, reasons FROM q"""),
    "assembled_features": _on_listings(", f AS (SELECT row_id, ANTIQUITY, PROPERTY_TYPE, " + ", ".join(
        f"COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM listings)) AS {c}" for c in ("ROOMS", "BUILT_AREA", "PRICE"))
        + " FROM listings) SELECT row_id, " + ", ".join(
        f"ROUND(({c} - (SELECT AVG({c}) FROM f)) / (SELECT STDDEV_POP({c}) FROM f), 6) AS f{i}" for i, c in enumerate(("ROOMS", "BUILT_AREA", "PRICE")))
        + ", " + " || ".join(
        [f"CASE WHEN ANTIQUITY = '{v}' THEN '1' ELSE '0' END" for v in sorted(ANTIQUITY_LABELS.values())]
        + [f"CASE WHEN PROPERTY_TYPE = '{v}' THEN '1' ELSE '0' END" for v in sorted(("Casa", "Apartamento", "Apartaestudio", "Oficina", "Local", "Bodega"))])
        + " AS bits FROM f"),
    "embed_with_model": f"""WITH t AS (SELECT p_partkey, coalesce(trim(regexp_replace(p_name, '{BLANKS}', ' ', 'g'), ' '), '') AS t FROM part)
      SELECT p_partkey, CAST(length(t) AS DOUBLE) AS e0, CAST(length(t) - length(replace(t, 'a', '')) - 2 * (length(t) - length(replace(t, 'e', ''))) AS DOUBLE) AS e1,
        0.5 * (length(t) - length(replace(t, ' ', ''))) AS e2 FROM t""",
    "one_hot": _on_listings("SELECT row_id, " + " || ".join(
        [f"CASE WHEN ANTIQUITY = '{v}' THEN '1' ELSE '0' END" for v in sorted(ANTIQUITY_LABELS.values())]
        + [f"CASE WHEN PROPERTY_TYPE = '{v}' THEN '1' ELSE '0' END" for v in sorted(("Casa", "Apartamento", "Apartaestudio", "Oficina", "Local", "Bodega"))])
        + " AS bits FROM listings"),
    "target_round_trip": _on_listings(""", p AS (SELECT row_id, PRICE FROM listings WHERE PRICE > 0)
      SELECT row_id, ROUND(LEAST(PRICE, (SELECT quantile_cont(PRICE, 0.95) FROM p)), 1) AS restored FROM p"""),
    "stream_ingest": f"""SELECT {_uuid('CAST(o_orderkey AS VARCHAR)')} AS _id, CAST(o_orderkey AS VARCHAR) AS WEB_PROPERTY_CODE, o_totalprice AS PRICE,
      'Listing of ' || o_orderpriority AS DESCRIPTION, {_case('1 + o_orderkey % 3', OPERATION_LABELS)} AS OPERATION_TYPE FROM orders""",
    "clean_job": f"WITH {CLEANED} " + _capped("kept", ["PRICE", *CAPPED_FIELDS], ["OPERATION_TYPE", "PROPERTY_TYPE"], "s.row_id, "),
    "clean_job_removed": _on_listings(f"SELECT COUNT(*) FILTER (WHERE {BAD}) AS removed, ROUND(COUNT(*) FILTER (WHERE {BAD}) * 100.0 / COUNT(*), 6) AS removed_pct FROM listings"),
    "clean_job_capped": _report(["PRICE", *CAPPED_FIELDS], 2, CLEANED, "kept"),
    "clean_job_with_dedup": f"WITH {LATEST}, kept AS (SELECT * FROM latest WHERE NOT {BAD}) "
        + _capped("kept", ["PRICE", *CAPPED_FIELDS], ["OPERATION_TYPE", "PROPERTY_TYPE"], "s.row_id, "),
    "ingest_run": f"""WITH p AS (SELECT o_orderkey // 32 AS page_no, {_case('o_orderkey % 21', PROPERTY_LABELS)} AS kind, o_totalprice AS price FROM orders),
      e AS (SELECT CASE WHEN page_no % 2 = 0 THEN 'Arriendo' ELSE 'Venta' END AS operation, page_no, kind, price, page_no % 3 AS pos,
        CASE page_no % 3 WHEN 0 THEN 'Casa' WHEN 1 THEN 'Apartamento' ELSE 'Lote' END AS property FROM p),
      asked AS (SELECT operation, property, pos, COUNT(DISTINCT page_no) AS pages FROM e GROUP BY 1, 2, 3)
      SELECT a.property, a.operation, a.pages AS pages_success, 0 AS pages_failed,
        (SELECT COUNT(*) FROM e WHERE e.operation = a.operation AND e.pos <= a.pos AND kind = a.property) AS total_properties,
        (SELECT ROUND(AVG(price), 4) FROM e WHERE e.operation = a.operation AND e.pos <= a.pos AND kind = a.property) AS mean_price,
        NULL::VARCHAR AS previous_timestamp FROM asked a""",
}
