"""Columns of the caller that bear an operator's own names, null keys, sizes."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.llm import bitsliced, decontaminate, lshforest, mixing, quality, sharding, spans

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
OWN = ["rate", "_source", "_k", "_key", "_place", "_hash", "_prefix", "_cell", "_d", "_p", "_over", "_part", "_i", "_t", "_drop", "_s", "_gone", "_id", "_th",
       "_text", "_at", "at", "h1", "h2", "first", "copies", "weight", "n", "bytes", "prefix", "cell", "_own0_rate", "item", "terms", "term", "pos"]
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def wide(spark):
    passage = "The first sentence is here. The second one follows it now. A third ends it."
    rows = [(1, passage, "en", "a", 1), (2, passage + " More of it.", "en", "a", 1), (3, "x " + ITEM, "en", "b", 1), (4, None, "en", None, 1)]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(f"own {c}").alias(c) for c in OWN])


def check(wide, got, added=()):
    assert got.columns == [*wide.columns, *added]
    rows = got.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in OWN)
    return rows


def test_own_columns_stay(spark, wide):
    check(wide, mixing.poisson_mix(wide, mixing.tempered_weights(wide), rows=60), ["copy"])
    check(wide, sharding.shard_rows(wide, limit=60), ["n_bytes", "shard", "depth", "page"])
    assert len(check(wide, spans.remove_repeats(wide), ["n_sentences", "n_removed"])) == 4
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert {r.doc_id for r in check(wide, decontaminate.clean_documents(wide, items))} == {1, 2, 4}
    assert len(check(wide, lshforest.keep_one(wide))) == 4


def test_own_columns_stay_in_the_quality_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[F.lit(f"own {c}").alias(c) for c in OWN])
    check(docs, quality.keep_good(docs, spark.read.parquet(f"{sf}/labels.parquet")))


def test_rows_without_key_draw_apart(spark):
    docs = spark.range(2000).selectExpr("cast(null AS bigint) AS doc_id", "concat('text ', id) AS text", "'a' AS source")
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    got = mixing.poisson_mix(docs, weights, rows=1000).count()
    assert 850 < got < 1150


def test_large_components_are_exact_or_refused(spark):
    rows = [(0, [300_000.0, -1.0]), (1, [300_000.0, 2.0]), (2, [-5.5, 1e6])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    got = {(r.query_id, r.vec_id): r.score for r in bitsliced.topk(df, df, 2).collect()}
    assert got == {(a, b): sum(x * y for x, y in zip(whole[a], whole[b])) for a in whole for b in whole if a != b}
    far = spark.createDataFrame([(0, [1e12]), (1, [1e12])], df.schema)
    with pytest.raises(Exception, match="leave 64 bits"):
        bitsliced.topk(far, far, 1).collect()


def test_long_repeats_are_removed_in_linear_time(spark):
    text = " ".join(f"Sentence number {i} has these eight words inside." for i in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (None, text)], "doc_id bigint, text string")
    got = spans.remove_repeats(docs).collect()
    assert sorted((r.doc_id or 99, r.n_removed, r.text == text) for r in got) == [(1, 0, True), (2, 30_000, False), (2, 30_000, False), (99, 30_000, False)]


def test_split_buckets_equal_sql(spark, sf):
    limit = 20_000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = {(r[0], r[1], r[2]) for r in con.execute(f"SELECT doc_id, shard, depth FROM ({sharding.shard_sql(limit)})").fetchall()}
    got = {(r.doc_id, r.shard, r.depth) for r in sharding.shard_rows(spark.read.parquet(f"{sf}/documents.parquet"), limit=limit).collect() if r.depth < 60}
    assert len({s for _, s, _ in got}) > 20 and len({d for _, _, d in got}) > 2
    assert got <= want and {i for i, _, _ in want} == {i for i, _, _ in got}
