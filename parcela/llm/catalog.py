"""The registered queries of this subpackage and the same queries in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bitsliced, crf, decontaminate, fagin, linededup, lshforest, merkle, mixing, quality, sharding, spans, warc, wrapper

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SMALL_SHARD_BYTES = 32 << 10


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc_index_merge(spark, sf):
    # The table has no capture time: one page a second, in page order.
    captured = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1_600_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return warc.archive_pages(table(spark, sf, "pages"), captured)


@query
def op2_bit_sliced_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return bitsliced.topk(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query
def op3_benchmark_decontamination(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("_th")


@query
def op4_wrapper_induction(spark, sf):
    return wrapper.extract_pages(table(spark, sf, "pages"))


@query
def op5_sentence_spans(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spans.remove_repeats(docs)


@query
def op6_lsh_forest(spark, sf):
    return lshforest.near_duplicates(table(spark, sf, "documents"), words=2, percent=80)


@query
def op7_extendible_sharding(spark, sf):
    return sharding.shard_rows(table(spark, sf, "documents"))


@query
def shards_of_32_kib(spark, sf):
    # Small tables split to several depths as well, and hold texts above the limit.
    # The number of an overflow page depends on the input's partitions.
    rows = sharding.shard_rows(table(spark, sf, "documents"), limit=SMALL_SHARD_BYTES)
    return rows.withColumn("overflowed", F.col("page") > 0).drop("page")


@query
def op8_crf_language(spark, sf):
    return crf.identify(table(spark, sf, "documents"))


@query
def op9_weak_label_quality(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("_th")


@query
def op10_poisson_mixing(spark, sf):
    docs = table(spark, sf, "documents")
    return mixing.poisson_mix(docs, mixing.tempered_weights(docs))


@query
def op11_line_dedup(spark, sf):
    return linededup.digests(table(spark, sf, "documents"))


@query
def op12_merkle_manifest(spark, sf):
    return merkle.verified(table(spark, sf, "documents"), merkle.third_of_ids())


@query
def op13_threshold_hard_negatives(spark, sf):
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").withColumn("label", noisy)
    return fagin.mine(vectors, vectors.filter("vec_id % 100 = 0"))


ORACLE: dict[str, str] = {
    "op2_bit_sliced_topk": bitsliced.TOPK_SQL,
    "op3_benchmark_decontamination": decontaminate.DECONTAMINATE_SQL,
    "op5_sentence_spans": spans.SPANS_SQL,
    "op7_extendible_sharding": sharding.shard_sql(),
    "shards_of_32_kib": f"SELECT * EXCLUDE (page), page > 0 AS overflowed FROM ({sharding.shard_sql(SMALL_SHARD_BYTES)})",
    "op10_poisson_mixing": mixing.MIX_SQL,
    "op11_line_dedup": linededup.LINES_SQL,
    "op12_merkle_manifest": merkle.MERKLE_SQL,
    "op13_threshold_hard_negatives": fagin.MINE_SQL,
}
