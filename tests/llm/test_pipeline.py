"""The stages of the pipeline, one by one and together."""

import corpus_pipeline
from pyspark.sql import functions as F

from parcela.llm import decontaminate, lshforest, mixing, sharding

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_what_they_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality classifier"](spark, docs, sf)
    assert good.columns == COLUMNS
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, (q, t) in labels.items() if q == 1 and t == 0]
    bad = [i for i, (q, t) in labels.items() if q == 0 or t == 1]
    assert sum(i in kept for i in clean) > 0.97 * len(clean) and sum(i not in kept for i in bad) >= 0.8 * len(bad)

    one = {r.doc_id for r in stages["MinHash near-dedup"](spark, docs, sf).collect()}
    group = lshforest.brute_force(list(texts.items()), words=5, percent=80)
    assert one == {i for i in texts if group[i] == i}

    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").select(decontaminate.words_of(F.col("text")).alias("w")).collect() if (w := r.w)]
    windows = {" ".join(w[s:s + 10]) for w in items for s in range(max(1, len(w) - 9))}
    words = {r.doc_id: r.w for r in docs.select("doc_id", decontaminate.words_of(F.col("text")).alias("w")).collect()}
    sizes = {len(x.split(" ")) for x in windows}
    hit = {i for i, w in words.items() if any(" ".join(w[s:s + n]) in windows for n in sizes for s in range(len(w) - n + 1))}
    assert {r.doc_id for r in stages["benchmark decontamination"](spark, docs, sf).collect()} == set(texts) - hit and hit

    mixed = stages["mixing to target weights"](spark, docs, sf)
    assert mixed.columns == COLUMNS and mixed.exceptAll(mixing.poisson_mix(docs, mixing.tempered_weights(docs)).drop("copy")).count() == 0

    shards = stages["sharding"](spark, docs, sf)
    assert shards.count() == len(texts)
    places = shards.withColumn("part", F.spark_partition_id()).groupBy("shard", "page").agg(F.count_distinct("part").alias("n"))
    assert places.filter("n > 1").count() == 0


def test_partitions_follow_the_bytes(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "repeat('x', 1000) AS text")
    few = sharding.together(sharding.shard_rows(rows, limit=20_000), limit=20_000)
    assert few.rdd.getNumPartitions() == 40


def test_run_is_the_chain_of_its_stages(spark, sf):
    done = corpus_pipeline.run(spark, sf)
    assert done.columns == [*COLUMNS, "n_bytes", "shard", "depth", "page"]
    known = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = done.collect()
    assert rows and all(known[r.doc_id] == r.text for r in rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights", "sharding"]
