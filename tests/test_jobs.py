import json

from pyspark.sql import functions as F

from parcela.fixtures import stored_pages
from parcela.operators import joins
from parcela.plans import end_to_end
from parcela.plans.end_to_end import JobConfig, run_end_to_end
from parcela.plans.ingest import ingest_listings, prepare_listings
from parcela.session import materialize
from parcela.sources import sinks
from parcela.streaming.ingest import start_ingest, stream_pages
from test_pages import listing, page


def test_stream_equals_batch(spark, sf, tmp_path):
    base = str(tmp_path)
    stored_pages(spark, sf).select("value").repartition(4).write.text(f"{base}/in")
    for _ in range(2):
        # The second start finds nothing new; a lost state folder replays all files.
        feed = stream_pages(spark, f"{base}/in", files_per_batch=2)
        start_ingest(feed, f"{base}/out", f"{base}/state", embed=False).awaitTermination()
    feed = stream_pages(spark, f"{base}/in")
    start_ingest(feed, f"{base}/out", f"{base}/state2", embed=False).awaitTermination()
    columns = ["_id", "WEB_PROPERTY_CODE", "PRICE", "AREA", "OPERATION_TYPE", "DESCRIPTION", "LINK"]
    batch = prepare_listings(stored_pages(spark, sf), F.current_timestamp(), embed=False)
    stored = spark.read.parquet(f"{base}/out")
    assert stored.count() == batch.count()
    assert stored.select(columns).exceptAll(batch.select(columns)).count() == 0


def requests(spark):
    return spark.createDataFrame([("Arriendo", "Apartamento", 0), ("Arriendo", "Casa", 1)], "operation string, property string, position int")


def test_runs_are_compared(spark, tmp_path):
    base = str(tmp_path)

    def run(at, *texts):
        df = spark.createDataFrame([("Arriendo", "Apartamento", t) for t in texts], "operation string, property string, value string")
        return ingest_listings(df, requests(spark), f"{base}/t", F.lit(at).cast("timestamp"), f"{base}/s").orderBy("property").collect()

    first = run("2024-01-01 00:00:00", page(listing(), listing(id=8)), "broken")
    assert [(r["property"], r["total_properties"], r["pages_success"], r["pages_failed"], r["success_rate"], r["previous_timestamp"]) for r in first] == [
        ("Apartamento", 2, 1, 1, 50.0, None), ("Casa", 0, 0, 0, None, None)]
    second = run("2024-01-02 00:00:00", page(listing(), listing(id=9, price={"amount": 150000, "admin_included": 0})))
    assert second[0]["previous_timestamp"] == "2024-01-01_00-00-00"
    assert second[0]["mean_price_change"] == -100000.0 and second[0]["success_rate_change"] == 50.0
    stored = spark.read.parquet(f"{base}/t")
    assert stored.count() == 3 and stored.filter("batch_id = '2024-01-01_00-00-00'").count() == 2
    assert stored.filter("size(embedding) = 256").count() == 3


def test_end_to_end(spark, sf, tmp_path):
    base = str(tmp_path)
    pages = stored_pages(spark, sf).select(F.lit("Arriendo").alias("operation"), F.lit("Casa").alias("property"), "value")
    cfg = JobConfig(f"{base}/t", f"{base}/m", f"{base}/s", "elastic_net", ingest={"embed": False}, training={"params": {"regParam": 0.1}})
    done = run_end_to_end(spark, pages, requests(spark), cfg)
    assert done.version == 1
    assert done.trained.metrics.count() == 2
    assert done.cleaned.filter("PRICE < 0").count() == 0
    assert json.loads(done.signature.toJSON().first())["operation"] == "Arriendo"


def test_vectors_are_made_once_as_rows_are_stored(spark, tmp_path, monkeypatch):
    copies = []
    for module in (joins, sinks):
        monkeypatch.setattr(module, "materialize", lambda df, name, **kw: copies.append(df.columns) or materialize(df, name, **kw))
    pages = [page(listing(id=1), listing(id=2)), page(listing(id=2), listing(id=3, description="otra casa"))]
    df = spark.createDataFrame([("Arriendo", "Casa", t) for t in pages], "operation string, property string, value string")
    for _ in range(2):
        ingest_listings(df, requests(spark), f"{tmp_path}/t", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert copies and not any("embedding" in c for c in copies)
    stored = sinks.read_keyed(spark, f"{tmp_path}/t")
    expected = prepare_listings(df.limit(2), F.lit("2024-01-01 00:00:00").cast("timestamp")).drop("position").distinct()
    assert set(stored.columns) == set(expected.columns)
    assert stored.count() == 3 and stored.select(expected.columns).exceptAll(expected).count() == 0


def test_end_to_end_copies_no_vectors(spark, sf, tmp_path, monkeypatch):
    copies = {}
    monkeypatch.setattr(end_to_end, "materialize", lambda df, name: copies.setdefault(name, materialize(df, name)))
    pages = stored_pages(spark, sf).select(F.lit("Arriendo").alias("operation"), F.lit("Casa").alias("property"), "value")
    cfg = JobConfig(f"{tmp_path}/t", f"{tmp_path}/m", kind="elastic_net", training={"params": {"regParam": 0.1}})
    done = run_end_to_end(spark, pages, requests(spark), cfg)
    stored = sinks.read_keyed(spark, cfg.target)
    assert copies["cleaned"].columns == [c for c in stored.columns if c != "embedding"]
    assert done.cleaned.columns == stored.columns
    assert done.cleaned.filter("size(embedding) = 256").count() == copies["cleaned"].count() > 0
    assert done.cleaned.drop("embedding").exceptAll(copies["cleaned"]).count() == 0
