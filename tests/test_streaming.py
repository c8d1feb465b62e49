from quarry.config import EngineConfig
from quarry.operators.catalog import Store
from quarry.streaming.ingest import ingest_stream


def test_pages_arrive_once(spark, tmp_path):
    schema = "page_id long, url string, html string"
    rows = [(i, f"http://e.org/{i % 3}", f"<article><p>page number {i % 3} has words</p></article>") for i in range(5)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store", EngineConfig(chunk_size=20, chunk_overlap=5))
    for _ in range(2):  # a second start finds nothing new
        ingest_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/checkpoint").awaitTermination()
    assert store.listing()[1] == 3 and store.stats()["chunk_count"] == 3
