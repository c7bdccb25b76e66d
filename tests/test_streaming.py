from quadlake.sources.catalog import Key, TableMap
from quadlake.streaming import stream_select


def test_stateless_query_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0), (2, 9.0)], "id long, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    table = TableMap("events", stream, Key("urn:e/", ("id",)), {"urn:v": "value"})
    out = stream_select(spark, table, "SELECT ?e ?v { ?e <urn:v> ?v FILTER(?v > 5) }")
    query = out.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM found").collect()] == [("urn:e/2", 9.0)]
