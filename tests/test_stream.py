from pyspark.sql import functions as F

from curbflow.functions import geo
from curbflow.operators import layers
from curbflow.schemas import PINGS
from curbflow.streaming import pings as streaming


def test_stream_merges_batches(spark, tmp_path):
    box = lambda name, value, *b: spark.range(1).select(F.lit(value).alias(name), geo.box(*map(F.lit, b)).alias("segs"))
    routes, fill, depot = box("route_id", "A", -117.3, 32.6, -117.1, 32.8), box("name", "L", 0.0, 0.0, 1.0, 1.0), box("name", "D", 2.0, 2.0, 3.0, 3.0)
    parcels = layers.build_parcels(box("APN", "P", 5.0, 5.0, 6.0, 6.0).withColumns({c: F.lit("A") for c in ("route_ref", "route_org", "route_rec")}))
    one = spark.createDataFrame([], PINGS).unionByName(spark.sql("SELECT '100001' AS vehicle_id, TIMESTAMP'2024-01-18 15:00:00' AS dt_utc, TIMESTAMP_NTZ'2024-01-18 07:00:00' AS dt_local, 32.7D AS lat, -117.2D AS lon, 5D AS speed_mph"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (one, one, one.withColumn("dt_utc", F.col("dt_utc") + F.expr("INTERVAL 1 MINUTE"))):
        batch.write.mode("append").parquet(source)
        streaming.enrich_stream(streaming.read_pings(spark, source), routes, parcels, fill, depot, out, str(tmp_path / "state"), once=True).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 2 and {r.route_id for r in rows} == {"A"}


def test_stop_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT 'v' AS vehicle_id, t AS dt_utc, CAST(t AS TIMESTAMP_NTZ) AS dt_local, 0D AS lat, 0D AS lon, 0D AS speed_mph FROM VALUES (TIMESTAMP'2024-01-18 15:01:00'), (TIMESTAMP'2024-01-18 15:01:00'), (TIMESTAMP'2024-01-18 15:06:00'), (TIMESTAMP'2024-01-18 15:10:00') AS x(t)").write.parquet(source)
    own = streaming.stop_counts(streaming.deduplicate(streaming.read_pings(spark, source)), late=None)
    query = own.writeStream.format("memory").queryName("stop_counts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert not query.exception()
