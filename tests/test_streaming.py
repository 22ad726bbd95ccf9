from tidemark.engine import Engine
from tidemark.streaming.ingest import ingest


def test_ingest_each_batch_once(spark, tmp_path):
    engine = Engine(spark)
    engine.script("CREATE DATABASE D; CREATE TABLE E (Id BIGINT PRIMARY KEY, Kind CHAR(20))", str(tmp_path))
    db = engine.open(f"{tmp_path}/D")
    source = f"{tmp_path}/in"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id AS Id", "event_type AS Kind")
    for k in range(2):
        events.where(f"Id % 2 = {k}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        ingest(stream, db, "E", f"{tmp_path}/state", once=True).awaitTermination()
    assert db.rows("E").count() == events.count()
    assert db.append("E", events, stamp=(f"{tmp_path}/state", 1)) == (0, [])
    assert sorted(map(tuple, db.rows("E").collect())) == sorted(map(tuple, events.collect()))
