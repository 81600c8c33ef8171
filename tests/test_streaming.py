from nestq import Session
from nestq.streaming import start


def test_stateless_query_over_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, [1, 2]), (2, []), (3, [5])], "id long, xs array<long>").write.parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([(1, "one"), (3, "three")], "k long, name string")
    s = Session(spark)
    s.register("events", spark.readStream.schema("id long, xs array<long>").parquet(str(tmp_path / "in"))).register("names", names)
    q = "SELECT e.id, x + 1 AS y, n.name FROM events AS e JOIN names AS n ON n.k = e.id, e.xs AS x WHERE x > 1"
    run = start(s, q, str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
    run.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 3, "one"), (3, 6, "three")]
