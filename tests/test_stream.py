from arcmesh.streaming.stateless import encode_stream


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.1), (3.0, 0.0)])], "id int, pts array<struct<x:double,y:double>>")
    df.write.parquet(str(tmp_path / "in"))
    how = {"grid": (0.0, 0.0, 1.0, 1.0), "eps": 0.5}
    q = encode_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), **how).writeStream.format("memory").queryName("lines").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lines").collect() == encode_stream(df, **how).collect()
    assert [tuple(p) for p in spark.table("lines").first().pts] == [(0, 0), (3, 0)]
