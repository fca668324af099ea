from pyspark.sql import functions as F

from axisframe import streaming


def test_each_epoch_is_appended_once(spark, tmp_path):
    schema = "name string, at long, entries array<struct<j: int, v: double>>"
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    rows = [(f"r{n}", 100 - n, [(n % 3, float(n)), (n % 3, 0.5)]) for n in range(7)]
    spark.createDataFrame(rows[:4], schema).write.parquet(source)
    run = lambda: streaming.append_stream(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "cp"), 3, "name", "at").awaitTermination()
    run()
    spark.createDataFrame(rows[4:], schema).write.mode("append").parquet(source)
    run()
    run()
    x = streaming.read_stream_store(spark, path)
    assert x.shape == (7, 3) and x.df.count() == 14
    got = {(r.i, r.j, r.seq, r.v) for r in x.df.collect()}
    assert (0, 0, 0, 3.0) in got and (3, 0, 0, 0.0) in got and (4, 0, 0, 6.0) in got
    streaming.append_batch(spark.createDataFrame(rows[:1], schema), 0, path, 3, "name", "at")
    assert streaming.read_stream_store(spark, path).shape == (7, 3)
    names = spark.read.parquet(f"{path}/names").orderBy("i").select(F.collect_list("name")).first()[0]
    assert sorted(names) == [f"r{n}" for n in range(7)]
    assert streaming.read_stream_store(spark, str(tmp_path / "none")) is None
