from spectraloom.streaming.merge import merge_stream


def test_watermark_closes_cells(spark, tmp_path):
    d = str(tmp_path / "in")
    rows = [(1, f"2024-01-01 00:00:{s:02d}", 100.0 + s, 1.0) for s in range(0, 25)] + [(1, "2024-01-01 01:00:00", 5.0, 9.0)]
    spark.createDataFrame(rows, "run_id long, t string, mz double, intensity double").selectExpr("run_id", "timestamp(t) AS at", "mz", "intensity").coalesce(1).write.parquet(d)
    spark.createDataFrame([(1, "2024-01-01 02:00:00", 5.0, 9.0)], "run_id long, t string, mz double, intensity double").selectExpr("run_id", "timestamp(t) AS at", "mz", "intensity").write.mode("append").parquet(d)
    stream = spark.readStream.schema(spark.read.parquet(d).schema).option("maxFilesPerTrigger", 1).parquet(d)
    q = merge_stream(stream).writeStream.outputMode("append").format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.rt_start)[-8:], r.mz_cell): r.intensity for r in spark.table("merged").collect()}
    assert got[("00:00:00", 10)] == 10.0 and got[("00:00:20", 12)] == 5.0


def _stream(spark, rows, schema, path):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_chain_and_store(spark, tmp_path):
    from spectraloom.operators.filters import sqrt_scale, threshold
    from spectraloom.streaming import consumers as c

    d, schema = str(tmp_path / "in"), "run_id long, mz double, intensity double"
    out = c.chain(_stream(spark, [[(1, 100.0, 16.0), (2, 200.0, 1.0)]], schema, d), lambda x: threshold(x, 4.0), sqrt_scale)
    go = lambda: c.store(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    go()  # nothing new
    spark.createDataFrame([(2, 300.0, 25.0)], schema).write.mode("append").parquet(d)
    go()
    assert sorted((r.run_id, r.intensity) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 4.0), (2, 5.0)]


def test_gaps_over_batches(spark, tmp_path):
    from spectraloom.streaming.consumers import time_gaps

    rows = [[(1, 0.0), (1, 1.0), (2, 5.0)], [(1, 9.0), (2, 6.0), (1, 0.5)], [(2, 30.0)]]
    q = time_gaps(_stream(spark, rows, "run_id long, rt double", str(tmp_path / "in")), 5.0).writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("gaps").collect()) == [(1, 1.0, 9.0), (2, 6.0, 30.0)]


def test_tic_windows(spark, tmp_path):
    from spectraloom.streaming.consumers import tic_stream

    at = lambda s: f"2024-01-01 {s}"
    d = str(tmp_path / "in")
    for part in ([(1, at("00:00:10"), 5.0), (1, at("00:00:50"), 7.0), (1, at("00:01:10"), 1.0)], [(1, at("00:10:00"), 1.0)], [(1, at("00:20:00"), 1.0)]):
        spark.createDataFrame(part, "run_id long, t string, intensity double").selectExpr("run_id", "timestamp(t) AS at", "intensity").coalesce(1).write.mode("append").parquet(d)
    stream = spark.readStream.schema(spark.read.parquet(d).schema).option("maxFilesPerTrigger", 1).parquet(d)
    q = tic_stream(stream).writeStream.outputMode("append").format("memory").queryName("tics").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {str(r.start)[-8:]: (r.tic, r.base_peak, r.n) for r in spark.table("tics").collect()}
    assert got["00:00:00"] == (12.0, 7.0, 2) and got["00:01:00"] == (1.0, 1.0, 1)
