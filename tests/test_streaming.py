from verdance.streaming.counts import site_counts, unique_calls


def test_stream_of_calls(spark, tmp_path):
    schema = "grp string, chrom string, pos string, sample_id string, gt string, seen_at timestamp"
    rows = [("w", "c", "1", "a", "0/1", "2024-01-01 00:00:00"), ("w", "c", "1", "a", "0/1", "2024-01-01 00:01:00"), ("w", "c", "1", "b", "1/.", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "grp string, chrom string, pos string, sample_id string, gt string, t string").selectExpr("grp", "chrom", "pos", "sample_id", "gt", "cast(t as timestamp) as seen_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert unique_calls(stream).isStreaming
    q = site_counts(stream).writeStream.outputMode("update").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from counts").collect()] == [("w", "c", "1", 3, 5)]
    q = unique_calls(stream).writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from once").count() == 2
