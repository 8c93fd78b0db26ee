from pyspark.sql import functions as F

from tidewater.sources import files
from tidewater.streaming import live


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("2026-04-12T09:14:48.20+0700 [RTR/0] OUT hello\n\nGetting app x\nplain line\n")
    got = {(r["source"], r["stream"], r["body"]) for r in files.read_log(spark, str(tmp_path / "a.log")).collect()}
    assert got == {("RTR/0", "OUT", "hello"), ("", "", "")}
    assert files.find_text(spark, str(tmp_path), "plain", 5).count() == 1
    (tmp_path / "r.json").write_text('{"a": 1, "b": null}\nnot json\n{"a": 2, "b": "x"}\n')
    assert sorted(map(tuple, files.read_records(spark, str(tmp_path / "r.json"), "a int, b string", {"b": ""}).collect())) == [(1, ""), (2, "x")]
    (tmp_path / "t.md").write_text("# t\n| k | v |\n|---|---|\n| 1 | a \\| b |\n| bad |\n")
    assert [tuple(r) for r in files.read_md_table(spark, str(tmp_path / "t.md"), ["k", "v"]).collect()] == [("1", "a | b")]
    rows = spark.createDataFrame([(1, 'say "hi", then'), (2, None)], "k int, v string")
    files.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == 'k,v\n1,"say ""hi"", then"\n2,\n'
    files.append_history(rows.withColumn("at", F.lit("2026-01-02").cast("timestamp")), str(tmp_path / "h"), "at")
    assert (tmp_path / "h" / "day=2026-01-02").exists()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("event_id").alias("id"), F.to_timestamp("ts").alias("at"), F.concat(F.lit("app-"), F.col("user_id") % 5).alias("app"), F.col("event_type").alias("level"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.read_table(spark, str(tmp_path / "in"), rows.schema)
    live.to_folder(live.fresh(stream, "60 days"), str(tmp_path / "out"), str(tmp_path / "cp"), ["app"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
    query = live.level_counts(stream, late="60 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = live.level_counts(rows)
    assert spark.table("counts").exceptAll(want).count() == 0 and want.count() == spark.table("counts").count()
    assert live.active_sessions(rows).agg(F.sum("n")).first()[0] == rows.count()
