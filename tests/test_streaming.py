from datetime import datetime

from logosmill.streaming import live


def run(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_cue_counts_and_late_rows(spark, tmp_path):
    rows = [(1, "However, it is so.", datetime(2026, 1, 1)), (2, "Therefore no.", datetime(2026, 1, 1, 5)), (3, "However.", datetime(2026, 3, 1))]
    schema = "doc_id long, text string, published_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "d"))
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "d"))
    got = {(r.start.day, r.label, r.n) for r in run(live.cue_counts(src), "cues", spark)}
    assert got == {(1, "Comparison.Contrast", 1), (1, "Contingency.Cause.Result", 1)}  # March is still open


def test_commitments_keep_state(spark, tmp_path):
    schema = "speaker string, ord long, act_id long, op string, key string"
    rows = [("a", 1, 1, "assert", "p"), ("a", 2, 2, "assert", "p"), ("a", 3, 3, "retract", "p"), ("b", 1, 4, "concede", "q")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "a"))
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "a"))
    got = {(r.act_id, r.active) for r in run(live.commitments(src), "held", spark)}
    assert got == {(1, 1), (2, 1), (3, 0), (4, 1)}
