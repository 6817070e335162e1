"""Duplicates on a stream, over several micro-batches."""

from indicatrix.streaming import stream

SCHEMA = "type string, value string, ts timestamp"


def land(spark, folder, rows):
    spark.createDataFrame(rows, "type string, value string, ts string").selectExpr("type", "value", "CAST(ts AS TIMESTAMP) AS ts").write.mode("append").parquet(folder)


def run(spark, tmp_path):
    rows = stream.stream_dedup(stream.read_documents(spark, str(tmp_path / "in"), SCHEMA), "ts", "1 day")
    query = stream.write_updates(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    return query


def reported(spark, tmp_path):
    found = spark.read.parquet(str(tmp_path / "out")).where("value IS NOT NULL").collect()
    return sorted((str(r.since.date()), r.value, str(r.ts)) for r in found)


def test_first_reports_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, [("ipv4", "1.1.1.1", "2024-01-05 10:00:00")] * 50 + [("ipv4", "1.1.1.1", "2024-01-05 09:00:00"), ("ipv4", "2.2.2.2", "2024-01-05 23:00:00"), ("url", None, "2024-01-05 23:00:00"), ("ipv4", "9.9.9.9", None)])
    run(spark, tmp_path)
    first = [("2024-01-05", "1.1.1.1", "2024-01-05 09:00:00"), ("2024-01-05", "2.2.2.2", "2024-01-05 23:00:00")]
    assert reported(spark, tmp_path) == first
    land(spark, folder, [("ipv4", "1.1.1.1", "2024-01-05 08:00:00"), ("ipv4", "1.1.1.1", "2024-01-06 08:00:00"), ("ipv4", "3.3.3.3", "2024-01-05 08:00:00")])
    run(spark, tmp_path)
    later = [("2024-01-05", "3.3.3.3", "2024-01-05 08:00:00"), ("2024-01-06", "1.1.1.1", "2024-01-06 08:00:00")]
    assert reported(spark, tmp_path) == sorted(first + later)


def test_combined_before_the_state(spark, tmp_path):
    """A hot value is one row of a task before the shuffle."""
    land(spark, str(tmp_path / "in"), [("ipv4", "1.1.1.1", "2024-01-05 10:00:00")] * 2000)
    query = run(spark, tmp_path)
    plan = query._jsq.explainInternal(False)
    assert "partial_min" in plan and plan.index("Exchange") < plan.rindex("partial_min")
    assert len(reported(spark, tmp_path)) == 1
