import os
from datetime import datetime

from pyspark.sql import functions as F

from threadgauge.streaming import jobs


def test_restart_counts_each_row_once(spark, tmp_path):
    source, home = str(tmp_path / "log"), str(tmp_path / "home")
    part = spark.range(10).select(F.concat(F.lit("r"), F.col("id") % 2).alias("run_id"), F.lit("calculated").alias("cost_class"), F.lit(5).alias("cost_micros"))
    part.coalesce(1).write.parquet(source)
    stream = jobs.read_stream(spark, source)
    jobs.drain(jobs.running_spend(stream), "update", home)
    part.coalesce(1).write.mode("append").parquet(source)
    out = jobs.final_state(jobs.drain(jobs.running_spend(jobs.read_stream(spark, source)), "update", home), ["run_id"])
    assert {r.run_id: (r.calculated_micros, r.n_rows) for r in out.collect()} == {"r0": (50, 10), "r1": (50, 10)}


def label_rows(spark, *rows):
    return spark.createDataFrame([(c, "q", v, n, datetime(2024, 1, d)) for c, v, n, d in rows], "comment_id long, question_id string, value string, seq long, ts timestamp").coalesce(1)


def test_latest_label_outlives_restarts_and_ignores_late_rows(spark, tmp_path):
    source, home = str(tmp_path / "log"), str(tmp_path / "home")

    def run(expire=None):
        out = jobs.latest_label(jobs.read_stream(spark, source, 1), home, expire)
        return {r.comment_id: (r.value, r.seq) for r in out.collect()}

    label_rows(spark, (1, "a", 1, 1), (1, "b", 3, 2), (2, "a", 2, 1)).write.parquet(source)
    assert run() == {1: ("b", 3), 2: ("a", 2)}
    assert run() == {1: ("b", 3), 2: ("a", 2)}  # nothing new
    label_rows(spark, (1, "late", 2, 1), (3, "c", 5, 20)).write.mode("append").parquet(source)
    label_rows(spark, (1, "b", 3, 2), (2, "d", 6, 19)).write.mode("append").parquet(source)
    assert run() == {1: ("b", 3), 2: ("d", 6), 3: ("c", 5)}
    label_rows(spark, (4, "e", 7, 21)).write.mode("append").parquet(source)
    assert run("10 days") == {2: ("d", 6), 3: ("c", 5), 4: ("e", 7)}
    kept = sorted(os.listdir(f"{home}/latest"))
    assert len(kept) == 2
    # A batch cut off before its marker is written again from the version before it.
    newest = max(kept, key=lambda v: int(v.split("=")[1]))
    os.replace(f"{home}/latest/{newest}/_SUCCESS", tmp_path / "marker")
    for name in os.listdir(f"{home}/checkpoint/commits"):
        if name.strip(".").startswith(newest.split("=")[1]):
            os.replace(f"{home}/checkpoint/commits/{name}", tmp_path / f"old{name}")
    assert run("10 days") == {2: ("d", 6), 3: ("c", 5), 4: ("e", 7)}


def test_latest_label_of_an_empty_log(spark, tmp_path):
    label_rows(spark, (1, "a", 1, 1)).filter("false").write.parquet(str(tmp_path / "log"))
    assert jobs.latest_label(jobs.read_stream(spark, str(tmp_path / "log")), str(tmp_path / "home")).count() == 0
