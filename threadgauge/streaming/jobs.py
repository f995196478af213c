"""Structured Streaming views of append-only logs (STR-*, LED-11).

Every job is a streaming DataFrame; ``drain`` runs it over what is available and
returns the written result. Results go to a folder beside the checkpoint, batch
by batch, never to the driver.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadgauge.operators.spread import latest_by
from threadgauge.session import new_home
from threadgauge.sources.readers import union_by_name

BATCH = "__batch"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of a Parquet folder or file with the schema of its present contents."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    fs, hadoop = _store(spark, path)
    if fs.getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", hadoop.getName()).parquet(hadoop.getParent().toString())
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str, home: str | None = None) -> DataFrame:
    """Run to the end of the available input; rows carry their batch number.

    A batch is written to its own folder and replaced when a restart repeats it,
    so each batch counts once.
    """
    spark = stream.sparkSession
    home = home or new_home(spark)
    empty = spark.createDataFrame([], stream.schema).withColumn(BATCH, F.lit(-1).cast("bigint"))
    empty.write.mode("overwrite").parquet(f"{home}/out/batch=none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn(BATCH, F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint")
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()
    return spark.read.schema(empty.schema).parquet(f"{home}/out/batch=*").filter(F.col(BATCH) >= 0)


def final_state(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key of an update-mode result."""
    return latest_by(updates, keys, [BATCH]).drop(BATCH)


def running_spend(attempts: DataFrame) -> DataFrame:
    """Calculated USD per run, updated as attempts arrive (STR-1, LED-11)."""
    return attempts.groupBy("run_id").agg(
        F.sum(F.when(F.col("cost_class") == "calculated", F.col("cost_micros")).otherwise(0)).alias("calculated_micros"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def pending_resolution(pending: DataFrame, final: DataFrame, delay: str = "10 minutes", timeout: str = "1 hour") -> DataFrame:
    """Pending joined to its final row; unmatched ones become unknown after the timeout (STR-2).

    Both sides: run_id, logical_call_id, attempt, ts; the final side also cost_class.
    """
    left = pending.select("run_id", "logical_call_id", "attempt", F.col("ts").alias("pending_ts")).withWatermark("pending_ts", delay)
    right = final.select(
        F.col("run_id").alias("f_run"), F.col("logical_call_id").alias("f_call"), F.col("attempt").alias("f_attempt"),
        F.col("ts").alias("final_ts"), "cost_class",
    ).withWatermark("final_ts", delay)
    on = (
        (F.col("run_id") == F.col("f_run")) & (F.col("logical_call_id") == F.col("f_call")) & (F.col("attempt") == F.col("f_attempt"))
        & (F.col("final_ts") >= F.col("pending_ts")) & (F.col("final_ts") <= F.col("pending_ts") + F.expr(f"INTERVAL {timeout}"))
    )
    return left.join(right, on, "left_outer").select(
        "run_id", "logical_call_id", "attempt", "pending_ts", F.coalesce("cost_class", F.lit("unknown")).alias("cost_class")
    )


def with_open_calls(resolved: DataFrame, pending: DataFrame) -> DataFrame:
    """A drained resolution and the calls it still waits for, as ``pending`` (STR-2)."""
    keys = ["run_id", "logical_call_id", "attempt"]
    rest = pending.select(*keys, F.col("ts").alias("pending_ts")).join(resolved.select(*keys), keys, "left_anti")
    return resolved.select(*rest.columns, "cost_class").unionByName(rest.withColumn("cost_class", F.lit("pending")))


def _store(spark: SparkSession, path: str):
    """(file system, path) of a folder, by the session's own settings."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of a table's complete versions, ascending."""
    fs, folder = _store(spark, f"{table}/version=*/_SUCCESS")
    found = fs.globStatus(folder) or []
    return sorted(int(s.getPath().getParent().getName().removeprefix("version=")) for s in found)


def latest_label(labels: DataFrame, home: str | None = None, expire: str | None = None) -> DataFrame:
    """Last label per (comment, question) of a log, kept as a table that outlives the stream (STR-3).

    Each batch is reduced to its last labels and merged with the newest complete
    version of the table into a version of its own number, so a repeated batch
    gives the same version and nothing is kept as streaming state. ``seq``
    decides, so late rows lose and repeated ones change nothing. With ``expire``
    (an interval, on the column ``ts``) labels that much older than the newest
    one go. The two newest versions stay on disk.
    """
    spark = labels.sparkSession
    home = home or new_home(spark)
    table, schema, keys = f"{home}/latest", labels.schema, ["comment_id", "question_id"]

    def merge(batch: DataFrame, number: int) -> None:
        older = [v for v in _versions(spark, table) if v < number]
        known = [spark.read.schema(schema).parquet(f"{table}/version={older[-1]}")] if older else []
        merged = latest_by(union_by_name(latest_by(batch, keys, ["seq"]), *known), keys, ["seq"])
        if expire:
            merged = merged.filter(F.col("ts") >= merged.agg(F.max("ts")).scalar() - F.expr(f"INTERVAL {expire}"))
        merged.write.mode("overwrite").parquet(f"{table}/version={number}")
        for v in older[:-1]:
            fs, folder = _store(spark, f"{table}/version={v}")
            fs.delete(folder, True)

    query = labels.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    done = _versions(spark, table)
    return spark.read.schema(schema).parquet(f"{table}/version={done[-1]}") if done else spark.createDataFrame([], schema)


def period_counts(events: DataFrame, start: str, period_seconds: int, delay: str = "1 day") -> DataFrame:
    """Counts per window period and type; periods are equal cuts from ``start`` (STR-4)."""
    shift = int(datetime.fromisoformat(start).replace(tzinfo=UTC).timestamp()) % period_seconds
    box = F.window("ts", f"{period_seconds} seconds", f"{period_seconds} seconds", f"{shift} seconds")
    return events.withWatermark("ts", delay).groupBy(box.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("period_start"), "event_type", "n"
    )


def with_open_periods(closed: DataFrame, counts: DataFrame) -> DataFrame:
    """Drained periods and those the watermark has not closed yet, from a batch count of the same log (STR-4)."""
    keys = ["period_start", "event_type"]
    rest = counts.join(closed.select(*keys), keys, "left_anti").select(*keys, "n", F.lit(False).alias("closed"))
    return closed.select(*keys, "n", F.lit(True).alias("closed")).unionByName(rest)


def unique_requests(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Work list without repeats inside the watermark; the checkpoint makes it resumable (STR-5)."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_key"])
