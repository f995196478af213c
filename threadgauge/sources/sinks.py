"""Writes and exports (SNK-*)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadgauge.operators.spread import latest_by, require_empty


def write_sorted(df: DataFrame, path: str, key: str = "id", rows_per_file: int = 5_000_000, rows_per_group: int = 100_000) -> None:
    """Range-sorted zstd Parquet (SNK-1): row groups of ``rows_per_group`` rows, the last of a file may have fewer.

    Files and their row groups hold ascending ranges of ``key``; rows of one key may end one and start the next.
    """
    (
        df.orderBy(key).write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
        .option("parquet.block.row.count.limit", rows_per_group).option("parquet.block.size", 1 << 30).parquet(path)
    )


def allowlisted(df: DataFrame, public: Sequence[str]) -> DataFrame:
    """Only the public columns that exist (SNK-2)."""
    return df.select(*[c for c in public if c in df.columns])


def latest_labels(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last label per key, reviewer dropped (SNK-3)."""
    return latest_by(rows, keys, order).drop("reviewer")


def _check_selection(new: DataFrame, key: str, judgment: str) -> None:
    p = F.col("selection_prob")
    bad = new.filter(((p.isNull()) & (F.col(key) != judgment)) | (p <= 0) | (p > 1))
    require_empty(bad.select(key, "selection_prob"), "selection probability outside (0, 1]")


def replace_label_sets(existing: DataFrame, new: DataFrame, key: str = "label_set", judgment: str = "judgment") -> DataFrame:
    """Rows of the written label sets replaced, others kept (SNK-4)."""
    _check_selection(new, key, judgment)
    written = new.select(key).distinct()
    return existing.join(written, key, "left_anti").unionByName(new)


def write_label_sets(new: DataFrame, path: str, key: str = "label_set", judgment: str = "judgment") -> None:
    """Write label sets to a table partitioned by them; those in ``new`` are replaced, others stay as they are (SNK-4).

    Rows are checked before anything is written. Files are staged and only a
    finished job moves its partitions into place. No rows change nothing.
    """
    _check_selection(new, key, judgment)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(key).parquet(path)


def read_label_sets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table of label sets, with names as they were written also where they look like numbers."""
    return spark.read.schema(schema).parquet(path)


def publish(tables: dict[str, DataFrame], root: str, gates: Sequence[Callable[[str, DataFrame], DataFrame]]) -> None:
    """Write every table to staging, gate what was written, then swap (SNK-5).

    A gate returns its findings; any finding leaves the published folder as it was.
    """
    spark = next(iter(tables.values())).sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    stage, live, old = f"{root}.staging", root, f"{root}.previous"
    fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop.Path(stage), True)
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{stage}/{name}")
    for name in tables:
        written = spark.read.parquet(f"{stage}/{name}")
        for gate in gates:
            require_empty(gate(name, written), f"gate failed for {name}")
    if fs.exists(hadoop.Path(old)) and not fs.delete(hadoop.Path(old), True):
        raise OSError(f"cannot remove {old}")
    present = fs.exists(hadoop.Path(live))
    if present and not fs.rename(hadoop.Path(live), hadoop.Path(old)):
        raise OSError(f"cannot move {live} aside")
    if not fs.rename(hadoop.Path(stage), hadoop.Path(live)):
        if present:
            fs.rename(hadoop.Path(old), hadoop.Path(live))
        raise OSError(f"cannot publish {stage} as {live}")


def bounded_listing(rows: DataFrame, most: int = 300) -> DataFrame:
    """Whitespace-normalised text cut for a tab-separated listing (SNK-7)."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.withColumn("severity", F.round("severity", 1)).withColumn("text", F.rtrim(F.substring(flat, 1, most)))


def write_listing(rows: DataFrame, path: str) -> None:
    bounded_listing(rows).write.mode("errorifexists").option("sep", "\t").csv(path)
