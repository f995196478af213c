"""Scans and dimension loads (SRC-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadgauge.operators.spread import latest_by
from threadgauge.schemas import CARDS, RAW_ITEM, conform


def _parsed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, record, broken, file, block): each line that is not blank, its record, and whether it is none.

    Broken are lines that are no JSON object or whose fields have other types
    than the record schema.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    record = F.from_json("line", f"{RAW_ITEM}, __broken string", {"columnNameOfCorruptRecord": "__broken"})
    parsed = lines.withColumn("record", record)
    return parsed.withColumn("broken", F.col("record").isNull() | F.col("record.__broken").isNotNull())


def raw_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw JSON lines with the fixed record schema; codecs by file suffix (SRC-1). Broken lines are in ``broken_lines``."""
    good = _parsed_lines(spark, path).filter("NOT broken AND trim(line) <> ''")
    return good.select("record.*").drop("__broken")


def broken_lines(spark: SparkSession, path: str | list[str], shard: str = r"shard[=_](\d+)") -> DataFrame:
    """(file, shard, block, position, n_bytes, id) of each line that is no record (SRC-1).

    ``position`` counts lines from 1 within the block of the file that begins at
    byte ``block`` (a compressed file is one block). ``shard`` is the number in
    the file's path that the pattern finds, ``id`` the first "id" the line still
    shows; either is null if there is none.
    """
    # A task reads a block in order, so numbers of its lines follow each other; the smallest one is the block's first line.
    numbered = _parsed_lines(spark, path).withColumn("number", F.monotonically_increasing_id())
    first = numbered.groupBy("file", "block").agg(F.min("number").alias("first"), F.count(F.when(F.col("broken"), 1)).alias("n"))
    bad = numbered.filter("broken AND trim(line) <> ''")

    def found(column: str, pattern: str) -> Column:
        text = F.regexp_extract(column, pattern, 1)
        return F.when(text != "", text.cast("bigint"))

    return bad.join(first.filter("n > 0"), ["file", "block"]).select(
        "file", found("file", shard).alias("shard"), "block", (F.col("number") - F.col("first") + 1).alias("position"),
        F.octet_length("line").cast("bigint").alias("n_bytes"), found("line", r'"id"\s*:\s*(\d{1,18})\b').alias("id"),
    )


def scan(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet with a column list (SRC-2)."""
    return spark.read.parquet(path).select(*columns)


def scan_ids(spark: SparkSession, path: str, ids: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Parquet rows whose key is in the id table (SRC-3)."""
    return scan(spark, path, columns).join(ids.select(key).distinct(), key, "left_semi")


def union_by_name(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Union by column name; absent columns are null (SRC-4)."""
    out = first
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def answer_parts(spark: SparkSession, path: str, then: Sequence[str] = ()) -> DataFrame:
    """``part-<n>.parquet`` files; the highest part wins per (comment, question), ties by ``then`` (SRC-5)."""
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)\.parquet", 1).cast("bigint")
    rows = spark.read.parquet(path).withColumn("part", part)
    return latest_by(rows, ["comment_id", "question_id"], ["part", *then])


def later_line_wins(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Keyed log: the later line replaces earlier ones (SRC-6)."""
    return latest_by(rows, [key], [line])


def dimension(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Small configured dimension (tools, weights, criteria) from JSON lines or CSV (SRC-7)."""
    reader = spark.read.schema(ddl)
    rows = reader.csv(path, header=True) if path.endswith(".csv") else reader.json(path)
    return conform(rows, ddl)


def taxonomy(cards: DataFrame, groups: DataFrame, version: str) -> DataFrame:
    """CARDS rows: every card with its group's label and the version (SRC-8). Author and time may be missing."""
    rows = cards.join(groups.select("group_id", "group_label"), "group_id").withColumn("taxonomy_version", F.lit(version))
    for name in ("author", "created_at"):
        if name not in cards.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return conform(rows, CARDS)
