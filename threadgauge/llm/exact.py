"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest, one row per distinct
normalised text ever seen. A batch is reduced to its distinct digests before
anything is joined, so a group of copies of any size is one row; the sort-merge
anti-join against the index needs no shuffle of the index; what it leaves is
appended in the same buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadgauge.llm.common import free_name, lookup, new_path, without, written

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """The table ``name`` at ``path``; files already there are taken up, otherwise it starts empty.

    Both default to new ones: a folder below the shared folder. The number of
    buckets is fixed when the index is made and must be given again to reopen it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, name: str | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digests")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the digests (digest, keep_id; distinct) that the index does not have yet."""
        fresh = groups.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")
        dealt = fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
        dealt.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add a batch to ``index``; one row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the document that an earlier batch brought, else the smallest
    doc_id of the batch (null ids last); ``group_size`` counts the batch. Of
    repeated rows with that id just one is kept. Null text is empty; empty texts
    are equal; other columns are ignored; no rows give no rows.
    """
    rows = written(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            digest(F.col(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests-in",
    )
    return _decide(rows, index).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def _decide(rows: DataFrame, index: DigestIndex) -> DataFrame:
    known = index.rows().isEmpty()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = written(rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    earlier = None if known else written(
        groups.select("digest").hint("merge").join(index.rows().hint("merge"), "digest"), "digests-known"
    )
    index.append(groups.select("digest", F.col("first.doc_id").alias("keep_id")))
    filed = groups.hint("merge").join(index.rows().hint("merge"), "digest")
    old = F.lit(False)
    if earlier is not None:
        filed = filed.join(earlier.select("digest", F.lit(True).alias("old")), "digest", "left")
        old = F.coalesce(F.col("old"), F.lit(False))
    filed = filed.select("digest", "keep_id", "group_size", F.when(old, None).otherwise(F.col("first.row")).alias("stays"))
    found = lookup(rows, written(filed, "digest-filed"), "digest", "group_size")
    return found.withColumn("kept", F.coalesce(F.col("row") == F.col("stays"), F.lit(False)))


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``deduplicate`` keeps, with their columns."""
    row = free_name(docs, "__row")
    tagged = written(docs.withColumn(row, F.monotonically_increasing_id()), "batch")
    rows = written(
        tagged.select(F.col(id_col).cast("bigint").alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.col(row).alias("row")),
        "digests-in",
    )
    gone = _decide(rows, index).filter(~F.col("kept")).select(F.col("row").alias(row))
    return without(tagged, written(gone, "dropped"), row).drop(row)
