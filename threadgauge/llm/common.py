"""Shared folder, written intermediate tables and joins that survive a hot key."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 512
SLOTS = 1 << 26
T = TypeVar("T")
_LOCAL: dict[str, str] = {}
_SOLE: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a single-machine session (``local`` master, as in tests) gets a
    temporary folder when neither is set; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="threadgauge-llm-")
    return _LOCAL[context.applicationId]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/llm-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df``, computed once and read from a table in the shared folder.

    Cuts lineage: a lost executor costs a reread, never a recomputation.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sole(key: object, make: Callable[[], T]) -> T:
    """What ``make`` gives for ``key``, kept in this worker until another key is asked for.

    Workers outlive stages; the memory of one operator must not stay beside the next one's.
    So it also goes back to the system, from Arrow's pool and from the allocator.
    """
    if key not in _SOLE:
        _SOLE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        _SOLE[key] = make()
    return _SOLE[key]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python workers ``rows`` at a time in this session, if it takes more so far."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def whole_text(name: str) -> Column:
    """Text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def lookup(left: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Join rows to the one row of their key, also when a key owns a third of all rows.

    ``groups`` is unique on ``key`` (never null) and ``size`` is the key's number
    of rows in ``left``. Keys with more than 1/512 of the rows number fewer than
    512, whatever the input: only their rows are broadcast. The rest shuffle.
    """
    total = groups.agg(F.sum(size)).scalar()
    hot = groups.filter(F.col(size) * F.lit(HOT_SHARE) > total)
    cold = groups.filter(~(F.col(size) * F.lit(HOT_SHARE) > total))
    on_hot = left.join(F.broadcast(hot), key)
    on_cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return on_hot.unionByName(on_cold)


def sieve(keys: DataFrame, key: str, most: int = SLOTS) -> Callable[[DataFrame], DataFrame]:
    """A filter of rows that passes every row with a ``key`` in ``keys``, and few others, without a shuffle.

    The keys' hashes are held in a bitmap of 16 slots a key and at most ``most`` in all,
    one row for each 64 slots; keys that share a slot only let more rows pass. The filter
    given ``False`` passes the other rows, none of which has a key in ``keys``.
    """
    slots = min(most, max(64, 1 << (16 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(slots))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    word = F.floor(place / 64).cast("int")
    held = written(keys.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits")), "sieve")

    def passing(rows: DataFrame, passed: bool = True) -> DataFrame:
        hit = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
        return rows.withColumn("__word", word).join(F.broadcast(held), "__word", "left").filter(hit == F.lit(passed)).select(*rows.columns)

    return passing


def without(rows: DataFrame, gone: DataFrame, key: str, most: int = SLOTS) -> DataFrame:
    """``rows`` but those with a ``key`` (never null) in ``gone``; only rows that its sieve passes may be shuffled."""
    passing = sieve(gone, key, most)
    return passing(rows, False).unionByName(passing(rows).join(gone, key, "left_anti"))
