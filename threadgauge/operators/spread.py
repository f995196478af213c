"""Ranks, draws and quantiles that never hold one key's rows in one task.

A plain window puts every row of a key into one task. Here each key is cut into
buckets, by hash prefix or by range partition; a small table of bucket counts
gives the offset of every bucket and rows are ordered only inside their bucket.
How many buckets there are follows the number of rows: of the largest key's n
rows, a hash bucket holds about the root and so does the table of its buckets; a
range bucket holds about ``RANGE_ROWS`` rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.functions.hashing import HASH_BITS
from threadgauge.session import cut_lineage

RANGE_ROWS = 1 << 20
MOST_BITS = 30
ALL = "__all"


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keys = list(keys)
    return (df, keys) if keys else (df.withColumn(ALL, F.lit(0)), [ALL])


def _offsets(bucketed: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Per (keys, bucket): rows in earlier buckets. One row per key and bucket."""
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.groupBy(*keys, "__b")
        .agg(amount.alias("__n"))
        .withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    )


def _prefixed(df: DataFrame, keys: list[str], draw: Column) -> DataFrame:
    """``df`` with a hash ``__h`` and its bucket ``__b``: the prefix of half as many bits as the largest key's row count has."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    bits = largest.select(F.least(F.ceil(F.log2(F.greatest("n", F.lit(1))) / 2), F.lit(MOST_BITS)).cast("int")).scalar()
    hashed = df.withColumn("__h", draw)
    return hashed.withColumn("__b", F.call_function("shiftright", F.col("__h"), F.lit(HASH_BITS) - F.coalesce(bits, F.lit(0))))


def ranged(df: DataFrame, order: Sequence[Column | str], rows: int) -> DataFrame:
    """``df`` written in range partitions of ``order``, numbered in ``__b``; more partitions than usual if ``rows`` need them."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-rows // RANGE_ROWS)
    dealt = df.repartitionByRange(needed, *order) if needed > usual else df.repartitionByRange(*order)
    return cut_lineage(dealt.withColumn("__b", F.spark_partition_id()))


def join_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where null equals null; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__k_{k}"])
        on = same if on is None else on & same
    return left.join(renamed, on).drop(*[f"__k_{k}" for k in keys])


def hash_rank(
    df: DataFrame, keys: Sequence[str], draw: Column, tie: Sequence[str], name: str = "draw_rank",
) -> DataFrame:
    """1-based rank inside ``keys`` by a 60-bit hash, ties by ``tie``."""
    df, keys = _keyed(df, keys)
    bucketed = _prefixed(df, keys, draw)
    offsets = _offsets(bucketed, keys, F.count(F.lit(1)))
    inside = Window.partitionBy(*keys, "__b").orderBy("__h", *tie)
    ranked = bucketed.withColumn("__r", F.row_number().over(inside))
    ranked = join_nulls(ranked, offsets, [*keys, "__b"])
    return ranked.withColumn(name, (F.col("__r") + F.col("__off")).cast("bigint")).drop(
        "__h", "__b", "__r", "__n", "__off", ALL
    )


def take_by_hash(
    df: DataFrame, keys: Sequence[str], draw: Column, tie: Sequence[str], quota: DataFrame,
    n: str = "n_take", name: str = "draw_rank",
) -> DataFrame:
    """The ``n`` rows with the smallest hash in each key, exact at any key size.

    ``quota`` has one row per key with the number to take. Buckets that start
    beyond the quota are dropped before the sort, so the shuffle carries about
    the rows that are kept, not the frame.
    """
    keys = list(keys)
    if not keys:
        df, quota, keys = df.withColumn(ALL, F.lit(0)), quota.withColumn(ALL, F.lit(0)), [ALL]
    bucketed = _prefixed(df, keys, draw)
    offsets = _offsets(bucketed, keys, F.count(F.lit(1)))
    wanted = join_nulls(offsets, quota.select(*keys, F.col(n).alias("__take")), keys).filter("__off < __take")
    inside = Window.partitionBy(*keys, "__b").orderBy("__h", *tie)
    return (
        join_nulls(bucketed, wanted, [*keys, "__b"])
        .withColumn("__r", F.row_number().over(inside))
        .withColumn(name, (F.col("__r") + F.col("__off")).cast("bigint"))
        .filter(F.col(name) <= F.col("__take"))
        .drop("__h", "__b", "__r", "__n", "__off", "__take", ALL)
    )


def ordered_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based rank of every row in a total order.

    Rows are dealt to range partitions and written; a small table of rows per
    partition gives offsets, and rows are numbered inside their partition.
    """
    dealt, keys = _keyed(ranged(df, order, df.count()), [])
    offsets = _offsets(dealt, keys, F.count(F.lit(1))).select("__b", "__off")
    inside = Window.partitionBy("__b").orderBy(*order)
    ranked = dealt.withColumn("__r", F.row_number().over(inside)).join(offsets, "__b")
    return ranked.withColumn(name, (F.col("__r") + F.col("__off")).cast("bigint")).drop("__b", "__r", "__off", ALL)


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str] = (), descending: bool = False,
    bucket: str | None = None,
) -> DataFrame:
    """One row per (keys, value): ``n`` rows, ``n_below`` rows ordered before it.

    ``sums`` columns are added up per value and, as ``<c>_below``, over all
    values ordered before it. Equal values are merged before anything is sorted;
    keys and values are then dealt to range partitions, so a large key spreads
    over many. ``bucket`` names a column for the range partition, which grows in
    the order asked for.
    """
    df, keys = _keyed(df.filter(F.col(value).isNotNull()), keys)
    merged = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    order = F.col(value).desc() if descending else F.col(value).asc()
    dealt = ranged(merged, [*[F.col(k) for k in keys if k != ALL], order], df.count())
    inside = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = ["n", *sums]
    steps = dealt.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__s_{c}") for c in totals])
    steps = steps.select(
        *keys, "__b",
        *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in totals],
    )
    out = join_nulls(dealt, steps, [*keys, "__b"])
    return out.select(
        *[k for k in keys if k != ALL], value, *totals, *([F.col("__b").alias(bucket)] if bucket else []),
        *[
            (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__o_{c}")).alias(f"{c}_below")
            for c in totals
        ],
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], method: str = "linear"
) -> DataFrame:
    """Exact quantiles per key with linear interpolation, or the lower order statistic."""
    keys = list(keys)
    ranks = value_ranks(df, keys, value)
    totals = ranks.groupBy(*keys).agg(F.sum("n").alias("__total"))
    ranks = join_nulls(ranks, totals, keys) if keys else ranks.withColumn("__total", totals.scalar())
    aggs, outs = [], []
    for name, q in points.items():
        pos = F.lit(q) * (F.col("__total") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("n_below") <= at) & (at < F.col("n_below") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{name}_{side}"))
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        outs.append((lo if method == "lower" else lo + (hi - lo) * frac).alias(name))
    return ranks.groupBy(*keys).agg(F.max("__total").alias("__total"), *aggs).select(*keys, *outs)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in ``order``; a partial aggregate, so a hot key is safe."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(last).select(*keys, "__row.*").select(*df.columns)


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(first).select(*keys, "__row.*").select(*df.columns)


def hot_lookup(left: DataFrame, right: DataFrame, key: str, share: int = 512) -> DataFrame:
    """Left join to a table unique on ``key`` when one key may own a third of the rows.

    Keys holding more than 1/``share`` of the left rows number fewer than
    ``share``; their right rows are sent to every task. The other keys shuffle.
    Rows without a key match nothing and stay where they are.
    """
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    hot = counts.filter(F.col("__n") * F.lit(share) > total).select(key, F.lit(True).alias("__hot"))
    tagged = left.join(F.broadcast(hot), key, "left")
    hot_right = F.broadcast(right.join(F.broadcast(hot.select(key)), key, "left_semi"))
    on_hot = tagged.filter(F.col("__hot") | F.col(key).isNull()).join(hot_right, key, "left")
    on_rest = tagged.filter(F.col("__hot").isNull() & F.col(key).isNotNull()).join(right, key, "left")
    return on_hot.unionByName(on_rest).drop("__hot")


def require_empty(df: DataFrame, message: str) -> None:
    """Raise when a data check finds a row; shows at most five of them."""
    bad = df.limit(5).collect()
    if bad:
        raise ValueError(f"{message}: {[r.asDict() for r in bad]}")


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Collect a table that must stay small; more rows than ``most`` is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows
