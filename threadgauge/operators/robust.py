"""Tests and agreement measures (TST-*, AGR-*)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.operators.bootstrap import POINT, interval, ratio_replicates
from threadgauge.operators.spread import ordered_rank, value_ranks


def every():
    """Window over a whole table of entities (never over rows)."""
    return Window.partitionBy()


def bootstrap_p(reps: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two-sided p: twice the smaller tail, (1+count)/(B+1), at most 1; 1 without replicates (TST-1)."""
    v = F.when((F.col("rep") != POINT) & ~F.isnan(value), F.col(value))
    out = reps.groupBy(*keys).agg(
        F.count(v).alias("__b"), F.count(F.when(v <= 0, 1)).alias("__lo"), F.count(F.when(v >= 0, 1)).alias("__hi")
    )
    p = F.least(F.lit(1.0), 2 * (1 + F.least("__lo", "__hi")) / (F.col("__b") + 1))
    return out.select(*keys, F.when(F.col("__b") == 0, 1.0).otherwise(p).alias("p"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Step-up adjusted p and rejection per family (TST-2).

    A family is a set of tests, at most a few per taxonomy entity or term group.
    Null p values stay null and do not count.
    """
    rows = tests.withColumn("__ok", F.col(p).isNotNull())
    part = [*family, "__ok"]
    up = Window.partitionBy(*part).orderBy(p)
    down = Window.partitionBy(*part).orderBy(F.col(p).desc(), F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    m = F.count(F.lit(1)).over(Window.partitionBy(*part))
    rows = rows.withColumn("__r", F.row_number().over(up)).withColumn("__raw", F.col(p) * m / F.col("__r"))
    adj = F.when(F.col("__ok"), F.least(F.lit(1.0), F.min("__raw").over(down)))
    return rows.withColumn("p_adj", adj).withColumn("rejected", F.coalesce(F.col("p_adj") <= alpha, F.lit(False))).drop("__ok", "__r", "__raw")


def contributions(rows: DataFrame, cluster: str = "cluster", weight: str = "weight") -> DataFrame:
    """(cluster, w, wx): weight and weighted sum of ``x``, its contribution, per cluster."""
    return rows.groupBy(cluster).agg(
        F.coalesce(F.sum(weight), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.col(weight) * F.col("x")), F.lit(0.0)).alias("wx")
    )


def leave_one_out(rows: DataFrame, k: int = 10, cluster: str = "cluster", weight: str = "weight") -> DataFrame:
    """Weighted mean with each of the k clusters of largest contribution left out: range, largest share, flag (TST-3)."""
    sums = contributions(rows, cluster, weight)
    total = sums.agg(F.sum("w").alias("tw"), F.sum("wx").alias("twx"))
    tw, twx = total.select("tw").scalar(), total.select("twx").scalar()
    stat = F.try_divide(twx - F.col("wx"), tw - F.col("w"))
    return sums.orderBy(F.col("wx").desc(), cluster).limit(k).agg(
        F.min(stat).alias("min_stat"), F.max(stat).alias("max_stat"), F.coalesce(F.max(F.try_divide("wx", twx)), F.lit(0.0)).alias("max_share"),
        F.first(F.try_divide(twx, tw)).alias("stat"),
    ).withColumn("flagged", F.col("max_share") > 0.10)


def drop_top_share(rows: DataFrame, share: float, cluster: str = "cluster", weight: str = "weight") -> DataFrame:
    """Weighted mean after dropping the ceil(share·clusters) clusters of largest contribution (TST-4).

    At least one is dropped and one must remain. Of equal contributions at the
    cut the smaller cluster ids go first; ranks come from range partitions, so
    no task holds all clusters, equal ones included.
    """
    ranked = ordered_rank(contributions(rows, cluster, weight), [F.col("wx").desc(), F.col(cluster).asc()], "__rank")
    n = ranked.count()
    n_drop = max(1, math.ceil(share * n))
    if n_drop >= n:
        raise ValueError(f"dropping {n_drop} of {n} clusters would leave none")
    return ranked.filter(F.col("__rank") > n_drop).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.try_divide(F.sum("wx"), F.sum("w")).alias("stat")
    )


def author_capped_weights(rows: DataFrame, k: int, author: str = "author") -> DataFrame:
    """Weight factor min(1, k/count) per author; null authors keep 1 (TST-5)."""
    counts = rows.filter(F.col(author).isNotNull()).groupBy(author).agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(counts, author, "left").withColumn("cap_factor", F.coalesce(F.least(F.lit(1.0), F.lit(float(k)) / F.col("__n")), F.lit(1.0))).drop("__n")


def midranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of each row's value, from merged values (AGR-2)."""
    ranks = value_ranks(rows, [], value).select(value, (F.col("n_below") + (F.col("n") + 1) / 2).alias(name))
    return rows.join(ranks, value)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation aggregate, null for a constant column."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of midranks; null for a constant column (AGR-2)."""
    ranked = midranks(midranks(rows.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "__ra"), b, "__rb")
    return ranked.agg(correlation("__ra", "__rb").alias("spearman"))


def kappa_columns(a: Column, b: Column) -> list[Column]:
    """Aggregates for agreement and Cohen's kappa of two yes/no columns (AGR-2)."""
    n = F.count(F.lit(1))
    po = F.avg((a == b).cast("double"))
    pa, pb = F.avg(a.cast("double")), F.avg(b.cast("double"))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return [n.alias("n"), po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa")]


def compare_screens(main: DataFrame, other: DataFrame, cutoff: float, **options) -> tuple[DataFrame, DataFrame]:
    """Prevalence with interval per run; agreement, kappa and Spearman on common ids (AGR-1)."""
    both = main.select("stratum", "cluster", "weight", "firsthand_p", F.lit("main").alias("run")).unionByName(
        other.select("stratum", "cluster", "weight", "firsthand_p", F.lit("other").alias("run"))
    )
    hit = F.col("firsthand_p") >= cutoff
    prevalence = interval(
        ratio_replicates(both, {"prevalence": (hit, F.lit(1.0))}, by=["run"], within=True, **options), ["run"], "ratio", n="n"
    )
    pairs = main.select("comment_id", F.col("firsthand_p").alias("a")).join(other.select("comment_id", F.col("firsthand_p").alias("b")), "comment_id")
    agree = pairs.agg(*kappa_columns(F.col("a") >= cutoff, F.col("b") >= cutoff))
    rho = spearman(pairs, "a", "b").scalar()
    return prevalence, agree.withColumn("spearman", rho)


def compare_assignments(main: DataFrame, other: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Group/card agreement on common ids, and share differences over both top lists (AGR-3)."""
    pairs = main.select("comment_id", F.col("group_id").alias("ga"), F.col("card_id").alias("ca")).join(
        other.select("comment_id", F.col("group_id").alias("gb"), F.col("card_id").alias("cb")), "comment_id"
    )
    agree = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ga").eqNullSafe(F.col("gb")).cast("double")).alias("group_agreement"),
        F.avg(F.col("ca").eqNullSafe(F.col("cb")).cast("double")).alias("card_agreement"),
    )

    def shares(df: DataFrame, name: str) -> DataFrame:
        real = df.filter(F.col("card_id").isNotNull() & (F.col("card_id") != "none")).groupBy("card_id").agg(F.count(F.lit(1)).alias("n"))
        rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "card_id"))
        return real.select("card_id", (F.col("n") / F.sum("n").over(every())).alias(f"share_{name}"), rank.alias(f"rank_{name}"))

    table = shares(main, "main").join(shares(other, "other"), "card_id", "full").filter(
        (F.col("rank_main") <= top) | (F.col("rank_other") <= top)
    )
    diff = F.abs(F.coalesce("share_main", F.lit(0.0)) - F.coalesce("share_other", F.lit(0.0)))
    return agree, table.select("card_id", F.coalesce("share_main", F.lit(0.0)).alias("share_main"), F.coalesce("share_other", F.lit(0.0)).alias("share_other"), diff.alias("abs_diff"))
