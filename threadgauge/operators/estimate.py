"""Weighted estimates with intervals (EST-5 … EST-23).

Rows carry stratum, cluster (the thread), weight and the coded columns.
Replicate tables hold replicates × entities rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.operators.bootstrap import (
    ALL_KEY, POINT, REPLICATES, finite_ratio, interval, level_replicates, ratio_estimates, ratio_replicates, resample, share_replicates,
)
from threadgauge.operators.robust import benjamini_hochberg, bootstrap_p

# Draws or cells of a class that a simulation holds at once, and simulations of a card that are one row of work.
DRAWN_AT_ONCE = 1 << 21
SIMS_AT_ONCE = 25


def every():
    """Window over a whole table of entities (never over rows)."""
    return Window.partitionBy()


def rao_wu(rows: DataFrame, n_rep: int = REPLICATES, seed: int = 0, min_hits: int = 30, **options) -> DataFrame:
    """Weighted proportion with rescaled m-1 draws and sampling fractions (EST-5).

    ``rows``: y, weight, stratum, cluster, fraction (constant per stratum) and
    ``domain`` (boolean mask over the full sample).
    """
    d = F.coalesce(F.col("domain"), F.lit(True)).cast("double")
    flat = rows.select("stratum", "cluster", (F.col("weight") * F.col("y") * d).alias("a"), (F.col("weight") * d).alias("w"))
    reps = resample(flat, ["a", "w"], ["stratum"], n_rep=n_rep, seed=seed, fewer=1, **options)
    facts = rows.groupBy(F.col("stratum").cast("string").alias("stratum")).agg(
        F.max("fraction").alias("f"), (F.max("fraction") != F.min("fraction")).alias("mixed"), F.countDistinct("cluster").alias("m"),
        F.sum(F.when((F.col("y") == 1) & (d > 0), 1).otherwise(0)).alias("hits"), F.sum(d).alias("n"),
    )
    point = reps.filter(F.col("rep") == POINT).select("stratum", F.col("a").alias("ta"), F.col("w").alias("tw"))
    lam = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("f")))
    drawn = reps.filter(F.col("rep") >= 0).join(point, "stratum").join(facts, "stratum")

    def scaled(total: str, rep: str) -> Column:
        moved = (1 - lam) * F.col(total) + lam * F.try_divide(F.col("m").cast("double"), F.col("m") - 1) * F.col(rep)
        return F.when(F.col("m") > 1, moved).otherwise(F.col(total))

    totals = drawn.select("rep", scaled("ta", "a").alias("a"), scaled("tw", "w").alias("w")).groupBy("rep").agg(F.sum("a").alias("a"), F.sum("w").alias("w"))
    plain = point.agg(F.lit(POINT).alias("rep"), F.sum("ta").alias("a"), F.sum("tw").alias("w"))
    ratios = plain.unionByName(totals).withColumn("ratio", finite_ratio(F.col("a"), F.col("w")))
    out = interval(ratios, [], "ratio")
    summary = facts.agg(
        F.sum("hits").alias("hits"), F.sum("n").cast("bigint").alias("n"), F.sum("m").alias("n_clusters"),
        F.count(F.when(F.col("m") == 1, 1)).alias("single_cluster_strata"), (F.min("f") >= 1 - 1e-12).alias("census"),
        F.max("mixed").alias("mixed"),
    )
    for c in ("hits", "n", "n_clusters", "single_cluster_strata", "census"):
        out = out.withColumn(c, summary.select(c).scalar())
    bad = F.when(summary.select("mixed").scalar(), F.raise_error(F.lit("fraction is not constant within a stratum")).cast("double"))
    return out.select(
        F.coalesce(bad, F.col("est")).alias("estimate"), F.when(F.col("census"), F.col("est")).otherwise(F.col("lo95")).alias("ci_low"),
        F.when(F.col("census"), F.col("est")).otherwise(F.col("hi95")).alias("ci_high"), "hits", "n", "n_clusters",
        "single_cluster_strata", (F.col("hits") < min_hits).alias("too_few"),
    )


def ppi_replicates(rows: DataFrame, gold: DataFrame, by: Sequence[str] = (), lam: float | None = None, n_rep: int = REPLICATES, seed: int = 0, **options) -> DataFrame:
    """(rep, *by, theta, lam, naive, gold_only): PPI++ means (EST-6).

    ``rows``: yhat, weight; ``gold``: y, yhat, weight, sel (selection
    probability in (0, 1]). Each part is resampled on its own.
    """
    w, f = F.col("weight"), F.col("yhat").cast("double")
    a = rows.select("stratum", "cluster", *by, w.alias("a0"), (w * f).alias("a1"), (w * f * f).alias("a2"), (w * w).alias("a3"))
    v, y = F.col("weight") / F.col("sel"), F.col("y").cast("double")
    g = gold.select(
        "stratum", "cluster", *by, v.alias("g0"), (v * y).alias("gy"), (v * f).alias("gf"), (v * y * f).alias("gyf"), (v * v).alias("gvv")
    )
    ra = resample(a, ["a0", "a1", "a2", "a3"], by, n_rep=n_rep, seed=seed, **options)
    rg = resample(g, ["g0", "gy", "gf", "gyf", "gvv"], by, n_rep=n_rep, seed=seed + 1, **options)
    return _corrected(ra.join(rg, ["rep", *by]), by, lam)


def _corrected(rows: DataFrame, by: Sequence[str], lam: float | None) -> DataFrame:
    """The PPI++ mean of each row of joined totals, with λ, the naive and the gold-only mean."""
    rows = rows.withColumn("naive", finite_ratio(F.col("a1"), F.col("a0"))).withColumn("gold_only", finite_ratio(F.col("gy"), F.col("g0")))
    mf = finite_ratio(F.col("gf"), F.col("g0"))
    var = finite_ratio(F.col("a2"), F.col("a0")) - F.col("naive") * F.col("naive")
    cov = finite_ratio(F.col("gyf"), F.col("g0")) - F.col("gold_only") * mf
    kish = finite_ratio(finite_ratio(F.col("g0") * F.col("g0"), F.col("gvv")), finite_ratio(F.col("a0") * F.col("a0"), F.col("a3")))
    tuned = F.when(var > 1e-12, finite_ratio(cov, (1 + kish) * var))
    picked = F.lit(float(lam)) if lam is not None else F.least(F.greatest(F.coalesce(tuned, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("lam", picked)
    return rows.select("rep", *by, (F.col("lam") * F.col("naive") + F.col("gold_only") - F.col("lam") * mf).alias("theta"), "lam", "naive", "gold_only")


def _point_columns(reps: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return reps.filter(F.col("rep") == POINT).select(*keys, *names)


def ppi_mean(rows: DataFrame, gold: DataFrame, **options) -> DataFrame:
    """Corrected mean with interval, λ, naive and gold-only estimates (EST-6)."""
    reps = ppi_replicates(rows, gold, **options)
    out = interval(reps, [], "theta")
    for c in ("lam", "naive", "gold_only"):
        out = out.withColumn(c, _point_columns(reps, [], [c]).scalar())
    return out.select(F.col("est").alias("estimate"), F.col("lo95").alias("ci_low"), F.col("hi95").alias("ci_high"), "lam", "naive", "gold_only")


def ppi_pair(rows: DataFrame, gold: DataFrame, key: str, first: str, second: str, how: str, **options) -> DataFrame:
    """Two corrected means on joint replicates: ratio first/second (EST-7) or difference second-first (EST-8)."""
    reps = ppi_replicates(rows, gold, [key], **options)
    wide = reps.groupBy("rep").agg(
        F.max(F.when(F.col(key) == first, F.col("theta"))).alias("a"), F.max(F.when(F.col(key) == second, F.col("theta"))).alias("b")
    )
    value = finite_ratio(F.col("a"), F.col("b")) if how == "ratio" else F.col("b") - F.col("a")
    return interval(wide.withColumn("v", value), [], "v").select(
        F.col("est").alias("estimate"), F.col("lo95").alias("ci_low"), F.col("hi95").alias("ci_high")
    )


def period_buckets(period: str = "period") -> Column:
    """all and the row's own period."""
    return F.array(F.lit("all"), F.col(period))


def half_buckets(period: str = "period") -> Column:
    half = F.when(F.col(period).between("P01", "P06"), "H1").when(F.col(period).between("P07", "P12"), "H2")
    return F.array_compact(F.array(F.lit("all"), half))


def panel_buckets(period: str = "period") -> Column:
    """all, half, quarter and month of a row (EST-11)."""
    k = F.substring(F.col(period), 2, 2).cast("int")
    inside = F.col(period).isNotNull()
    half = F.when(k <= 6, "h1").otherwise("h2")
    quarter = F.concat(F.lit("q"), (F.floor((k - 1) / 3) + 1).cast("string"))
    return F.when(inside, F.array(F.lit("all"), half, quarter, F.col(period))).otherwise(F.array(F.lit("all")))


def domain_shares(rows: DataFrame, gold: DataFrame, min_gold: int = 10, min_n: int = 30, n_rep: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Domain share among firsthand rows per period and overall (EST-9).

    The PPI ratio replaces the naive share where a period has enough gold
    labels; intervals of thin cells are hidden. ``gold``: comment_id, fh,
    gold_domain, sel.
    """
    reps = share_replicates(rows.filter("firsthand"), "domain", period_buckets(), within=True, n_rep=n_rep, seed=seed)
    naive = interval(reps, ["bucket", "id"], "share", n="n")
    every = rows.withColumn("bucket", F.explode(period_buckets()))
    labelled = every.join(gold, "comment_id")
    counts = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_gold"))
    w, v = F.col("weight").cast("double"), F.col("weight") / F.col("sel")
    f, y = flag(F.col("firsthand")), flag(F.col("fh"))
    same = flag(F.col("fh") & (F.col("gold_domain") == F.col("domain")))

    def part(df: DataFrame, key: Column, sums: dict[str, Column], names: Sequence[str]) -> DataFrame:
        values = [sums.get(c, F.lit(0.0)).alias(c) for c in names]
        return df.select(F.concat_ws("~", "bucket", "stratum").alias("stratum"), "cluster", "bucket", key.alias("id"), *values)

    # A row counts for its own domain only, and for the bucket as a whole: no row is repeated per domain.
    a_names, g_names, whole = ["a0", "a1", "a2", "a3"], ["g0", "gy", "gf", "gyf", "gvv"], F.lit(ALL_KEY)
    in_model = F.col("firsthand") & F.col("domain").isNotNull()
    a = part(every, whole, {"a0": w, "a1": w * f, "a2": w * f, "a3": w * w}, a_names).unionByName(
        part(every.filter(in_model), F.col("domain"), {"a1": w, "a2": w}, a_names)
    )
    g = part(labelled, whole, {"g0": v, "gy": v * y, "gf": v * f, "gyf": v * y * f, "gvv": v * v}, g_names).unionByName(
        part(labelled.filter(in_model), F.col("domain"), {"gf": v, "gyf": v * same}, g_names)
    ).unionByName(part(labelled.filter(F.col("fh") & F.col("gold_domain").isNotNull()), F.col("gold_domain"), {"gy": v}, g_names))
    ra = resample(a, a_names, ["bucket", "id"], n_rep=n_rep, seed=seed)
    rg = resample(g, g_names, ["bucket", "id"], n_rep=n_rep, seed=seed + 1)
    totals = ra.filter(F.col("id") == ALL_KEY).drop("id").join(rg.filter(F.col("id") == ALL_KEY).drop("id"), ["rep", "bucket"])
    den = _corrected(totals, ["bucket"], None).select("rep", "bucket", F.col("theta").alias("den"))
    own = ra.filter(F.col("id") != ALL_KEY).select("rep", "bucket", "id", "a1", "a2").join(
        rg.filter(F.col("id") != ALL_KEY).select("rep", "bucket", "id", "gy", "gf", "gyf"), ["rep", "bucket", "id"], "left"
    ).fillna(0.0, ["gy", "gf", "gyf"])
    num = _corrected(own.join(totals.select("rep", "bucket", "a0", "a3", "g0", "gvv"), ["rep", "bucket"]), ["bucket", "id"], None)
    ratio = num.join(den, ["rep", "bucket"]).select("rep", "bucket", "id", finite_ratio(F.col("theta"), F.col("den")).alias("v"))
    ppi = interval(ratio, ["bucket", "id"], "v").select("bucket", "id", F.col("est").alias("p"), F.col("lo95").alias("plo"), F.col("hi95").alias("phi"))
    out = naive.join(counts, "bucket", "left").join(ppi, ["bucket", "id"], "left")
    use = (F.coalesce("n_gold", F.lit(0)) >= min_gold) & F.col("p").isNotNull()
    thin = F.col("n") < min_n

    def pick(a: str, b: str) -> Column:
        return F.when(use, F.col(a)).otherwise(F.col(b))

    return out.select(
        F.col("id").alias("domain"), F.col("bucket").alias("period"), "n", pick("p", "est").alias("weighted_share"),
        F.when(~thin, pick("plo", "lo95")).alias("ci_low"), F.when(~thin, pick("phi", "hi95")).alias("ci_high"), thin.alias("too_few"),
        F.when(use, F.concat(F.lit("PPI-corrected with "), F.col("n_gold").cast("string"), F.lit(" gold labels"))).otherwise("model labels only").alias("qualifier"),
    )


def difference(reps: DataFrame, first: str, second: str, keys: Sequence[str] = ("id",), value: str = "share") -> DataFrame:
    """second - first bucket per replicate (shared draws)."""
    return reps.groupBy("rep", *keys).agg(
        (F.max(F.when(F.col("bucket") == second, F.col(value))) - F.max(F.when(F.col("bucket") == first, F.col(value)))).alias("diff")
    )


def taxonomy_shares(rows: DataFrame, levels: Sequence[str] = ("group_id", "card_id"), n_rep: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Shares per population, level and bucket, and H2-H1 with adjusted p (EST-10); all levels share the draws of a population."""
    out, key = None, ["level", "id"]
    for population, phases in (("pos", ["pos"]), ("pos+neg", ["pos", "neg"])):
        pop = rows.filter(F.col("phase").isin(*phases))
        inside = level_replicates(pop, levels, half_buckets(), within=True, n_rep=n_rep, seed=seed)
        boxes = interval(inside, ["bucket", *key], "share", n="n")
        named = F.inline(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("id")) for c in levels]))
        people = pop.withColumn("bucket", F.explode(half_buckets())).select("bucket", named, "author").groupBy("bucket", *key).agg(
            F.countDistinct("author").alias("n_authors")
        )
        boxes = boxes.join(people, ["bucket", *key], "left").select(
            "bucket", *key, F.col("est").alias("share"), "lo95", "hi95", "n", F.coalesce("n_authors", F.lit(0)).alias("n_authors"),
            F.lit(None).cast("double").alias("p_adj"),
        )
        shared = difference(level_replicates(pop, levels, half_buckets(), n_rep=n_rep, seed=seed), "H1", "H2", key)
        p = benjamini_hochberg(bootstrap_p(shared, key, "diff"), family=["level"]).select(*key, "p_adj")
        whole = boxes.filter("bucket = 'all'").select(*key, "n", "n_authors")
        moved = interval(shared, key, "diff").join(p, key).join(whole, key).select(
            F.lit("H2_minus_H1").alias("bucket"), *key, F.col("est").alias("share"), "lo95", "hi95", "n", "n_authors",
            F.when(F.col("est").isNotNull(), F.col("p_adj")).alias("p_adj"),
        )
        part = boxes.unionByName(moved).withColumn("population", F.lit(population))
        out = part if out is None else out.unionByName(part)
    return out


def share_panel(rows: DataFrame, level: str, n_rep: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Shares for all, halves, quarters and months with shared replicates (EST-11)."""
    reps = share_replicates(rows, level, panel_buckets(), n_rep=n_rep, seed=seed)
    return interval(reps, ["bucket", "id"], "share", n="n")


def changes(diff_reps: DataFrame, key: str = "id", value: str = "diff") -> DataFrame:
    """Change with interval, adjusted p and empirical-Bayes shrinkage (EST-12)."""
    rows = interval(diff_reps, [key], value).join(bootstrap_p(diff_reps, [key], value), key)
    se = diff_reps.filter(F.col("rep") >= 0).groupBy(key).agg(F.stddev_pop(value).alias("se"))
    rows = rows.join(se, key).withColumn("p", F.when(F.col("est").isNotNull(), F.col("p")))
    good = F.col("est").isNotNull() & F.col("se").isNotNull()
    spread = F.var_pop(F.when(good, F.col("est"))).over(every()) - F.avg(F.when(good, F.col("se") * F.col("se"))).over(every())
    tau2 = F.when(F.count(F.when(good, 1)).over(every()) >= 2, F.greatest(F.lit(0.0), spread)).otherwise(0.0)
    rows = benjamini_hochberg(rows).withColumn("tau2", tau2)
    factor = F.try_divide(F.col("tau2"), F.col("tau2") + F.col("se") * F.col("se"))
    return rows.withColumn("factor", factor).withColumn("shrunk", F.col("est") * F.col("factor")).select(
        key, "est", "lo95", "hi95", "p_adj", "shrunk", "factor"
    )


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def unplaced_and_roles(rows: DataFrame, unstated: Sequence[str] = ("other", "mixed", "unclear"), **options) -> DataFrame:
    """Unplaced share with its domain and role mix; role mix and known share per group (EST-13).

    One long table: measure, key, id.
    """
    unplaced = F.col("card_id").isNull() | (F.col("card_id") == "none")
    stated = F.col("role").isNotNull() & ~F.col("role").isin(*unstated)
    parts = [
        ratio_estimates(rows, {"unplaced": (flag(unplaced), F.lit(1.0))}, **options).select(
            F.col("name").alias("measure"), F.lit("all").alias("key"), F.lit("all").alias("id"), "est", "lo95", "hi95", "n"
        ),
        ratio_estimates(rows, {"known_role": (flag(stated), F.lit(1.0))}, by=["group_id"], **options).select(
            F.col("name").alias("measure"), F.col("group_id").alias("key"), F.lit("all").alias("id"), "est", "lo95", "hi95", "n"
        ),
    ]
    for measure, cond, column, key in (
        ("unplaced_domain", unplaced, "domain", F.lit("all")), ("unplaced_role", unplaced, "role", F.lit("all")),
        ("group_role", stated, "role", F.col("group_id")),
    ):
        kept = rows.filter(cond).withColumn("__key", key).filter("__key IS NOT NULL")
        reps = share_replicates(kept, column, F.array(F.col("__key")), **options)
        parts.append(interval(reps, ["bucket", "id"], "share", n="n").select(
            F.lit(measure).alias("measure"), F.col("bucket").alias("key"), "id", "est", "lo95", "hi95", "n"
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def complaint_rates(rows: DataFrame, **options) -> DataFrame:
    """Domain share among all and among firsthand rows, and their ratio (EST-14)."""
    buckets = F.when(F.col("firsthand"), F.array(F.lit("all"), F.lit("firsthand"))).otherwise(F.array(F.lit("all")))
    reps = share_replicates(rows, "domain", buckets, **options)
    wide = reps.groupBy("rep", "id").agg(
        F.max(F.when(F.col("bucket") == "all", F.col("share"))).alias("talk"), F.max(F.when(F.col("bucket") == "firsthand", F.col("share"))).alias("complaint")
    ).withColumn("rate", finite_ratio(F.col("complaint"), F.col("talk")))
    point = wide.filter(F.col("rep") == POINT).select("id", "talk", "complaint")
    return interval(wide, ["id"], "rate").join(point, "id").select(F.col("id").alias("domain"), "talk", "complaint", F.col("est").alias("rate"), "lo95", "hi95")


def signal_shares(rows: DataFrame, severity_cut: float = 1.5, specificity_cut: float = 2.5, **options) -> DataFrame:
    """Within-card shares of coping and quality signals (EST-15)."""
    pairs = {s: (flag(F.col(f"f_{s}") >= 0.5), F.lit(1.0)) for s in ("paid", "switched", "abandoned", "workaround")}
    pairs["commercial"] = (flag(F.greatest("f_paid", "f_switched", "f_abandoned") >= 0.5), F.lit(1.0))
    pairs["severe"] = (flag(F.col("severity") >= severity_cut), F.lit(1.0))
    pairs["specific"] = (flag(F.col("specificity") >= specificity_cut), F.lit(1.0))
    return ratio_estimates(rows, pairs, by=["card_id"], **options)


def chao_shen(counts: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Chao–Shen entropy in bits from counts per category (EST-16)."""
    n = counts.filter(F.col(x) > 0).groupBy(*keys).agg(F.sum(x).alias("__n"), F.count(F.when(F.col(x) == 1, 1)).alias("__f1"))
    rows = counts.filter(F.col(x) > 0).join(n, list(keys))
    p = (1 - F.col("__f1") / F.col("__n")) * F.col(x) / F.col("__n")
    rows = rows.withColumn("__p", p)
    corr = 1 - F.pow(1 - F.col("__p"), F.col("__n"))
    term = F.when((F.col("__p") > 0) & (corr > 0), F.col("__p") * F.log2("__p") / corr).otherwise(0.0)
    return rows.groupBy(*keys).agg((-F.sum(term)).alias("entropy"))


def card_breadth(rows: DataFrame, n_rep: int = REPLICATES, seed: int = 0, sparse_below: int = 100) -> DataFrame:
    """Entropy of the domain mix per card with interval (EST-16); each card resamples its own units."""
    strata = F.concat_ws("~", "card_id", F.col("stratum").cast("string"))
    flat = rows.filter("domain IS NOT NULL").select(strata.alias("stratum"), "cluster", "card_id", "domain", F.lit(1.0).alias("x"))
    reps = resample(flat, ["x"], ["card_id", "domain"], n_rep=n_rep, seed=seed)
    ent = chao_shen(reps, ["rep", "card_id"])
    n = rows.groupBy("card_id").agg(F.count(F.lit(1)).alias("n"))
    return interval(ent, ["card_id"], "entropy").join(n, "card_id").withColumn("sparse", F.col("n") < sparse_below)


def domain_mix(rows: DataFrame) -> DataFrame:
    """Weighted domain mix and Pearson residual per card and domain (EST-16)."""
    cells = rows.filter("domain IS NOT NULL").groupBy("card_id", "domain").agg(F.count(F.lit(1)).alias("obs"), F.sum("weight").alias("w"))
    row, col = Window.partitionBy("card_id"), Window.partitionBy("domain")
    exp = F.sum("obs").over(row) * F.sum("obs").over(col) / F.sum("obs").over(every())
    return cells.select("card_id", "domain", (F.col("w") / F.sum("w").over(row)).alias("share"), ((F.col("obs") - exp) / F.sqrt(exp)).alias("residual"))


def top_cluster_shares(rows: DataFrame, cluster: str, k: int = 3) -> DataFrame:
    """Weighted share of the largest and the k largest clusters per card (EST-17).

    The constant rank limit lets Spark keep k clusters per card and task.
    """
    sums = rows.filter(F.col(cluster).isNotNull()).groupBy("card_id", cluster).agg(F.sum("weight").alias("w"))
    total = sums.groupBy("card_id").agg(F.sum("w").alias("t"))
    order = Window.partitionBy("card_id").orderBy(F.col("w").desc(), cluster)
    top = sums.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return top.groupBy("card_id").agg(F.max("w").alias("w1"), F.sum("w").alias("wk")).join(total, "card_id").select(
        "card_id", finite_ratio(F.col("w1"), F.col("t")).alias("top1"), finite_ratio(F.col("wk"), F.col("t")).alias(f"top{k}")
    )


def top_counts(rng: np.random.Generator, draws: int, cells: int, k: int) -> list[int]:
    """The k largest counts when ``draws`` fall evenly on ``cells``; halves are dealt first while both numbers are large."""
    if not draws:
        return []
    if min(draws, cells) > DRAWN_AT_ONCE:
        half = cells // 2
        left = int(rng.binomial(draws, half / cells))
        return sorted(top_counts(rng, left, half, k) + top_counts(rng, draws - left, cells - half, k))[-k:]
    if cells <= 4 * draws:
        counts = rng.multinomial(draws, np.full(cells, 1 / cells)) if draws > DRAWN_AT_ONCE else np.bincount(rng.integers(0, cells, draws))
    else:
        counts = np.unique(rng.integers(0, cells, draws), return_counts=True)[1]
    return np.sort(np.partition(counts, max(len(counts) - k, 0))[-k:]).tolist()


def _null_shares(frames: Iterator[pd.DataFrame], sizes: np.ndarray, cells: np.ndarray, k: int, seed: int) -> Iterator[pd.DataFrame]:
    share = sizes * cells / (sizes * cells).sum()
    for frame in frames:
        out = []
        for card, n, first, last in frame[["card_id", "n", "first", "last"]].itertuples(index=False):
            for sim in range(first, last):
                key = int(hashlib.md5(f"{seed}|band|{card}|{sim}".encode()).hexdigest(), 16)
                rng = np.random.Generator(np.random.Philox(key=key))
                falls = rng.multinomial(n, share)
                top = [c for i in np.flatnonzero(falls).tolist() for c in top_counts(rng, int(falls[i]), int(cells[i]), k)]
                out.append((card, sum(sorted(top)[-k:]) / n))
        yield pd.DataFrame(out, columns=["card_id", "s"])


def null_band(rows: DataFrame, cluster: str, sims: int = 500, seed: int = 0, k: int = 3) -> DataFrame:
    """2.5/97.5 percentiles of the top-k share if a card's n problems fell on clusters in proportion to their size (EST-17).

    Clusters of one size are alike, so a simulation deals the n draws over the
    classes of equal size and then evenly inside each class, and only the largest
    counts are kept. No draw is a row: a task gets a card and a few simulations.
    The classes (at most the root of twice the number of rows) go to every task.
    """
    base = rows.filter(F.col(cluster).isNotNull())
    sized = base.groupBy(cluster).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("cells"))
    classes = [(r["size"], r["cells"]) for r in sized.orderBy("size").collect()]
    sizes, cells = (np.array([c[i] for c in classes], dtype=np.int64) for i in (0, 1))
    first = F.explode(F.sequence(F.lit(0), F.lit(sims - 1), F.lit(SIMS_AT_ONCE))).alias("first")
    todo = base.groupBy("card_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("card_id").cast("string").alias("card_id"), "n", first)
    todo = todo.withColumn("last", F.least(F.col("first") + SIMS_AT_ONCE, F.lit(sims)))
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    work = partial(_null_shares, sizes=sizes, cells=cells, k=k, seed=seed)
    shares = todo.repartition(tasks, "card_id", "first").mapInPandas(work, "card_id string, s double")
    q = F.percentile("s", F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    return shares.groupBy("card_id").agg(q).select("card_id", F.col("q")[0].alias("null_lo"), F.col("q")[1].alias("null_hi"))


def concentration_flags(rows: DataFrame, min_n: int = 50, thread_bar: float = 0.30, author_bar: float = 0.10) -> DataFrame:
    """Top thread and author shares with the concentration flag (EST-17)."""
    t = top_cluster_shares(rows, "story_id").select("card_id", F.col("top1").alias("top1_thread"), F.col("top3").alias("top3_threads"))
    a = top_cluster_shares(rows, "author").select("card_id", F.col("top1").alias("top1_author"), F.col("top3").alias("top3_authors"))
    n = rows.groupBy("card_id").agg(F.count(F.lit(1)).alias("n"))
    over = F.coalesce(F.col("top1_thread") > thread_bar, F.lit(False)) | F.coalesce(F.col("top1_author") > author_bar, F.lit(False))
    return n.join(t, "card_id", "left").join(a, "card_id", "left").withColumn("flagged", F.when(F.col("n") >= min_n, over))


def launch_shares(launches: DataFrame, complaints: DataFrame, n_rep: int = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Launch share per card, match rate, and launch/complaint ratio on paired replicates (EST-18).

    ``launches``: story_id, period, weight, card_id (null when unmatched);
    ``complaints``: replicate shares (rep, id, share) of the complaint side.
    """
    total = launches.agg(F.sum("weight")).scalar()
    rows = launches.select(
        F.col("period").alias("stratum"), F.col("story_id").alias("cluster"),
        F.explode(F.array_compact(F.array("card_id", F.when(F.col("card_id").isNotNull(), F.lit("__match")), F.lit("__all")))).alias("id"),
        F.col("weight").alias("x"), F.lit(1.0).alias("n"),
    )
    reps = resample(rows, ["x", "n"], ["id"], n_rep=n_rep, seed=seed).filter("id <> '__all'").withColumn("share", F.col("x") / total)
    shares = interval(reps, ["id"], "share", n="n")
    other = complaints.select("rep", "id", F.col("share").alias("complaint")).filter("complaint > 0")
    paired = reps.join(other, ["rep", "id"]).withColumn("ratio", F.col("share") / F.col("complaint"))
    return shares, interval(paired, ["id"], "ratio", n="n")


def unsolved_shares(rows: DataFrame, min_measured: int = 30, **options) -> DataFrame:
    """Unsolved and author-solved shares among measured rows per card (EST-19)."""
    measured = F.col("unsolved").isNotNull()
    pairs = {
        "unsolved": (flag(F.col("unsolved")), flag(measured)), "author_solved": (flag(F.col("author_says_solved")), flag(measured)),
    }
    counts = rows.groupBy("card_id").agg(F.count(F.when(measured, 1)).alias("n_measured"))
    out = ratio_estimates(rows, pairs, by=["card_id"], **options).drop("n", "sparse").join(counts, "card_id")
    return out.filter(F.col("n_measured") >= min_measured)


def fix_shares(threads: DataFrame, **options) -> DataFrame:
    """Thread-level fix/(fix+complaint) per tool; a thread may count on both sides (EST-20)."""
    cluster = F.coalesce(F.col("story_id"), -F.col("comment_id")).alias("cluster")
    flags = threads.groupBy(cluster, "tool").agg(
        F.min_by("stratum", "comment_id").alias("stratum"), F.max(F.col("is_fix").cast("int")).alias("fix"),
        F.max(F.col("is_complaint").cast("int")).alias("complaint"),
    )
    pair = {"fix_share": (F.col("fix"), F.col("fix") + F.col("complaint"))}
    return ratio_estimates(flags, pair, by=["tool"], weight=None, within=True, **options)


# Components of the opportunity score and the weight presets.
COMPONENTS = ("share", "change", "paid", "unsolved", "severity3", "launch_ratio", "reliability", "customers")
_HALF = {c: 0.5 for c in COMPONENTS}
PRESETS = {
    "balanced": {c: 1.0 for c in COMPONENTS},
    "growth": {**_HALF, "share": 1.0, "change": 3.0},
    "paid_pain": {**_HALF, "paid": 3.0, "severity3": 2.0, "unsolved": 2.0},
    "underbuilt": {**_HALF, "launch_ratio": 3.0, "unsolved": 2.0},
}


def midrank_percentiles(rows: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """(average rank - 0.5)/k over non-null values of a card-sized set."""
    part = [F.col(k) for k in keys] + [F.col(value).isNull()]
    rank = F.rank().over(Window.partitionBy(*part).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, F.col(value)))
    k = F.count(F.lit(1)).over(Window.partitionBy(*part))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), (rank + (ties - 1) / 2 - 0.5) / k))


def weighted_score(components: Sequence[str], weights: dict[str, float]) -> Column:
    """Weighted mean of non-null components; all-zero weights mean equal weights (EST-21)."""
    if sum(weights.get(c, 0.0) for c in components) <= 0:
        weights = {c: 1.0 for c in components}
    used = [(c, float(weights.get(c, 0.0))) for c in components if weights.get(c, 0.0) > 0]
    num = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in used), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in used), F.lit(0.0))
    return finite_ratio(num, den)


def opportunity_scores(cards: DataFrame, presets: dict[str, dict[str, float]], components: Sequence[str], min_n: int = 50) -> DataFrame:
    """Percentile components among cards with enough rows, and preset scores (EST-21)."""
    rows = cards.filter(F.col("n") >= min_n)
    for c in components:
        rows = midrank_percentiles(rows, c, f"__p_{c}").drop(c).withColumnRenamed(f"__p_{c}", c)
    for name, weights in presets.items():
        rows = rows.withColumn(f"score_{name}", weighted_score(components, weights))
    return rows


def rank_stability(reps: DataFrame, components: Sequence[str], weights: dict[str, float], key: str = "card_id", ventiles: int = 20) -> DataFrame:
    """Rank of the score in each replicate, and ventiles of the rank per card (EST-22).

    ``reps``: (rep, card, components…), one row per card and replicate.
    """
    rows = reps.filter(F.col("rep") >= 0)
    for c in components:
        rows = midrank_percentiles(rows, c, f"__p_{c}", ["rep"]).drop(c).withColumnRenamed(f"__p_{c}", c)
    # Scores equal to nine decimals tie, so float noise does not order cards.
    rows = rows.withColumn("score", F.round(weighted_score(components, weights), 9)).filter("score IS NOT NULL")
    ties = F.count(F.lit(1)).over(Window.partitionBy("rep", "score"))
    rows = rows.withColumn("rank", F.rank().over(Window.partitionBy("rep").orderBy(F.col("score").desc())) + (ties - 1) / 2)
    cuts = [i / ventiles for i in range(1, ventiles + 1)]
    found = F.percentile("rank", F.array(*[F.lit(c) for c in cuts]))
    return rows.groupBy(key).agg(found.alias("__q"), F.percentile("rank", F.lit(0.5)).alias("median_rank")).select(
        key, F.transform("__q", lambda v: F.greatest(F.lit(1), F.bround(v).cast("int"))).alias("rank_ventiles"), "median_rank"
    )


def component_replicates(rows: DataFrame, shrink: DataFrame, severity_cut: float = 2.5, n_rep: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(rep, card_id, share, change, paid, severity3) on shared draws (EST-22)."""
    shares = share_replicates(rows, "card_id", half_buckets(), n_rep=n_rep, seed=seed)
    diff = difference(shares, "H1", "H2").join(shrink.select("id", "factor"), "id", "left")
    inside = ratio_replicates(rows.filter("card_id IS NOT NULL"), {
        "paid": (flag(F.greatest("f_paid", "f_switched", "f_abandoned") >= 0.5), F.lit(1.0)),
        "severity3": (flag(F.col("severity") >= severity_cut), F.lit(1.0)),
    }, by=["card_id"], n_rep=n_rep, seed=seed)
    wide = inside.groupBy("rep", "card_id").agg(*[F.max(F.when(F.col("name") == c, F.col("ratio"))).alias(c) for c in ("paid", "severity3")])
    whole = shares.filter("bucket = 'all'").select("rep", F.col("id").alias("card_id"), "share")
    moved = diff.select("rep", F.col("id").alias("card_id"), (F.col("diff") * F.col("factor")).alias("change"))
    return whole.join(moved, ["rep", "card_id"], "left").join(wide, ["rep", "card_id"], "left")


def bundle_shares(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Share of a bundle as the sum of its members' replicate shares (EST-23)."""
    summed = members.join(reps.select("rep", F.col("id").alias("card_id"), "share", "n"), "card_id").groupBy("bundle_id", "rep").agg(
        F.sum("share").alias("share"), F.sum("n").alias("n")
    )
    return interval(summed, ["bundle_id"], "share", n="n")
