"""Label quality: precision and recall, thresholds, reliability, audits (MET-*).

Labelled rows carry y (0/1), score, weight, stratum, cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.functions import text as tx
from threadgauge.operators.bootstrap import POINT, finite_ratio, interval, resample
from threadgauge.operators.spread import latest_by, require_empty, value_ranks
from threadgauge.session import cut_lineage

MIN_JOIN_COVERAGE = 0.9
CUTS = 64


def _confusion(rows: DataFrame, said: Column, by: Sequence[str]) -> DataFrame:
    y, w = F.col("y") == 1, F.col("weight")

    def part(cond: Column) -> Column:
        return F.when(cond, w).otherwise(0.0)

    return rows.select("stratum", "cluster", *by, part(y & said).alias("tp"), part(~y & said).alias("fp"), part(y & ~said).alias("fn"))


def binary_metrics(rows: DataFrame, threshold: float, by: Sequence[str] = (), **options) -> DataFrame:
    """Weighted precision, recall, F1 with intervals; one row per metric (MET-1).

    ``n_undefined`` counts replicates without precision or recall.
    """
    said = F.col("score") >= threshold
    reps = resample(_confusion(rows, said, by), ["tp", "fp", "fn"], by, **options)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    values = {
        "precision": finite_ratio(tp, tp + fp), "recall": finite_ratio(tp, tp + fn), "f1": finite_ratio(2 * tp, 2 * tp + fp + fn),
    }
    reps = reps.select("rep", *by, *[v.alias(k) for k, v in values.items()])
    gone = reps.filter(F.col("rep") >= 0).groupBy(*by).agg(
        F.count(F.when(F.col("precision").isNull() | F.col("recall").isNull(), 1)).alias("n_undefined")
    )
    long = reps.unpivot(["rep", *by], list(values), "metric", "v")
    out = interval(long, [*by, "metric"], "v").drop("lo50", "hi50")
    return out.join(gone, list(by)) if by else out.withColumn("n_undefined", gone.scalar())


def confusion_counts(rows: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted tp, fp, fn, tn (MET-1)."""
    y, said = F.col("y") == 1, F.col("score") >= threshold
    return rows.groupBy(*by).agg(
        F.count(F.when(y & said, 1)).alias("tp"), F.count(F.when(~y & said, 1)).alias("fp"),
        F.count(F.when(y & ~said, 1)).alias("fn"), F.count(F.when(~y & ~said, 1)).alias("tn"),
    )


def threshold_for_recall(rows: DataFrame, target: float) -> DataFrame:
    """Largest threshold whose weighted recall reaches the target (MET-2)."""
    ranks = value_ranks(rows.filter("y = 1").select("score", "weight"), [], "score", ["weight"], descending=True)
    total = ranks.agg(F.sum("weight")).scalar()
    reached = F.col("weight_below") + F.col("weight") >= F.lit(target - 1e-12) * total
    return ranks.agg(F.max(F.when(reached, F.col("score"))).alias("threshold"))


def _recall_bounds(pos: DataFrame, none: DataFrame, cuts: list[float], alpha: float, **options) -> list[tuple[float, float | None, float | None]]:
    """(cut, lower bound, point) of the recall at each of a few rising cuts: scores fall into the gaps between them."""
    gap = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("score")))
    flat = pos.select("stratum", "cluster", gap.alias("gap"), "w").unionByName(none.withColumn("gap", F.lit(0)))
    reps = resample(flat, ["w"], ["gap"], **options).withColumn("gap", F.col("gap").cast("int"))
    above = Window.partitionBy("rep").orderBy(F.col("gap").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reps = reps.withColumn("recall", finite_ratio(F.sum("w").over(above), F.sum("w").over(Window.partitionBy("rep"))))
    found = reps.filter("gap > 0").groupBy("gap").agg(
        F.percentile(F.when(F.col("rep") >= 0, F.col("recall")), F.lit(alpha)).alias("lower"),
        F.max(F.when(F.col("rep") == POINT, F.col("recall"))).alias("point"),
    )
    return [(cuts[r["gap"] - 1], r["lower"], r["point"]) for r in found.orderBy("gap").collect()]


def threshold_by_lower_bound(rows: DataFrame, target: float, alpha: float = 0.05, cuts: int = CUTS, **options) -> DataFrame:
    """Largest threshold whose one-sided bootstrap recall bound reaches the target (MET-3).

    Recall falls as the threshold rises in every replicate, and so does its bound.
    So a round asks for the bound at a few scores only and the next one looks
    between the two neighbours where it crosses the target, on the same draws: the
    result is that of all scores, while a replicate never has more than ``cuts``
    rows. Nulls if no score reaches the target.
    """
    pos = cut_lineage(rows.filter("y = 1").select("stratum", "cluster", F.col("score").cast("double").alias("score"), F.col("weight").alias("w")))
    none = rows.filter("y <> 1").select("stratum", "cluster", F.lit(0.0).alias("w"))
    best, inside = (None, None, None), pos.filter("score IS NOT NULL")
    while True:
        values = [r[0] for r in inside.select("score").distinct().limit(cuts + 1).collect()]
        if len(values) > cuts:
            shares = F.array(*[F.lit((i + 0.5) / cuts) for i in range(cuts)])
            values = inside.agg(F.percentile_approx("score", shares, 100 * cuts)).first()[0]
        values = sorted(set(values))
        if not values:
            break
        good = [b for b in _recall_bounds(pos, none, values, alpha, **options) if b[1] is not None and b[1] >= target - 1e-12]
        over = [v for v in values if not good or v > good[-1][0]]
        if good:
            best = good[-1]
            inside = inside.filter(F.col("score") > best[0])
        inside = inside.filter(F.col("score") < over[0]) if over else inside
    schema = "threshold double, recall_lower_bound double, point_recall double"
    return rows.sparkSession.createDataFrame([best], schema)


def reliability_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Weighted mean predicted and observed per score bin, empty bins kept (MET-4)."""
    s = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    index = F.least(F.floor(s * bins), F.lit(bins - 1)).cast("bigint")
    w = F.col("weight")
    got = rows.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight"), finite_ratio(F.sum(w * s), F.sum(w)).alias("mean_predicted"),
        finite_ratio(F.sum(w * F.col("y")), F.sum(w)).alias("observed"),
    )
    grid = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(got, "bin", "left").fillna(0, ["n"]).fillna(0.0, ["weight"])


def choice_confusion(pairs: DataFrame, truth: str, said: str) -> tuple[DataFrame, DataFrame]:
    """Accuracy row and the matrix of counts (MET-5)."""
    matrix = pairs.groupBy(truth, said).agg(F.count(F.lit(1)).alias("n"))
    accuracy = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(said)).cast("double")).alias("accuracy"))
    return accuracy, matrix


def latest_labels(rows: DataFrame, void_labels: DataFrame, unblinded: DataFrame) -> DataFrame:
    """Excluded rows dropped first, then the last label per (set, comment, question) (MET-9)."""
    kept = rows.join(unblinded.select("comment_id"), "comment_id", "left_anti").join(void_labels.select("label_id"), "label_id", "left_anti")
    return latest_by(kept.select(*rows.columns), ["label_set", "comment_id", "question_id"], ["seq"])


def exclusion_counts(rows: DataFrame, void_labels: DataFrame, unblinded: DataFrame) -> DataFrame:
    """Excluded label rows by reason; an unblinded comment wins over a void label (MET-9)."""
    marked = rows.join(unblinded.select("comment_id", F.col("reason").alias("__c")), "comment_id", "left").join(
        void_labels.select("label_id", F.col("reason").alias("__l")), "label_id", "left"
    )
    reason = F.coalesce("__c", "__l")
    return marked.filter(reason.isNotNull()).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def rater_agreement(first: DataFrame, repeats: DataFrame) -> DataFrame:
    """Agreement of repeated labels per question (MET-6)."""
    pairs = first.select("comment_id", "question_id", "value").join(
        repeats.select("comment_id", "question_id", F.col("value").alias("again")), ["comment_id", "question_id"]
    )
    return pairs.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") == F.col("again")).cast("double")).alias("agreement"))


def evaluation_rows(labels: DataFrame, answers: DataFrame, queue: DataFrame, design: DataFrame) -> DataFrame:
    """Labelled rows ready for the metrics: weight 1/rate × design weight, stratum band, cluster story (MET-6).

    A join coverage under 90% is an error.
    """
    joined = labels.join(answers.filter("noul IS NOT NULL").select("comment_id", F.col("noul").alias("score")), "comment_id", "left")
    low = joined.agg(F.count("score").alias("n_joined"), F.count(F.lit(1)).alias("n_labeled")).filter(
        F.col("n_joined") < MIN_JOIN_COVERAGE * F.col("n_labeled")
    )
    require_empty(low, "join coverage too low")
    rows = joined.filter("score IS NOT NULL AND value <> 'unsure'").join(queue.select("comment_id", "band", "rate"), "comment_id")
    rows = rows.join(design.select("comment_id", F.col("weight").alias("__w"), "story_id"), "comment_id", "left")
    return rows.select(
        "comment_id", F.when(F.col("value") == "yes", 1).otherwise(0).alias("y"), "score",
        (F.coalesce("__w", F.lit(1.0)) / F.col("rate")).alias("weight"), F.col("band").alias("stratum"),
        F.coalesce("story_id", "comment_id").alias("cluster"),
    )


def evaluation_report(rows: DataFrame, texts: DataFrame, target: float, min_yes: int = 60, **options) -> DataFrame:
    """Metric rows for the model at its threshold and for the keyword baseline, with the stop rule (MET-6)."""
    found = threshold_by_lower_bound(rows, target, **options).first()["threshold"]
    cut = 0.5 if found is None else found
    model = binary_metrics(rows, cut, **options).withColumn("system", F.lit("model")).withColumn("threshold", F.lit(float(cut)))
    base = rows.join(texts.select("comment_id", tx.keyword_score(F.col("text")).alias("__k")), "comment_id").withColumn("score", F.col("__k"))
    other = binary_metrics(base, 0.5, **options).withColumn("system", F.lit("keyword")).withColumn("threshold", F.lit(0.5))
    enough = rows.agg(F.count(F.when(F.col("y") == 1, 1)) >= min_yes).scalar()
    return model.unionByName(other).withColumn("stop_rule_met", enough)


def assignment_audit(rows: DataFrame, target: float = 0.75, **options) -> DataFrame:
    """Strict and lenient precision for shown picks and random cards, with the gap (MET-7).

    ``rows``: value (yes/partly/no/unsure), is_pick, weight, stratum, cluster.
    """
    usable = rows.filter("value <> 'unsure'").withColumn("group", F.when(F.col("is_pick"), "pick").otherwise("random"))
    strata = F.concat_ws("~", "group", F.col("stratum").cast("string"))
    flat = usable.select(
        strata.alias("stratum"), "cluster", "group", F.col("weight").alias("w"),
        F.when(F.col("value").isin("yes", "partly"), F.col("weight")).otherwise(0.0).alias("lenient"),
        F.when(F.col("value") == "yes", F.col("weight")).otherwise(0.0).alias("strict"),
    )
    reps = resample(flat, ["w", "lenient", "strict"], ["group"], **options)
    reps = reps.select("rep", "group", *[finite_ratio(F.col(c), F.col("w")).alias(c) for c in ("lenient", "strict")])
    out = interval(reps.unpivot(["rep", "group"], ["lenient", "strict"], "rule", "v"), ["group", "rule"], "v").drop("lo50", "hi50")
    gap = Window.partitionBy("rule")
    pick = F.max(F.when(F.col("group") == "pick", F.col("est"))).over(gap)
    rand = F.max(F.when(F.col("group") == "random", F.col("est"))).over(gap)
    return out.withColumn("gap", pick - rand).withColumn("meets_target", pick >= target)


def facet_audit(labels: DataFrame, answers: DataFrame, **options) -> DataFrame:
    """Precision and recall per facet question at 0.5 (MET-8)."""
    rows = labels.filter("value <> 'unsure'").join(
        answers.filter("noul IS NOT NULL").select("comment_id", "question_id", F.col("noul").alias("score")), ["comment_id", "question_id"]
    ).withColumn("y", F.when(F.col("value") == "yes", 1).otherwise(0))
    strata = F.concat_ws("~", "question_id", F.col("stratum").cast("string"))
    return binary_metrics(rows.withColumn("stratum", strata), 0.5, ["question_id"], **options).filter("metric <> 'f1'")


def quality_rows(report: DataFrame, keys: Sequence[str], metrics: Sequence[str], system: str) -> DataFrame:
    """A wide report as (keys, metric, value, system) rows (MET-10)."""
    return report.unpivot(list(keys), list(metrics), "metric", "value").withColumn("system", F.lit(system))
