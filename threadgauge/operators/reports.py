"""Report tables over estimate tables (PUB-*).

Inputs have one row per card, group, tool, phase or domain; windows without a
key hold such rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.operators.bootstrap import finite_ratio
from threadgauge.operators.spread import require_empty


def every():
    """Window over a whole table of entities (never over rows)."""
    return Window.partitionBy()


TINY = 1e-9


def first_rows(order: Sequence, by: Sequence[str] = ()) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def coping_composition(cards: DataFrame, min_respond: int = 50, top: int = 15) -> DataFrame:
    """paid, workaround, abandoned scaled to one; the largest by commercial marked (PUB-1)."""
    total = F.coalesce("paid", F.lit(0.0)) + F.coalesce("workaround", F.lit(0.0)) + F.coalesce("abandoned", F.lit(0.0))
    rows = cards.withColumn("__t", total).filter((F.col("n") >= min_respond) & (F.col("__t") > 0))
    rows = rows.select(
        "card_id", "n", *[(F.coalesce(c, F.lit(0.0)) / F.col("__t")).alias(c) for c in ("paid", "workaround", "abandoned")],
        F.coalesce("commercial", F.lit(0.0)).alias("commercial"),
    )
    return rows.withColumn("in_side_list", first_rows([F.col("commercial").desc(), "card_id"]) <= top)


def group_cost_profile(costs: DataFrame, shares: DataFrame) -> DataFrame:
    """Share-weighted cost per group and axis, interval from squared half-widths, mean over groups (PUB-2).

    ``costs``: card_id, axis, est, lo95, hi95; ``shares``: card_id, group_id, share, sparse.
    """
    known = shares.filter("NOT sparse").join(costs.select("card_id").distinct(), "card_id", "left_semi")
    totals = known.groupBy("group_id").agg(F.sum("share").alias("__t"))
    rows = known.join(costs, "card_id")
    half = (F.col("hi95") - F.col("lo95")) / 2 * F.col("share")
    sums = rows.groupBy("group_id", "axis").agg(F.sum(F.col("est") * F.col("share")).alias("__s"), F.sqrt(F.sum(half * half)).alias("__h"))
    out = sums.join(totals, "group_id")
    est, h = F.col("__s") / F.col("__t"), F.col("__h") / F.col("__t")
    out = out.select(
        "group_id", "axis", est.alias("est"), F.greatest(F.lit(0.0), est - h).alias("lo"), F.least(F.lit(1.0), est + h).alias("hi")
    )
    return out.withColumn("overall", F.avg("est").over(Window.partitionBy("axis")))


def domain_over_index(domains: DataFrame) -> DataFrame:
    """Complaint rate over the overall rate (PUB-3)."""
    overall = F.sum("complaints").over(every()) / F.greatest(F.sum("discussion").over(every()), F.lit(TINY))
    return domains.withColumn("over_index", F.col("rate") / F.greatest(overall, F.lit(TINY)))


def top_with_ties(cards: DataFrame, n: int = 30) -> DataFrame:
    """Top n by share and every card whose upper bound reaches the n-th share (PUB-4)."""
    rows = cards.withColumn("position", first_rows([F.col("share").desc(), "card_id"]))
    cut = F.min(F.when(F.col("position") <= n, F.col("share"))).over(every())
    rows = rows.withColumn("cut", cut).filter((F.col("position") <= n) | (F.col("hi95") >= F.col("cut")))
    return rows.withColumn("beyond", F.col("position") > n)


def quarter_log_ratio(panel: DataFrame) -> DataFrame:
    """ln(quarter share / full-year share) per group (PUB-5); ``panel``: bucket, id, est."""
    year = panel.filter("bucket = 'all'").select("id", F.col("est").alias("__y"))
    rows = panel.filter(F.col("bucket").rlike("^q[1-4]$")).join(year, "id")
    ratio = F.log(F.greatest("est", F.lit(TINY)) / F.greatest("__y", F.lit(TINY)))
    return rows.select("id", F.col("bucket").alias("quarter"), ratio.alias("log_ratio"))


def spend_receipt(phases: DataFrame, floor: float = 0.02) -> DataFrame:
    """Share of calls and cost per phase; phases small in both merge into other (PUB-6)."""
    calls = F.col("calls") / F.greatest(F.sum("calls").over(every()), F.lit(1))
    cost = F.col("usd") / F.greatest(F.sum("usd").over(every()), F.lit(TINY))
    rows = phases.withColumn("share_calls", calls).withColumn("share_cost", cost)
    small = (F.col("share_calls") < floor) & (F.col("share_cost") < floor)
    merged = rows.withColumn("phase", F.when(small, "other").otherwise(F.col("phase")))
    return merged.groupBy("phase").agg(*[F.sum(c).alias(c) for c in ("calls", "usd", "share_calls", "share_cost")]).withColumn(
        "usd_per_1k", F.col("usd") / F.greatest("calls", F.lit(1)) * 1000
    )


def role_mix(mix: DataFrame, groups: DataFrame, top: int = 6) -> DataFrame:
    """Top roles per group, the rest as other, and group width among placed (PUB-7).

    ``mix``: group_id, role, est; ``groups``: group_id, share.
    """
    width = groups.withColumn("width", F.col("share") / F.sum("share").over(every()))
    rows = mix.join(width, "group_id")
    totals = rows.groupBy("role").agg(F.sum(F.coalesce("est", F.lit(0.0)) * F.col("share")).alias("t"))
    kept = totals.withColumn("r", first_rows([F.col("t").desc(), "role"])).filter(F.col("r") <= top).select("role")
    tiles = rows.join(kept, "role", "left_semi").select("group_id", "width", "role", F.coalesce("est", F.lit(0.0)).alias("share"))
    rest = width.select("group_id", "width").join(tiles.groupBy("group_id").agg(F.sum("share").alias("__s")), "group_id", "left")
    rest = rest.select("group_id", "width", F.lit("other").alias("role"), F.greatest(F.lit(0.0), 1 - F.coalesce("__s", F.lit(0.0))).alias("share"))
    return tiles.unionByName(rest).filter("share > 0.001")


def funnel_bounds(tools: DataFrame, min_threads: int = 10, n_outside: int = 12, n_named: int = 5) -> DataFrame:
    """Bounds around the overall fix share, distance outside, labelled rows (PUB-8)."""
    rows = tools.filter(F.col("threads") >= min_threads)
    overall = F.sum("fix_threads").over(every()) / F.sum("threads").over(every())
    rows = rows.withColumn("overall", overall)
    half = 1.96 * F.sqrt(F.col("overall") * (1 - F.col("overall")) / F.greatest("threads", F.lit(1)))
    rows = rows.withColumn("lo", F.greatest(F.lit(0.0), F.col("overall") - half)).withColumn("hi", F.least(F.lit(1.0), F.col("overall") + half))
    rows = rows.withColumn("est", F.coalesce("fix_share", F.col("fix_threads") / F.greatest("threads", F.lit(1))))
    outside = F.when(F.col("est") > F.col("hi"), "above").when(F.col("est") < F.col("lo"), "below")
    rows = rows.withColumn("outside", outside).withColumn("distance", F.greatest(F.lit(0.0), F.col("est") - F.col("hi"), F.col("lo") - F.col("est")))
    rows = rows.withColumn("__named", first_rows([F.col("threads").desc(), "tool"]) <= n_named)
    rows = rows.withColumn("__out", F.col("outside").isNotNull())
    # Outsiders among the most named already count; the rest fills by distance.
    already = F.count(F.when(F.col("__named") & F.col("__out"), 1)).over(every())
    fill = F.row_number().over(Window.partitionBy(F.col("__out") & ~F.col("__named")).orderBy(F.col("distance").desc(), "tool"))
    rows = rows.withColumn("__already", already).withColumn("__fill", fill)
    labelled = F.col("__named") | (F.col("__out") & ~F.col("__named") & (F.col("__fill") <= F.lit(n_outside) - F.col("__already")))
    return rows.select("tool", "threads", "est", "lo", "hi", "outside", "distance", labelled.alias("labelled"))


def rank_ranges(ranks: DataFrame, widest: int = 3) -> DataFrame:
    """Best and worst rank over specifications, the widest flagged (PUB-9); ``ranks``: spec, card_id, rank."""
    rows = ranks.groupBy("card_id").agg(
        F.max(F.when(F.col("spec") == "main", F.col("rank"))).alias("main"), F.min("rank").alias("best"), F.max("rank").alias("worst")
    )
    return rows.withColumn("fragile", first_rows([(F.col("worst") - F.col("best")).desc(), "main", "card_id"]) <= widest)


def resolved_share(cards: DataFrame) -> DataFrame:
    """Share-weighted mean of unsolved over measured cards (PUB-10)."""
    measured = cards.filter("unsolved IS NOT NULL")
    return measured.agg(finite_ratio(F.sum(F.col("share") * F.col("unsolved")), F.sum("share")).alias("no_fix")).withColumn("fix", 1 - F.col("no_fix"))


def evidence_scores(rows: DataFrame, weights: Sequence[float], lane: str | None = None, domain: str | None = None, card: str | None = None) -> DataFrame:
    """Weighted mean of six signals; three come from the probability JSON, missing is 0 (PUB-11)."""
    if lane is not None:
        rows = rows.filter(F.col("lane") == lane)
    if domain is not None:
        rows = rows.filter(F.col("domain") == domain)
    if card is not None:
        rows = rows.filter(F.col("subtopic") == card)
    p = F.from_json("probabilities_json", "map<string,double>")
    terms = [
        F.col("specificity") / 3, F.try_element_at(p, F.lit("concrete_task")), F.col("workaround_p"), F.col("consequence_any_p"),
        F.try_element_at(p, F.lit("behavior_any")), F.try_element_at(p, F.lit("timing_current")),
    ]
    total = sum(weights) or 1.0
    score = sum((F.coalesce(t, F.lit(0.0)) * float(w) for t, w in zip(terms, weights, strict=True)), F.lit(0.0)) / total
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), "comment_id")


def launch_points(cards: DataFrame, min_n: int = 100, n_labels: int = 8) -> DataFrame:
    """log10 of complaint and launch shares, zero floor, lowest ratios labelled (PUB-12)."""
    zero = F.coalesce(F.col("launch_share") <= 0, F.lit(True))
    rows = cards.select(
        "card_id", F.log10(F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(1e-5))).alias("x"),
        F.when(zero, 0.0).otherwise(F.log10(F.greatest("launch_share", F.lit(1e-5)))).alias("y"), zero.alias("floor"), "ratio",
        ((F.col("n") >= min_n) & F.col("ratio").isNotNull()).alias("__ok"),
    )
    order = F.row_number().over(Window.partitionBy("__ok").orderBy("ratio", "card_id"))
    return rows.withColumn("__r", order).withColumn("labelled", F.col("__ok") & (F.col("__r") <= n_labels)).drop("__ok", "__r")


def significant_movers(changes: DataFrame, concentration: DataFrame) -> DataFrame:
    """Changes with adjusted p under 0.05 by shrunk size, concentration marked (PUB-13)."""
    rows = changes.filter("p_adj < 0.05").join(concentration.select("id", "top3_threads"), "id", "left")
    move = F.coalesce("shrunk", "est")
    return rows.select("id", move.alias("shrunk"), "est", "p_adj", (F.coalesce("top3_threads", F.lit(0.0)) > 0.5).alias("hollow")).orderBy(F.col("shrunk").desc(), "id")


def opportunity_list(scores: DataFrame, stability: DataFrame, score: str, weights: dict[str, float], min_n: int = 200, top: int = 20, tied: int = 3, delta: float = 5.0) -> DataFrame:
    """Top cards by score; unstable when the median rank is far from the shown one (PUB-14)."""
    pool = scores.filter(F.col("n") >= min_n)
    if weights.get("unsolved", 0.0) > 0:
        pool = pool.filter("unsolved IS NOT NULL")
    rows = pool.withColumn("rank", first_rows([F.col(score).desc_nulls_last(), "card_id"])).filter(F.col("rank") <= top)
    rows = rows.join(stability.select("card_id", "median_rank"), "card_id", "left")
    return rows.select(
        "card_id", F.col(score).alias("score"), "rank", (F.col("rank") <= tied).alias("tied"),
        F.coalesce(F.abs(F.col("median_rank") - F.col("rank")) > delta, F.lit(False)).alias("unstable"),
    )


def bundle_view(members: DataFrame, edges: DataFrame, min_persistence: float = 0.5) -> DataFrame:
    """Edges whose ends lie in one persistent bundle (PUB-15); ``members``: bundle_id, card_id, persistence."""
    kept = members.filter(F.coalesce("persistence", F.lit(0.0)) >= min_persistence)
    a = kept.select(F.col("card_id").alias("a"), "bundle_id")
    b = kept.select(F.col("card_id").alias("b"), F.col("bundle_id").alias("__o"))
    return edges.join(a, "a").join(b, "b").filter("bundle_id = __o").select("bundle_id", "a", "b", "score")


def breadth_list(entropy: DataFrame, mix: DataFrame, min_n: int = 100) -> DataFrame:
    """Cards by entropy with their three largest domains (PUB-16)."""
    top = mix.withColumn("r", first_rows([F.col("share").desc(), "domain"], ["card_id"])).filter("r <= 3")
    text = F.concat(F.col("domain"), F.lit(" "), F.round(F.col("share") * 100).cast("int").cast("string"), F.lit("%"))
    listed = top.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))).alias("l")).select(
        "card_id", F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("domains")
    )
    return entropy.filter(F.col("n") >= min_n).join(listed, "card_id", "left").select("card_id", "entropy", "n", "domains").orderBy("entropy", "card_id")


def taxonomy_tree(groups: DataFrame, cards: DataFrame, unplaced: DataFrame) -> DataFrame:
    """Group, its share and its cards by share, plus an unplaced node (PUB-17); cards per group are bounded."""
    entry = F.struct((-F.greatest("share", F.lit(0.0001))).alias("o"), "card_id")
    kids = cards.groupBy("group_id").agg(F.array_sort(F.collect_list(entry)).alias("k")).select(
        "group_id", F.transform("k", lambda x: x["card_id"]).alias("cards")
    )
    tree = groups.join(kids, "group_id", "left").select("group_id", F.col("share").alias("value"), "cards")
    return tree.unionByName(unplaced.select(F.lit("__unplaced").alias("group_id"), F.col("share").alias("value"), F.array(F.lit("__unplaced")).alias("cards")))


def term_rows(terms: DataFrame, top: int = 8) -> DataFrame:
    """Top terms per group with the interval midpoint (PUB-18)."""
    rows = terms.withColumn("position", first_rows([F.col("z").desc(), "term"], ["group_id"])).filter(F.col("position") <= top)
    return rows.select("group_id", "position", "term", ((F.col("lo95") + F.col("hi95")) / 2).alias("delta"), "n_comments", "n_authors")


def method_summary(runs: DataFrame, quality: DataFrame) -> DataFrame:
    """Totals over runs and quality values as (item, value) rows (PUB-19)."""
    totals = runs.agg(F.sum("calls").cast("double").alias("total_calls"), F.sum("calculated_usd").alias("total_usd"), F.count(F.lit(1)).cast("double").alias("runs"))
    rows = totals.unpivot([], ["total_calls", "total_usd", "runs"], "item", "value")
    return rows.unionByName(quality.select(F.concat_ws(":", "system", "metric").alias("item"), F.col("value").cast("double").alias("value")))


def wording_panel(robustness: DataFrame) -> DataFrame:
    """Prevalence rows, paraphrase runs marked by having agreement rows (PUB-20)."""
    para = robustness.filter(F.col("metric").isin("agreement", "kappa", "spearman")).select("run_id").distinct().withColumn("__p", F.lit(True))
    rows = robustness.filter("check = 'screen_wording' AND metric = 'prevalence'").join(para, "run_id", "left")
    return rows.select("run_id", F.when(F.col("__p"), "paraphrase").otherwise("main").alias("kind"), "value", "lo", "hi")


def quality_panel(quality: DataFrame) -> DataFrame:
    """Strict precision of model and random control, then synthetic rows (PUB-20)."""
    audit = quality.filter("label_set = 'assignment_audit' AND metric = 'precision_strict' AND system IN ('pick', 'random')").select(
        F.col("system").alias("label"), "value", F.lit(False).alias("synthetic")
    )
    bench = quality.filter("label_set = 'synthetic'").select(
        F.concat(F.replace("question_id", F.lit("_"), F.lit(" ")), F.lit(" "), F.replace("metric", F.lit("_"), F.lit(" "))).alias("label"), "value", F.lit(True).alias("synthetic")
    )
    return audit.unionByName(bench)


def display_labels(rows: DataFrame, labels: DataFrame, key: str, full: str, most: int = 32) -> DataFrame:
    """Short label, else the full text; short labels over the cap are an error (PUB-21)."""
    require_empty(labels.filter(F.length("short") > most), "label too long")
    return rows.join(labels.select(key, "short"), key, "left").withColumn("display", F.coalesce("short", full)).drop("short")


def missing_labels(choices: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Choices without a label; empty when the labels cover them (PUB-21)."""
    return choices.select(key).distinct().join(labels.select(key), key, "left_anti")


# Each funnel step and the step it is a share of.
FUNNEL_BASE = {"eligible": "all", "screened": "eligible", "firsthand": "eligible", "placed": "firsthand"}


def funnel_ratios(steps: DataFrame, base: dict[str, str] = FUNNEL_BASE) -> DataFrame:
    """Each step as a share of its base step (PUB-22)."""
    names = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    rows = steps.withColumn("base", F.try_element_at(names, F.col("step")))
    other = steps.select(F.col("step").alias("base"), F.col("count").alias("__b"))
    return rows.join(other, "base", "left").select("step", "count", "base", finite_ratio(F.col("count").cast("double"), F.col("__b")).alias("ratio"))


def card_profiles(cards: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One wide row per card; each part's columns take its name as prefix (PUB-23)."""
    out = cards
    for name, df in parts.items():
        renamed = df.select("card_id", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "card_id"])
        out = out.join(renamed, "card_id", "left")
    return out
