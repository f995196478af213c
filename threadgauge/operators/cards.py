"""Card metrics, convergence, finding gate, rankings and evidence (CRD-*).

Inputs are wide coded rows: comment_id, card_id, card_p, author, story_id,
period, half, weight, the f_* signals, domain, role, resolution, specificity.
Tables with one row per card are taxonomy-sized; windows without a key are only
used on those.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = "none"
NOT_STATED = ("other", "mixed", "unclear")
SIGNALS = ("workaround", "paid", "switched", "abandoned")


def every():
    """Window over a whole table of entities (never over rows)."""
    return Window.partitionBy()


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def card_comments(assignments: DataFrame, comments: DataFrame, sample: DataFrame | None = None, min_p: float = 0.5) -> DataFrame:
    """Assignments with a real card and p at the cut, joined to comments and weights (CRD-1)."""
    real = assignments.filter(F.col("card_id").isNotNull() & (F.col("card_id") != NONE) & (F.col("card_p") >= min_p))
    rows = real.join(comments, "comment_id")
    return rows if sample is None else rows.join(sample.select("comment_id", "weight"), "comment_id", "left")


def yes_rate(col: str, cut: float = 0.5) -> Column:
    """Share at or over the cut among non-null values; null when there are none."""
    return F.try_divide(F.count(F.when(F.col(col) >= cut, 1)).cast("double"), F.count(col))


def commercial(paid: Column, switched: Column, abandoned: Column) -> Column:
    """Largest of the three, nulls ignored (CRD-5)."""
    return F.greatest(paid, switched, abandoned)


def capped_counts(rows: DataFrame, cap: int) -> DataFrame:
    """Comments per card with each author capped; null authors count one each (CRD-3)."""
    per = rows.groupBy("card_id", "author").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("author").isNull(), F.col("n")).otherwise(F.least("n", F.lit(cap)))
    return per.groupBy("card_id").agg(F.sum(n).alias("n_comments_capped"))


def concentration_shares(rows: DataFrame) -> DataFrame:
    """Largest thread and author share per card (CRD-4).

    A null story stands for itself; null authors stay out of the author share.
    """
    return _largest(rows).select("card_id", "max_thread_share", "max_author_share")


def _largest(rows: DataFrame) -> DataFrame:
    """Per card: numbers of threads and authors and the shares of the largest of them, from rows merged by thread and by author."""
    own = F.coalesce(F.concat(F.lit("s"), F.col("story_id").cast("string")), F.concat(F.lit("c"), F.col("comment_id").cast("string")))
    threads = rows.groupBy("card_id", own.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("story_id").isNotNull().cast("int")).alias("thread"))
    threads = threads.groupBy("card_id").agg(F.max("n").alias("__t"), F.sum("n").alias("__n"), F.sum("thread").alias("n_threads"))
    authors = rows.filter("author IS NOT NULL").groupBy("card_id", "author").agg(F.count(F.lit(1)).alias("n")).groupBy("card_id").agg(
        F.max("n").alias("__a"), F.count(F.lit(1)).alias("n_authors")
    )
    return threads.join(authors, "card_id", "left").select(
        "card_id", (F.col("__t") / F.col("__n")).alias("max_thread_share"), (F.col("__a") / F.col("__n")).alias("max_author_share"),
        "n_threads", F.coalesce("n_authors", F.lit(0)).alias("n_authors"),
    )


def unsolved_rates(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Among card comments with replies, share without any solved_p at 0.5 (CRD-6)."""
    best = replies.groupBy("comment_id").agg(F.max((F.coalesce(F.col("solved_p") >= 0.5, F.lit(False))).cast("int")).alias("any"))
    return rows.select("card_id", "comment_id").join(best, "comment_id").groupBy("card_id").agg(
        F.avg(F.when(F.col("any") == 0, 1.0).otherwise(0.0)).alias("unsolved_rate")
    )


def card_metrics(rows: DataFrame, cap: int = 3, replies: DataFrame | None = None) -> DataFrame:
    """All per-card metrics of the ranking (CRD-2).

    Threads and authors are counted from rows merged by them; periods, domains
    and roles come from short fixed lists, so a set of each is merged per card.
    No row is repeated for a distinct count.
    """

    def stated(col: str) -> Column:
        return F.when(~F.col(col).isin(*NOT_STATED), F.col(col))

    half = F.when(F.col("period").between("P01", "P06"), "H1").when(F.col("period").between("P07", "P12"), "H2")
    base = rows.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("n_comments"),
        *[F.size(F.collect_set(c)).cast("bigint").alias(n) for n, c in (("n_periods", F.col("period")), ("n_halfyears", half), ("n_domains", stated("domain")), ("n_roles", stated("role")))],
        *[yes_rate(f"f_{s}").alias(f"{s}_rate") for s in SIGNALS],
        F.try_divide(F.count(F.when(F.col("resolution") == "unresolved", 1)).cast("double"), F.count("resolution")).alias("unresolved_rate"),
        F.avg("specificity").alias("mean_specificity"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weighted_n"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"),
    )
    base = base.withColumn("commercial_rate", commercial(*[F.col(f"{s}_rate") for s in ("paid", "switched", "abandoned")]))
    out = base.join(capped_counts(rows, cap), "card_id", "left").join(_largest(rows), "card_id", "left")
    if replies is None:
        return out.withColumn("unsolved_rate", F.lit(None).cast("double"))
    return out.join(unsolved_rates(rows, replies), "card_id", "left")


def category_matrix(rows: DataFrame, category: str) -> DataFrame:
    """Distinct authors per (card, category), unstated values left out (CRD-7)."""
    kept = rows.filter(F.col(category).isNotNull() & ~F.col(category).isin(*NOT_STATED))
    return kept.groupBy("card_id", category).agg(F.countDistinct("author").alias("n_authors"))


def convergence(rows: DataFrame) -> DataFrame:
    """Effective number of domains and roles per card, 0 when none (CRD-8)."""
    out = rows.select("card_id").distinct()
    for category in ("domain", "role"):
        total = F.sum("n_authors").over(Window.partitionBy("card_id"))
        p = category_matrix(rows, category).withColumn("p", F.col("n_authors") / total)
        eff = p.filter("p > 0").groupBy("card_id").agg(F.exp(-F.sum(F.col("p") * F.log("p"))).alias(f"effective_{category}s"))
        out = out.join(eff, "card_id", "left")
    return out.fillna(0.0, ["effective_domains", "effective_roles"])


CRITERIA = {"n_authors": ("min", 10), "n_periods": ("min", 3), "n_domains": ("min", 2), "max_thread_share": ("max", 0.30)}


def finding_gate(explore: DataFrame, confirm: DataFrame, criteria: dict = CRITERIA) -> DataFrame:
    """Each criterion in both halves, with the list of failed ones (CRD-9)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        failed = []
        for col, (kind, limit) in criteria.items():
            bad = F.col(col).isNull() | (F.col(col) < limit if kind == "min" else F.col(col) > limit)
            failed.append(F.when(bad, F.lit(f"{name}: {col}")))
        return df.select("card_id", F.array_compact(F.array(*failed)).alias(f"__{name}"))

    rows = side(explore, "explore").join(side(confirm, "confirm"), "card_id", "full")
    reasons = F.concat(*[F.coalesce(f"__{n}", F.array(F.lit(f"{n}: missing"))) for n in ("explore", "confirm")])
    rows = rows.select(
        "card_id", reasons.alias("reasons"),
        *[F.coalesce(F.size(f"__{n}") == 0, F.lit(False)).alias(f"passes_{n}") for n in ("explore", "confirm")],
    )
    return rows.withColumn("candidate", F.col("passes_explore") & F.col("passes_confirm"))


def ranking_inputs(metrics: DataFrame, conv: DataFrame | None = None) -> DataFrame:
    """Metrics with the columns the weights name (CRD-11)."""
    out = metrics.withColumn("n_authors_capped", F.col("n_comments_capped"))
    if "commercial_rate" not in out.columns:
        out = out.withColumn("commercial_rate", commercial(F.col("paid_rate"), F.col("switched_rate"), F.col("abandoned_rate")))
    return out if conv is None else out.join(conv, "card_id", "left")


# Ranking components and their default weights.
RANKING_WEIGHTS = {
    "n_authors_capped": 1.0,
    "n_threads": 1.0,
    "n_periods": 1.0,
    "effective_domains": 1.0,
    "effective_roles": 1.0,
    "workaround_rate": 1.0,
    "commercial_rate": 1.0,
    "unresolved_rate": 1.0,
    "mean_specificity": 1.0,
    "max_thread_share": -1.0,
}


def rank_cards(metrics: DataFrame, weights: dict[str, float] = RANKING_WEIGHTS) -> DataFrame:
    """Weighted sum of min-max normalised components, ordinal rank, ties by card (CRD-10)."""
    unknown = [k for k in weights if k not in metrics.columns]
    if unknown:
        raise ValueError(f"no metric column for weights {unknown}")
    rows = metrics.select("card_id", *weights)
    score = F.lit(0.0)
    for name, weight in weights.items():
        low, high = F.min(name).over(every()), F.max(name).over(every())
        norm = F.coalesce(F.when(high > low, (F.col(name) - low) / (high - low)), F.lit(0.0))
        rows = rows.withColumn(f"{name}_norm", norm)
        score = score + F.lit(float(weight)) * F.col(f"{name}_norm")
    rows = rows.withColumn("score", score)
    order = Window.orderBy(F.col("score").desc(), "card_id")
    return rows.withColumn("rank", F.row_number().over(order)).drop(*weights)


def evidence_rows(rows: DataFrame) -> DataFrame:
    """Positive-phase comments with consequence, specificity and strength (CRD-13)."""
    consequence = F.greatest("f_paid", "f_switched", "f_abandoned")
    spec = F.least(F.greatest(F.col("specificity") / 3.0, F.lit(0.0)), F.lit(1.0))
    out = rows.filter("phase = 'pos'").withColumn("consequence_any_p", consequence).withColumn("specificity_n", spec)
    signals = F.array_compact(F.array("firsthand_p", "f_workaround", "consequence_any_p", "specificity_n"))
    total = F.aggregate(signals, F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "comment_id", "domain", F.when(F.col("card_id") != NONE, F.col("card_id")).alias("subtopic"), "period", "story_id",
        "firsthand_p", "specificity", F.col("f_workaround").alias("workaround_p"), "consequence_any_p",
        F.try_divide(total, F.size(signals)).alias("evidence_strength"), "weight",
    )


def finding_evidence(rows: DataFrame) -> DataFrame:
    """Comment roles per finding: contradicting below 0.5, else supporting (CRD-14)."""
    role = F.when(F.col("verified_p") < 0.5, "contradicting").otherwise("supporting")
    return rows.select(F.col("card_id").alias("finding_id"), "comment_id", F.col("card_p").alias("match_p"), role.alias("role"))


def findings(rows: DataFrame, half: str = "half", top_n: int = 20, cap: int = 3, weights: dict[str, float] = RANKING_WEIGHTS) -> DataFrame:
    """Top cards by explore rank with status, contradictions and modal domain (CRD-12).

    ``half`` holds explore/confirm.
    """
    explore, confirm = rows.filter(F.col(half) == "explore"), rows.filter(F.col(half) == "confirm")
    metrics, mine, other = card_metrics(rows, cap), card_metrics(explore, cap), card_metrics(confirm, cap)
    ranks = rank_cards(ranking_inputs(mine, convergence(explore)), weights).select("card_id", "rank")
    gate = finding_gate(mine, other).select("card_id", "candidate", "reasons")
    contra = finding_evidence(rows).groupBy(F.col("finding_id").alias("card_id")).agg(
        F.count(F.when(F.col("role") == "contradicting", 1)).alias("contradicting_n")
    )
    by_domain = rows.filter("domain IS NOT NULL").groupBy("card_id", "domain").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"))
    top_domain = by_domain.groupBy("card_id").agg(F.min_by("domain", F.struct(-F.col("w"), "domain")).alias("top_domain"))
    unmet = F.array_sort(F.array_distinct(F.transform("reasons", lambda r: F.split_part(r, F.lit(": "), F.lit(2)))))
    out = (
        metrics.join(ranks, "card_id", "left").join(gate, "card_id", "left").join(contra, "card_id", "left")
        .join(top_domain, "card_id", "left")
    )
    order = Window.orderBy(F.col("rank").asc_nulls_last(), "card_id")
    return out.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top_n).select(
        F.col("card_id").alias("finding_id"), "position", "top_domain", "n_comments", "n_authors", "n_threads",
        F.col("n_periods").alias("months_present"), F.when(F.col("candidate"), "validated").otherwise("candidate").alias("status"),
        (F.col("contradicting_n") > 0).alias("contradicting"), "contradicting_n",
        F.to_json(F.coalesce(unmet, F.array().cast("array<string>"))).alias("unknowns_json"), "max_thread_share",
    )


def best_cell_weight(rows: DataFrame, key: str) -> DataFrame:
    """Per card: sum over cells of ``key`` of the largest weight; null keys stand alone."""
    cell = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("c"), F.col("comment_id").cast("string")))
    return rows.groupBy("card_id", cell.alias("k")).agg(F.max("weight").alias("w")).groupBy("card_id").agg(F.sum("w").alias("score"))


def spec_ranks(rows: DataFrame, cards: DataFrame, strict_p: float = 0.7, top: int = 20, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """Competition rank per specification and the union of their top cards (CRD-15).

    ``rows`` are firsthand positive rows with a real card; ``extra`` maps a name
    to assignments of a paraphrase run.
    """
    specs = {
        "main": rows.groupBy("card_id").agg(F.sum("weight").alias("score")),
        "strict": rows.filter(F.col("card_p") >= strict_p).groupBy("card_id").agg(F.sum("weight").alias("score")),
        "one_per_thread": best_cell_weight(rows, "story_id"),
        "one_per_author": best_cell_weight(rows, "author"),
    }
    for name, df in (extra or {}).items():
        specs[name] = df.filter(F.col("card_id") != NONE).groupBy("card_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    parts = []
    for name, df in specs.items():
        scored = cards.select("card_id").join(df, "card_id", "left").fillna(0.0, ["score"])
        parts.append(scored.select(
            F.lit(name).alias("spec"), "card_id", "score", F.rank().over(Window.orderBy(F.col("score").desc())).alias("rank"),
            F.row_number().over(Window.orderBy(F.col("score").desc(), "card_id")).alias("position"),
        ))
    ranked = union_all(parts)
    keep = ranked.filter((F.col("spec") != "main") & (F.col("position") <= top) & (F.col("score") > 0)).select("card_id").distinct()
    return ranked.join(keep, "card_id", "left_semi").select("spec", "card_id", "rank")


def entity_counts(rows: DataFrame, level: str) -> DataFrame:
    """Problems, authors, threads and largest thread weight share per entity (CRD-16)."""
    threads = rows.groupBy(level, "story_id").agg(F.sum("weight").alias("w"))
    share = threads.groupBy(level).agg(F.try_divide(F.max("w"), F.sum("w")).alias("top_thread_share"))
    counts = rows.groupBy(level).agg(
        F.count(F.lit(1)).alias("n_problems"), F.countDistinct("author").alias("n_authors"), F.countDistinct("story_id").alias("n_threads")
    )
    return counts.join(share, level)


def funnel(comments: DataFrame, screened: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts of all, eligible, screened, and weighted firsthand and placed (CRD-17)."""
    first = comments.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("eligible"), 1)).alias("eligible"))
    second = screened.agg(F.count(F.lit(1)).alias("screened"))
    fh = F.col("firsthand")
    placed = fh & F.col("card_id").isNotNull() & (F.col("card_id") != NONE)
    third = rows.agg(
        F.bround(F.sum(F.when(fh, F.col("weight")).otherwise(0.0))).cast("bigint").alias("firsthand"),
        F.bround(F.sum(F.when(placed, F.col("weight")).otherwise(0.0))).cast("bigint").alias("placed"),
    )
    parts = [
        df.unpivot([], list(df.columns), "step", "count").withColumn("count", F.col("count").cast("bigint"))
        for df in (first, second, third)
    ]
    return union_all(parts)


def period_funnel(comments: DataFrame, rows: DataFrame) -> DataFrame:
    """Per period: comments and weighted firsthand share (CRD-17)."""
    fh = F.when(F.col("firsthand"), F.col("weight")).otherwise(0.0)
    share = rows.groupBy("period").agg(F.try_divide(F.sum(fh), F.sum("weight")).alias("firsthand_share"))
    return comments.groupBy("period").agg(F.count(F.lit(1)).alias("comments")).join(share, "period", "left")


def change_rows(diffs: DataFrame, min_sig: int = 4, per_side: int = 8) -> DataFrame:
    """Significant risers and fallers, filled with the largest moves (CRD-18).

    ``diffs`` has (id, share, p_adj), one row per card.
    """
    rows = diffs.filter("share IS NOT NULL")
    sig = (F.col("p_adj") < 0.05) & (F.col("share") != 0)
    side = F.when(F.coalesce(sig, F.lit(False)), F.signum("share"))
    rows = rows.withColumn("__side", side).withColumn(
        "__n", F.row_number().over(Window.partitionBy("__side").orderBy(F.abs("share").desc(), "id"))
    )
    rows = rows.withColumn("picked", F.coalesce(F.col("__side").isNotNull() & (F.col("__n") <= per_side), F.lit(False)))
    n_sig = F.count(F.when(F.col("picked"), 1)).over(every())
    fill = F.row_number().over(Window.partitionBy("picked").orderBy(F.abs("share").desc(), "id"))
    rows = rows.withColumn("__sig", n_sig).withColumn("__fill", fill)
    return rows.filter(F.col("picked") | (F.col("__fill") <= F.lit(min_sig) - F.col("__sig"))).select("id", "share", "p_adj", F.col("picked").alias("significant"))


def card_domain_counts(evidence: DataFrame, members: DataFrame, metrics: DataFrame, top_n: int, n_domains: int = 8) -> DataFrame:
    """Comments per top finding and domain over the largest domains (CRD-19)."""
    top = metrics.orderBy(F.col("n_authors").desc(), "card_id").limit(top_n).select("card_id")
    cells = members.join(top, "card_id", "left_semi").join(evidence.select("comment_id", "domain"), "comment_id").filter("domain IS NOT NULL")
    cells = cells.groupBy("card_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    keep = cells.groupBy("domain").agg(F.sum("n").alias("t")).orderBy(F.col("t").desc(), "domain").limit(n_domains)
    return cells.join(keep.select("domain"), "domain", "left_semi").select("card_id", "domain", "n")
