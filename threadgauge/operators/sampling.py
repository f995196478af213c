"""Frames, draws and queues with exact design weights (SMP-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.functions import text as tx
from threadgauge.functions.hashing import HASH_BITS, half_split, hash60, unit_interval
from threadgauge.operators import allocate as al
from threadgauge.operators.spread import exact_quantiles, hash_rank, require_empty, take_by_hash
from threadgauge.session import cut_lineage


def engagement_cutpoints(stories: DataFrame, value: str = "descendants") -> DataFrame:
    """Lower-tercile cut points as one row (SMP-1)."""
    return exact_quantiles(stories, [], value, {"lo": 1 / 3, "hi": 2 / 3}, method="lower")


def frame_v1(comments: DataFrame, stories: DataFrame, cut: tuple[float, float]) -> DataFrame:
    """Eligible rows labelled period|thread type|tier (SMP-2)."""
    d = F.col("descendants")
    tier = F.when(d.isNull(), "e0").when(d <= cut[0], "e1").when(d <= cut[1], "e2").otherwise("e3")
    joined = comments.filter("eligible").join(stories.select("story_id", "descendants"), "story_id", "left")
    label = F.concat_ws("|", F.coalesce("period", F.lit("")), F.coalesce("thread_type", F.lit("")), tier)
    return joined.select("comment_id", "story_id", label.alias("stratum"))


def frame_v2(comments: DataFrame, salt: str) -> DataFrame:
    """Stratum pain|length|half-year|thread with the explore/confirm half (SMP-3)."""
    pain = F.when(tx.pain_flag(F.col("text_norm")), "pain").otherwise("nopain")
    kind = F.coalesce("thread_type", "story_thread_type", F.lit("unknown"))
    label = F.concat_ws("|", pain, tx.length_bin(F.col("word_count")), tx.half_year(F.col("period")), tx.thread_group(kind))
    return comments.filter("eligible").select(
        "comment_id", "story_id", label.alias("stratum"), half_split("story_id", salt).alias("half")
    )


def draw(
    frame: DataFrame, quota: DataFrame, seed: int, keys: Sequence[str] = ("stratum",), key: str = "comment_id",
    n: str = "n_take", name: str = "draw_rank",
) -> DataFrame:
    """Exactly n_h rows per stratum without replacement, keyed by seed and id (SMP-7)."""
    return take_by_hash(frame, list(keys), hash60(seed, F.col(key)), [key], quota, n, name)


def weighted(drawn: DataFrame, sizes: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Inclusion probability n_h/N_h and weight N_h/n_h (SMP-8)."""
    taken = drawn.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_taken"))
    return drawn.join(sizes.select(stratum, F.col("n_frame").alias("n_population")), stratum).join(taken, stratum).withColumn(
        "inclusion_prob", F.col("n_taken") / F.col("n_population")
    ).withColumn("weight", F.col("n_population") / F.col("n_taken"))


def check_weights(sample: DataFrame, sizes: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Strata where Σweight differs from the frame or nothing was drawn; empty when valid (SMP-8)."""
    sums = sample.groupBy(stratum).agg(F.sum("weight").alias("w"))
    return sizes.join(sums, stratum, "left").filter("w IS NULL OR abs(w - n_frame) > 1e-6 * n_frame")


def stratified_sample(frame: DataFrame, n: int, floor: int, seed: int, key: str = "comment_id") -> DataFrame:
    """Allocation, draw and weights in one go: the reference pipeline's first sample."""
    sizes = al.stratum_sizes(frame)
    drawn = draw(frame, al.allocate(sizes, n, floor), seed, key=key)
    return weighted(drawn, sizes)


def expand(sample: DataFrame, frame: DataFrame, quota: DataFrame, seed: int, batch: int, key: str = "comment_id") -> DataFrame:
    """A further batch from unselected rows; all probabilities recomputed (SMP-9).

    Draw order continues after the largest one in the sample.
    """
    sample = cut_lineage(sample)  # sample-sized; read four times below
    rest = frame.join(sample.select(key), key, "left_anti")
    more = draw(rest, quota, seed, key=key)
    more = hash_rank(cut_lineage(more.drop("draw_rank")), [], hash60(seed, "order", F.col(key)), [key], "__pos")
    start = sample.agg(F.max("draw_order")).scalar()
    added = more.withColumn("batch", F.lit(batch)).withColumn("draw_order", start + F.col("__pos")).drop("__pos")
    cols = [*frame.columns, "batch", "draw_order"]
    return weighted(sample.select(*cols).unionByName(added.select(*cols)), al.stratum_sizes(frame))


def sample_manifest(sample: DataFrame, frame: DataFrame) -> DataFrame:
    """Per stratum: frame and sample size (SMP-10)."""
    sizes = al.stratum_sizes(frame)
    return sizes.join(sample.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_sample")), "stratum", "left").fillna(0, ["n_sample"])


def draw_allocated(frame: DataFrame, allocation: DataFrame, seed: int, key: str = "comment_id") -> DataFrame:
    """Draw with a given allocation; its strata must match the frame (SMP-12)."""
    sizes = al.stratum_sizes(frame)
    both = sizes.join(allocation.select("stratum", "n_take").filter("n_take > 0"), "stratum", "full")
    require_empty(both.filter("n_frame IS NULL OR n_take IS NULL OR n_take > n_frame"), "allocation does not fit the frame")
    return weighted(draw(frame, allocation, seed, key=key), sizes)


def two_phase(screen: DataFrame, n_pos: int, n_neg: int, cutoff: float, seed: int) -> DataFrame:
    """Positive and negative second-phase draws, weight w1/p2 (SMP-18)."""
    phase = F.when(F.col("firsthand_p") >= cutoff, "pos").otherwise("neg")
    rows = screen.withColumn("phase", phase)
    stats = rows.groupBy("phase", "stratum").agg(F.count(F.lit(1)).alias("n_frame"), F.sum("weight").alias("wsum"))
    quota = None
    for name, n in (("pos", n_pos), ("neg", n_neg)):
        part = al.capped_allocation(stats.filter(F.col("phase") == name), n)
        quota = part if quota is None else quota.unionByName(part)
    quota = quota.withColumn("n_take", F.least("n_take", "n_frame"))
    drawn = draw(rows, quota, seed, keys=("phase", "stratum")).drop("draw_rank")
    p2 = quota.select("phase", "stratum", (F.col("n_take") / F.col("n_frame")).alias("p2"))
    return drawn.withColumnRenamed("weight", "w1").join(p2, ["phase", "stratum"]).withColumn("weight", F.col("w1") / F.col("p2"))


def expand_two_phase(base: DataFrame, screen: DataFrame, n_pos: int, cutoff: float, seed: int) -> DataFrame:
    """Grow the positive phase to ``n_pos``; kept rows are wave 1, added wave 2 (SMP-19)."""
    pos = screen.filter(F.col("firsthand_p") >= cutoff)
    old = base.filter("phase = 'pos'")
    require_empty(old.select("comment_id").join(pos.select("comment_id"), "comment_id", "left_anti"), "base rows not positive")
    stats = pos.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_frame"), F.sum("weight").alias("wsum"))
    kept = old.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_old"))
    plan = al.capped_allocation(stats, n_pos).join(kept, "stratum", "left").fillna(0, ["n_old"])
    more = F.least(F.greatest(F.col("n_take") - F.col("n_old"), F.lit(0)), F.col("n_frame") - F.col("n_old"))
    plan = plan.withColumn("n_more", more).withColumn("p2", (F.col("n_old") + F.col("n_more")) / F.col("n_frame"))
    rest = pos.join(old.select("comment_id"), "comment_id", "left_anti")
    added = draw(rest, plan, seed, n="n_more").drop("draw_rank").withColumn("wave", F.lit(2))
    first = pos.join(old.select("comment_id"), "comment_id", "left_semi").withColumn("wave", F.lit(1))
    grown = first.unionByName(added).join(plan.select("stratum", "p2"), "stratum").select(
        "comment_id", "story_id", "stratum", "half", F.lit("pos").alias("phase"), F.col("weight").alias("w1"), "p2",
        (F.col("weight") / F.col("p2")).alias("weight"), "firsthand_p", "wave",
    )
    neg = base.filter("phase = 'neg'").select(*[c for c in grown.columns if c != "wave"], F.lit(1).alias("wave"))
    return grown.unionByName(neg).withColumn("wave", F.col("wave").cast("tinyint"))


def subsample(parent: DataFrame, n: int, seed: int) -> DataFrame:
    """Stratified subsample with rescaled weights, one per stratum at least (SMP-20)."""
    sizes = al.stratum_sizes(parent)
    n_h = al.allocate(sizes, n, 1)
    drawn = draw(parent, n_h, seed).drop("draw_rank")
    ratio = sizes.join(n_h, "stratum").select("stratum", (F.col("n_frame") / F.col("n_take")).alias("__r"))
    return drawn.join(ratio, "stratum").withColumn("weight", F.col("weight") * F.col("__r")).drop("__r").withColumn(
        "inclusion_prob", 1 / F.col("weight")
    )


def _quota(rows: DataFrame, n: int) -> DataFrame:
    return rows.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("n_take"))


def simple_sample(rows: DataFrame, n: int, seed: int, key: str = "comment_id") -> DataFrame:
    """n rows by keyed hash, all when the table is smaller (SMP-21)."""
    return take_by_hash(rows, [], hash60(seed, F.col(key)), [key], _quota(rows, n)).drop("draw_rank")


def pps_sample(pool: DataFrame, n: int, seed: int, key: str = "comment_id", weight: str = "weight") -> DataFrame:
    """Successive draws proportional to weight, by exponential keys (SMP-22).

    The clock is mapped to hash buckets in its own order, so the first n are
    found like any other draw; about half of the buckets lie below the n-th.
    """
    pool = pool.withColumn("clock", -F.log(unit_interval(seed, F.col(key))) / F.col(weight))
    near = pool.agg(F.lit(float(n)) / F.sum(weight)).scalar()
    place = F.lit(1.0) - F.try_divide(near, near + F.col("clock"))
    draw = F.least(F.floor(place * float(1 << HASH_BITS)), F.lit((1 << HASH_BITS) - 1))
    return take_by_hash(pool, [], draw, ["clock", key], _quota(pool, n)).drop("draw_rank")


def launch_sample(launches: DataFrame, n: int, seed: int, key: str = "story_id") -> DataFrame:
    """Period-proportional draw of launches with weights (SMP-23)."""
    frame = launches.withColumnRenamed("period", "stratum")
    sizes = al.stratum_sizes(frame)
    drawn = draw(frame, al.proportional_allocation(sizes, n), seed, key=key)
    return weighted(drawn, sizes).select(key, F.col("stratum").alias("period"), "weight")


def band_of(score: Column, bands: dict[str, tuple[float, float]]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, (lo, hi) in bands.items():
        out = out.when((score >= lo) & (score < hi), name)
    return out


def label_queue(
    frame: DataFrame, bands: dict[str, tuple[float, float]], sizes: dict[str, int], seed: int,
    exclude: DataFrame | None = None, repeat_share: float = 0.1,
) -> DataFrame:
    """Score-banded queue with rates, shuffled order and repeats (SMP-24).

    Repeats are the first ``round(share·n)`` of a second shuffle; the queue is
    ``Σ sizes`` rows, its shuffles work on hash buckets.
    """
    rows = frame if exclude is None else frame.join(exclude.select("comment_id"), "comment_id", "left_anti")
    rows = rows.withColumn("band", band_of(F.col("score"), bands)).filter("band IS NOT NULL")
    want = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    quota = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n_members")).withColumn(
        "n_take", F.least(F.col("n_members"), want[F.col("band")].cast("bigint"))
    )
    picked = take_by_hash(rows, ["band"], hash60(seed, F.col("comment_id")), ["comment_id"], quota).drop("draw_rank")
    picked = picked.join(quota.select("band", (F.col("n_take") / F.col("n_members")).alias("rate")), "band")
    picked = cut_lineage(picked)  # queue-sized; read three times below
    picked = hash_rank(picked, [], hash60(seed, "order", F.col("comment_id")), ["comment_id"], "position")
    picked = hash_rank(picked, [], hash60(seed, "repeat", F.col("comment_id")), ["comment_id"], "__rep")
    n = picked.agg(F.count(F.lit(1))).scalar()
    return picked.withColumn("repeated", F.col("__rep") <= F.bround(n * F.lit(repeat_share))).drop("__rep")


def top_up_queue(queue: DataFrame, frame: DataFrame, bands: dict[str, tuple[float, float]], n: int, seed: int) -> DataFrame:
    """Draw more from the given bands and update their rates (SMP-25)."""
    rows = frame.withColumn("band", band_of(F.col("score"), bands)).filter("band IS NOT NULL")
    members = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n_members"))
    have = queue.filter(F.col("band").isin(*bands)).groupBy("band").agg(F.count(F.lit(1)).alias("n_frame"))
    want = al.hamilton(have, n, "band").select("band", "n_take", F.col("n_frame").alias("n_have"))
    rest = rows.join(queue.select("comment_id"), "comment_id", "left_anti")
    more = take_by_hash(rest, ["band"], hash60(seed, F.col("comment_id")), ["comment_id"], want).drop("draw_rank")
    both = queue.select("comment_id", "score", "band", F.lit(0).alias("top_up")).unionByName(
        more.select("comment_id", "score", "band", F.lit(1).alias("top_up"))
    )
    rate = both.groupBy("band").agg(F.count(F.lit(1)).alias("n")).join(members, "band").select(
        "band", (F.col("n") / F.col("n_members")).alias("rate")
    )
    return both.join(rate, "band", "left")


def gate_and_share(scored: DataFrame, threshold: float, share: float, seed: int) -> DataFrame:
    """Everything at or over the gate, and a seeded share of the rest (SMP-26)."""
    gate = scored.filter(F.col("screen_p") >= threshold).select(
        "comment_id", "screen_p", F.lit("gate").alias("rule"), F.lit(1.0).alias("selection_prob")
    )
    rest = scored.filter(F.col("screen_p") < threshold)
    quota = rest.agg(F.count(F.lit(1)).alias("n_rest")).withColumn("n_take", F.bround(F.col("n_rest") * share).cast("bigint"))
    picked = take_by_hash(rest, [], hash60(seed, F.col("comment_id")), ["comment_id"], quota)
    prob = quota.select((F.col("n_take") / F.col("n_rest")).alias("p")).scalar()
    return gate.unionByName(picked.select("comment_id", "screen_p", F.lit("random").alias("rule"), prob.alias("selection_prob")))


def gold_draws(calibration: DataFrame, audit: DataFrame, selection: DataFrame, n_pool: int) -> DataFrame:
    """Selection probability per labelled item; audit adds the queue's rate (SMP-27)."""
    first = calibration.select(
        F.lit("calibration").alias("label_set"), "comment_id", F.col("band").alias("draw_stratum"),
        F.col("rate").alias("selection_prob"), F.lit("calibration").alias("purpose"),
    )
    n_audit = audit.agg(F.count(F.lit(1))).scalar()
    second = audit.select("comment_id").join(selection, "comment_id").select(
        F.lit("audit").alias("label_set"), "comment_id", F.concat(F.lit("faceted:"), F.col("rule")).alias("draw_stratum"),
        (F.col("selection_prob") * (n_audit / F.lit(n_pool))).alias("selection_prob"), F.lit("audit").alias("purpose"),
    )
    return first.unionByName(second)


def shown_card_audit(queue: DataFrame, cards: DataFrame, seed: int, show_share: float = 0.5) -> DataFrame:
    """Half see the picked card, half a random other card of its group (SMP-28).

    ``cards`` is the taxonomy (at most 254 cards per group), so the list of
    group-mates carried by a row is bounded.
    """
    mates = cards.groupBy("group_id").agg(F.array_sort(F.collect_list("card_id")).alias("mates"))
    rows = queue.join(cards.select("card_id", "group_id"), "card_id").join(mates, "group_id")
    others = F.filter("mates", lambda c: c != F.col("card_id"))
    coin = unit_interval(seed, "coin", F.col("comment_id"))
    slot = (hash60(seed, "card", F.col("comment_id")) % F.size(others)).cast("int") + 1
    forced = F.size(others) == 0
    shown = F.when(forced | (coin < show_share), F.col("card_id")).otherwise(F.try_element_at(others, slot))
    return rows.select("comment_id", "card_id", forced.alias("forced"), shown.alias("shown_card_id")).withColumn(
        "is_pick", F.col("shown_card_id") == F.col("card_id")
    )


def residue_sample(assignments: DataFrame, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Sample of comments without a card, and residue shares per group (SMP-29)."""
    residue = F.coalesce(F.col("group_id") == "none", F.lit(False)) | F.coalesce(F.col("card_id") == "none", F.lit(False))
    rows = assignments.withColumn("__res", residue).withColumn("stratum", F.coalesce("group_id", F.lit("none")))
    shares = rows.groupBy("stratum").agg(F.avg(F.col("__res").cast("double")).alias("share"), F.count(F.lit(1)).alias("n_total"))
    pool = rows.filter("__res").drop("__res")
    drawn = draw(pool, al.residue_allocation(al.stratum_sizes(pool), k), seed).drop("draw_rank")
    return drawn, shares


def top_cards_with_examples(metrics: DataFrame, examples: DataFrame, k: int, seed: int, per_card: int = 5) -> DataFrame:
    """Top k cards by score, else authors, with sampled examples (SMP-30).

    The constant row limits let Spark keep only ``per_card`` rows per card and task.
    """
    order = "score" if "score" in metrics.columns else "n_authors"
    top = metrics.orderBy(F.col(order).desc_nulls_last(), "card_id").limit(k).select("card_id", order)
    pick = Window.partitionBy("card_id").orderBy(hash60(seed, F.col("card_id"), F.col("comment_id")), "comment_id")
    chosen = examples.withColumn("example_no", F.row_number().over(pick)).filter(F.col("example_no") <= per_card)
    return top.join(chosen.select("card_id", "comment_id", "example_no"), "card_id", "left")


def facet_queue(answers: DataFrame, bands: dict[str, tuple[float, float]], sizes: dict[str, int], seed: int) -> DataFrame:
    """Queue on the largest facet value per comment (SMP-31)."""
    scored = answers.filter("noul IS NOT NULL").groupBy("comment_id").agg(F.max("noul").alias("score"))
    return label_queue(scored, bands, sizes, seed)


def merge_queue(pairs: DataFrame, bands: dict[str, tuple[float, float]], sizes: dict[str, int], seed: int) -> DataFrame:
    """Queue of scored card pairs on expected score (SMP-31)."""
    return label_queue(pairs.select(F.col("pair_id").alias("comment_id"), F.col("expected").alias("score")), bands, sizes, seed)


def stratum_report(frame: DataFrame, sample: DataFrame) -> DataFrame:
    """N_h and n_h per stratum with a total row (SMP-33)."""
    rows = sample_manifest(sample, frame)
    return rows.rollup("stratum").agg(F.sum("n_frame").alias("n_frame"), F.sum("n_sample").alias("n_sample")).withColumn(
        "stratum", F.coalesce("stratum", F.lit("total"))
    )
