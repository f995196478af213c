"""Answers, packing, assignment and taxonomy checks (ANS-*)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgauge.functions import jsonx as jx
from threadgauge.functions import text as tx
from threadgauge.operators.robust import correlation
from threadgauge.operators.spread import earliest_by, require_empty, value_ranks
from threadgauge.schemas import ANSWERS, fields
from threadgauge.session import cut_lineage

NONE = "none"
# Status names and the sizes a taxonomy may have.
ACTIVE, MERGED = "approved", "merged_into:"
MAX_GROUPS = MAX_CARDS_PER_GROUP = 254


def pivot_answers(answers: DataFrame, questions: Sequence[str], value: str = "noul", key: str = "comment_id") -> DataFrame:
    """One row per comment with ``f_<question>`` columns (ANS-1); the question list is fixed."""
    picked = answers.filter(F.col("question_id").isin(*questions))
    cells = [F.max(F.when(F.col("question_id") == q, F.col(value))).alias(f"f_{q}") for q in questions]
    return picked.groupBy(key).agg(*cells)


def duplicate_answers(answers: DataFrame, key: str = "comment_id") -> DataFrame:
    """(comment, question) pairs answered more than once (ANS-2)."""
    return answers.groupBy(key, "question_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pack(items: DataFrame, k: int = 5, key: str = "comment_id") -> DataFrame:
    """(packed_id, slot, comment_id): consecutive ids k at a time (ANS-3).

    The position comes from range buckets, so no task orders the whole table.
    """
    ordered = value_ranks(items.select(key), [], key).select(key, F.col("n_below").alias("__pos"))
    group = F.floor(F.col("__pos") / k)
    rows = ordered.withColumn("__g", group)
    first = rows.filter(F.col("__pos") % k == 0).select("__g", F.col(key).alias("packed_id"))
    slot = F.concat(F.lit("c"), (F.col("__pos") % k + 1).cast("int").cast("string"))
    return rows.join(first, "__g").select("packed_id", slot.alias("slot"), F.col(key))


def packed_requests(items: DataFrame, packed: DataFrame, text: str = "text") -> DataFrame:
    """One row per packed id with its k member texts by slot (ANS-3); k bounds the group."""
    rows = packed.join(items.select("comment_id", text), "comment_id")
    return rows.groupBy("packed_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", text)))).alias("state"),
        F.count(F.lit(1)).alias("n_members"),
    )


def unpack(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """``c<j>_<question>`` answers back to their member comments (ANS-4)."""
    pattern = r"^(c\d+)_(.+)$"
    rows = answers.filter(F.col("question_id").rlike(pattern)).select(
        F.col("comment_id").alias("packed_id"), F.regexp_extract("question_id", pattern, 1).alias("slot"),
        F.regexp_extract("question_id", pattern, 2).alias("question_id"), "noul",
    )
    return rows.join(packed, ["packed_id", "slot"]).select("comment_id", "question_id", "noul", "packed_id", "slot")


def screen_table(answers: DataFrame, done: DataFrame, packed: DataFrame, sample: DataFrame, question: str = "firsthand_problem") -> DataFrame:
    """Authoritative answers joined to the sample, with the four checks (ANS-5).

    ``answers`` and ``done`` share (comment_id, part); only logged parts count.
    """
    require_empty(packed.groupBy("comment_id").count().filter("count > 1"), "duplicate packed-map rows")
    live = answers.join(done.select("comment_id", "part"), ["comment_id", "part"], "left_semi")
    found = unpack(live, packed).filter(F.col("question_id") == question)
    require_empty(found.groupBy("comment_id").count().filter("count > 1"), "duplicate answers")
    usable = found.filter("noul IS NOT NULL")
    require_empty(sample.select("comment_id").join(usable, "comment_id", "left_anti"), "missing answers")
    require_empty(usable.select("comment_id").join(sample, "comment_id", "left_anti"), "answers outside the sample")
    return sample.join(usable.select("comment_id", F.col("noul").alias("firsthand_p"), "packed_id", "slot"), "comment_id")


def packed_vs_single(packed: DataFrame, single: DataFrame) -> DataFrame:
    """n, Pearson, agreement at 0.5 and mean absolute difference on common comments (ANS-6)."""
    both = packed.select("comment_id", F.col("noul").alias("a")).join(
        single.select("comment_id", F.col("noul").alias("b")), "comment_id"
    ).filter("a IS NOT NULL AND b IS NOT NULL")
    same = ((F.col("a") >= 0.5) == (F.col("b") >= 0.5)).cast("double")
    return both.agg(
        F.count(F.lit(1)).alias("n"), correlation("a", "b").alias("pearson"), F.avg(same).alias("agreement"),
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"),
    )


def work_list(items: DataFrame, done: DataFrame, key: str = "comment_id") -> DataFrame:
    """Items not answered yet (ANS-7)."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def reuse_responses(calls: DataFrame, key: str = "request_key", order: Sequence[str] = ("time", "request_id")) -> DataFrame:
    """First response per key wins; later identical calls become replays (ANS-8)."""
    first = earliest_by(calls.select(key, *order, "noul"), [key], list(order)).select(
        key, F.col(order[-1]).alias("source_request_id"), F.col("noul").alias("answer")
    )
    return calls.join(first, key).withColumn("replayed", F.col(order[-1]) != F.col("source_request_id"))


def keyword_scorer(text: str = "text") -> Column:
    """Example scorer: share of words that are first-person pronouns."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    people = F.filter(words, lambda w: w.isin("i", "we", "my", "our", "me", "us"))
    return F.when(F.size(words) > 0, F.size(people) / F.size(words)).otherwise(0.0)


def score_items(
    items: DataFrame, run_id: str, question_set: str, question_id: str,
    scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | Column | None = None,
) -> DataFrame:
    """Fill the ANSWERS contract from any scorer (ANS-9).

    A column expression is scored in the JVM; a function runs in ``mapInPandas``
    over Arrow batches of (comment_id, text) and returns (comment_id, noul).
    """
    if scorer is None:
        scorer = tx.keyword_score(F.col("text"))
    if isinstance(scorer, Column):
        scored = items.select("comment_id", scorer.alias("noul"))
    else:
        scored = items.select("comment_id", "text").mapInPandas(scorer, "comment_id bigint, noul double")
    values = {
        "run_id": F.lit(run_id), "question_set": F.lit(question_set), "question_id": F.lit(question_id),
        "qtype": F.lit("noul"), "comment_id": F.col("comment_id"), "noul": F.col("noul"), "cache_hit": F.lit(False),
        "logical_call_id": F.concat_ws(":", F.lit(run_id), F.col("comment_id").cast("string")),
    }
    return scored.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields(ANSWERS)]
    )


def not_in(pinned: DataFrame, new: DataFrame, key: str = "comment_id") -> DataFrame:
    """Pinned ids that the new set lost; empty when it is a superset (ANS-10)."""
    return pinned.select(key).distinct().join(new.select(key), key, "left_anti")


def answer_distributions(answers: DataFrame, bins: int = 10) -> DataFrame:
    """Histogram of nouls, choice counts and mean score per question (ANS-11)."""
    edge = F.least(F.floor(F.col("noul") * bins), F.lit(bins - 1)).cast("string")
    hist = answers.filter("noul IS NOT NULL").groupBy("question_id", edge.alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("mean")
    ).withColumn("kind", F.lit("noul_bin"))
    picks = answers.filter("choice IS NOT NULL").groupBy("question_id", F.col("choice").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("mean")
    ).withColumn("kind", F.lit("choice"))
    scores = answers.filter("score IS NOT NULL").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")
    ).select("question_id", F.lit("mean").alias("key"), "n", "mean", F.lit("score").alias("kind"))
    return hist.unionByName(picks).unionByName(scores)


def gate_loss(selected: DataFrame, evidence: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Estimated positives lost below the gate, scaled by selection probability (ANS-12)."""
    best = evidence.groupBy("comment_id").agg(F.max("noul").alias("best"))
    rows = selected.filter("rule = 'random'").join(best, "comment_id", "left")
    hit = F.coalesce(F.col("best") >= threshold, F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("n_random"), F.count(F.when(hit, 1)).alias("n_hits"),
        F.sum(F.when(hit, 1 / F.col("selection_prob")).otherwise(0.0)).alias("estimated_lost"),
    )


def assign_two_level(items: DataFrame, groups: DataFrame, cards: DataFrame, run_id: str, version: str) -> DataFrame:
    """Group choice, then card choice inside it; failed calls omitted (ANS-13).

    Both answer tables hold (comment_id, choice, confidence, probabilities_json).
    """

    def level(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "comment_id", F.col("choice").alias(f"{name}_id"), F.col("confidence").alias(f"{name}_confidence"),
            F.try_element_at(jx.probability_map("probabilities_json"), F.col("choice")).alias(f"{name}_p"),
            F.array_join(jx.top_options(jx.probability_map("probabilities_json")), ",").alias(f"{name}_top2"),
        )

    rows = items.select("comment_id").join(level(groups, "group"), "comment_id").filter("group_id IS NOT NULL")
    rows = rows.join(level(cards, "card"), "comment_id", "left")
    real = F.col("group_id") != NONE
    rows = rows.filter(~real | F.col("card_id").isNotNull())

    def only(name: str) -> Column:
        return F.when(real, F.col(name)).alias(name)

    return rows.select(
        F.lit(run_id).alias("run_id"), "comment_id", F.lit(version).alias("taxonomy_version"), "group_id", "group_p",
        "group_confidence", only("card_id"), only("card_p"), only("card_confidence"),
        F.lit(None).cast("double").alias("verified_p"), only("card_top2"),
        F.coalesce(F.when(real, F.col("card_confidence") < 0.5), F.lit(False)).alias("low_confidence"),
    )


def merge_map(cards: DataFrame) -> DataFrame:
    """(card_id, final_id) along ``merged_into`` links; cycles and unknown targets are errors (ANS-14).

    Pointer doubling: every round sends each card to its target's target, so a
    chain of n links takes log2(n) rounds. What has not met an unmerged card
    after as many rounds as the longest possible chain needs is a cycle.
    """
    merged = F.coalesce(F.col("status").startswith(MERGED), F.lit(False))
    links = cut_lineage(
        cards.groupBy("card_id").agg(F.max("status").alias("status")).select(
            "card_id", F.when(merged, F.regexp_replace("status", f"^{MERGED}", "")).otherwise(F.col("card_id")).alias("final_id"),
            (~merged).alias("done"),
        )
    )
    known = links.select(F.col("card_id").alias("final_id"))
    require_empty(links.join(known, "final_id", "left_anti").select("card_id", "final_id"), "cards merge into unknown ones")
    for _ in range(links.count().bit_length() + 1):
        if links.filter("NOT done").isEmpty():
            break
        hop = links.select(F.col("card_id").alias("final_id"), F.col("final_id").alias("__next"), F.col("done").alias("__done"))
        moved = links.filter("NOT done").join(hop, "final_id").select("card_id", F.col("__next").alias("final_id"), F.col("__done").alias("done"))
        links = cut_lineage(moved.unionByName(links.filter("done")))
    require_empty(links.filter("NOT done").select("card_id"), "merge cycle")
    return links.select("card_id", "final_id")


def resolve_cards(rows: DataFrame, cards: DataFrame, column: str = "card_id") -> DataFrame:
    """Adds ``final_id``; unknown cards stay null (ANS-14)."""
    return rows.join(merge_map(cards).withColumnRenamed("card_id", column), column, "left")


def taxonomy_problems(
    cards: DataFrame, groups: DataFrame, label_words: int = 8, statement_words: int = 20,
    most_groups: int = MAX_GROUPS, most_cards: int = MAX_CARDS_PER_GROUP,
) -> DataFrame:
    """(problem, key) rows; empty when the taxonomy is valid (ANS-15). Only active cards count towards a group's size."""
    target = F.when(F.col("status").startswith(MERGED), F.regexp_replace("status", f"^{MERGED}", ""))
    valid = F.coalesce(F.col("status").isin("draft", ACTIVE, "retired") | (target != ""), F.lit(False))
    into = cards.filter(target != "").select("card_id", target.alias("target"))
    known = cards.select(F.col("card_id").alias("target"))

    def problem(name: str, rows: DataFrame, key: Column | str) -> DataFrame:
        return rows.select(F.lit(name).alias("problem"), F.col(key).cast("string").alias("key") if isinstance(key, str) else key.alias("key"))

    checks = [
        problem("duplicate_card", cards.groupBy("card_id").count().filter("count > 1"), "card_id"),
        problem("duplicate_group", groups.groupBy("group_id").count().filter("count > 1"), "group_id"),
        problem("unknown_group", cards.join(groups, "group_id", "left_anti"), "card_id"),
        problem("bad_status", cards.filter(~valid), "card_id"),
        problem("unknown_merge_target", into.join(known, "target", "left_anti"), "card_id"),
        problem("too_many_groups", groups.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_groups), "n"),
        problem("group_too_large", cards.filter(F.col("status") == ACTIVE).groupBy("group_id").count().filter(F.col("count") > most_cards), "group_id"),
        problem("no_label", groups.filter(F.trim(F.coalesce("group_label", F.lit(""))) == ""), "group_id"),
        problem("label_too_long", groups.filter(tx.word_count(F.col("group_label")) > label_words), "group_id"),
        problem("statement_too_long", cards.filter(tx.word_count(F.col("statement")) > statement_words), "card_id"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def changed_cards(base: DataFrame, new: DataFrame) -> DataFrame:
    """Base cards missing or changed in the new version; empty for a superset (ANS-16)."""
    cols = ["card_id", "group_id", "statement", "status"]
    return base.select(*cols).exceptAll(new.select(*cols))


def scoped(rows: DataFrame, scope: str = "residue", threshold: float = 0.5) -> DataFrame:
    """Rows to ask again: real group but card null, none or below the cut; or all with a group (ANS-17)."""
    real = rows.filter(F.col("group_id").isNotNull() & (F.col("group_id") != NONE))
    if scope == "all":
        return real
    return real.filter(F.col("card_id").isNull() | (F.col("card_id") == NONE) | (F.col("card_p") < threshold))


def reassign(base: DataFrame, answers: DataFrame, run_id: str, version: str, scope: str = "residue") -> DataFrame:
    """Scoped rows take new card answers (dropped when missing), the rest is re-stamped (ANS-18)."""
    ids = scoped(base, scope).select("comment_id")
    carried = base.join(ids, "comment_id", "left_anti")
    new = answers.filter("choice IS NOT NULL").select(
        "comment_id", F.col("choice").alias("__card"), F.col("p").alias("__p"), F.col("confidence").alias("__c")
    )
    asked = base.join(ids, "comment_id", "left_semi").join(new, "comment_id")
    asked = (
        asked.withColumn("card_id", F.col("__card")).withColumn("card_p", F.col("__p"))
        .withColumn("card_confidence", F.col("__c")).withColumn("verified_p", F.lit(None).cast("double"))
    )
    both = carried.unionByName(asked.select(*base.columns))
    return both.withColumn("run_id", F.lit(run_id)).withColumn("taxonomy_version", F.lit(version))


def reassignment_stats(base: DataFrame, new: DataFrame, scope: str = "residue") -> DataFrame:
    """carried, reassigned, moved and changed counts (ANS-19); none equals null."""

    def real(col: str) -> Column:
        return F.when(F.col(col) != NONE, F.col(col))

    ids = scoped(base, scope).select("comment_id", F.lit(True).alias("__in"))
    rows = new.select("comment_id", "card_id").join(
        base.select("comment_id", F.col("card_id").alias("__old")), "comment_id", "left"
    ).join(ids, "comment_id", "left")
    asked = F.coalesce("__in", F.lit(False))
    return rows.agg(
        F.count(F.when(~asked, 1)).alias("carried"), F.count(F.when(asked, 1)).alias("reassigned"),
        F.count(F.when(asked & real("card_id").isNotNull(), 1)).alias("moved_to_card"),
        F.count(F.when(~real("card_id").eqNullSafe(real("__old")), 1)).alias("changed_card"),
    )


def added_card_counts(new: DataFrame, base_cards: DataFrame, new_cards: DataFrame) -> DataFrame:
    """Assignments of each card the new version added, zero included (ANS-19)."""
    added = new_cards.select("card_id").join(base_cards.select("card_id"), "card_id", "left_anti")
    counts = new.groupBy("card_id").agg(F.count(F.lit(1)).alias("n"))
    return added.join(counts, "card_id", "left").fillna(0, ["n"])


def combine_runs(runs: Sequence[DataFrame], version: str, check: bool = True) -> DataFrame:
    """Union of assignment tables; overlap and foreign versions are errors (ANS-20)."""
    out = runs[0]
    for df in runs[1:]:
        out = out.unionByName(df)
    if check:
        require_empty(out.filter(F.col("taxonomy_version") != version).select("comment_id"), "foreign taxonomy version")
        require_empty(out.groupBy("comment_id").count().filter("count > 1"), "comments in more than one run")
    return out


def combine_pain(tables: Sequence[DataFrame], check: bool = True) -> DataFrame:
    """(comment_id, pain_sentence) of several runs; runs that disagree on a comment are an error (ANS-20).

    A null sentence is one of its own: null against a text is a disagreement.
    """
    out = tables[0].select("comment_id", "pain_sentence")
    for df in tables[1:]:
        out = out.unionByName(df.select("comment_id", "pain_sentence"))
    texts, nulls = F.col("least").eqNullSafe(F.col("most")), F.col("nulls").isin(0, F.col("n"))
    held = out.groupBy("comment_id").agg(
        F.min("pain_sentence").alias("least"), F.max("pain_sentence").alias("most"),
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pain_sentence").isNull(), 1)).alias("nulls"),
    )
    if check:
        require_empty(held.filter(~(texts & nulls)).select("comment_id"), "runs disagree on the pain sentence")
    return held.select("comment_id", F.col("least").alias("pain_sentence"))


def merge_pairs(cards: DataFrame, top2: DataFrame, min_overlap: int = 3) -> DataFrame:
    """Candidate pairs of active cards: co-listed ones of two groups and pairs inside a group (ANS-21).

    Merged cards in the two-element lists count for the card they end in; lists
    with an unknown or inactive card, or twice the same one, do not count. Active
    cards per group are bounded by the taxonomy rule (254, checked); co-listed
    pairs are counted before any join with the cards.
    """
    active = cards.filter(F.col("status") == ACTIVE).select("card_id", "group_id")
    require_empty(
        active.groupBy("group_id").count().filter(F.col("count") > MAX_CARDS_PER_GROUP), "group too large for pairing"
    )
    a = active.select(F.col("card_id").alias("card_a"), F.col("group_id").alias("ga"))
    b = active.select(F.col("card_id").alias("card_b"), F.col("group_id").alias("gb"))
    inside = a.join(b, F.col("ga") == F.col("gb")).filter("card_a < card_b").select("card_a", "card_b")
    final = merge_map(cards)
    x, y = (final.select(F.col("card_id").alias(c), F.col("final_id").alias(f"__{c}")) for c in ("first", "second"))
    counts = top2.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).join(x, "first").join(y, "second")
    counts = counts.groupBy(F.least("__first", "__second").alias("card_a"), F.greatest("__first", "__second").alias("card_b")).agg(F.sum("n").alias("n"))
    across = counts.filter(F.col("n") >= min_overlap).join(a, "card_a").join(b, "card_b").filter("ga <> gb")
    return inside.unionByName(across.select("card_a", "card_b"))


def propose_merges(scored: DataFrame, threshold: float = 1.6) -> DataFrame:
    """Expected score per pair at or over the threshold, best first (ANS-22)."""
    expected = F.coalesce(jx.expected_score(jx.probability_map("probabilities_json")), F.col("score"))
    return scored.withColumn("expected", expected).filter(F.col("expected") >= threshold).orderBy(
        F.col("expected").desc(), "card_a", "card_b"
    )


def fill_verification(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """verified_p from the member answer where there is one (ANS-23)."""
    new = answers.filter("noul IS NOT NULL").select("comment_id", F.col("noul").alias("__v"))
    return rows.join(new, "comment_id", "left").withColumn("verified_p", F.coalesce("__v", "verified_p")).drop("__v")


def planted_recovery(planted: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per need and overall: share on the true card; decoys on any real card (ANS-24).

    ``planted`` has (comment_id, card_id) with null card for decoys; a missing
    assignment is a miss.
    """
    got = assignments.select("comment_id", F.col("card_id").alias("__got"))
    rows = planted.join(got, "comment_id", "left").withColumn("__decoy", F.col("card_id").isNull())
    hit = F.coalesce(F.when(F.col("__decoy"), F.col("__got") != NONE).otherwise(F.col("__got") == F.col("card_id")), F.lit(False))
    rows = rows.withColumn("__hit", hit.cast("double"))
    need = F.when(F.col("__decoy"), "decoy").otherwise(F.col("card_id"))
    per = rows.groupBy(need.alias("need")).agg(F.count(F.lit(1)).alias("n"), F.avg("__hit").alias("share"))
    whole = rows.filter("NOT __decoy").agg(F.count(F.lit(1)).alias("n"), F.avg("__hit").alias("share"))
    return per.unionByName(whole.select(F.lit("all").alias("need"), "n", "share"))


def item_table(answers: DataFrame, sample: DataFrame, sentences: DataFrame, question: str = "pain", kind: str = "account") -> tuple[DataFrame, DataFrame]:
    """Firsthand rows whose pain option resolves to a sentence, and per-phase counts (ANS-25)."""
    wide = answers.groupBy("comment_id").agg(
        F.max(F.when(F.col("question_id") == question, F.col("choice"))).alias("pain_option"),
        F.max(F.when(F.col("question_id") == kind, F.col("choice"))).alias("account_type"),
    )
    rows = sample.join(wide, "comment_id").join(sentences, "comment_id", "left")
    index = tx.option_index(F.col("pain_option"))
    rows = rows.withColumn("pain_sentence", F.when(index >= 0, F.try_element_at("sentences", index + 1)))
    firsthand = F.col("account_type") == "firsthand"
    kept = rows.filter(firsthand & F.col("pain_sentence").isNotNull())
    counts = rows.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(firsthand, 1)).alias("n_firsthand"),
        F.count(F.when(firsthand & F.col("pain_sentence").isNull(), 1)).alias("n_dropped"),
    )
    return kept.drop("sentences"), counts


def benchmark_scores(cases: DataFrame, got: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts per threshold, overall and per category; missing score counts as negative (ANS-26)."""
    rows = cases.join(got.select("case_id", "score"), "case_id", "left")
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    yes, said = F.col("expected"), F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    counts = [
        F.count(F.when(yes & said, 1)).alias("tp"), F.count(F.when(~yes & said, 1)).alias("fp"),
        F.count(F.when(yes & ~said, 1)).alias("fn"), F.count(F.when(~yes & ~said, 1)).alias("tn"),
    ]
    out = rows.groupingSets([[F.col("threshold")], [F.col("threshold"), F.col("category")]], "threshold", "category").agg(*counts)
    return out.withColumn("category", F.coalesce("category", F.lit("all")))


def benchmark_choices(cases: DataFrame, got: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of cases whose expected choice was returned, per expected column (ANS-26)."""
    rows = cases.join(got.select("case_id", *[F.col(c).alias(f"__{c}") for c in columns]), "case_id", "left")
    out = None
    for c in columns:
        asked = rows.filter(F.col(c).isNotNull())
        part = asked.groupBy(F.lit(c).alias("question")).agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(c) == F.col(f"__{c}"), 1)).alias("n_right")
        )
        out = part if out is None else out.unionByName(part)
    return out


def benchmark_cards(cases: DataFrame, assigned: DataFrame) -> DataFrame:
    """Card outcome per expectation: none, any card, or a card of the group (ANS-26)."""
    rows = cases.join(assigned.select("case_id", F.col("card_id").alias("__card"), F.col("group_id").alias("__group")), "case_id", "left")
    real = F.col("__card").isNotNull() & (F.col("__card") != NONE)
    ok = F.when(F.col("card_rule") == "none", ~real).when(F.col("card_rule") == "carded", real).otherwise(
        real & F.coalesce(F.col("__group") == F.col("card_rule"), F.lit(False))
    )
    kind = F.when(F.col("card_rule").isin("none", "carded"), F.col("card_rule")).otherwise("group")
    return rows.filter("card_rule IS NOT NULL").groupBy(kind.alias("rule")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("n_right")
    )


def benchmark_misses(cases: DataFrame, got: DataFrame, threshold: float) -> DataFrame:
    """Cases on the wrong side of the threshold (ANS-26)."""
    rows = cases.join(got.select("case_id", "score"), "case_id", "left")
    said = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return rows.filter(said != F.col("expected")).select("case_id", "category", "expected", "score")


def injected_accuracy(cases: DataFrame, answers: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy overall and by type; a missing answer is wrong (ANS-27)."""
    rows = cases.join(answers.select("comment_id", "noul"), "comment_id", "left")
    right = F.coalesce((F.col("noul") >= threshold) == F.col("expected"), F.lit(False))
    out = rows.rollup("case_type").agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))
    return out.withColumn("case_type", F.coalesce("case_type", F.lit("all")))


def positive_rates(sample: DataFrame, screened: DataFrame, cutoff: float) -> DataFrame:
    """Per stratum: sampled, screened, positive and raw rate (ANS-28)."""
    rows = sample.select("comment_id", "stratum").join(screened.select("comment_id", "firsthand_p"), "comment_id", "left")
    hit = F.col("firsthand_p") >= cutoff
    out = rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_sampled"), F.count("firsthand_p").alias("n_screened"), F.count(F.when(hit, 1)).alias("n_positive")
    )
    return out.withColumn("rate", F.try_divide(F.col("n_positive").cast("double"), F.col("n_screened")))


def union_taxonomy(base: DataFrame, planted: DataFrame, key: str = "card_id") -> DataFrame:
    """Base and planted cards together; a shared id is an error (ANS-29)."""
    require_empty(base.select(key).intersect(planted.select(key)), "planted ids collide")
    return base.unionByName(planted)


def planted_items(planted: DataFrame, decoys: DataFrame) -> DataFrame:
    """Planted and decoy texts as items (ANS-29)."""
    return planted.select("comment_id", "card_id", "text").unionByName(
        decoys.select("comment_id", F.lit(None).cast("string").alias("card_id"), "text")
    )


def launch_items(launches: DataFrame, stories: DataFrame) -> DataFrame:
    """Sampled launches with stripped title and bounded snippet (ANS-30)."""
    require_empty(launches.select("story_id").join(stories, "story_id", "left_anti"), "launch without story")
    title = tx.strip_launch_prefix(F.col("title"))
    return launches.join(stories.select("story_id", "title", "text_norm"), "story_id").select(
        "story_id", title.alias("title"), tx.bounded_snippet(title, tx.split_sentences(F.col("text_norm"))).alias("snippet")
    )


def label_frame(sample: DataFrame, answers: DataFrame, question: str) -> DataFrame:
    """Sampled comments with a noul: id, score, weight (ANS-31)."""
    scores = answers.filter((F.col("question_id") == question) & F.col("noul").isNotNull()).select("comment_id", F.col("noul").alias("score"))
    return sample.select("comment_id", "weight").join(scores, "comment_id")
