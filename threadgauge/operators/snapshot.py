"""Snapshot building: item states, thread roots, periods, eligibility, coverage (SNP-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgauge.functions import text as tx
from threadgauge.operators.spread import hot_lookup, require_empty
from threadgauge.schemas import EXCLUSION_ORDER, fields
from threadgauge.session import cut_lineage


def item_state(is_null: Column, deleted: Column, dead: Column) -> Column:
    """null, deleted, dead or ok, first match wins (SNP-1)."""
    return (
        F.when(is_null, "null").when(F.coalesce(deleted, F.lit(False)), "deleted")
        .when(F.coalesce(dead, F.lit(False)), "dead").otherwise("ok")
    )


def normalize_items(raw: DataFrame) -> DataFrame:
    """Raw records (RAW_ITEM) to typed rows with text, sentences, hash and words (SNP-2)."""
    state = item_state(F.col("item").isNull(), F.col("item.deleted"), F.col("item.dead"))
    rows = raw.filter(F.col("item").isNotNull()).select(
        F.col("item.id").alias("id"), F.col("item.type").alias("type"), F.col("item.parent").alias("parent_id"),
        F.col("item.time").alias("time"), F.col("item.by").alias("author"), F.col("item.title").alias("title"),
        F.col("item.url").alias("url"), F.col("item.score").alias("score"),
        F.col("item.descendants").alias("descendants"), state.alias("state"),
        F.col("ended_at").alias("fetched_at"), tx.html_to_text(F.col("item.text")).alias("text_norm"),
    )
    return normalized_text(rows)


def normalized_text(rows: DataFrame, text: str = "text_norm") -> DataFrame:
    return rows.select(
        "*", tx.split_sentences(F.col(text)).alias("sentences"), tx.text_hash(F.col(text)).alias("text_sha256"),
        tx.word_count(F.col(text)).alias("word_count"), F.lit("und").alias("lang"),
    )


def record_tally(items: DataFrame, state: str = "state", kind: str = "type") -> DataFrame:
    """Every scanned id counted once by outcome, with a reconciliation flag (SNP-3)."""
    live = ~F.col(state).isin("null", "failed")
    typed = F.col(kind).isNotNull()
    parts = {
        "comments": live & (F.col(kind) == "comment"),
        "stories": live & F.col(kind).isin(*tx.ROOT_TYPES),
        "other": live & typed & (F.col(kind) != "comment") & ~F.col(kind).isin(*tx.ROOT_TYPES),
        "null": F.col(state) == "null",
        "failed": F.col(state) == "failed",
        "deleted_without_type": live & ~typed,
    }
    counted = items.agg(
        F.count(F.lit(1)).alias("ids_scanned"),
        *[F.count(F.when(cond, 1)).alias(f"n_{name}") for name, cond in parts.items()],
    )
    total = sum((F.col(f"n_{n}") for n in parts), F.lit(0))
    return counted.withColumn("reconciled", total == F.col("ids_scanned"))


def scan_wins(scan: DataFrame, context: DataFrame, key: str = "id") -> DataFrame:
    """All items: context rows only where the scan has none (SNP-4)."""
    return scan.unionByName(context.join(scan.select(key), key, "left_anti"), allowMissingColumns=True)


def missing_parents(items: DataFrame) -> DataFrame:
    """Distinct parents of comments that are not in the id set (SNP-7)."""
    wanted = items.filter("type = 'comment' AND parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    return wanted.join(items.select("id"), "id", "left_anti")


def resolve_roots(items: DataFrame) -> DataFrame:
    """(id, story_id, depth) for every comment, null where unresolved (SNP-6).

    Pointer doubling: each round replaces a pointer by its target's pointer, so
    a thread of depth d needs log2(d) rounds. Chains that meet a missing item, a
    non-comment non-root or a cycle never point at a root. Only open chains are
    written again in a round; what is finished or dead stays as it was written.
    """
    comments = items.filter("type = 'comment'").select("id", F.col("parent_id").alias("nxt"))
    kinds = items.select(
        F.col("id").alias("nxt"),
        F.when(F.col("type").isin(*tx.ROOT_TYPES), "root").when(F.col("type") == "comment", "open").otherwise("dead").alias("st"),
    )
    state = hot_lookup(comments, kinds, "nxt").select(
        "id", "nxt", F.lit(1).alias("dist"), F.coalesce("st", F.lit("dead")).alias("st")
    )
    settled, active = [], cut_lineage(state)
    still = active.count()
    for _ in range(still.bit_length() + 2):
        settled.append(active.filter("st <> 'open'"))
        active = active.filter("st = 'open'")
        before, still = still, active.count()
        # Open chains always lose members; if none did, only cycles are left.
        if still == 0 or (still == before and len(settled) > 1):
            break
        target = reduce(DataFrame.unionByName, settled, active).select(
            F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("dist").alias("dist2"), F.col("st").alias("st2")
        )
        # A comment answered by a third of all rows is one hot key here; the target
        # side is unique, so the adaptive skew join splits the hot side.
        moved = active.join(target, "nxt", "left").select(
            "id", F.col("nxt2").alias("nxt"), (F.col("dist") + F.col("dist2")).alias("dist"),
            F.coalesce("st2", F.lit("dead")).alias("st"),
        )
        active = cut_lineage(moved)
    table = reduce(DataFrame.unionByName, settled, active.filter("st = 'open'"))
    root = F.col("st") == "root"
    return table.select(
        "id", F.when(root, F.col("nxt")).alias("story_id"), F.when(root, F.col("dist")).cast("smallint").alias("depth")
    )


def window_period(time: Column, start: int, end: int) -> Column:
    """P01…P12 inside the half-open window, else null (SNP-8)."""
    step = F.floor((time - F.lit(start)) * 12 / F.lit(end - start)) + 1
    return F.when((time >= start) & (time < end), F.format_string("P%02d", step.cast("bigint")))


def calendar_month(time: Column) -> Column:
    """YYYY-MM in UTC (SNP-9)."""
    return F.date_format(F.timestamp_seconds(time), "yyyy-MM")


def exclusion_reason(kind: Column, time: Column, state: Column, text: Column, lang: Column, start: int, end: int) -> Column:
    """First matching reason, null when eligible (SNP-10)."""
    inside = F.coalesce((time >= start) & (time < end), F.lit(False))
    tests = dict(zip(EXCLUSION_ORDER, (
        kind != "comment", ~inside, state == "deleted", state == "dead", text == "", ~lang.isin("en", "und"),
    ), strict=True))
    out = F.when(F.lit(False), F.lit(""))
    for reason, test in tests.items():
        out = out.when(test, reason)
    return out


def comments_table(items: DataFrame, roots: DataFrame, start: int, end: int) -> DataFrame:
    """Comments with root, period, thread type and eligibility (SNP-11)."""
    types = items.filter(F.col("type").isin(*tx.ROOT_TYPES)).select(
        F.col("id").alias("story_id"), tx.thread_type(F.col("type"), F.col("title")).alias("thread_type")
    )
    rows = items.filter("type = 'comment'").join(roots, "id")
    rows = hot_lookup(rows, types, "story_id")
    time = F.col("time")
    reason = exclusion_reason(F.col("type"), time, F.col("state"), F.col("text_norm"), F.col("lang"), start, end)
    return rows.select(
        "id", "time", F.timestamp_seconds(time).alias("created_at"), calendar_month(time).alias("month"),
        window_period(time, start, end).alias("period"), "parent_id", "story_id", "depth", "text_norm",
        "sentences", "text_sha256", "author", F.coalesce("thread_type", F.lit("unknown")).alias("thread_type"),
        "state", F.coalesce((time >= start) & (time < end), F.lit(False)).alias("in_window"), "lang", "word_count",
        reason.isNull().alias("eligible"), reason.alias("exclusion_reason"),
    )


def stories_table(items: DataFrame, start: int, end: int) -> DataFrame:
    """Root items with thread type and window flag (SNP-12)."""
    time = F.col("time")
    return items.filter(F.col("type").isin(*tx.ROOT_TYPES)).select(
        "id", "time", F.timestamp_seconds(time).alias("created_at"), "type", "title", "text_norm",
        tx.thread_type(F.col("type"), F.col("title")).alias("thread_type"), "state",
        F.coalesce((time >= start) & (time < end), F.lit(False)).alias("in_window"),
    )


def context_table(context: DataFrame, scan: DataFrame) -> DataFrame:
    """Out-of-range ancestors (SNP-13)."""
    return context.join(scan.select("id"), "id", "left_anti").select(
        "id", "time", "type", "parent_id", "text_norm", "state"
    )


def coverage_table(comments: DataFrame, items: DataFrame, missing: DataFrame) -> DataFrame:
    """(dimension, key, count) over all coverage dimensions (SNP-14).

    One pass per source: grouping sets count every dimension at once.
    """

    def counts(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
        prepared = df.select(*[c.cast("string").alias(d) for d, c in dims.items()])
        sets = [[F.col(d)] for d in dims]
        grouped = prepared.groupingSets(sets, *[F.col(d) for d in dims]).agg(
            F.count(F.lit(1)).alias("count"),
            *[F.grouping(d).alias(f"__g_{d}") for d in dims],
        )
        name, key = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
        for d in dims:
            name = name.when(F.col(f"__g_{d}") == 0, d)
            key = key.when(F.col(f"__g_{d}") == 0, F.col(d))
        return grouped.select(name.alias("dimension"), key.alias("key"), "count").filter("key IS NOT NULL")

    from_comments = counts(comments, {
        "exclusion_reason": F.coalesce("exclusion_reason", F.lit("eligible")),
        "period": F.col("period"), "month": F.col("month"), "thread_type": F.col("thread_type"),
    })
    from_items = counts(items, {"state": F.col("state"), "type": F.col("type")})
    unresolved = comments.agg(F.count(F.when(F.col("story_id").isNull(), 1)).alias("count")).select(
        F.lit("unresolved_root").alias("dimension"), F.lit("comments").alias("key"), "count"
    )
    lost = missing.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("unresolved_root").alias("dimension"), F.lit("missing_parents").alias("key"), "count"
    )
    return from_comments.unionByName(from_items).unionByName(unresolved).unionByName(lost)


def snapshot_stats(comments: DataFrame) -> DataFrame:
    """Total, eligible and per-reason counts as rows (SNP-15)."""
    by_reason = comments.groupBy(F.coalesce("exclusion_reason", F.lit("eligible")).alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = comments.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("key"), "n")
    return by_reason.unionByName(total)


def content_hash(df: DataFrame) -> Column:
    """Order-free hash of whole rows, an aggregate (SNP-16)."""
    return F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"))


def verify_table(df: DataFrame, name: str, contract: str, expected_rows: int, expected_hash: str | None = None) -> DataFrame:
    """One report row: counts, schema and content; never raises (SNP-16)."""
    want = {f.name: f.dataType for f in fields(contract)}
    have = {f.name: f.dataType for f in df.schema}
    got = df.agg(F.count(F.lit(1)).alias("n_rows"), content_hash(df).cast("string").alias("content_hash"))
    hash_ok = F.lit(True) if expected_hash is None else F.coalesce(F.col("content_hash") == expected_hash, F.lit(False))
    return got.select(
        F.lit(name).alias("table"), "n_rows", "content_hash", (F.col("n_rows") == expected_rows).alias("rows_ok"),
        F.lit(want == have).alias("schema_ok"), hash_ok.alias("hash_ok"),
    )


def shard_status(records: DataFrame, expected: DataFrame, size: int, id_col: str = "id", state: str = "state", broken: DataFrame | None = None) -> DataFrame:
    """Per shard: missing, corrupt, partial or complete (SNP-17).

    ``expected`` holds (shard, n_lines) as announced by shard metadata;
    ``broken`` a row with ``shard`` per line that is no record. A shard with such
    a line is corrupt, and its count is added as ``n_broken``.
    """
    shard = F.floor(F.col(id_col) / size).cast("bigint")
    seen = records.groupBy(shard.alias("shard")).agg(
        F.count(F.lit(1)).alias("n_seen"), F.count(F.when(F.col(state) == "failed", 1)).alias("n_failed")
    )
    counted = expected.join(seen, "shard", "left")
    n_broken = F.lit(0)
    if broken is not None:
        counted = counted.join(broken.groupBy("shard").agg(F.count(F.lit(1)).alias("n_broken")), "shard", "left")
        n_broken = F.coalesce("n_broken", F.lit(0))
    status = (
        F.when(F.col("n_seen").isNull() & (n_broken == 0), "missing")
        .when((n_broken > 0) | (F.col("n_seen") != F.col("n_lines")), "corrupt")
        .when(F.col("n_failed") > 0, "partial").otherwise("complete")
    )
    return counted.select(
        "shard", "n_lines", F.coalesce("n_seen", F.lit(0)).alias("n_seen"),
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"), *([n_broken.alias("n_broken")] if broken is not None else []), status.alias("status"),
    )


def refetch_list(wanted: DataFrame, records: DataFrame, id_col: str = "id", state: str = "state") -> DataFrame:
    """Ids still to fetch: absent or failed (SNP-17)."""
    return wanted.select(id_col).join(records.filter(F.col(state) != "failed").select(id_col), id_col, "left_anti")


def load_items(ids: DataFrame, comments: DataFrame, stories: DataFrame, context: DataFrame, check: bool = True) -> DataFrame:
    """Comment with parent text and story title; unknown ids are an error (SNP-19)."""
    if check:
        require_empty(ids.join(comments.select("id"), "id", "left_anti"), "unknown comment ids")
    base = ids.join(comments.select("id", "parent_id", "story_id", F.col("text_norm").alias("text")), "id")
    texts = (
        comments.select(F.col("id").alias("parent_id"), F.col("text_norm").alias("parent_text"), F.lit(1).alias("pref"))
        .unionByName(stories.select(F.col("id").alias("parent_id"), F.col("text_norm").alias("parent_text"), F.lit(2).alias("pref")))
        .unionByName(context.select(F.col("id").alias("parent_id"), F.col("text_norm").alias("parent_text"), F.lit(3).alias("pref")))
    )
    parents = base.select("parent_id").filter("parent_id IS NOT NULL").distinct().join(texts, "parent_id")
    parents = parents.filter("parent_text IS NOT NULL").groupBy("parent_id").agg(F.min_by("parent_text", "pref").alias("parent_text"))
    titles = stories.select(F.col("id").alias("story_id"), F.coalesce("title", F.lit("")).alias("title"))
    rows = base.join(parents, "parent_id", "left").join(titles, "story_id", "left")
    keep = [c for c in ids.columns if c != "id"]
    return rows.select(
        "id", *keep, "story_id", "text", F.coalesce("parent_text", F.lit("")).alias("parent_text"),
        F.coalesce("title", F.lit("")).alias("title"),
    )


def bucket_hits(hits: DataFrame, comments: DataFrame) -> DataFrame:
    """Each unique hit id: in_frame, ineligible or outside_frame (SNP-20)."""
    flags = comments.select("id", "eligible")
    status = F.when(F.col("eligible"), "in_frame").when(~F.col("eligible"), "ineligible").otherwise("outside_frame")
    return hits.select("id").distinct().join(flags, "id", "left").select("id", status.alias("frame_status"))


def hits_per_query(hits: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deduplicated hits with frame status, and counts per query and bucket (SNP-21)."""
    unique = hits.select("query", "id").distinct()
    table = unique.join(bucket_hits(unique, comments), "id")
    counts = table.groupBy("query", "frame_status").agg(F.count(F.lit(1)).alias("n"))
    return table, counts
