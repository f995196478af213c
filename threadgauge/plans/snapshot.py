"""Snapshot plans (SRC, SNP, SNK) over the conversation threads and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.functions import text as tx
from threadgauge.functions.hashing import half_split
from threadgauge.operators import snapshot as sn
from threadgauge.operators.spread import latest_by
from threadgauge.plans.registry import Tables, plan
from threadgauge.plans.roles import cte, with_roles
from threadgauge.session import new_home
from threadgauge.sources import readers, sinks

START, END = 1704110400, 1706184000
SALT = "threads-v1"


def items(t: Tables):
    rows = t.role("items").withColumn("state", F.col("raw_state")).withColumn("text_norm", F.expr(
        "case when id % 31 = 7 then '' else text end"
    )).withColumn("lang", F.expr("case when conv_id % 14 = 6 then 'de' when conv_id % 5 = 0 then 'und' else 'en' end"))
    return rows


def comments(t: Tables):
    rows = items(t)
    rows = rows.select(
        "*", tx.split_sentences(F.col("text_norm")).alias("sentences"), tx.text_hash(F.col("text_norm")).alias("text_sha256"),
        tx.word_count(F.col("text_norm")).alias("word_count"),
    )
    return sn.comments_table(rows, sn.resolve_roots(items(t)), START, END)


ITEMS = f"""items0 AS ({cte('items')}), items AS (SELECT *, raw_state AS state,
 CASE WHEN id % 31 = 7 THEN '' ELSE text END AS text_norm,
 CASE WHEN conv_id % 14 = 6 THEN 'de' WHEN conv_id % 5 = 0 THEN 'und' ELSE 'en' END AS lang FROM items0)"""
ROOTS = """up AS (SELECT id, parent_id AS at, 1 AS depth FROM items WHERE type = 'comment'
 UNION ALL SELECT u.id, i.parent_id, u.depth + 1 FROM up u JOIN items i ON i.id = u.at AND i.type = 'comment' WHERE u.depth < 60),
roots AS (SELECT c.id, max(CASE WHEN r.type IN ('story','poll','job') THEN r.id END) AS story_id,
 max(CASE WHEN r.type IN ('story','poll','job') THEN u.depth END) AS depth
 FROM items c JOIN up u ON u.id = c.id LEFT JOIN items r ON r.id = u.at WHERE c.type = 'comment' GROUP BY c.id)"""
KIND = """CASE WHEN type = 'story' THEN CASE WHEN starts_with(title,'Ask HN:') THEN 'ask_hn' WHEN starts_with(title,'Show HN:') THEN 'show_hn'
 WHEN starts_with(title,'Launch HN:') THEN 'launch_hn' WHEN starts_with(title,'Tell HN:') THEN 'tell_hn' ELSE 'story' END
 WHEN type IN ('poll','job') THEN type ELSE 'unknown' END"""
COMMENTS = f"""comments AS (SELECT c.id, c.time, strftime(make_timestamp(c.time * 1000000), '%Y-%m') AS month,
 CASE WHEN c.time >= {START} AND c.time < {END} THEN 'P' || lpad(CAST((c.time - {START}) * 12 // ({END} - {START}) + 1 AS VARCHAR), 2, '0') END AS period,
 c.parent_id, r.story_id, r.depth, c.text_norm, c.author, coalesce(k.thread_type, 'unknown') AS thread_type, c.state, c.lang,
 (c.time >= {START} AND c.time < {END}) AS in_window,
 CASE WHEN NOT (c.time >= {START} AND c.time < {END}) THEN 'out_of_window' WHEN c.state = 'deleted' THEN 'deleted'
 WHEN c.state = 'dead' THEN 'dead' WHEN c.text_norm = '' THEN 'empty_text' WHEN c.lang NOT IN ('en','und') THEN 'non_english' END AS exclusion_reason
 FROM items c JOIN roots r ON r.id = c.id
 LEFT JOIN (SELECT id AS story_id, {KIND} AS thread_type FROM items WHERE type IN ('story','poll','job')) k ON k.story_id = r.story_id
 WHERE c.type = 'comment')"""
BASE = f"WITH RECURSIVE {ITEMS}, {ROOTS}, {COMMENTS}"


@plan("src_02_column_scan", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(t: Tables):
    return readers.scan(t.spark, t.path("orders"), ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@plan("src_03_id_set_scan", """SELECT o_orderkey, o_totalprice FROM orders
 WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')""")
def _(t: Tables):
    ids = t.lineitem.filter("l_quantity >= 50 AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.scan_ids(t.spark, t.path("orders"), ids, "o_orderkey", ["o_orderkey", "o_totalprice"])


@plan("src_04_union_by_name", """SELECT kind, count(*) AS n, count(city) AS n_city, round(sum(bal), 2) AS bal FROM (
 SELECT 'c' AS kind, c_acctbal AS bal, c_mktsegment AS city FROM customer UNION ALL BY NAME
 SELECT 's' AS kind, s_acctbal AS bal, NULL AS city FROM supplier) GROUP BY kind""")
def _(t: Tables):
    left = t.customer.select(F.lit("c").alias("kind"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("city"))
    right = t.supplier.select(F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal"))
    both = readers.union_by_name(left, right)
    return both.groupBy("kind").agg(
        F.count("*").alias("n"), F.count("city").alias("n_city"), F.round(F.sum("bal"), 2).alias("bal")
    )


@plan("src_05_latest_answer_part", f"""{with_roles('answers')} SELECT comment_id, question_id, noul, part, seq FROM answers
 QUALIFY row_number() OVER (PARTITION BY comment_id, question_id ORDER BY part DESC, seq DESC) = 1""")
def _(t: Tables):
    rows = t.role("answers").select("comment_id", "question_id", "noul", "part", "seq")
    return latest_by(rows, ["comment_id", "question_id"], ["part", "seq"])


@plan("src_06_context_later_line_wins", """SELECT user_id, event_id AS line, event_type FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def _(t: Tables):
    rows = t.events.select("user_id", F.col("event_id").alias("line"), "event_type")
    return readers.later_line_wins(rows, "user_id", "line")


@plan("src_08_taxonomy_table", """SELECT 'c' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS card_id, 'g' || CAST(n_regionkey AS VARCHAR) AS group_id,
 r_name AS group_label, n_name AS statement, 'v3' AS taxonomy_version, 'approved' AS status, CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS created_at, n_used FROM nation JOIN region ON r_regionkey = n_regionkey
 JOIN (SELECT c_nationkey, count(*) AS n_used FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey""")
def _(t: Tables):
    rows = t.nation.select(
        F.format_string("c%02d", "n_nationkey").alias("card_id"), F.concat(F.lit("g"), F.col("n_regionkey")).alias("group_id"),
        F.col("n_name").alias("statement"), F.lit("approved").alias("status"),
    )
    groups = t.region.select(F.concat(F.lit("g"), F.col("r_regionkey")).alias("group_id"), F.col("r_name").alias("group_label"))
    cards = readers.taxonomy(rows, groups, "v3")
    used = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n_used"))
    key = F.substring("card_id", 2, 2).cast("int")
    return cards.join(used, key == F.col("c_nationkey")).drop("c_nationkey")


@plan("snp_01_item_state", f"""{with_roles('items')} SELECT state, count(*) AS n FROM (SELECT CASE WHEN raw_state = 'null' THEN 'null'
 WHEN raw_state = 'deleted' THEN 'deleted' WHEN raw_state = 'dead' THEN 'dead' ELSE 'ok' END AS state FROM items) GROUP BY state""")
def _(t: Tables):
    s = F.col("raw_state")
    rows = t.role("items").select(sn.item_state(s == "null", s == "deleted", s == "dead").alias("state"))
    return rows.groupBy("state").agg(F.count("*").alias("n"))


@plan("snp_02_normalized_rows", """SELECT doc_id AS id, sha256(text) AS text_sha256,
 len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word_count, 'und' AS lang FROM documents""")
def _(t: Tables):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("text_norm"))
    return sn.normalized_text(rows).select("id", "text_sha256", "word_count", "lang")


@plan("snp_03_record_tally", f"""WITH {ITEMS} SELECT count(*) AS ids_scanned, count(*) FILTER (state <> 'null' AND type = 'comment') AS n_comments,
 count(*) FILTER (state <> 'null' AND type IN ('story','poll','job')) AS n_stories, count(*) FILTER (state <> 'null' AND type = 'pollopt') AS n_other,
 count(*) FILTER (state = 'null') AS n_null, 0::BIGINT AS n_failed, 0::BIGINT AS n_deleted_without_type, true AS reconciled FROM items""")
def _(t: Tables):
    return sn.record_tally(items(t))


@plan("snp_04_scan_wins", f"""{with_roles('items')} SELECT id, type, title FROM items WHERE turn < 4
 UNION ALL SELECT id, 'context' AS type, title FROM items WHERE turn >= 3 AND id NOT IN (SELECT id FROM items WHERE turn < 4)""")
def _(t: Tables):
    rows = t.role("items")
    scan = rows.filter("turn < 4").select("id", "type", "title")
    context = rows.filter("turn >= 3").select("id", F.lit("context").alias("type"), "title")
    return sn.scan_wins(scan, context)


@plan("snp_05_thread_type", f"WITH {ITEMS} SELECT {KIND} AS thread_type, count(*) AS n FROM items GROUP BY 1")
def _(t: Tables):
    from threadgauge.functions.text import thread_type

    rows = items(t).select(thread_type(F.col("type"), F.col("title")).alias("thread_type"))
    return rows.groupBy("thread_type").agg(F.count("*").alias("n"))


@plan("snp_06_roots", f"WITH RECURSIVE {ITEMS}, {ROOTS} SELECT id, story_id, depth FROM roots")
def _(t: Tables):
    return sn.resolve_roots(t.role("items"))


@plan("snp_06_roots_deep_chains", """WITH links AS (SELECT event_id AS id, user_id,
 lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_id FROM events)
 SELECT id, CASE WHEN parent_id IS NOT NULL THEN min(id) OVER (PARTITION BY user_id) END AS story_id,
 row_number() OVER (PARTITION BY user_id ORDER BY id) - 1 AS depth FROM links QUALIFY parent_id IS NOT NULL""")
def _(t: Tables):
    from pyspark.sql import Window

    previous = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select(F.col("event_id").alias("id"), previous.alias("parent_id"))
    rows = rows.withColumn("type", F.when(F.col("parent_id").isNull(), "story").otherwise("comment"))
    return sn.resolve_roots(rows)


@plan("snp_07_missing_parents", f"""{with_roles('items')} SELECT DISTINCT parent_id AS id FROM items WHERE type = 'comment'
 AND parent_id NOT IN (SELECT id FROM items)""")
def _(t: Tables):
    return sn.missing_parents(t.role("items"))


@plan("snp_08_window_period", """SELECT CASE WHEN s >= 800000000 AND s < 900000000 THEN 'P' || lpad(CAST((s - 800000000) * 12 // 100000000 + 1 AS VARCHAR), 2, '0') END AS period,
 count(*) AS n FROM (SELECT CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders) GROUP BY 1""")
def _(t: Tables):
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    rows = t.orders.select(sn.window_period(seconds, 800_000_000, 900_000_000).alias("period"))
    return rows.groupBy("period").agg(F.count("*").alias("n"))


@plan("snp_09_calendar_month", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables):
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    return t.lineitem.select(sn.calendar_month(seconds).alias("month")).groupBy("month").agg(F.count("*").alias("n"))


@plan("snp_11_comments_table", f"""{BASE} SELECT id, time, month, period, parent_id, story_id, depth, author, thread_type, state, lang, in_window,
 exclusion_reason IS NULL AS eligible, exclusion_reason, sha256(text_norm) AS text_sha256,
 len(list_filter(regexp_split_to_array(text_norm, '\\s+'), lambda x: x <> '')) AS word_count FROM comments""")
def _(t: Tables):
    return comments(t).drop("text_norm", "sentences", "created_at")


@plan("snp_12_stories_table", f"""WITH {ITEMS} SELECT id, time, type, title, {KIND} AS thread_type, state, (time >= {START} AND time < {END}) AS in_window
 FROM items WHERE type IN ('story','poll','job')""")
def _(t: Tables):
    return sn.stories_table(items(t), START, END).drop("text_norm", "created_at")


@plan("snp_13_context_table", f"""WITH {ITEMS} SELECT id, time, type, parent_id, state FROM items WHERE conv_id % 3 = 0
 AND id NOT IN (SELECT id FROM items WHERE turn < 2)""")
def _(t: Tables):
    rows = items(t)
    return sn.context_table(rows.filter("conv_id % 3 = 0"), rows.filter("turn < 2")).drop("text_norm")


@plan("snp_14_coverage", f"""{BASE} SELECT 'exclusion_reason' AS dimension, coalesce(exclusion_reason, 'eligible') AS key, count(*) AS count FROM comments GROUP BY ALL
 UNION ALL SELECT 'period', period, count(*) FROM comments WHERE period IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'month', month, count(*) FROM comments GROUP BY ALL
 UNION ALL SELECT 'thread_type', thread_type, count(*) FROM comments GROUP BY ALL
 UNION ALL SELECT 'state', state, count(*) FROM items GROUP BY ALL
 UNION ALL SELECT 'type', type, count(*) FROM items GROUP BY ALL
 UNION ALL SELECT 'unresolved_root', 'comments', count(*) FROM comments WHERE story_id IS NULL
 UNION ALL SELECT 'unresolved_root', 'missing_parents', count(DISTINCT parent_id) FROM items WHERE type = 'comment' AND parent_id NOT IN (SELECT id FROM items)""")
def _(t: Tables):
    rows = items(t)
    return sn.coverage_table(comments(t), rows, sn.missing_parents(rows))


@plan("snp_15_snapshot_stats", f"""{BASE} SELECT coalesce(exclusion_reason, 'eligible') AS key, count(*) AS n FROM comments GROUP BY ALL
 UNION ALL SELECT 'total', count(*) FROM comments""")
def _(t: Tables):
    return sn.snapshot_stats(comments(t))


@plan("snp_16_verify", """SELECT 'orders' AS "table", count(*) AS n_rows, true AS rows_ok, false AS schema_ok, true AS hash_ok FROM orders
 UNION ALL SELECT 'nation', count(*), count(*) = 25, true, true FROM nation""")
def _(t: Tables):
    orders, nation = t.orders, t.nation
    first = sn.verify_table(orders, "orders", "o_orderkey bigint", orders.count())
    second = sn.verify_table(nation, "nation", "n_nationkey int, n_name string, n_regionkey int", 25)
    return first.unionByName(second).drop("content_hash")


@plan("snp_17_shard_status", """WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 977 = 5 THEN 'failed' ELSE 'ok' END AS state FROM events
 WHERE NOT (event_id // 500 % 7 = 3) AND NOT (event_id // 500 % 5 = 2 AND event_id % 100 = 0)),
 e AS (SELECT event_id // 500 AS shard, count(*) AS n_lines FROM events GROUP BY 1),
 s AS (SELECT id // 500 AS shard, count(*) AS n_seen, count(*) FILTER (state = 'failed') AS n_failed FROM r GROUP BY 1)
 SELECT e.shard, n_lines, coalesce(n_seen, 0) AS n_seen, coalesce(n_failed, 0) AS n_failed,
 CASE WHEN n_seen IS NULL THEN 'missing' WHEN n_seen <> n_lines THEN 'corrupt' WHEN n_failed > 0 THEN 'partial' ELSE 'complete' END AS status
 FROM e LEFT JOIN s USING (shard)""")
def _(t: Tables):
    return sn.shard_status(_records(t), _expected(t), 500)


def _records(t: Tables):
    rows = t.events.select(F.col("event_id").alias("id"), F.expr("case when event_id % 977 = 5 then 'failed' else 'ok' end").alias("state"))
    return rows.filter("NOT ((id div 500) % 7 = 3) AND NOT ((id div 500) % 5 = 2 AND id % 100 = 0)")


def _expected(t: Tables):
    return t.events.groupBy(F.expr("event_id div 500").alias("shard")).agg(F.count("*").alias("n_lines"))


@plan("snp_17_refetch_list", """SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT event_id FROM events
 WHERE NOT (event_id // 500 % 7 = 3) AND NOT (event_id // 500 % 5 = 2 AND event_id % 100 = 0) AND event_id % 977 <> 5)""")
def _(t: Tables):
    return sn.refetch_list(t.events.select(F.col("event_id").alias("id")), _records(t))


@plan("snp_18_half_split", f"""SELECT CASE WHEN CAST('0x' || substr(sha256('{SALT}:' || CAST(o_custkey AS VARCHAR)), 1, 2) AS INT) % 2 = 0
 THEN 'explore' ELSE 'confirm' END AS half, count(*) AS n, count(DISTINCT o_custkey) AS n_threads FROM orders GROUP BY 1""")
def _(t: Tables):
    rows = t.orders.select("o_custkey", half_split("o_custkey", SALT).alias("half"))
    return rows.groupBy("half").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_threads"))


@plan("snp_19_item_loader", f"""{BASE}, sid AS (SELECT id, title, text_norm FROM items WHERE type IN ('story','poll','job'))
 SELECT c.id, c.story_id, md5(c.text_norm) AS text_key, md5(coalesce(p.text_norm, s.text_norm, x.text_norm, '')) AS parent_key, coalesce(r.title, '') AS title
 FROM comments c LEFT JOIN comments p ON p.id = c.parent_id LEFT JOIN sid s ON s.id = c.parent_id
 LEFT JOIN (SELECT id, text_norm FROM items WHERE type = 'pollopt') x ON x.id = c.parent_id LEFT JOIN sid r ON r.id = c.story_id""")
def _(t: Tables):
    table, rows = comments(t), items(t)
    ids = table.select("id")
    out = sn.load_items(ids, table, sn.stories_table(rows, START, END), rows.filter("type = 'pollopt'"))
    return out.select("id", "story_id", F.md5("text").alias("text_key"), F.md5("parent_text").alias("parent_key"), "title")


HITS = """hits AS (SELECT event_type AS query, event_id % 20000 AS id FROM events)"""


def _hits(t: Tables):
    return t.events.select(F.col("event_type").alias("query"), (F.col("event_id") % 20000).alias("id"))


def _frame(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("eligible"))


STATUS = """CASE WHEN o_orderstatus <> 'F' THEN 'in_frame' WHEN o_orderstatus = 'F' THEN 'ineligible' ELSE 'outside_frame' END"""


@plan("snp_20_hit_bucketing", f"""WITH {HITS} SELECT id, {STATUS} AS frame_status FROM (SELECT DISTINCT id FROM hits) LEFT JOIN orders ON o_orderkey = id""")
def _(t: Tables):
    return sn.bucket_hits(_hits(t), _frame(t))


@plan("snp_21_hits_per_query", f"""WITH {HITS} SELECT query, {STATUS} AS frame_status, count(*) AS n FROM (SELECT DISTINCT query, id FROM hits)
 LEFT JOIN orders ON o_orderkey = id GROUP BY ALL""")
def _(t: Tables):
    return sn.hits_per_query(_hits(t), _frame(t))[1]


@plan("snk_02_allowlisted_export", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t: Tables):
    return sinks.allowlisted(t.customer, ["c_custkey", "c_mktsegment", "not_there"])


@plan("snk_03_latest_labels", """SELECT user_id AS comment_id, event_type AS question_id, value FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def _(t: Tables):
    rows = t.events.select(
        F.col("user_id").alias("comment_id"), F.col("event_type").alias("question_id"), "value", "ts", "event_id",
        F.lit("someone").alias("reviewer"),
    )
    out = sinks.latest_labels(rows, ["comment_id", "question_id"], ["ts", "event_id"])
    return out.select("comment_id", "question_id", "value")


@plan("snk_04_replace_partition", """SELECT c_mktsegment AS label_set, c_custkey AS comment_id, 0.5::DOUBLE AS selection_prob FROM customer WHERE c_mktsegment NOT IN ('BUILDING')
 UNION ALL SELECT 'BUILDING', s_suppkey, 0.25::DOUBLE FROM supplier""")
def _(t: Tables):
    old = t.customer.select(F.col("c_mktsegment").alias("label_set"), F.col("c_custkey").alias("comment_id"), F.lit(0.5).alias("selection_prob"))
    new = t.supplier.select(F.lit("BUILDING").alias("label_set"), F.col("s_suppkey").alias("comment_id"), F.lit(0.25).alias("selection_prob"))
    return sinks.replace_label_sets(old, new)


@plan("snk_06_conform", "SELECT o_orderkey, CAST(floor(o_totalprice) AS INTEGER) AS whole, CAST(o_totalprice AS DOUBLE) AS price, o_orderstatus FROM orders")
def _(t: Tables):
    from threadgauge.schemas import conform

    rows = t.orders.select(
        F.lit("dropped").alias("extra"), "o_orderstatus", F.col("o_totalprice").cast("string").alias("price"),
        F.floor("o_totalprice").cast("string").alias("whole"), F.col("o_orderkey").cast("string").alias("o_orderkey"),
    )
    return conform(rows, "o_orderkey bigint, whole int, price double, o_orderstatus string")


@plan("snk_07_bounded_listing", """SELECT doc_id AS id, source AS domain, CAST(n_chars AS DOUBLE) / 1000 AS severity_raw,
 round(CAST(n_chars AS DOUBLE) / 1000, 1) AS severity, rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300)) AS text FROM documents""")
def _(t: Tables):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("domain"), (F.col("n_chars") / 1000).alias("severity_raw"), "text")
    return sinks.bounded_listing(rows.withColumn("severity", F.col("severity_raw")))


def scratch(t: Tables) -> str:
    """A new folder beside the checkpoints, for files a plan writes and reads back."""
    return new_home(t.spark)


@plan("src_01_raw_records", """SELECT conv_id * 100 + turn AS id, CASE WHEN turn = 0 THEN 'story' ELSE 'comment' END AS type, CASE WHEN turn % 7 = 6 THEN 'deleted' WHEN turn % 5 = 4 THEN 'dead' ELSE 'ok' END AS state, sha256(regexp_replace(text, '\\s+$', '')) AS text_sha256
 FROM conversations""")
def _(t: Tables):
    item = F.struct(
        F.expr("conv_id * 100 + turn").alias("id"), F.expr("if(turn = 0, 'story', 'comment')").alias("type"),
        F.expr("if(turn = 0, null, conv_id * 100 + turn - 1)").alias("parent"), F.expr("1704067200 + conv_id").alias("time"), F.col("role").alias("by"),
        F.replace("text", F.lit("&"), F.lit("&amp;")).alias("text"), (F.col("turn") % 5 == 4).alias("dead"), (F.col("turn") % 7 == 6).alias("deleted"),
    )
    folder = f"{scratch(t)}/raw"
    t.conversations.select(F.expr("conv_id * 100 + turn").alias("id"), F.lit("ok").alias("state"), item.alias("item")).write.option("compression", "gzip").json(folder)
    return sn.normalize_items(readers.raw_records(t.spark, folder)).select("id", "type", "state", "text_sha256")


def broken_shards(t: Tables) -> str:
    """Folder of gzip shards of 50 conversations with the lines of some ids cut short."""
    folder = f"{scratch(t)}/broken"
    line = F.to_json(F.struct(F.expr("conv_id * 100 + turn").alias("id"), F.expr("if(turn % 5 = 4, 'failed', 'ok')").alias("state"), F.struct("text").alias("item")))
    cut = F.expr("(conv_id * 100 + turn) % 97 = 5")
    rows = t.conversations.withColumn("line", line)
    rows = rows.select(F.expr("conv_id div 50").alias("shard"), F.when(cut, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line")).alias("value"))
    rows.write.partitionBy("shard").option("compression", "gzip").text(folder)
    return folder


BROKEN = "c AS (SELECT conv_id * 100 + turn AS id, conv_id // 50 AS shard, (conv_id * 100 + turn) % 97 = 5 AS broken, turn % 5 = 4 AS failed FROM conversations)"


@plan("src_01_broken_lines", f"WITH {BROKEN} SELECT shard, id, count(*) AS n FROM c WHERE broken GROUP BY ALL")
def _(t: Tables):
    bad = readers.broken_lines(t.spark, broken_shards(t))
    return bad.filter("position >= 1 AND block = 0").groupBy("shard", "id").agg(F.count("*").alias("n"))


@plan("snp_17_status_with_broken_lines", f"""WITH {BROKEN}, s AS (SELECT shard, count(*) AS n_lines, count(*) FILTER (NOT broken) AS n_seen, count(*) FILTER (failed AND NOT broken) AS n_failed, count(*) FILTER (broken) AS n_broken FROM c GROUP BY 1)
 SELECT *, CASE WHEN n_broken > 0 THEN 'corrupt' WHEN n_failed > 0 THEN 'partial' ELSE 'complete' END AS status FROM s""")
def _(t: Tables):
    folder = broken_shards(t)
    expected = t.conversations.groupBy(F.expr("conv_id div 50").alias("shard")).agg(F.count("*").alias("n_lines"))
    return sn.shard_status(readers.raw_records(t.spark, folder), expected, 5000, broken=readers.broken_lines(t.spark, folder))


@plan("src_05_answer_part_files", f"""{with_roles('answers')} SELECT comment_id, question_id, noul, part, seq FROM answers
 QUALIFY row_number() OVER (PARTITION BY comment_id, question_id ORDER BY part DESC, seq DESC) = 1""")
def _(t: Tables):
    rows, folder = t.role("answers").select("comment_id", "question_id", "noul", "part", "seq"), scratch(t)
    for n in range(7):
        rows.filter(F.col("part") == n).drop("part").write.parquet(f"{folder}/part-{n}.parquet")
    return readers.answer_parts(t.spark, f"{folder}/part-*.parquet", ["seq"])


@plan("src_07_dimension", "SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1")
def _(t: Tables):
    path = f"{scratch(t)}/brands.csv"
    t.part.select(F.col("p_brand").alias("name")).distinct().write.option("header", True).csv(path)
    brands = readers.dimension(t.spark, path, "name string")
    return t.part.join(brands, F.col("p_brand") == F.col("name")).groupBy("name").agg(F.count("*").alias("n"))


@plan("snp_10_eligibility", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN turn = 0 THEN 'not_comment' WHEN conv_id >= 90 THEN 'out_of_window' WHEN turn % 7 = 6 THEN 'deleted' WHEN turn % 5 = 4 THEN 'dead'
 WHEN text = '' THEN 'empty_text' WHEN conv_id % 4 = 1 THEN 'non_english' ELSE 'eligible' END AS reason FROM conversations) GROUP BY 1""")
def _(t: Tables):
    rows = t.conversations.select(
        F.expr("if(turn = 0, 'story', 'comment')").alias("type"), "conv_id", F.expr("if(turn % 7 = 6, 'deleted', if(turn % 5 = 4, 'dead', 'ok'))").alias("state"),
        "text", F.expr("if(conv_id % 4 = 1, 'fr', 'en')").alias("lang"),
    )
    reason = sn.exclusion_reason(F.col("type"), F.col("conv_id"), F.col("state"), F.col("text"), F.col("lang"), 0, 90)
    return rows.select(F.coalesce(reason, F.lit("eligible")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@plan("snk_01_sorted_write", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(t: Tables):
    path = f"{scratch(t)}/sorted"
    sinks.write_sorted(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), path, "l_orderkey")
    return t.spark.read.parquet(path)


@plan("snk_04_written_label_sets", """SELECT c_mktsegment AS label_set, c_custkey AS comment_id, 0.5::DOUBLE AS selection_prob FROM customer WHERE c_mktsegment NOT IN ('BUILDING')
 UNION ALL SELECT 'BUILDING', s_suppkey, 0.25::DOUBLE FROM supplier""")
def _(t: Tables):
    path = f"{scratch(t)}/labels"
    old = t.customer.select(F.col("c_mktsegment").alias("label_set"), F.col("c_custkey").alias("comment_id"), F.lit(0.5).alias("selection_prob"))
    new = t.supplier.select(F.lit("BUILDING").alias("label_set"), F.col("s_suppkey").alias("comment_id"), F.lit(0.25).alias("selection_prob"))
    for rows in (old, new):
        sinks.write_label_sets(rows, path)
    return sinks.read_label_sets(t.spark, path, "label_set string, comment_id bigint, selection_prob double")


@plan("snk_05_gated_publish", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(t: Tables):
    from threadgauge.operators.gates import forbidden_fields

    path = f"{scratch(t)}/site"
    tables = {"segments": t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))}
    sinks.publish(tables, path, [forbidden_fields])
    return t.spark.read.parquet(f"{path}/segments")
