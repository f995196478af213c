"""Answer plans (ANS): events are the answer log, orders the coded comments, nations the cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.operators import answers as an
from threadgauge.operators.spread import latest_by
from threadgauge.plans.registry import Tables, plan
from threadgauge.plans.roles import cte

ANSWERS = f"answers AS ({cte('answers')}), last AS (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY comment_id, question_id ORDER BY part DESC, seq DESC) = 1)"
PROBLEMS = f"problems AS ({cte('problems')})"


def last(t: Tables):
    return latest_by(t.role("answers"), ["comment_id", "question_id"], ["part", "seq"])


@plan("ans_01_pivot", f"""WITH {ANSWERS} SELECT comment_id, max(noul) FILTER (question_id = 'click') AS f_click, max(noul) FILTER (question_id = 'view') AS f_view,
 max(noul) FILTER (question_id = 'error') AS f_error FROM last WHERE question_id IN ('click', 'view', 'error') GROUP BY 1""")
def _(t: Tables):
    return an.pivot_answers(last(t), ["click", "view", "error"])


@plan("ans_02_duplicate_answers", f"WITH {ANSWERS} SELECT comment_id, question_id, count(*) AS n FROM answers GROUP BY ALL HAVING count(*) > 1")
def _(t: Tables):
    return an.duplicate_answers(t.role("answers"))


PACK = """pos AS (SELECT o_orderkey AS comment_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders WHERE o_orderstatus <> 'F'),
 packed AS (SELECT first_value(comment_id) OVER (PARTITION BY p // 5 ORDER BY p) AS packed_id, 'c' || CAST(p % 5 + 1 AS VARCHAR) AS slot, comment_id FROM pos)"""


def items(t: Tables):
    return t.orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("comment_id"), F.col("o_orderpriority").alias("text"))


@plan("ans_03_pack", f"WITH {PACK} SELECT * FROM packed")
def _(t: Tables):
    return an.pack(items(t))


@plan("ans_03_packed_requests", f"WITH {PACK} SELECT packed_id, count(*) AS n_members, string_agg(slot || '=' || o_orderpriority, ';' ORDER BY slot) AS state FROM packed JOIN orders ON o_orderkey = comment_id GROUP BY 1")
def _(t: Tables):
    rows = an.packed_requests(items(t), an.pack(items(t)))
    state = F.array_join(F.transform(F.map_entries("state"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return rows.select("packed_id", "n_members", state.alias("state"))


def packed_answers(packed):
    qid = F.concat("slot", F.lit("_firsthand_problem"))
    rows = packed.select(F.col("packed_id").alias("comment_id"), qid.alias("question_id"), (F.col("comment_id") % 97 / 96.0).alias("noul"), (F.col("packed_id") % 4).alias("part"))
    stale = rows.withColumn("part", F.lit(9)).withColumn("noul", F.lit(0.0))
    return rows.unionByName(stale)


@plan("ans_04_unpack", f"WITH {PACK} SELECT comment_id, 'firsthand_problem' AS question_id, round(noul, 9) AS noul FROM (SELECT comment_id, comment_id % 97 / 96e0 AS noul FROM packed UNION ALL SELECT comment_id, 0e0 FROM packed)")
def _(t: Tables):
    packed = an.pack(items(t))
    return an.unpack(packed_answers(packed), packed).select("comment_id", "question_id", F.round("noul", 9).alias("noul"))


@plan("ans_05_screen_table", f"WITH {PACK} SELECT comment_id, o_orderpriority AS stratum, round(comment_id % 97 / 96e0, 9) AS firsthand_p, packed_id, slot FROM packed JOIN orders ON o_orderkey = comment_id")
def _(t: Tables):
    packed = an.pack(items(t))
    answers = packed_answers(packed)
    done = answers.filter("part < 9").select("comment_id", "part").distinct()
    out = an.screen_table(answers, done, packed, items(t).select("comment_id", F.col("text").alias("stratum")))
    return out.withColumn("firsthand_p", F.round("firsthand_p", 9))


@plan("ans_06_packed_vs_single", f"WITH {PROBLEMS} SELECT count(*) AS n, round(corr(firsthand_p, card_p), 6) AS pearson, round(avg(CASE WHEN (firsthand_p >= 5e-1) = (card_p >= 5e-1) THEN 1e0 ELSE 0e0 END), 6) AS agreement, round(avg(abs(firsthand_p - card_p)), 6) AS mean_abs_diff FROM problems")
def _(t: Tables):
    rows = t.role("problems")
    out = an.packed_vs_single(rows.select("comment_id", F.col("firsthand_p").alias("noul")), rows.select("comment_id", F.col("card_p").alias("noul")))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("pearson", "agreement", "mean_abs_diff")])


@plan("ans_07_work_list", f"WITH {ANSWERS} SELECT o_orderkey AS comment_id FROM orders WHERE o_orderkey NOT IN (SELECT comment_id FROM answers)")
def _(t: Tables):
    return an.work_list(t.orders.select(F.col("o_orderkey").alias("comment_id")), t.role("answers"))


@plan("ans_08_response_reuse", """WITH c AS (SELECT event_id AS request_id, user_id || ':' || event_type AS request_key, value AS noul FROM events)
 SELECT request_id, request_key, min(request_id) OVER (PARTITION BY request_key) AS source_request_id, arg_min(noul, request_id) OVER (PARTITION BY request_key) AS answer,
 request_id <> min(request_id) OVER (PARTITION BY request_key) AS replayed FROM c""")
def _(t: Tables):
    calls = t.events.select(F.col("event_id").alias("request_id"), F.concat_ws(":", "user_id", "event_type").alias("request_key"), F.col("value").alias("noul"))
    return an.reuse_responses(calls, order=("request_id",)).select("request_id", "request_key", "source_request_id", "answer", "replayed")


@plan("ans_09_scoring_pass", """SELECT doc_id AS comment_id, 'r1' AS run_id, 'screen@1' AS question_set, 'noul' AS qtype, round(len(list_filter(w, lambda x: x IN ('i','we','my','our','me','us'))) / greatest(len(w), 1), 9) AS noul
 FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def _(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("comment_id"), "text")
    out = an.score_items(docs, "r1", "screen@1", "firsthand_problem", an.keyword_scorer())
    return out.select("comment_id", "run_id", "question_set", "qtype", F.round("noul", 9).alias("noul"))


@plan("ans_10_superset_pin", "SELECT o_orderkey AS comment_id FROM orders WHERE o_orderstatus = 'P'")
def _(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("comment_id"), "o_orderstatus")
    return an.not_in(rows, rows.filter("o_orderstatus <> 'P'"))


@plan("ans_11_answer_distributions", f"""WITH {ANSWERS} SELECT question_id, CAST(CAST(least(floor(noul * 10), 9) AS BIGINT) AS VARCHAR) AS key, count(*) AS n, NULL::DOUBLE AS mean, 'noul_bin' AS kind FROM last GROUP BY ALL
 UNION ALL SELECT question_id, choice, count(*), NULL, 'choice' FROM last GROUP BY ALL UNION ALL SELECT question_id, 'mean', count(*), round(avg(score), 6), 'score' FROM last GROUP BY ALL""")
def _(t: Tables):
    return an.answer_distributions(last(t)).withColumn("mean", F.round("mean", 6))


@plan("ans_12_gate_loss", f"""WITH {PROBLEMS}, {ANSWERS}, sel AS (SELECT comment_id, 5e-1 AS p FROM problems WHERE firsthand_p < 6e-1 AND comment_id % 2 = 0), b AS (SELECT comment_id, max(noul) AS best FROM answers GROUP BY 1)
 SELECT count(*) AS n_random, count(*) FILTER (best >= 8e-1) AS n_hits, round(coalesce(sum(1 / p) FILTER (best >= 8e-1), 0), 4) AS estimated_lost FROM sel LEFT JOIN b USING (comment_id)""")
def _(t: Tables):
    sel = t.role("problems").filter("firsthand_p < 0.6 AND comment_id % 2 = 0").select("comment_id", F.lit("random").alias("rule"), F.lit(0.5).alias("selection_prob"))
    return an.gate_loss(sel, t.role("answers"), 0.8).withColumn("estimated_lost", F.round("estimated_lost", 4))


def level_answers(t: Tables):
    rows = t.role("problems")
    probs = F.to_json(F.map_from_arrays(F.array("group_id", F.lit("gz")), F.array(F.col("group_p"), F.lit(0.3))))
    groups = rows.filter("comment_id % 53 <> 0 AND group_id IS NOT NULL").select(
        "comment_id", F.when(F.col("comment_id") % 37 == 0, "none").otherwise(F.col("group_id")).alias("choice"), F.col("group_p").alias("confidence"), probs.alias("probabilities_json")
    )
    cprobs = F.to_json(F.map_from_arrays(F.array("card_id", F.lit("cz"), F.lit("ca")), F.array(F.col("card_p"), F.lit(0.3), F.lit(0.25))))
    cards = rows.filter("comment_id % 59 <> 0 AND card_id IS NOT NULL").select("comment_id", F.col("card_id").alias("choice"), F.col("card_p").alias("confidence"), cprobs.alias("probabilities_json"))
    return rows, groups, cards


@plan("ans_13_two_level_assignment", f"""WITH {PROBLEMS}, r AS (SELECT comment_id, CASE WHEN comment_id % 37 = 0 THEN 'none' ELSE group_id END AS group_id, group_p AS gc, CASE WHEN comment_id % 37 = 0 THEN NULL ELSE group_p END AS group_p,
 CASE WHEN comment_id % 59 <> 0 THEN card_id END AS card_id, card_p FROM problems WHERE comment_id % 53 <> 0 AND group_id IS NOT NULL)
 SELECT comment_id, group_id, group_p, gc AS group_confidence, CASE WHEN group_id <> 'none' THEN card_id END AS card_id, CASE WHEN group_id <> 'none' THEN card_p END AS card_p,
 CASE WHEN group_id <> 'none' THEN CASE WHEN card_id = 'none' THEN 'cz,ca' WHEN card_p > 3e-1 THEN card_id || ',cz' WHEN card_p = 3e-1 THEN card_id || ',cz' WHEN card_p > 25e-2 THEN 'cz,' || card_id WHEN card_p = 25e-2 THEN 'cz,' || least(card_id, 'ca') ELSE 'cz,ca' END END AS card_top2,
 coalesce(group_id <> 'none' AND card_p < 5e-1, false) AS low_confidence FROM r WHERE group_id = 'none' OR card_id IS NOT NULL""")
def _(t: Tables):
    rows, groups, cards = level_answers(t)
    out = an.assign_two_level(rows, groups, cards, "r1", "t1")
    return out.select("comment_id", "group_id", "group_p", "group_confidence", "card_id", "card_p", "card_top2", "low_confidence")


CARDS = """cards AS (SELECT 'c' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS card_id, 'g' || CAST(n_regionkey AS VARCHAR) AS group_id, n_name AS statement,
 CASE WHEN n_nationkey % 6 = 5 THEN 'merged_into:c' || lpad(CAST(n_nationkey - 1 AS VARCHAR), 2, '0') WHEN n_nationkey = 4 THEN 'merged_into:c00' WHEN n_nationkey = 7 THEN 'retired' ELSE 'approved' END AS status FROM nation)"""


def cards(t: Tables):
    status = F.expr("case when n_nationkey % 6 = 5 then concat('merged_into:c', lpad(n_nationkey - 1, 2, '0')) when n_nationkey = 4 then 'merged_into:c00' when n_nationkey = 7 then 'retired' else 'approved' end")
    return t.nation.select(F.format_string("c%02d", "n_nationkey").alias("card_id"), F.concat(F.lit("g"), F.col("n_regionkey")).alias("group_id"), F.col("n_name").alias("statement"), status.alias("status"))


FINAL = """final AS (WITH RECURSIVE f AS (SELECT card_id, card_id AS at FROM cards UNION ALL SELECT f.card_id, substr(c.status, 13) FROM f JOIN cards c ON c.card_id = f.at AND c.status LIKE 'merged_into:%')
 SELECT f.card_id, f.at AS final_id FROM f JOIN cards c ON c.card_id = f.at AND c.status NOT LIKE 'merged_into:%')"""


@plan("ans_14_merge_chain", f"WITH RECURSIVE {PROBLEMS}, {CARDS}, {FINAL} SELECT comment_id, card_id, final_id FROM problems LEFT JOIN final USING (card_id)")
def _(t: Tables):
    return an.resolve_cards(t.role("problems").select("comment_id", "card_id"), cards(t))


@plan("ans_15_taxonomy_problems", """SELECT 'statement_too_long' AS problem, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE len(regexp_split_to_array(p_name || ' ' || p_type, '\\s+')) > 2
 UNION ALL SELECT 'unknown_group', CAST(p_partkey AS VARCHAR) FROM part WHERE p_brand = 'Brand#7' UNION ALL SELECT 'bad_status', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size IN (1, 4)
 UNION ALL SELECT 'unknown_merge_target', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size = 2
 UNION ALL SELECT 'too_many_groups', CAST(count(DISTINCT p_brand) AS VARCHAR) FROM part WHERE p_brand <> 'Brand#7' HAVING count(DISTINCT p_brand) > 20
 UNION ALL SELECT 'group_too_large', p_brand FROM part WHERE p_size > 4 GROUP BY p_brand HAVING count(*) > 70""")
def _(t: Tables):
    rows = t.part.select(F.col("p_partkey").cast("string").alias("card_id"), F.col("p_brand").alias("group_id"), F.concat_ws(" ", "p_name", "p_type").alias("statement"), F.expr("case p_size when 1 then 'odd' when 2 then 'merged_into:none' when 3 then 'draft' when 4 then 'merged_into:' else 'approved' end").alias("status"))
    groups = t.part.select(F.col("p_brand").alias("group_id"), F.col("p_brand").alias("group_label")).distinct().filter("group_id <> 'Brand#7'")
    return an.taxonomy_problems(rows, groups, statement_words=2, most_groups=20, most_cards=70)


@plan("ans_16_changed_cards", """SELECT CAST(p_partkey AS VARCHAR) AS card_id, p_brand AS group_id, p_name AS statement, 'approved' AS status FROM part WHERE p_size % 10 = 0""")
def _(t: Tables):
    base = t.part.select(F.col("p_partkey").cast("string").alias("card_id"), F.col("p_brand").alias("group_id"), F.col("p_name").alias("statement"), F.lit("approved").alias("status"), "p_size")
    new = base.withColumn("statement", F.expr("if(p_size % 20 = 0, 'changed', statement)")).filter("p_size % 20 <> 10")
    return an.changed_cards(base, new)


SCOPED = "group_id IS NOT NULL AND group_id <> 'none' AND (card_id IS NULL OR card_id = 'none' OR card_p < 5e-1)"


@plan("ans_17_residue_scope", f"WITH {PROBLEMS} SELECT 'residue' AS scope, count(*) AS n FROM problems WHERE {SCOPED} UNION ALL SELECT 'all', count(*) FROM problems WHERE group_id IS NOT NULL AND group_id <> 'none'")
def _(t: Tables):
    rows = t.role("problems")
    parts = [an.scoped(rows, s).groupBy(F.lit(s).alias("scope")).agg(F.count("*").alias("n")) for s in ("residue", "all")]
    return parts[0].unionByName(parts[1])


NEW = """new AS (SELECT comment_id, CASE WHEN comment_id % 3 = 0 THEN 'c99' ELSE card_id END AS choice, 75e-2 AS p FROM problems WHERE comment_id % 11 <> 0)"""
OUT = f"""{PROBLEMS}, {NEW}, out AS (SELECT comment_id, group_id, card_id, card_p FROM problems WHERE NOT coalesce({SCOPED}, false)
 UNION ALL SELECT comment_id, group_id, choice, p FROM problems JOIN new USING (comment_id) WHERE {SCOPED} AND choice IS NOT NULL)"""


def reassigned(t: Tables):
    rows = t.role("problems").select("comment_id", "group_id", "card_id", "card_p", F.col("card_p").alias("card_confidence"), "verified_p", F.lit("r0").alias("run_id"), F.lit("t0").alias("taxonomy_version"))
    new = rows.filter("comment_id % 11 <> 0").select("comment_id", F.expr("if(comment_id % 3 = 0, 'c99', card_id)").alias("choice"), F.lit(0.75).alias("p"), F.lit(0.6).alias("confidence"))
    return rows, an.reassign(rows, new, "r1", "t1")


@plan("ans_18_reassign", f"WITH {OUT} SELECT comment_id, group_id, card_id, card_p, 't1' AS taxonomy_version FROM out")
def _(t: Tables):
    return reassigned(t)[1].select("comment_id", "group_id", "card_id", "card_p", "taxonomy_version")


@plan("ans_19_reassignment_stats", f"""WITH {OUT}, j AS (SELECT nullif(o.card_id, 'none') AS new_card, nullif(b.card_id, 'none') AS old_card, coalesce(b.group_id IS NOT NULL AND b.group_id <> 'none' AND (b.card_id IS NULL OR b.card_id = 'none' OR b.card_p < 5e-1), false) AS asked
 FROM out o JOIN problems b USING (comment_id)) SELECT count(*) FILTER (NOT asked) AS carried, count(*) FILTER (asked) AS reassigned, count(*) FILTER (asked AND new_card IS NOT NULL) AS moved_to_card, count(*) FILTER (new_card IS DISTINCT FROM old_card) AS changed_card FROM j""")
def _(t: Tables):
    base, new = reassigned(t)
    return an.reassignment_stats(base, new)


@plan("ans_19_added_card_counts", f"WITH {OUT} SELECT 'c99' AS card_id, count(*) AS n FROM out WHERE card_id = 'c99'")
def _(t: Tables):
    _base, new = reassigned(t)
    old = cards(t).select("card_id")
    return an.added_card_counts(new, old, old.unionByName(t.nation.select(F.lit("c99").alias("card_id")).distinct()))


@plan("ans_20_combine_runs", f"WITH {PROBLEMS} SELECT comment_id, card_id, CASE WHEN comment_id % 2 = 0 THEN 'a' ELSE 'b' END AS run_id FROM problems")
def _(t: Tables):
    rows = t.role("problems").select("comment_id", "card_id", F.lit("t1").alias("taxonomy_version"))
    a = rows.filter("comment_id % 2 = 0").withColumn("run_id", F.lit("a"))
    b = rows.filter("comment_id % 2 <> 0").withColumn("run_id", F.lit("b"))
    return an.combine_runs([a, b], "t1").drop("taxonomy_version")


@plan("ans_20_combine_pain", "SELECT doc_id AS comment_id, text AS pain_sentence FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    rows = t.documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("comment_id"), F.col("text").alias("pain_sentence"))
    return an.combine_pain([rows.filter("comment_id % 3 < 2"), rows.filter("comment_id % 3 > 0")])


TOP2 = """top2 AS (SELECT 'c' || lpad(CAST((o_orderkey * 7 + o_custkey) % 25 AS VARCHAR), 2, '0') AS first, 'c' || lpad(CAST((o_orderkey * o_custkey) % 25 AS VARCHAR), 2, '0') AS second FROM orders)"""


@plan("ans_21_merge_pairs", f"""WITH RECURSIVE {CARDS}, {FINAL}, {TOP2}, act AS (SELECT * FROM cards WHERE status = 'approved'), r AS (SELECT x.final_id AS first, y.final_id AS second FROM top2 JOIN final x ON x.card_id = first JOIN final y ON y.card_id = second),
 n AS (SELECT least(first, second) AS card_a, greatest(first, second) AS card_b, count(*) AS n FROM r WHERE first <> second GROUP BY ALL HAVING count(*) >= 40)
 SELECT a.card_id AS card_a, b.card_id AS card_b FROM act a JOIN act b ON a.group_id = b.group_id AND a.card_id < b.card_id
 UNION ALL SELECT card_a, card_b FROM n JOIN act a ON a.card_id = card_a JOIN act b ON b.card_id = card_b WHERE a.group_id <> b.group_id""")
def _(t: Tables):
    top = t.orders.select(F.format_string("c%02d", F.expr("(o_orderkey * 7 + o_custkey) % 25")).alias("first"), F.format_string("c%02d", F.expr("(o_orderkey * o_custkey) % 25")).alias("second"))
    return an.merge_pairs(cards(t), top, 40)


@plan("ans_22_propose_merges", """WITH p AS (SELECT p_partkey, (p_size % 11) / 1e1 AS one, (p_size % 7) / 1e1 AS two FROM part) SELECT 'a' || CAST(p_partkey AS VARCHAR) AS card_a, 'b' AS card_b, round(one + 2 * two, 6) AS expected FROM p WHERE one + 2 * two >= 155e-2""")
def _(t: Tables):
    js = F.to_json(F.struct(F.expr("(p_size % 11) / 1e1").alias("1"), F.expr("(p_size % 7) / 1e1").alias("2")))
    rows = t.part.select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("card_a"), F.lit("b").alias("card_b"), js.alias("probabilities_json"), F.lit(0.0).alias("score"))
    return an.propose_merges(rows, 1.55).select("card_a", "card_b", F.round("expected", 6).alias("expected"))


@plan("ans_23_verification_fill", f"WITH {PROBLEMS} SELECT comment_id, CASE WHEN comment_id % 2 = 0 THEN firsthand_p ELSE verified_p END AS verified_p FROM problems")
def _(t: Tables):
    rows = t.role("problems")
    new = rows.filter("comment_id % 2 = 0").select("comment_id", F.col("firsthand_p").alias("noul"))
    return an.fill_verification(rows.select("comment_id", "verified_p"), new)


PLANT = """plant AS (SELECT comment_id, CASE WHEN comment_id % 5 = 0 THEN NULL WHEN comment_id % 3 = 0 THEN 'c01' ELSE coalesce(nullif(card_id, 'none'), 'c02') END AS card_id FROM problems), got AS (SELECT comment_id, card_id AS g FROM problems WHERE comment_id % 10 <> 7)"""


@plan("ans_24_planted_recovery", f"""WITH {PROBLEMS}, {PLANT}, r AS (SELECT coalesce(card_id, 'decoy') AS need, CASE WHEN card_id IS NULL THEN CASE WHEN g <> 'none' THEN 1e0 ELSE 0e0 END WHEN g = card_id THEN 1e0 ELSE 0e0 END AS hit FROM plant LEFT JOIN got USING (comment_id))
 SELECT need, count(*) AS n, round(avg(hit), 6) AS share FROM r GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(hit), 6) FROM r WHERE need <> 'decoy'""")
def _(t: Tables):
    rows = t.role("problems")
    planted = rows.select("comment_id", F.expr("case when comment_id % 5 = 0 then null when comment_id % 3 = 0 then 'c01' else coalesce(nullif(card_id, 'none'), 'c02') end").alias("card_id"))
    return an.planted_recovery(planted, rows.filter("comment_id % 10 <> 7")).withColumn("share", F.round("share", 6))


@plan("ans_25_item_table", """WITH s AS (SELECT doc_id AS comment_id, CASE WHEN doc_id % 2 = 0 THEN 'pos' ELSE 'neg' END AS phase, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)
 SELECT comment_id, phase, md5(l[comment_id % 3 + 1]) AS pain_key FROM s WHERE comment_id % 4 <> 1 AND comment_id % 7 <> 0 AND l[comment_id % 3 + 1] IS NOT NULL""")
def _(t: Tables):
    return an.item_table(*item_inputs(t))[0].select("comment_id", "phase", F.md5("pain_sentence").alias("pain_key"))


def item_inputs(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("comment_id"), "text")
    answers = docs.select("comment_id", F.lit("pain").alias("question_id"), F.expr("if(comment_id % 7 = 0, 'none', concat('s', comment_id % 3))").alias("choice")).unionByName(
        docs.select("comment_id", F.lit("account").alias("question_id"), F.expr("if(comment_id % 4 = 1, 'other', 'firsthand')").alias("choice"))
    )
    sample = docs.select("comment_id", F.expr("if(comment_id % 2 = 0, 'pos', 'neg')").alias("phase"))
    sentences = docs.select("comment_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("sentences"))
    return answers, sample, sentences


@plan("ans_25_item_counts", """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pos' ELSE 'neg' END AS phase, doc_id % 4 <> 1 AS f, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)
 SELECT phase, count(*) AS n, count(*) FILTER (f) AS n_firsthand, count(*) FILTER (f AND (doc_id % 7 = 0 OR l[doc_id % 3 + 1] IS NULL)) AS n_dropped FROM s GROUP BY 1""")
def _(t: Tables):
    return an.item_table(*item_inputs(t))[1]


CASES = """cases AS (SELECT d.doc_id AS case_id, lang AS category, quality = 1 AS expected, CASE WHEN d.doc_id % 3 = 0 THEN 'x' END AS account, source AS facet,
 CASE d.doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'carded' WHEN 2 THEN 'g1' END AS card_rule FROM documents d JOIN labels USING (doc_id)),
 got AS (SELECT case_id, (case_id * 13) % 100 / 1e2 AS score, CASE WHEN case_id % 2 = 0 THEN 'x' ELSE 'y' END AS account, 'src' || CAST(case_id % 20 AS VARCHAR) AS facet,
 CASE WHEN case_id % 5 = 0 THEN 'none' ELSE 'c1' END AS card_id, 'g' || CAST(case_id % 3 AS VARCHAR) AS group_id FROM cases WHERE case_id % 9 <> 4)"""


def cases(t: Tables):
    base = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("category"), (F.col("quality") == 1).alias("expected"),
        F.expr("case when doc_id % 3 = 0 then 'x' end").alias("account"), F.col("source").alias("facet"),
        F.expr("case doc_id % 4 when 0 then 'none' when 1 then 'carded' when 2 then 'g1' end").alias("card_rule"),
    )
    got = base.filter("case_id % 9 <> 4").select(
        "case_id", F.expr("(case_id * 13) % 100 / 1e2").alias("score"), F.expr("if(case_id % 2 = 0, 'x', 'y')").alias("account"),
        F.expr("concat('src', case_id % 20)").alias("facet"), F.expr("if(case_id % 5 = 0, 'none', 'c1')").alias("card_id"), F.expr("concat('g', case_id % 3)").alias("group_id"),
    )
    return base, got


@plan("ans_26_benchmark_confusion", f"""WITH {CASES}, r AS (SELECT category, expected AS y, coalesce(score >= threshold, false) AS s, threshold FROM cases LEFT JOIN (SELECT case_id, score FROM got) USING (case_id), (SELECT unnest([3e-1, 5e-1, 7e-1]) AS threshold))
 SELECT threshold, coalesce(category, 'all') AS category, count(*) FILTER (y AND s) AS tp, count(*) FILTER (NOT y AND s) AS fp, count(*) FILTER (y AND NOT s) AS fn, count(*) FILTER (NOT y AND NOT s) AS tn FROM r GROUP BY GROUPING SETS ((threshold), (threshold, category))""")
def _(t: Tables):
    return an.benchmark_scores(*cases(t), [0.3, 0.5, 0.7])


@plan("ans_26_benchmark_choices", f"""WITH {CASES} SELECT 'account' AS question, count(*) AS n, count(*) FILTER (c.account = g.account) AS n_right FROM cases c LEFT JOIN got g USING (case_id) WHERE c.account IS NOT NULL
 UNION ALL SELECT 'facet', count(*), count(*) FILTER (c.facet = g.facet) FROM cases c LEFT JOIN got g USING (case_id)""")
def _(t: Tables):
    return an.benchmark_choices(*cases(t), ["account", "facet"])


@plan("ans_26_benchmark_cards", f"""WITH {CASES}, r AS (SELECT card_rule, coalesce(card_id <> 'none', false) AS real, group_id FROM cases LEFT JOIN (SELECT case_id, card_id, group_id FROM got) USING (case_id) WHERE card_rule IS NOT NULL)
 SELECT CASE WHEN card_rule IN ('none', 'carded') THEN card_rule ELSE 'group' END AS rule, count(*) AS n, count(*) FILTER (CASE card_rule WHEN 'none' THEN NOT real WHEN 'carded' THEN real ELSE real AND group_id = card_rule END) AS n_right FROM r GROUP BY 1""")
def _(t: Tables):
    return an.benchmark_cards(*cases(t))


@plan("ans_26_benchmark_misses", f"WITH {CASES} SELECT case_id, category, expected, score FROM cases LEFT JOIN (SELECT case_id, score FROM got) USING (case_id) WHERE coalesce(score >= 5e-1, false) <> expected")
def _(t: Tables):
    return an.benchmark_misses(*cases(t), 0.5)


@plan("ans_27_injected_accuracy", f"""WITH {PROBLEMS}, r AS (SELECT p.role AS case_type, p.comment_id % 2 = 0 AS expected, a.firsthand_p AS noul FROM problems p LEFT JOIN (SELECT comment_id, firsthand_p FROM problems WHERE comment_id % 6 <> 1) a USING (comment_id))
 SELECT coalesce(case_type, 'all') AS case_type, count(*) AS n, round(avg(CASE WHEN coalesce((noul >= 5e-1) = expected, false) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM r GROUP BY ROLLUP (case_type)""")
def _(t: Tables):
    rows = t.role("problems")
    injected = rows.select("comment_id", F.col("role").alias("case_type"), (F.col("comment_id") % 2 == 0).alias("expected"))
    answers = rows.filter("comment_id % 6 <> 1").select("comment_id", F.col("firsthand_p").alias("noul"))
    return an.injected_accuracy(injected, answers).withColumn("accuracy", F.round("accuracy", 6))


@plan("ans_28_positive_rates", f"""WITH {PROBLEMS}, r AS (SELECT stratum, CASE WHEN comment_id % 4 <> 0 THEN firsthand_p END AS p FROM problems)
 SELECT stratum, count(*) AS n_sampled, count(p) AS n_screened, count(*) FILTER (p >= 7e-1) AS n_positive, round(count(*) FILTER (p >= 7e-1) / nullif(count(p), 0), 6) AS rate FROM r GROUP BY 1""")
def _(t: Tables):
    rows = t.role("problems")
    return an.positive_rates(rows, rows.filter("comment_id % 4 <> 0"), 0.7).withColumn("rate", F.round("rate", 6))


@plan("ans_29_union_taxonomy", f"WITH {PROBLEMS}, used AS (SELECT card_id, count(*) AS n FROM problems GROUP BY 1) SELECT u.card_id, n FROM used u WHERE card_id IN (SELECT 'c' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') FROM nation)")
def _(t: Tables):
    base = cards(t).filter("group_id <> 'g3'").select("card_id")
    planted = cards(t).filter("group_id = 'g3'").select("card_id")
    used = t.role("problems").groupBy("card_id").agg(F.count("*").alias("n"))
    return an.union_taxonomy(base, planted).join(used, "card_id")


@plan("ans_30_launch_items", r"""SELECT doc_id AS story_id, source AS title, rtrim(substr(source || coalesce(' ' || nullif(array_to_string(s[1:3], ' '), ''), ''), 1, 300)) AS snippet FROM (SELECT doc_id, source,
 list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s
 FROM documents)""")
def _(t: Tables):
    stories = t.documents.select(F.col("doc_id").alias("story_id"), F.concat(F.lit("Show HN: "), F.col("source")).alias("title"), F.col("text").alias("text_norm"))
    return an.launch_items(stories.select("story_id"), stories)


@plan("ans_31_label_frame", f"WITH {PROBLEMS}, {ANSWERS} SELECT comment_id, weight, noul AS score FROM problems JOIN (SELECT comment_id, noul FROM last WHERE question_id = 'click' AND noul IS NOT NULL) USING (comment_id)")
def _(t: Tables):
    return an.label_frame(t.role("problems"), last(t), "click")
