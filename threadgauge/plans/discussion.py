"""Reply, mention, term and bundle plans (REP, MEN, TRM, BUN, and TXT-11 to 14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.operators import answers as an
from threadgauge.operators import discussion as ds
from threadgauge.plans.answers import CARDS, FINAL, cards
from threadgauge.plans.estimates import R, boot, ci, rounded
from threadgauge.plans.registry import Tables, plan
from threadgauge.plans.roles import cte
from threadgauge.session import cut_lineage

PROBLEMS = f"problems AS ({cte('problems')})"
REPLIES = """replies AS (SELECT event_id + 10000000 AS id, (event_id * 7) % 900 AS parent_id, epoch(date_trunc('second', ts))::BIGINT AS time, CASE WHEN event_id % 19 = 0 THEN '  ' ELSE event_type || ' fix ' || CAST(event_id AS VARCHAR) END AS text,
 'u' || CAST((event_id * 7) % 900 % (997 - event_id % 2) AS VARCHAR) AS author, CASE WHEN event_id % 23 = 0 THEN 'dead' ELSE 'ok' END AS state FROM events)"""


def replies(t: Tables):
    return t.events.select(
        (F.col("event_id") + 10_000_000).alias("id"), ((F.col("event_id") * 7) % 900).alias("parent_id"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time"),
        F.expr("case when event_id % 19 = 0 then '  ' else concat(event_type, ' fix ', event_id) end").alias("text"),
        F.expr("concat('u', (event_id * 7) % 900 % (997 - event_id % 2))").alias("author"),
        F.expr("case when event_id % 23 = 0 then 'dead' else 'ok' end").alias("state"),
    )


def problems(t: Tables):
    return t.role("problems").withColumn("author", F.expr("case when comment_id % 41 = 0 then null when comment_id % 5 = 0 then concat('u', comment_id % 997) else concat('v', comment_id % 997) end"))


PAIRS = f"""{PROBLEMS}, {REPLIES}, pa AS (SELECT comment_id AS problem_id, CASE WHEN comment_id % 41 = 0 THEN NULL WHEN comment_id % 5 = 0 THEN 'u' || CAST(comment_id % 997 AS VARCHAR) ELSE 'v' || CAST(comment_id % 997 AS VARCHAR) END AS author FROM problems),
 pairs AS (SELECT id AS reply_id, problem_id, time, text, CASE WHEN coalesce(pa.author = r.author, false) THEN 'followup' ELSE 'reply' END AS kind FROM replies r JOIN pa ON pa.problem_id = r.parent_id WHERE state = 'ok' AND trim(text) <> ''
 QUALIFY row_number() OVER (PARTITION BY problem_id, kind ORDER BY time, id) <= 5)"""


def pairs(t: Tables):
    return ds.reply_pairs(problems(t).select(F.col("comment_id").alias("problem_id"), "author"), replies(t))


@plan("rep_01_reply_pairs", f"WITH {PAIRS} SELECT reply_id, problem_id, kind, time, text FROM pairs")
def _(t: Tables):
    return pairs(t)


@plan("rep_02_problem_selection", f"WITH RECURSIVE {PROBLEMS}, {CARDS}, {FINAL}, q AS (SELECT comment_id, final_id AS card_id FROM problems JOIN final USING (card_id) WHERE card_p >= 5e-1) SELECT * FROM q WHERE card_id IN (SELECT card_id FROM q GROUP BY 1 ORDER BY count(*) DESC, card_id LIMIT 5)")
def _(t: Tables):
    return ds.select_problems(t.role("problems"), an.merge_map(cards(t)), 5)


@plan("rep_03_reply_items", f"WITH {PAIRS} SELECT reply_id, problem_id, kind, time, md5(substr(text, 1, 1200)) AS text_key, 'pain ' || CAST(problem_id AS VARCHAR) AS pain_sentence FROM pairs WHERE problem_id % 3 > 0")
def _(t: Tables):
    sentences = problems(t).filter("comment_id % 3 > 0").select("comment_id", F.concat(F.lit("pain "), F.col("comment_id").cast("string")).alias("pain_sentence"))
    return ds.reply_items(pairs(t), sentences, ds.TEXT_CAP).withColumn("text_key", F.md5("text")).drop("text")


VERDICT = "CASE reply_id % 4 WHEN 0 THEN 'solved' WHEN 1 THEN 'still_unsolved' WHEN 2 THEN 'unclear' END"


def reply_answers(t: Tables):
    rows = pairs(t)
    noul = rows.select(F.col("reply_id").alias("comment_id"), F.lit("names_solution").alias("question_id"), F.expr("(reply_id % 11) / 1e1").alias("noul"), F.lit(None).cast("string").alias("choice"))
    kind = rows.select(F.col("reply_id").alias("comment_id"), F.lit("solution_kind").alias("question_id"), F.lit(None).cast("double").alias("noul"), F.expr("case reply_id % 3 when 0 then 'tool' when 1 then 'none' else 'habit' end").alias("choice"))
    says = rows.filter("kind = 'followup'").select(F.col("reply_id").alias("comment_id"), F.lit("author_says_solved").alias("question_id"), F.lit(None).cast("double").alias("noul"), F.expr(VERDICT).alias("choice"))
    return noul.unionByName(kind).unionByName(says), rows


@plan("rep_04_unsolved", f"""WITH {PAIRS}, i AS (SELECT *, kind = 'reply' AND reply_id % 11 >= 5 AS named, {VERDICT} AS verdict FROM pairs), g AS (SELECT problem_id AS comment_id, count(*) FILTER (kind = 'reply') AS n_replies, bool_or(named) AS any_solution_named,
 coalesce(string_agg(DISTINCT CASE reply_id % 3 WHEN 0 THEN 'tool' WHEN 2 THEN 'habit' END, ',' ORDER BY CASE reply_id % 3 WHEN 0 THEN 'tool' WHEN 2 THEN 'habit' END) FILTER (named AND reply_id % 3 <> 1), '') AS solution_kinds,
 CASE WHEN bool_or(kind = 'followup') THEN coalesce(arg_max(verdict, time * 100000000 + reply_id) FILTER (kind = 'followup' AND verdict <> 'unclear'), 'unclear') END AS author_says_solved FROM i GROUP BY 1)
 SELECT *, coalesce(author_says_solved, '') <> 'solved' AND (NOT any_solution_named OR coalesce(author_says_solved, '') = 'still_unsolved') AS unsolved FROM g""")
def _(t: Tables):
    answers, rows = reply_answers(t)
    return ds.unsolved_by_problem(answers, rows).drop("solved_p").withColumn("solution_kinds", F.array_join("solution_kinds", ","))


def tools(t: Tables):
    """Configured dictionary: words that occur in the corpus, with aliases and case rules."""
    rows = [("Tion", ["tionan", "edion"], "suffix", False), ("Of", [], "short", False), ("The", ["thth"], "article", True), ("Nicht", ["nichts"], "german", False), ("Que", ["quela"], "french", False)]
    return t.spark.createDataFrame(rows, "name string, aliases array<string>, category string, name_case boolean")


TERMS = """terms AS (SELECT * FROM (VALUES ('tion', 'Tion', false), ('tionan', 'Tion', false), ('edion', 'Tion', false), ('Of', 'Of', true), ('The', 'The', true), ('thth', 'The', false), ('nicht', 'Nicht', false), ('nichts', 'Nicht', false), ('Que', 'Que', true), ('quela', 'Que', false)) v(term, tool, exact))"""


def mention_sql(src: str, keys: str) -> str:
    return f"SELECT DISTINCT {keys}, tool FROM (SELECT {keys}, unnest(regexp_extract_all(text, '[\\pL\\pM\\pN_]+')) AS w FROM {src}) JOIN terms ON (exact AND w = term) OR (NOT exact AND lower(w) = term)"


@plan("txt_11_dictionary_mentions", f"WITH {TERMS}, d AS (SELECT doc_id, text FROM documents) {mention_sql('d', 'doc_id')}")
def _(t: Tables):
    return ds.find_mentions(t.documents.select("doc_id", "text"), tools(t))


MENTIONS = f"""{TERMS}, {PROBLEMS}, docs AS (SELECT doc_id, text, source, lang FROM documents), pr AS (SELECT doc_id AS problem_id, 'c' || CAST(doc_id % 7 AS VARCHAR) AS card_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 120 END AS story_id, lang AS stratum, doc_id AS time, text FROM docs WHERE doc_id % 3 = 0),
 rp AS (SELECT doc_id AS reply_id, doc_id - doc_id % 3 AS problem_id, CASE WHEN doc_id % 3 = 1 THEN 'reply' ELSE 'followup' END AS kind, doc_id AS time, text, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 110 END AS story_id FROM docs WHERE doc_id % 3 > 0),
 al AS (SELECT problem_id AS comment_id, problem_id, 'problem' AS kind, time, text FROM pr UNION ALL SELECT reply_id, problem_id, kind, time, text FROM rp), fd AS ({mention_sql('al', 'comment_id, problem_id, kind, time')}),
 mentions AS (SELECT (CAST('0x' || substr(sha256(CAST(comment_id AS VARCHAR) || '|' || tool), 1, 1) AS BIGINT) & 7) * 1152921504606846976 + CAST('0x' || substr(sha256(CAST(comment_id AS VARCHAR) || '|' || tool), 2, 15) AS BIGINT) AS hit_id,
 comment_id, f.problem_id, card_id, coalesce(rp.story_id, pr.story_id) AS story_id, stratum, f.kind, tool, f.time FROM fd f JOIN pr USING (problem_id) LEFT JOIN rp ON rp.reply_id = f.comment_id)"""


def mention_inputs(t: Tables):
    docs = t.documents
    pr = docs.filter("doc_id % 3 = 0").select(
        F.col("doc_id").alias("problem_id"), F.expr("concat('c', doc_id % 7)").alias("card_id"), F.expr("case when doc_id % 9 = 0 then null else doc_id % 120 end").alias("story_id"),
        F.col("lang").alias("stratum"), F.col("doc_id").alias("time"), "text",
    )
    rp = docs.filter("doc_id % 3 > 0").select(
        F.col("doc_id").alias("reply_id"), F.expr("doc_id - doc_id % 3").alias("problem_id"), F.expr("if(doc_id % 3 = 1, 'reply', 'followup')").alias("kind"),
        F.col("doc_id").alias("time"), "text", F.expr("case when doc_id % 4 = 0 then null else doc_id % 110 end").alias("story_id"),
    )
    return pr, rp


@plan("men_01_collect", f"WITH {MENTIONS} SELECT * FROM mentions")
def _(t: Tables):
    return ds.collect_mentions(*mention_inputs(t), tools(t))


CONFIRM = "ok AS (SELECT hit_id FROM mentions WHERE kind <> 'problem' AND hit_id % 10 >= 4)"


def confirmed(t: Tables):
    # Written once: mentions are few beside the texts, and every reader would search the texts again.
    mentions = cut_lineage(ds.collect_mentions(*mention_inputs(t), tools(t)))
    answers = mentions.filter("kind <> 'problem'").select(F.col("hit_id").alias("comment_id"), F.lit("recommends").alias("question_id"), F.expr("hit_id % 10 / 1e1 + 0.1d").alias("noul"))
    return mentions, ds.confirmed_hits(answers)


@plan("men_02_confirmed_hits", f"WITH {MENTIONS}, {CONFIRM} SELECT hit_id FROM ok")
def _(t: Tables):
    return confirmed(t)[1]


COUNTED = f"{CONFIRM}, cn AS (SELECT m.*, kind = 'problem' AS is_complaint, kind <> 'problem' AND hit_id IN (SELECT hit_id FROM ok) AS is_fix FROM mentions m WHERE kind = 'problem' OR hit_id IN (SELECT hit_id FROM ok))"


@plan("men_03_tool_tally", f"""WITH {MENTIONS}, {COUNTED}, tf AS (SELECT tool, coalesce(story_id, -comment_id) AS cluster, arg_min(stratum, comment_id) AS stratum, max(is_fix::INT) AS f, max(is_complaint::INT) AS c FROM cn GROUP BY 1, 2), ts AS (SELECT tool || '~' || stratum AS stratum, cluster, tool, f AS a, f + c AS d FROM tf),
 {boot('b', 'ts', ['tool'], ['a', 'd'])}, s AS ({ci('a / nullif(d, 0)', 'b', 'tool, ')})
 SELECT tool, CASE tool WHEN 'Tion' THEN 'suffix' WHEN 'Of' THEN 'short' WHEN 'The' THEN 'article' WHEN 'Nicht' THEN 'german' ELSE 'french' END AS category, count(DISTINCT story_id) AS threads, count(DISTINCT story_id) FILTER (is_fix) AS fix_threads, count(DISTINCT story_id) FILTER (is_complaint) AS complaint_threads,
 any_value(est) AS fix_share, any_value(lo95) AS lo95, any_value(hi95) AS hi95, count(DISTINCT story_id) < 10 AS sparse FROM cn JOIN s USING (tool) GROUP BY 1""")
def _(t: Tables):
    mentions, ok = confirmed(t)
    return rounded(ds.tool_tally(mentions, ok, tools(t), n_rep=R), "fix_share", "lo95", "hi95")


CARD_TALLY = "tl AS (SELECT card_id, CASE WHEN is_complaint THEN 'blamed' ELSE 'fixes' END AS side, tool, count(DISTINCT coalesce(CAST(story_id AS VARCHAR), '-')) AS threads FROM cn GROUP BY ALL)"


@plan("men_04_card_tool_tally", f"WITH {MENTIONS}, {COUNTED}, {CARD_TALLY} SELECT card_id, side, string_agg(tool || ':' || CAST(threads AS VARCHAR), ',' ORDER BY threads DESC, tool) AS tools FROM tl GROUP BY ALL")
def _(t: Tables):
    return ds.listed_tools(ds.card_tool_tally(*confirmed(t))).withColumn("tools", F.array_join("tools", ","))


@plan("men_05_rekeyed_tally", f"WITH {MENTIONS}, {COUNTED}, {CARD_TALLY} SELECT CASE WHEN card_id IN ('c1', 'c2') THEN 'c0' ELSE card_id END AS card_id, side, tool, CAST(sum(threads) AS BIGINT) AS threads FROM tl GROUP BY ALL")
def _(t: Tables):
    tally = cut_lineage(ds.card_tool_tally(*confirmed(t)))
    final = tally.select("card_id").distinct().withColumn("final_id", F.expr("if(card_id in ('c1', 'c2'), 'c0', card_id)"))
    return ds.rekey_tally(tally, final)


STOP_SQL = ", ".join(f"'{w}'" for w in ds.STOP)
TOKEN_SQL = f"list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]*'), lambda t: regexp_extract(t, '^.*(?:\\+\\+|[a-z0-9#])')), lambda t: length(t) BETWEEN 3 AND 30 AND t NOT IN ({STOP_SQL}))"


@plan("txt_12_terms", f"WITH k AS (SELECT doc_id, {TOKEN_SQL} AS t FROM documents), b AS (SELECT doc_id, unnest(t) AS term FROM k UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM k) SELECT term, count(*) AS n FROM b GROUP BY 1")
def _(t: Tables):
    return t.documents.select(ds.tokens(F.col("text")).alias("t")).select(F.explode(ds.terms(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@plan("txt_13_lexical_exclusion", rf"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[\s,;]+')) AS term FROM documents) SELECT term, NOT (regexp_matches(term, '\d{{4,}}') OR regexp_matches(term, '(?:https?|ftp|www)\.|^www$|^(?:https?|ftp)$|\b[\w-]+\.(?:{ds.TLDS})\b') OR regexp_matches(term, '\S+@\S+') OR regexp_matches(term, '(?:^|\s)@\w+')) AS ok FROM w""")
def _(t: Tables):
    words = t.documents.select(F.explode(F.split(F.lower("text"), r"[\s,;]+")).alias("term")).distinct()
    return words.select("term", ds.lexical_ok(F.col("term")).alias("ok"))


VOCAB = f"vocab AS (SELECT DISTINCT unnest({TOKEN_SQL}) AS term FROM documents UNION SELECT DISTINCT p_name || 's' FROM part UNION SELECT DISTINCT p_name FROM part)"


@plan("txt_14_plural_folding", f"WITH {VOCAB} SELECT term, substr(term, 1, length(term) - 1) AS canon FROM vocab WHERE length(split_part(term, ' ', -1)) > 4 AND term LIKE '%s' AND term NOT LIKE '%ss' AND substr(term, 1, length(term) - 1) IN (SELECT term FROM vocab)")
def _(t: Tables):
    vocab = t.documents.select(F.explode(ds.tokens(F.col("text"))).alias("term"))
    names = t.part.select(F.explode(F.array("p_name", F.concat("p_name", F.lit("s")))).alias("term"))
    return ds.plural_map(vocab.union(names).distinct())


GROUPED = "gd AS (SELECT doc_id AS comment_id, lang AS group_id, CASE WHEN doc_id % 31 = 0 THEN 'that' ELSE source || CAST(doc_id % 40 AS VARCHAR) END AS author, text FROM documents)"


def grouped_docs(t: Tables):
    return t.documents.select(F.col("doc_id").alias("comment_id"), F.col("lang").alias("group_id"), F.expr("if(doc_id % 31 = 0, 'nicht', concat(source, doc_id % 40))").alias("author"), "text")


TSTATS = f"""{GROUPED.replace("'that'", "'nicht'")}, k AS (SELECT comment_id, group_id, author, {TOKEN_SQL} AS t FROM gd), oc0 AS (SELECT comment_id, group_id, author, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM k),
 oc AS (SELECT comment_id, group_id, author, term, count(*) AS c FROM oc0 GROUP BY ALL), cp AS (SELECT term, sum(c) AS c FROM oc GROUP BY 1),
 cm AS (SELECT cp.term, coalesce(s.term, cp.term) AS canon, cp.c FROM cp LEFT JOIN cp s ON length(split_part(cp.term, ' ', -1)) > 4 AND cp.term LIKE '%s' AND cp.term NOT LIKE '%ss' AND s.term = substr(cp.term, 1, length(cp.term) - 1)),
 wd AS (SELECT canon, sum(c) AS corpus, arg_min(term, (-c, term)) AS display, list_distinct(flatten(list(string_split(term, ' ')))) AS words FROM cm GROUP BY 1),
 st AS (SELECT group_id, canon, sum(oc.c) AS cnt, count(*) AS n_comments, count(DISTINCT author) AS n_authors FROM oc JOIN cm USING (term) GROUP BY ALL),
 an AS (SELECT st.*, corpus, display FROM st JOIN wd USING (canon) WHERE n_comments >= 20 AND n_authors >= 10 AND NOT list_has_any(words, ['nicht']) AND NOT list_has_any(words, (SELECT list(DISTINCT author) FROM gd))
 AND NOT regexp_matches(display, '\\d{{4,}}') AND NOT regexp_matches(display, '(?:https?|ftp|www)\\.|^www$|^(?:https?|ftp)$|\\b[\\w-]+\\.(?:{ds.TLDS})\\b'))"""


@plan("trm_02_anonymous_terms", f"WITH {TSTATS} SELECT group_id, canon, display, CAST(cnt AS BIGINT) AS cnt, n_comments, n_authors FROM an")
def _(t: Tables):
    rows = grouped_docs(t)
    stats, words, _totals = ds.term_stats(rows, least=20)
    out = ds.anonymous_terms(stats, words, rows)
    return out.select("group_id", "canon", "display", "cnt", "n_comments", "n_authors")


# Complementary error function as a Chebyshev fit (relative error below 1.2e-7), enough to apply the q < 0.05 cut.
ERFC = "(1 / (1 + 5e-1 * x)) * exp(-x * x - 1.26551223 + (1 / (1 + 5e-1 * x)) * (1.00002368 + (1 / (1 + 5e-1 * x)) * (0.37409196 + (1 / (1 + 5e-1 * x)) * (0.09678418 + (1 / (1 + 5e-1 * x)) * (-0.18628806 + (1 / (1 + 5e-1 * x)) * (0.27886807 + (1 / (1 + 5e-1 * x)) * (-1.13520398 + (1 / (1 + 5e-1 * x)) * (1.48851587 + (1 / (1 + 5e-1 * x)) * (-0.82215223 + (1 / (1 + 5e-1 * x)) * 0.17087277)))))))))"


@plan("trm_01_distinctive_terms", f"""WITH {TSTATS}, gt AS (SELECT group_id, sum(cnt) AS n FROM st GROUP BY 1), a1 AS (SELECT an.*, n, 5e2 * corpus / (SELECT sum(cnt) FROM st) AS alpha, corpus - cnt AS rest, (SELECT sum(cnt) FROM st) AS whole FROM an JOIN gt USING (group_id)),
 a2 AS (SELECT *, ln((cnt + alpha) / (n + 500 - cnt - alpha)) - ln((rest + alpha) / (whole - n + 500 - rest - alpha)) AS delta, sqrt(1 / (cnt + alpha) + 1 / (rest + alpha)) AS sd FROM a1), a3 AS (SELECT *, delta / sd AS z, abs(delta / sd) / sqrt(2) AS x FROM a2),
 a4 AS (SELECT *, {ERFC} AS p FROM a3), a5 AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM a4), a6 AS (SELECT *, min(p * m / r) OVER (ORDER BY p DESC, r DESC ROWS UNBOUNDED PRECEDING) AS q FROM a5)
 SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY z DESC, display) AS position, display AS term, round(z, 6) AS z, round(delta - 1.96::DOUBLE * sd, 6) AS lo95, round(delta + 1.96::DOUBLE * sd, 6) AS hi95, n_comments, n_authors FROM a6 WHERE q < 5e-2 AND z > 0 QUALIFY position <= 8""")
def _(t: Tables):
    return rounded(ds.distinctive_terms(grouped_docs(t)), "z", "lo95", "hi95")


PAIR_ROLE = "sp AS (SELECT 'c' || lpad(CAST((o_orderkey * 7 + o_custkey) % 25 AS VARCHAR), 2, '0') AS card_a, 'c' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') AS card_b, (CAST(floor(o_totalprice) AS BIGINT) % 2001) / 1e3 * CASE WHEN (o_orderkey * 7 + o_custkey) % 5 = o_custkey % 5 THEN 1 ELSE 5e-1 END AS expected FROM orders)"


def pair_scores(t: Tables):
    return t.orders.select(
        F.format_string("c%02d", F.expr("(o_orderkey * 7 + o_custkey) % 25")).alias("card_a"), F.format_string("c%02d", F.expr("o_custkey % 25")).alias("card_b"),
        F.expr("(cast(floor(o_totalprice) as bigint) % 2001) / 1e3 * case when (o_orderkey * 7 + o_custkey) % 5 = o_custkey % 5 then 1d else 0.5d end").alias("expected"),
    )


SCORES = f"{PAIR_ROLE}, ps AS (SELECT least(card_a, card_b) AS a, greatest(card_a, card_b) AS b, max(expected) AS score FROM sp WHERE card_a <> card_b GROUP BY ALL)"


@plan("bun_01_scored_pairs", f"WITH {SCORES} SELECT a, b, round(score, 9) AS score FROM ps")
def _(t: Tables):
    return rounded(ds.scored_pairs(pair_scores(t)), "score", digits=9)


@plan("bun_01_edges", f"""WITH {SCORES}, e AS (SELECT a AS card, b AS other, score FROM ps UNION ALL SELECT b, a, score FROM ps), k AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY score DESC, other) AS r FROM e)
 SELECT DISTINCT least(card, other) AS a, greatest(card, other) AS b, round(score, 9) AS score FROM k WHERE r <= 8 AND score >= 1""")
def _(t: Tables):
    return rounded(ds.bundle_edges(ds.scored_pairs(pair_scores(t))), "score", digits=9)


@plan("bun_02_bundles")
def _(t: Tables):
    cards_dim = t.nation.select(F.format_string("c%02d", "n_nationkey").alias("card_id"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("group_id"))
    out = ds.bundles(cards_dim, ds.scored_pairs(pair_scores(t)))
    return out.withColumn("cards", F.array_join("cards", ","))
