"""Text plans (TXT, JSN) over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.functions import jsonx as jx
from threadgauge.functions import text as tx
from threadgauge.functions.hashing import sha_id15, sha_id63
from threadgauge.plans.registry import Tables, plan
from threadgauge.plans.roles import with_roles

# RE2 has ASCII word boundaries: map accented letters to a letter, keep lengths.
ASCII = "regexp_replace(replace({t}, '’', ''''), '[À-ɏ]', 'x', 'g')"
PERSON, PAIN = tx.DESIGN_PERSON, tx.DESIGN_PAIN.replace("'", "''").replace("[''’]", "''")
NEAR = rf"(?is)\b(?:{PERSON})\b.{{0,80}}?\b(?:{PAIN})\b|\b(?:{PAIN})\b.{{0,80}}?\b(?:{PERSON})\b"
PAIN_SQL = f"regexp_matches(regexp_replace({ASCII.format(t='text')}, '(?i)\\bi\\.e\\.', ' ', 'g'), '{NEAR}')"
BP, BT = tx.BASELINE_PERSON, tx.BASELINE_PAIN.replace("'", "''")
KEYWORD_SQL = (
    f"CASE WHEN regexp_matches({ASCII.format(t='text')}, '(?i)\\b(?:{BP})\\b[^\\n]{{0,60}}?\\b(?:{BT})|\\b(?:{BT})[^\\n]{{0,60}}?\\b(?:{BP})\\b')"
    " THEN 1e0 ELSE 0e0 END"
)
WORDS_SQL = "len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> ''))"
TEXTS = """texts AS (SELECT doc_id AS id, text FROM documents UNION ALL
 SELECT 10000000 + doc_id, CASE doc_id % 6 WHEN 0 THEN 'I can''t export this, ' || text WHEN 1 THEN 'Nobody here. ' || text || ' it broke'
 WHEN 2 THEN text || ' We spent two days on it' WHEN 3 THEN 'broken, i.e. it fails ' || text WHEN 4 THEN 'the outage hit ' || text || ' us' ELSE '' END FROM documents)"""


def texts(t: Tables):
    extra = F.expr(
        "case doc_id % 6 when 0 then concat('I can\\'t export this, ', text) when 1 then concat('Nobody here. ', text, ' it broke')"
        " when 2 then concat(text, ' We spent two days on it') when 3 then concat('broken, i.e. it fails ', text)"
        " when 4 then concat('the outage hit ', text, ' us') else '' end"
    )
    docs = t.documents
    return docs.select(F.col("doc_id").alias("id"), "text").unionByName(
        docs.select((F.col("doc_id") + 10_000_000).alias("id"), extra.alias("text"))
    )


@plan("txt_01_html_to_text", r"""WITH a AS (SELECT page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') AS h FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(h, '<![a-z][^>]*>', '', 'gi'), '<(?:p|pre)(?:\s[^>]*)?/?>', chr(10) || chr(10), 'gi') AS h FROM a),
 c AS (SELECT page_id, regexp_replace(h, '</?[a-z][^>]*>', '', 'gi') AS h FROM b),
 d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS h FROM c)
 SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(h, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+', ''), '[\s\x{A0}]+$', '')) AS text_key FROM d""")
def _(t: Tables):
    return t.pages.select("page_id", F.md5(tx.html_to_text(F.col("html"))).alias("text_key"))


@plan("txt_02_sentence_split", r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)),
 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS piece, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)),
 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 1) AS i FROM documents),
 g AS (SELECT doc_id, i, piece, sum(CASE WHEN regexp_matches(lower(prev), '(e\.g\.|i\.e\.|etc\.|vs\.|cf\.)$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k
 FROM (SELECT *, coalesce(lag(piece) OVER (PARTITION BY doc_id ORDER BY i), '') AS prev FROM s)),
 m AS (SELECT doc_id, k, string_agg(piece, ' ' ORDER BY i) AS sentence FROM g GROUP BY ALL),
 l AS (SELECT doc_id, least(k, 255) AS k, string_agg(sentence, ' ' ORDER BY k) AS sentence FROM m GROUP BY doc_id, least(k, 255))
 SELECT doc_id, CAST(k - 1 AS BIGINT) AS i, md5(sentence) AS sentence_key FROM l""")
def _(t: Tables):
    parts = t.documents.select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("i", "s"))
    return parts.select("doc_id", F.col("i").cast("bigint").alias("i"), F.md5("s").alias("sentence_key"))


@plan("txt_03_04_hash_and_words", f"SELECT doc_id, sha256(text) AS text_sha256, {WORDS_SQL.format(t='text')} AS word_count FROM documents")
def _(t: Tables):
    text = F.col("text")
    return t.documents.select("doc_id", tx.text_hash(text).alias("text_sha256"), tx.word_count(text).alias("word_count"))


def _stop_sql(lang: str) -> str:
    listed = ", ".join(f"'{w}'" for w in tx.STOP_WORDS[lang].split())
    return f"len(list_filter(w, lambda x: x IN ({listed}))) AS {lang}"


@plan("txt_05_language_label", rf"""WITH k AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(regexp_replace(text, 'https?://\S+', ' ', 'g'), '\s+'), lambda x: x <> ''),
 lambda x: regexp_replace(lower(x), '^[^\pL\pM\pN_]+|[^\pL\pM\pN_]+$', '', 'g')) AS w FROM documents),
 h AS (SELECT doc_id, len(w) AS n, {', '.join(_stop_sql(c) for c in tx.STOP_WORDS)} FROM k)
 SELECT doc_id, CASE WHEN n < 5 OR de + en + es + fr = 0 THEN 'und' WHEN en >= 0.2::DOUBLE * (de + en + es + fr) THEN 'en'
 WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS lang_label FROM h""")
def _(t: Tables):
    return tx.language_labels(t.documents, "doc_id", "text")


@plan("txt_06_pain_flag", f"WITH {TEXTS} SELECT id, {PAIN_SQL} AS pain FROM texts")
def _(t: Tables):
    return texts(t).select("id", tx.pain_flag(F.col("text")).alias("pain"))


BIN = "CASE WHEN {n} < 15 THEN 'L0' WHEN {n} < 60 THEN 'L1' WHEN {n} < 200 THEN 'L2' ELSE 'L3' END"


@plan("txt_07_length_bin", f"SELECT bin, count(*) AS n FROM (SELECT {BIN.format(n=WORDS_SQL.format(t='text'))} AS bin FROM documents) GROUP BY bin")
def _(t: Tables):
    return t.documents.select(tx.length_bin(tx.word_count(F.col("text"))).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@plan("txt_08_09_thread_group_and_half", """SELECT CASE WHEN kind IN ('ask_hn','tell_hn') THEN 'ask' WHEN kind IN ('show_hn','launch_hn') THEN 'show' WHEN kind = 'story' THEN 'story' ELSE 'other' END AS thread_group,
 CASE WHEN m <= 6 THEN 'H1' ELSE 'H2' END AS half, count(*) AS n FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'ask_hn' WHEN 1 THEN 'show_hn' WHEN 2 THEN 'launch_hn' WHEN 3 THEN 'tell_hn' WHEN 4 THEN 'story' END AS kind,
 month(o_orderdate) AS m FROM orders) GROUP BY ALL""")
def _(t: Tables):
    kind = F.expr("case o_orderkey % 6 when 0 then 'ask_hn' when 1 then 'show_hn' when 2 then 'launch_hn' when 3 then 'tell_hn' when 4 then 'story' end")
    period = F.format_string("P%02d", F.month("o_orderdate"))
    rows = t.orders.select(tx.thread_group(kind).alias("thread_group"), tx.half_year(period).alias("half"))
    return rows.groupBy("thread_group", "half").agg(F.count("*").alias("n"))


@plan("txt_10_keyword_score", f"WITH {TEXTS} SELECT id, {KEYWORD_SQL} AS score FROM texts")
def _(t: Tables):
    return texts(t).select("id", tx.keyword_score(F.col("text")).alias("score"))


@plan("txt_15_title_prefix", rf"""{with_roles('items')} SELECT id, regexp_matches(title, '(?i)^\s*show\s*hn\b') AS is_launch,
 trim(regexp_replace(title, '(?i)^\s*show\s*hn\b\s*[:\-–—]*\s*', '')) AS stripped FROM items""")
def _(t: Tables):
    title = F.col("title")
    return t.role("items").select("id", tx.launch_title(title).alias("is_launch"), tx.strip_launch_prefix(title).alias("stripped"))


SENT_SQL = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


@plan("txt_16_bounded_snippet", rf"""WITH s AS (SELECT doc_id, source, {SENT_SQL} AS s FROM documents)
 SELECT doc_id, rtrim(substr(source || ' ' || array_to_string(s[1:3], ' '), 1, 300)) AS snippet FROM s""")
def _(t: Tables):
    return t.documents.select("doc_id", tx.bounded_snippet(F.col("source"), tx.split_sentences(F.col("text"))).alias("snippet"))


@plan("txt_17_question_state", """SELECT doc_id, CAST(least(255, n) AS BIGINT) AS n_sentences, md5(substr(source || text, 1, 1500)) AS parent_key, source AS story_title, lang AS thread_type FROM
 (SELECT doc_id, source, text, lang, count(*) AS n FROM (SELECT doc_id, source, text, lang, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text,
 '(?i)(e\\.g\\.|i\\.e\\.|etc\\.|vs\\.|cf\\.)\\s+', '\\1_', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n{2,}', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) FROM documents) GROUP BY ALL)""")
def _(t: Tables):
    text = F.col("text")
    fields = ("parent", "sentences", "story_title", "thread_type")
    state = tx.question_state(text, F.concat("source", "text"), F.col("source"), F.col("lang"), tx.split_sentences(text), fields)
    rows = t.documents.select("doc_id", state.alias("s"))
    return rows.select("doc_id", F.size("s.sentences").cast("bigint").alias("n_sentences"), F.md5("s.parent").alias("parent_key"), "s.story_title", "s.thread_type")


@plan("txt_18_request_key", """SELECT o_orderkey, sha256('{"model":"m1","question_set":"screen@1","questions":{"late":{"ask":"' || o_orderstatus || '?"}},"state":{"priority":"' || o_orderpriority || '","story":' || CAST(o_custkey AS VARCHAR) || '}}') AS request_key FROM orders""")
def _(t: Tables):
    state = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("story")))
    questions = F.to_json(F.struct(F.struct(F.concat("o_orderstatus", F.lit("?")).alias("ask")).alias("late")))
    return t.orders.select("o_orderkey", tx.request_key(state, questions, "screen@1", "m1").alias("request_key"))


@plan("txt_19_surrogate_ids", """WITH h AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR)) AS d FROM orders)
 SELECT o_orderkey, CAST('0x' || substr(d, 1, 15) AS BIGINT) AS id15,
 (CAST('0x' || substr(d, 1, 1) AS BIGINT) & 7) * 1152921504606846976 + CAST('0x' || substr(d, 2, 15) AS BIGINT) AS id63 FROM h""")
def _(t: Tables):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", sha_id15(a, b).alias("id15"), sha_id63(a, b).alias("id63"))


@plan("txt_20_option_index", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 255 END AS option_index FROM events""")
def _(t: Tables):
    option = F.expr("case when event_id % 5 = 0 then 'none' else concat('s', event_id % 255) end")
    return t.events.select("event_id", tx.option_index(option).alias("option_index"))


@plan("txt_21_token_estimate", "SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 3.2::DOUBLE) AS BIGINT) AS tokens FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


PROBS = """p AS (SELECT event_id, (event_id * 7) % 50 / 1e2 AS a, (event_id * 11) % 50 / 1e2 AS b, (event_id * 13) % 50 / 1e2 AS c, 0.9 AS none FROM events)"""


def probabilities(t: Tables):
    def part(k: int):
        return F.expr(f"(event_id * {k}) % 50 / 1e2")

    js = F.to_json(F.struct(part(7).alias("a"), part(11).alias("b"), part(13).alias("c"), F.lit(0.9).alias("none")))
    return t.events.select("event_id", js.alias("probabilities_json"))


@plan("jsn_01_top_two", f"""WITH {PROBS}, l AS (SELECT event_id, k, v, row_number() OVER (PARTITION BY event_id ORDER BY v DESC, k) AS r FROM
 (SELECT event_id, 'a' AS k, a AS v FROM p UNION ALL SELECT event_id, 'b', b FROM p UNION ALL SELECT event_id, 'c', c FROM p))
 SELECT event_id, max(k) FILTER (r = 1) AS first, max(k) FILTER (r = 2) AS second FROM l GROUP BY event_id""")
def _(t: Tables):
    top = jx.top_options(jx.probability_map("probabilities_json"), 2)
    return probabilities(t).select("event_id", top[0].alias("first"), top[1].alias("second"))


@plan("jsn_02_expected_score", """SELECT event_id, round((event_id % 10) / 1e1 * 1 + (event_id % 7) / 1e1 * 2, 6) AS expected FROM events""")
def _(t: Tables):
    js = F.to_json(F.struct(F.lit(0.5).alias("0"), F.expr("(event_id % 10) / 1e1").alias("1"), F.expr("(event_id % 7) / 1e1").alias("2")))
    rows = t.events.select("event_id", js.alias("probabilities_json"))
    return rows.select("event_id", F.round(jx.expected_score(jx.probability_map("probabilities_json")), 6).alias("expected"))


@plan("jsn_03_key_walk", "SELECT key, count(*) AS n, max(len) AS longest FROM (SELECT 'k' AS key, length(json_extract_string(props, '$.k')) AS len FROM events) GROUP BY key")
def _(t: Tables):
    return jx.key_lengths(t.events, "props")


@plan("jsn_04_answer_shape", """SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'choice_not_an_option' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'probabilities_incomplete'
 WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'type_mismatch' WHEN event_type = 'signup' THEN 'unknown_question' END AS problem FROM events""")
def _(t: Tables):
    questions = t.spark.createDataFrame(
        [("click", "choice", ["a", "b"]), ("view", "noul", None), ("error", "score", None), ("purchase", "noul", None)],
        "question_id string, qtype string, options array<string>",
    )
    rows = t.events.select(
        "event_id", F.col("event_type").alias("question_id"),
        F.expr("case event_type when 'click' then 'choice' when 'error' then if(event_id % 2 = 0, 'noul', 'score') else 'noul' end").alias("qtype"),
        F.expr("case when event_type = 'click' then if(event_id % 3 = 0, 'z', 'a') end").alias("choice"),
        F.expr("case when event_type = 'click' then if(event_id % 4 = 0, '{\"a\":1.0}', '{\"a\":0.5,\"b\":0.5}') end").alias("probabilities_json"),
    )
    return jx.answer_problems(rows, questions).select("event_id", "problem")
