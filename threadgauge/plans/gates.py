"""Gate plans (GATE): documents hold personal data and secrets on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.operators import gates as gt
from threadgauge.plans.estimates import rounded
from threadgauge.plans.registry import Tables, plan


@plan("gate_01_forbidden_fields", "SELECT 'documents' AS \"table\", unnest(['text', 'meta.author']) AS field, n FROM (SELECT count(*) AS n FROM documents)")
def _(t: Tables):
    nested = t.documents.select("doc_id", "text", F.struct(F.col("source").alias("author"), "lang").alias("meta"))
    found = gt.forbidden_fields("documents", nested)
    return found.withColumn("n", nested.agg(F.count("*")).scalar())


@plan("gate_01_inner_keys", """SELECT 'documents' AS "table", unnest(['notes.title', 'extra.author', 'payload.by', 'payload.comment']) AS field""")
def _(t: Tables):
    rows = t.documents.select(
        "doc_id", F.array(F.struct(F.col("source").alias("title"))).alias("notes"),
        F.create_map(F.when(F.col("doc_id") % 5 == 0, "author").otherwise("site"), F.col("source")).alias("extra"),
        F.concat(F.lit('{"a": [{"\\u0062y": '), F.col("doc_id").cast("string"), F.lit('}], "b": "\\"title\\":", "comment": 1}')).alias("payload"),
    )
    return gt.forbidden_fields("documents", rows)


@plan("gate_02_long_text", """SELECT 'documents' AS "table", 'text' AS "column", median(length(text))::DOUBLE AS median FROM documents HAVING median(length(text)) > 80
 UNION ALL SELECT 'documents', 'parts', m FROM (SELECT median(length(p))::DOUBLE AS m FROM (SELECT unnest(string_split(text, '. ')) AS p FROM documents)) WHERE m > 80""")
def _(t: Tables):
    return gt.long_text("documents", t.documents.withColumn("parts", F.split("text", r"\. ")).withColumn("note_hash", F.col("text")))


@plan("gate_02_length_medians", """SELECT 'text' AS "column", median(length(text))::DOUBLE AS median FROM documents UNION ALL SELECT 'lang', median(length(lang))::DOUBLE FROM documents UNION ALL SELECT 'source', median(length(source))::DOUBLE FROM documents""")
def _(t: Tables):
    return gt.length_medians(t.documents)


@plan("gate_03_unapproved_strings", """WITH v AS (SELECT n_name AS term FROM nation UNION SELECT 'HOUSEHOLD' UNION SELECT 'BUILDING'), l AS (SELECT 'c_name' AS "column", c_name AS value FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'ref', 'ab' || CAST(c_custkey AS VARCHAR) FROM customer)
 SELECT 'customer' AS "table", "column", value, count(*) AS n FROM l WHERE NOT regexp_matches(value, '^[a-z]{1,4}[0-9]{1,6}$') AND NOT regexp_matches(value, '^\\d{4}-\\d{2}-\\d{2}') AND value NOT IN (SELECT term FROM v) GROUP BY ALL""")
def _(t: Tables):
    vocabulary = t.nation.select(F.col("n_name").alias("term")).union(t.customer.filter("c_mktsegment IN ('HOUSEHOLD', 'BUILDING')").select("c_mktsegment"))
    rows = t.customer.select("c_name", "c_mktsegment", F.concat(F.lit("ab"), F.col("c_custkey").cast("string")).alias("ref"))
    return gt.unapproved_strings("customer", rows, vocabulary)


@plan("gate_03_thin_terms", "SELECT p_name AS term, count(*) AS n_comments, count(DISTINCT p_brand) AS n_authors FROM part GROUP BY 1 HAVING count(*) < 36 OR count(DISTINCT p_brand) < 19")
def _(t: Tables):
    terms = t.part.groupBy(F.col("p_name").alias("term")).agg(F.count("*").alias("n_comments"), F.countDistinct("p_brand").alias("n_authors"))
    return gt.thin_terms(terms, 36, 19)


def pattern_sql() -> str:
    parts = []
    for rule, rx in gt.PATTERNS.items():
        escaped = rx.replace("'", "''")
        parts.append(f"SELECT 'documents' AS \"table\", doc_id AS row_key, 'text' AS \"column\", '{rule}' AS rule FROM documents WHERE regexp_matches(text, '{escaped}')")
    return " UNION ALL ".join(parts)


@plan("gate_04_pattern_findings", pattern_sql())
def _(t: Tables):
    return gt.pattern_findings("documents", t.documents, "doc_id")


def nested(t: Tables):
    """Whole texts in a struct, in structs of an array and in map values."""
    return t.documents.select(
        "doc_id", F.struct(F.col("text").alias("body"), F.col("doc_id").alias("n")).alias("meta"),
        F.array(F.struct(F.col("source").alias("note")), F.struct(F.col("text").alias("note"))).alias("notes"),
        F.create_map("lang", "text").alias("extra"),
    ).withColumnRenamed("doc_id", "row_no")


def nested_pattern_sql() -> str:
    found = f"f AS ({pattern_sql()})"
    return f"""WITH {found} SELECT "table", row_key, c AS "column", rule FROM f, (SELECT unnest(['meta.body', 'notes.note', 'extra']) AS c)"""


@plan("gate_02_nested_long_text", """SELECT 'documents' AS "table", c AS "column", median(length(text))::DOUBLE AS median FROM documents, (SELECT unnest(['meta.body', 'extra']) AS c) GROUP BY c HAVING median(length(text)) > 80""")
def _(t: Tables):
    return gt.long_text("documents", nested(t).drop("notes"))


@plan("gate_04_nested_findings", nested_pattern_sql())
def _(t: Tables):
    return gt.pattern_findings("documents", nested(t), "row_no")


@plan("gate_05_claims", """SELECT 'orders' AS id, true AS ok, count(*)::DOUBLE AS expected, count(*)::DOUBLE AS actual, NULL AS error FROM orders UNION ALL SELECT 'wrong', false, 1e0, count(*)::DOUBLE, NULL FROM orders
 UNION ALL SELECT 'many', false, 1e0, NULL, 'not_scalar' UNION ALL SELECT 'null', false, 1e0, NULL, 'null_result' UNION ALL SELECT 'orders', false, 1e0, NULL, 'id_repeated' UNION ALL SELECT 'lane', false, 1e0, NULL, 'lane_known' UNION ALL SELECT 'short', false, 1e0, NULL, 'no_text, no_run_id'
 UNION ALL SELECT 'share', true, 0.34::DOUBLE, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END), 6), NULL FROM orders""")
def _(t: Tables):
    t.orders.createOrReplaceTempView("claim_orders")
    base = {"text": "x", "run_id": "r", "question_set": "q", "qualifier": "", "lane": "discovery", "denominator": "orders", "weighted": False, "tolerance": 0, "ci_low": None, "ci_high": None}
    count = t.orders.count()
    claims = [
        {**base, "id": "orders", "sql": "SELECT count(*) FROM claim_orders", "value": count},
        {**base, "id": "wrong", "sql": "SELECT count(*) FROM claim_orders", "value": 1},
        {**base, "id": "many", "sql": "SELECT o_orderkey FROM claim_orders", "value": 1},
        {**base, "id": "null", "sql": "SELECT max(o_orderkey) FROM claim_orders WHERE o_orderkey < 0", "value": 1},
        {**base, "id": "orders", "sql": "SELECT 1", "value": 1},
        {**base, "id": "lane", "sql": "SELECT 1", "value": 1, "lane": "depth"},
        {k: v for k, v in base.items() if k not in ("text", "run_id")} | {"id": "short", "sql": "SELECT 1", "value": 1},
        {**base, "id": "share", "sql": "SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1d ELSE 0d END) FROM claim_orders", "value": 0.34, "tolerance": 0.05, "ci_low": 0.3, "ci_high": 0.4},
    ]
    found = gt.check_claims(t.spark, claims)
    t.spark.catalog.dropTempView("claim_orders")
    return rounded(found, "actual")


DRIFT = """dr AS (SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'match' END AS status FROM documents)"""


def drift(t: Tables):
    docs = t.documents
    fetched = docs.filter("doc_id % 7 <> 0 OR doc_id % 13 = 0").select(
        F.col("doc_id").alias("id"), F.expr("case when doc_id % 13 = 0 then 'failed' when doc_id % 11 = 0 then 'dead' else 'ok' end").alias("state"),
        F.expr("if(doc_id % 5 = 0, concat(text, '!'), text)").alias("text"),
    )
    return gt.text_drift(docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_sha256")), fetched)


@plan("gate_06_text_drift", f"WITH {DRIFT} SELECT * FROM dr")
def _(t: Tables):
    return drift(t)


@plan("gate_06_drift_summary", f"WITH {DRIFT} SELECT count(*) AS n, count(*) FILTER (status = 'match') AS n_match, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'failed') AS n_failed, round(avg((status <> 'match')::INT), 6) AS no_longer_matching_share FROM dr")
def _(t: Tables):
    return rounded(gt.drift_summary(drift(t)), "no_longer_matching_share")
