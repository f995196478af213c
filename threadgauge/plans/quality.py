"""Quality plans (AGR, MET): document labels as human labels, coded orders as screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.operators import quality as ql
from threadgauge.operators import robust as rb
from threadgauge.plans import estimates
from threadgauge.plans.estimates import CODED, ci, coded, rounded
from threadgauge.plans.registry import Tables, plan
from threadgauge.plans.text import KEYWORD_SQL

R = 2000


def boot(name: str, src: str, keys: list[str], values: list[str]) -> str:
    return estimates.boot(name, src, keys, values, R)


LAB = """lab AS (SELECT l.doc_id AS comment_id, quality AS y, toxic, text, lang AS stratum, source || '-' || CAST(l.doc_id % 50 AS VARCHAR) AS cluster, CAST(1 + l.doc_id % 3 AS DOUBLE) AS weight,
 least(1e0, greatest(0e0, ((l.doc_id * 13) % 100) / 1e2 * 7e-1 + quality * 3e-1)) AS score FROM labels l JOIN documents d USING (doc_id))"""


def labelled(t: Tables):
    return t.labels.join(t.documents, "doc_id").select(
        F.col("doc_id").alias("comment_id"), F.col("quality").alias("y"), "toxic", "text", F.col("lang").alias("stratum"),
        F.expr("concat(source, '-', doc_id % 50)").alias("cluster"), F.expr("cast(1 + doc_id % 3 as double)").alias("weight"),
        F.expr("least(1d, greatest(0d, ((doc_id * 13) % 100) / 1e2 * 0.7d + quality * 0.3d))").alias("score"),
    )


OTHER = "other AS (SELECT *, CASE WHEN comment_id % 7 = 0 THEN 1e0 - firsthand_p ELSE firsthand_p END AS q FROM coded WHERE comment_id % 3 > 0)"


def other_screen(t: Tables):
    return coded(t).filter("comment_id % 3 > 0").withColumn("firsthand_p", F.expr("if(comment_id % 7 = 0, 1d - firsthand_p, firsthand_p)"))


@plan("agr_01_screen_prevalence", f"""WITH {CODED}, {OTHER}, pv AS (SELECT 'main~' || stratum AS stratum, cluster, 'main' AS run, weight * CASE WHEN firsthand_p >= 7e-1 THEN 1 ELSE 0 END AS a, weight AS d, CASE WHEN firsthand_p >= 7e-1 THEN 1 ELSE 0 END AS n FROM coded
 UNION ALL SELECT 'other~' || stratum, cluster, 'other', weight * CASE WHEN q >= 7e-1 THEN 1 ELSE 0 END, weight, CASE WHEN q >= 7e-1 THEN 1 ELSE 0 END FROM other), {boot('b', 'pv', ['run'], ['a', 'd', 'n'])} SELECT *, n < 30 AS sparse FROM ({ci('a / d', 'b', 'run, ', 'n')})""")
def _(t: Tables):
    return rounded(rb.compare_screens(coded(t), other_screen(t), 0.7, n_rep=R)[0])


MID = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"


@plan("agr_01_screen_agreement", f"""WITH {CODED}, {OTHER}, j AS (SELECT c.firsthand_p AS a, o.q AS b FROM coded c JOIN other o USING (comment_id)), f AS (SELECT a >= 7e-1 AS x, b >= 7e-1 AS y, {MID.format(c='a')} AS ra, {MID.format(c='b')} AS rb FROM j),
 s AS (SELECT count(*) AS n, avg((x = y)::INT) AS po, avg(x::INT) AS pa, avg(y::INT) AS pb, corr(ra, rb) AS spearman FROM f)
 SELECT n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa, round(spearman, 6) AS spearman FROM s""")
def _(t: Tables):
    return rounded(rb.compare_screens(coded(t), other_screen(t), 0.7, n_rep=R)[1], "agreement", "kappa", "spearman")


@plan("agr_02_midranks", "SELECT c_custkey, rank() OVER (ORDER BY floor(c_acctbal / 10)) + (count(*) OVER (PARTITION BY floor(c_acctbal / 10)) - 1) / 2 AS midrank FROM customer")
def _(t: Tables):
    return rb.midranks(t.customer.select("c_custkey", F.floor(F.col("c_acctbal") / 10).alias("v")), "v", "midrank").select("c_custkey", "midrank")


@plan("agr_02_spearman", f"WITH r AS (SELECT {MID.format(c='l_quantity')} AS a, {MID.format(c='l_discount')} AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def _(t: Tables):
    return rounded(rb.spearman(t.lineitem, "l_quantity", "l_discount"), "spearman")


PARA = "para AS (SELECT comment_id, group_id, CASE WHEN comment_id % 12 = 0 THEN 'c00' ELSE card_id END AS card_id FROM problems WHERE comment_id % 4 > 0)"


def para(t: Tables):
    return t.role("problems").filter("comment_id % 4 > 0").withColumn("card_id", F.expr("if(comment_id % 12 = 1, 'c00', card_id)"))


@plan("agr_03_assignment_agreement", f"WITH {CODED}, {PARA.replace('= 0 THEN', '= 1 THEN')} SELECT count(*) AS n, round(avg((a.group_id IS NOT DISTINCT FROM b.group_id)::INT), 6) AS group_agreement, round(avg((a.card_id IS NOT DISTINCT FROM b.card_id)::INT), 6) AS card_agreement FROM problems a JOIN para b USING (comment_id)")
def _(t: Tables):
    return rounded(rb.compare_assignments(t.role("problems"), para(t))[0], "group_agreement", "card_agreement")


def share_sql(src: str, name: str) -> str:
    return f"SELECT card_id, count(*) / sum(count(*)) OVER () AS share_{name}, row_number() OVER (ORDER BY count(*) DESC, card_id) AS rank_{name} FROM {src} WHERE card_id <> 'none' GROUP BY 1"


@plan("agr_03_top_share_difference", f"WITH {CODED}, {PARA.replace('= 0 THEN', '= 1 THEN')} SELECT card_id, round(coalesce(share_main, 0), 6) AS share_main, round(coalesce(share_other, 0), 6) AS share_other, round(abs(coalesce(share_main, 0) - coalesce(share_other, 0)), 6) AS abs_diff FROM ({share_sql('problems', 'main')}) FULL JOIN ({share_sql('para', 'other')}) USING (card_id) WHERE rank_main <= 8 OR rank_other <= 8")
def _(t: Tables):
    return rounded(rb.compare_assignments(t.role("problems"), para(t), 8)[1], "share_main", "share_other", "abs_diff")


def conf(cut: str, src: str = "lab", score: str = "score") -> str:
    return f"SELECT stratum, cluster, CASE WHEN y = 1 AND {score} >= {cut} THEN weight ELSE 0 END AS tp, CASE WHEN y <> 1 AND {score} >= {cut} THEN weight ELSE 0 END AS fp, CASE WHEN y = 1 AND {score} < {cut} THEN weight ELSE 0 END AS fn FROM {src}"


def metric_sql(src: str = "b", keys: str = "") -> str:
    parts = " UNION ALL ".join(
        f"SELECT rep, {keys}'{m}' AS metric, {e} AS v FROM {src}"
        for m, e in (("precision", "tp / nullif(tp + fp, 0)"), ("recall", "tp / nullif(tp + fn, 0)"), ("f1", "2 * tp / nullif(2 * tp + fp + fn, 0)"))
    )
    return f"SELECT {keys}metric, est, lo95, hi95 FROM ({ci('v', f'({parts})', keys + 'metric, ')})"


@plan("met_01_binary_metrics", f"WITH {LAB}, cf AS ({conf('5e-1')}), {boot('b', 'cf', [], ['tp', 'fp', 'fn'])} {metric_sql()}")
def _(t: Tables):
    return rounded(ql.binary_metrics(labelled(t), 0.5, n_rep=R).drop("n_undefined"), "est", "lo95", "hi95")


@plan("met_01_confusion_counts", f"WITH {LAB} SELECT stratum, count(*) FILTER (y = 1 AND score >= 5e-1) AS tp, count(*) FILTER (y <> 1 AND score >= 5e-1) AS fp, count(*) FILTER (y = 1 AND score < 5e-1) AS fn, count(*) FILTER (y <> 1 AND score < 5e-1) AS tn FROM lab GROUP BY 1")
def _(t: Tables):
    return ql.confusion_counts(labelled(t), 0.5, ["stratum"])


@plan("met_02_threshold_for_recall", f"WITH {LAB}, c AS (SELECT score, sum(sum(weight)) OVER (ORDER BY score DESC) / sum(sum(weight)) OVER () AS r FROM lab WHERE y = 1 GROUP BY 1) SELECT round(max(score), 9) AS threshold FROM c WHERE r >= 85e-2 - 1e-12")
def _(t: Tables):
    return rounded(ql.threshold_for_recall(labelled(t), 0.85), "threshold", digits=9)


LOWER = f"""cw AS (SELECT stratum, cluster, CASE WHEN y = 1 THEN score ELSE -1 END AS cut, CASE WHEN y = 1 THEN weight ELSE 0 END AS w FROM lab), {boot('b', 'cw', ['cut'], ['w'])},
 cr AS (SELECT rep, cut, sum(w) OVER (PARTITION BY rep ORDER BY cut DESC ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY rep) AS recall FROM b WHERE cut >= 0),
 cl AS (SELECT cut, quantile_cont(recall, 0.05) FILTER (rep >= 0) AS lower_, max(recall) FILTER (rep = -1) AS point FROM cr GROUP BY 1), ok AS (SELECT * FROM cl WHERE lower_ >= 8e-1 - 1e-12)"""


@plan("met_03_threshold_by_lower_bound", f"WITH {LAB}, {LOWER} SELECT round(max(cut), 9) AS threshold, round(arg_max(lower_, cut), 6) AS recall_lower_bound, round(arg_max(point, cut), 6) AS point_recall FROM ok")
def _(t: Tables):
    out = ql.threshold_by_lower_bound(labelled(t), 0.8, n_rep=R)
    return rounded(rounded(out, "recall_lower_bound", "point_recall"), "threshold", digits=9)


@plan("met_04_reliability_bins", f"""WITH {LAB}, g AS (SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, sum(weight) AS weight, sum(weight * score) / sum(weight) AS mean_predicted, sum(weight * y) / sum(weight) AS observed FROM lab GROUP BY 1)
 SELECT bin, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, round(mean_predicted, 6) AS mean_predicted, round(observed, 6) AS observed FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN g USING (bin)""")
def _(t: Tables):
    return rounded(ql.reliability_bins(labelled(t)), "mean_predicted", "observed")


@plan("met_05_choice_accuracy", f"WITH {CODED} SELECT count(*) AS n, round(avg((domain = role)::INT), 6) AS accuracy FROM (SELECT domain, CASE WHEN comment_id % 3 = 0 THEN domain ELSE 'web' END AS role FROM coded)")
def _(t: Tables):
    pairs = t.role("problems").select("domain", F.expr("if(comment_id % 3 = 0, domain, 'web')").alias("said"))
    return rounded(ql.choice_confusion(pairs, "domain", "said")[0], "accuracy")


@plan("met_05_choice_matrix", f"WITH {CODED} SELECT domain, CASE WHEN comment_id % 3 = 0 THEN domain ELSE 'web' END AS said, count(*) AS n FROM coded GROUP BY ALL")
def _(t: Tables):
    pairs = t.role("problems").select("domain", F.expr("if(comment_id % 3 = 0, domain, 'web')").alias("said"))
    return ql.choice_confusion(pairs, "domain", "said")[1]


EVAL = f"""{LAB}, er AS (SELECT comment_id, y, score, text, weight / CASE WHEN y = 1 THEN 5e-1 ELSE 8e-1 END AS weight, CASE WHEN y = 1 THEN 'high' ELSE 'low' END AS stratum, comment_id % 60 AS cluster FROM lab WHERE comment_id % 11 > 0)"""


def evaluated(t: Tables):
    rows = labelled(t)
    labels = rows.select("comment_id", F.expr("case when comment_id % 11 = 0 then 'unsure' when y = 1 then 'yes' else 'no' end").alias("value"))
    queue = rows.select("comment_id", F.expr("if(y = 1, 'high', 'low')").alias("band"), F.expr("if(y = 1, 0.5d, 0.8d)").alias("rate"))
    design = rows.select("comment_id", "weight", (F.col("comment_id") % 60).alias("story_id"))
    return ql.evaluation_rows(labels, rows.select("comment_id", F.col("score").alias("noul")), queue, design)


@plan("met_06_evaluation_rows", f"WITH {EVAL} SELECT comment_id, y, round(score, 9) AS score, round(weight, 9) AS weight, stratum, cluster FROM er")
def _(t: Tables):
    return rounded(evaluated(t), "score", "weight", digits=9)


def report_sql() -> str:
    low = LOWER.replace("FROM lab", "FROM er").replace("8e-1", "7e-1")
    model = conf("(SELECT max(cut) - 1e-12 FROM ok)", "er")
    base = conf("5e-1", "ek", "k")
    return f"""WITH {EVAL}, {low}, ek AS (SELECT *, {KEYWORD_SQL} AS k FROM er), mf AS ({model}), {boot('mb', 'mf', [], ['tp', 'fp', 'fn'])}, kf AS ({base}), {boot('kb', 'kf', [], ['tp', 'fp', 'fn'])}
 SELECT *, 'model' AS system, (SELECT round(max(cut), 9) FROM ok) AS threshold, (SELECT count(*) FILTER (y = 1) >= 60 FROM er) AS stop_rule_met FROM ({metric_sql('mb')}) UNION ALL SELECT *, 'keyword', 5e-1, (SELECT count(*) FILTER (y = 1) >= 60 FROM er) FROM ({metric_sql('kb')})"""


@plan("met_06_evaluation_report", report_sql())
def _(t: Tables):
    texts = t.documents.select(F.col("doc_id").alias("comment_id"), "text")
    out = ql.evaluation_report(evaluated(t), texts, 0.7, n_rep=R).drop("n_undefined")
    return rounded(rounded(out, "est", "lo95", "hi95"), "threshold", digits=9)


@plan("met_06_intra_rater", "SELECT event_type AS question_id, count(*) AS n, round(avg((a = b)::INT), 6) AS agreement FROM (SELECT event_type, user_id % 4 AS a, CASE WHEN event_id % 5 = 0 THEN 0 ELSE user_id % 4 END AS b FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def _(t: Tables):
    rows = t.events.select(F.col("event_id").alias("comment_id"), F.col("event_type").alias("question_id"), (F.col("user_id") % 4).alias("value"))
    again = rows.filter("comment_id % 3 = 0").withColumn("value", F.expr("if(comment_id % 5 = 0, 0, value)"))
    return rounded(ql.rater_agreement(rows, again), "agreement")


AUDIT = "au AS (SELECT CASE WHEN comment_id % 2 = 0 THEN 'pick' ELSE 'random' END AS grp, stratum, cluster, weight AS w, CASE WHEN comment_id % 5 IN (0, 1, 2) OR comment_id % 2 = 0 THEN weight ELSE 0 END AS lenient, CASE WHEN comment_id % 5 = 0 OR comment_id % 4 = 0 THEN weight ELSE 0 END AS strict FROM lab WHERE comment_id % 13 > 0)"


@plan("met_07_assignment_audit", f"""WITH {LAB}, {AUDIT}, as0 AS (SELECT grp || '~' || stratum AS stratum, cluster, grp, w, lenient, strict FROM au), {boot('b', 'as0', ['grp'], ['w', 'lenient', 'strict'])},
 l AS (SELECT rep, grp, 'lenient' AS rule, lenient / w AS v FROM b UNION ALL SELECT rep, grp, 'strict', strict / w FROM b), c AS ({ci('v', 'l', 'grp, rule, ', None, 9)})
 SELECT grp AS "group", rule, round(est, 6) AS est, round(lo95, 6) AS lo95, round(hi95, 6) AS hi95, round(max(est) FILTER (grp = 'pick') OVER (PARTITION BY rule) - max(est) FILTER (grp = 'random') OVER (PARTITION BY rule), 6) AS gap, max(est) FILTER (grp = 'pick') OVER (PARTITION BY rule) >= 75e-2 AS meets_target FROM c""")
def _(t: Tables):
    rows = labelled(t).withColumn("is_pick", F.col("comment_id") % 2 == 0).withColumn("value", F.expr(
        "case when comment_id % 13 = 0 then 'unsure' when comment_id % 5 = 0 or comment_id % 4 = 0 then 'yes' when comment_id % 5 in (1, 2) or comment_id % 2 = 0 then 'partly' else 'no' end"
    ))
    return rounded(ql.assignment_audit(rows, n_rep=R), "est", "lo95", "hi95", "gap")


@plan("met_08_facet_audit", f"""WITH {LAB}, q AS (SELECT comment_id, weight, cluster, unnest(['quality', 'toxic']) AS question_id, unnest([y, toxic]) AS y, stratum AS s, score FROM lab WHERE comment_id % 17 > 0),
 fx AS (SELECT question_id || '~' || s AS stratum, cluster, question_id, weight, y, score FROM q), cf AS ({conf('5e-1', 'fx').replace('cluster,', 'cluster, question_id,', 1)}), {boot('b', 'cf', ['question_id'], ['tp', 'fp', 'fn'])} SELECT * FROM ({metric_sql('b', 'question_id, ')}) WHERE metric <> 'f1'""")
def _(t: Tables):
    rows = labelled(t)
    pairs = F.explode(F.array(F.struct(F.lit("quality").alias("q"), F.col("y").alias("v")), F.struct(F.lit("toxic").alias("q"), F.col("toxic").alias("v")))).alias("p")
    long = rows.select("comment_id", "weight", "stratum", "cluster", "score", pairs).select("*", "p.*")
    value = F.expr("case when comment_id % 17 = 0 then 'unsure' when v = 1 then 'yes' else 'no' end")
    labels = long.select("comment_id", "weight", "stratum", "cluster", F.col("q").alias("question_id"), value.alias("value"))
    answers = long.select("comment_id", F.col("q").alias("question_id"), F.col("score").alias("noul"))
    return rounded(ql.facet_audit(labels, answers, n_rep=R).drop("n_undefined"), "est", "lo95", "hi95")


EVENT_LABELS = "el AS (SELECT event_id AS label_id, user_id AS comment_id, event_type AS question_id, 'main' AS label_set, value, event_id AS seq FROM events)"


def event_labels(t: Tables):
    rows = t.events.select(F.col("event_id").alias("label_id"), F.col("user_id").alias("comment_id"), F.col("event_type").alias("question_id"), F.lit("main").alias("label_set"), "value", F.col("event_id").alias("seq"))
    void = t.events.filter("event_id % 4 = 0").select(F.col("event_id").alias("label_id"), F.lit("void").alias("reason"))
    unblinded = t.events.filter("user_id % 10 = 3").select(F.col("user_id").alias("comment_id"), F.lit("seen").alias("reason")).distinct()
    return rows, void, unblinded


@plan("met_09_latest_labels", f"WITH {EVENT_LABELS} SELECT * FROM el WHERE label_id % 4 <> 0 AND comment_id % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY comment_id, question_id ORDER BY seq DESC) = 1")
def _(t: Tables):
    return ql.latest_labels(*event_labels(t))


@plan("met_09_exclusion_counts", f"WITH {EVENT_LABELS} SELECT CASE WHEN comment_id % 10 = 3 THEN 'seen' ELSE 'void' END AS reason, count(*) AS n FROM el WHERE comment_id % 10 = 3 OR label_id % 4 = 0 GROUP BY 1")
def _(t: Tables):
    return ql.exclusion_counts(*event_labels(t))


@plan("met_10_quality_rows", f"""WITH {LAB}, s AS (SELECT stratum, avg(y) AS accuracy, avg(score) AS mean_score, avg(toxic) AS toxic_share FROM lab GROUP BY 1) SELECT stratum, metric, round(value, 6) AS value, 'model' AS system FROM (UNPIVOT s ON accuracy, mean_score, toxic_share INTO NAME metric VALUE value)""")
def _(t: Tables):
    wide = labelled(t).groupBy("stratum").agg(F.avg("y").alias("accuracy"), F.avg("score").alias("mean_score"), F.avg("toxic").alias("toxic_share"))
    return rounded(ql.quality_rows(wide, ["stratum"], ["accuracy", "mean_score", "toxic_share"], "model"), "value")
