"""Report plans (PUB) over card, group, phase and tool tables of the coded orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.operators import cards as cd
from threadgauge.operators import estimate as es
from threadgauge.operators import reports as rp
from threadgauge.plans.cards import CC, coded, funnel_rows, FUNNEL_ROWS
from threadgauge.plans.estimates import rounded
from threadgauge.plans.ledger import LOG, RUNS, runs
from threadgauge.plans.quality import LAB, labelled
from threadgauge.plans.registry import Tables, plan

BASE = f"""{CC}, ca AS (SELECT card_id, any_value(group_id) AS group_id, count(*) AS n, sum(weight) AS w, avg((f_paid >= 5e-1)::INT) AS paid, avg((f_switched >= 5e-1)::INT) AS switched, avg((f_abandoned >= 5e-1)::INT) AS abandoned,
 avg((f_workaround >= 5e-1)::INT) AS workaround, CASE WHEN card_id < 'c20' THEN avg((solved_p < 5e-1)::INT) END AS unsolved, avg(severity) AS severity FROM cc GROUP BY 1),
 card AS (SELECT *, w / sum(w) OVER () AS share, w / sum(w) OVER () * 8e-1 AS lo95, w / sum(w) OVER () * 12e-1 AS hi95, greatest(paid, switched, abandoned) AS commercial FROM ca)"""


def base(t: Tables):
    def yes(c: str):
        return F.avg((F.col(c) >= 0.5).cast("int"))

    rows = coded(t).groupBy("card_id").agg(
        F.min("group_id").alias("group_id"), F.count("*").alias("n"), F.sum("weight").alias("w"), yes("f_paid").alias("paid"),
        yes("f_switched").alias("switched"), yes("f_abandoned").alias("abandoned"), yes("f_workaround").alias("workaround"),
        F.avg((F.col("solved_p") < 0.5).cast("int")).alias("u"), F.avg("severity").alias("severity"),
    ).withColumn("unsolved", F.when(F.col("card_id") < "c20", F.col("u"))).drop("u")
    share = F.col("w") / F.sum("w").over(rp.every())
    return rows.withColumn("share", share).withColumn("lo95", share * 0.8).withColumn("hi95", share * 1.2).withColumn(
        "commercial", F.greatest("paid", "switched", "abandoned")
    )


def with_base(sql: str) -> str:
    return f"WITH {BASE.replace('any_value(group_id)', 'min(group_id)')}, {sql}" if not sql.startswith("SELECT") else f"WITH {BASE.replace('any_value(group_id)', 'min(group_id)')} {sql}"


@plan("pub_01_coping_composition", with_base("""SELECT card_id, n, round(paid / (paid + workaround + abandoned), 6) AS paid, round(workaround / (paid + workaround + abandoned), 6) AS workaround, round(abandoned / (paid + workaround + abandoned), 6) AS abandoned,
 round(commercial, 6) AS commercial, row_number() OVER (ORDER BY commercial DESC, card_id) <= 15 AS in_side_list FROM card WHERE n >= 250"""))
def _(t: Tables):
    return rounded(rp.coping_composition(base(t), 250), "paid", "workaround", "abandoned", "commercial")


@plan("pub_02_group_cost_profile", with_base("""c AS (SELECT card_id, axis, est, est * 9e-1 AS lo, est * 11e-1 AS hi FROM (UNPIVOT (SELECT card_id, paid AS money, workaround AS time FROM card) ON money, time INTO NAME axis VALUE est)),
 g AS (SELECT group_id, axis, sum(est * share) / sum(share) AS est, sqrt(sum(pow((hi - lo) / 2 * share, 2))) / sum(share) AS h FROM c JOIN card USING (card_id) WHERE n >= 250 GROUP BY ALL)
 SELECT group_id, axis, round(est, 6) AS est, round(greatest(0, est - h), 6) AS lo, round(least(1, est + h), 6) AS hi, round(avg(est) OVER (PARTITION BY axis), 6) AS overall FROM g"""))
def _(t: Tables):
    rows = base(t)
    costs = rows.select("card_id", F.col("paid").alias("money"), F.col("workaround").alias("time")).unpivot(["card_id"], ["money", "time"], "axis", "est")
    costs = costs.withColumn("lo95", F.col("est") * 0.9).withColumn("hi95", F.col("est") * 1.1)
    return rounded(rp.group_cost_profile(costs, rows.select("card_id", "group_id", "share", (F.col("n") < 250).alias("sparse"))), "est", "lo", "hi", "overall")


DOM = "d AS (SELECT domain, sum(weight) / (SELECT sum(weight) FROM problems) AS discussion, sum(weight) FILTER (firsthand_p >= 5e-1) / (SELECT sum(weight) FROM problems) AS complaints FROM problems GROUP BY 1)"


@plan("pub_03_domain_over_index", f"WITH {CC}, {DOM} SELECT domain, round(complaints / discussion, 6) AS rate, round(complaints / discussion / (sum(complaints) OVER () / sum(discussion) OVER ()), 6) AS over_index FROM d")
def _(t: Tables):
    rows = t.role("problems").groupBy("domain").agg(F.sum("weight").alias("discussion"), F.sum(F.when(F.col("firsthand_p") >= 0.5, F.col("weight")).otherwise(0.0)).alias("complaints"))
    total = F.sum("discussion").over(rp.every())
    rows = rows.withColumn("__t", total).withColumn("discussion", F.col("discussion") / F.col("__t")).withColumn("complaints", F.col("complaints") / F.col("__t"))
    return rounded(rp.domain_over_index(rows.withColumn("rate", F.col("complaints") / F.col("discussion"))).select("domain", "rate", "over_index"), "rate", "over_index")


@plan("pub_04_top_with_ties", with_base("p AS (SELECT card_id, share, hi95, row_number() OVER (ORDER BY share DESC, card_id) AS position FROM card) SELECT card_id, round(share, 6) AS share, position, position > 5 AS beyond FROM p WHERE position <= 5 OR hi95 * 85e-2 >= (SELECT share FROM p WHERE position = 5)"))
def _(t: Tables):
    rows = base(t).withColumn("hi95", F.col("hi95") * 0.85)
    return rounded(rp.top_with_ties(rows, 5).select("card_id", "share", "position", "beyond"), "share")


PANEL = """q AS (SELECT group_id AS id, 'q' || CAST((CAST(substr(period, 2, 2) AS INT) - 1) // 3 + 1 AS VARCHAR) AS bucket, sum(weight) AS w FROM cc GROUP BY ALL), qs AS (SELECT id, bucket, w / sum(w) OVER (PARTITION BY bucket) AS est FROM q), y AS (SELECT id, sum(w) / (SELECT sum(w) FROM q) AS ye FROM q GROUP BY 1)"""


@plan("pub_05_quarter_log_ratio", with_base(f"{PANEL} SELECT id, bucket AS quarter, round(ln(est / ye), 6) AS log_ratio FROM qs JOIN y USING (id)"))
def _(t: Tables):
    from pyspark.sql import Window

    rows = coded(t).withColumn("bucket", F.explode(es.panel_buckets())).groupBy("bucket", F.col("group_id").alias("id")).agg(F.sum("weight").alias("w"))
    panel = rows.withColumn("est", F.col("w") / F.sum("w").over(Window.partitionBy("bucket")))
    return rounded(rp.quarter_log_ratio(panel), "log_ratio")


@plan("pub_06_spend_receipt", f"""WITH {LOG}, {RUNS}, p AS (SELECT phase, CAST(sum(calls) AS BIGINT) AS calls, sum(calculated_usd) AS usd FROM runs GROUP BY 1), s AS (SELECT *, calls / sum(calls) OVER () AS sc, usd / sum(usd) OVER () AS su FROM p)
 SELECT CASE WHEN sc < 4e-1 AND su < 4e-1 THEN 'other' ELSE phase END AS phase, CAST(sum(calls) AS BIGINT) AS calls, round(sum(usd), 4) AS usd, round(sum(sc), 6) AS share_calls, round(sum(su), 6) AS share_cost, round(sum(usd) / sum(calls) * 1000, 4) AS usd_per_1k FROM s GROUP BY 1""")
def _(t: Tables):
    from threadgauge.operators.ledger import spend_by_phase

    out = rp.spend_receipt(spend_by_phase(runs(t)).select("phase", "calls", "usd"), 0.4)
    return rounded(rounded(out, "share_calls", "share_cost"), "usd", "usd_per_1k", digits=4)


@plan("pub_07_role_mix", with_base("""g0 AS (SELECT group_id, sum(weight) AS w FROM cc GROUP BY 1), g AS (SELECT group_id, w / sum(w) OVER () AS share FROM g0), m0 AS (SELECT group_id, role, sum(weight) AS w FROM cc WHERE role <> 'unclear' GROUP BY 1, 2), m AS (SELECT group_id, role, w / sum(w) OVER (PARTITION BY group_id) AS est FROM m0),
 k AS (SELECT role FROM m JOIN g USING (group_id) GROUP BY 1 ORDER BY sum(est * share) DESC, role LIMIT 2), tl AS (SELECT group_id, role, est AS share FROM m WHERE role IN (SELECT role FROM k))
 SELECT group_id, round(g.share / (SELECT sum(share) FROM g), 6) AS width, role, round(x.share, 6) AS share FROM (SELECT * FROM tl UNION ALL SELECT group_id, 'other', greatest(0, 1 - sum(share)) FROM tl GROUP BY 1) x JOIN g USING (group_id) WHERE x.share > 1e-3"""))
def _(t: Tables):
    from pyspark.sql import Window

    rows = coded(t)
    groups = rows.groupBy("group_id").agg(F.sum("weight").alias("w")).withColumn("share", F.col("w") / F.sum("w").over(rp.every())).drop("w")
    mix = rows.filter("role <> 'unclear'").groupBy("group_id", "role").agg(F.sum("weight").alias("w"))
    mix = mix.withColumn("est", F.col("w") / F.sum("w").over(Window.partitionBy("group_id"))).drop("w")
    return rounded(rp.role_mix(mix, groups, 2), "width", "share")


@plan("pub_08_funnel_bounds", """WITH t AS (SELECT p_brand AS tool, count(*) AS threads, count(*) FILTER (p_size % 3 = 0) AS fix_threads FROM part GROUP BY 1 HAVING count(*) >= 10), o AS (SELECT *, sum(fix_threads) OVER () / sum(threads) OVER () AS p FROM t),
 b AS (SELECT tool, threads, fix_threads / threads AS est, greatest(0, p - 1.96::DOUBLE * sqrt(p * (1 - p) / threads)) AS lo, least(1, p + 1.96::DOUBLE * sqrt(p * (1 - p) / threads)) AS hi FROM o),
 c AS (SELECT *, CASE WHEN est > hi THEN 'above' WHEN est < lo THEN 'below' END AS outside, greatest(0, est - hi, lo - est) AS distance, row_number() OVER (ORDER BY threads DESC, tool) <= 5 AS named FROM b),
 f AS (SELECT *, row_number() OVER (PARTITION BY outside IS NOT NULL AND NOT named ORDER BY distance DESC, tool) AS k, count(*) FILTER (named AND outside IS NOT NULL) OVER () AS a FROM c)
 SELECT tool, threads, round(est, 6) AS est, round(lo, 6) AS lo, round(hi, 6) AS hi, outside, round(distance, 6) AS distance, named OR (outside IS NOT NULL AND NOT named AND k <= 12 - a) AS labelled FROM f""")
def _(t: Tables):
    tools = t.part.groupBy(F.col("p_brand").alias("tool")).agg(F.count("*").alias("threads"), F.count(F.when(F.col("p_size") % 3 == 0, 1)).alias("fix_threads")).withColumn("fix_share", F.lit(None).cast("double"))
    return rounded(rp.funnel_bounds(tools), "est", "lo", "hi", "distance")


@plan("pub_09_rank_ranges", with_base("""s AS (SELECT 'main' AS spec, card_id, share AS v FROM card UNION ALL SELECT 'paid', card_id, paid FROM card UNION ALL SELECT 'severity', card_id, severity FROM card), r AS (SELECT *, rank() OVER (PARTITION BY spec ORDER BY v DESC) AS rank FROM s),
 x AS (SELECT card_id, max(rank) FILTER (spec = 'main') AS main, min(rank) AS best, max(rank) AS worst FROM r GROUP BY 1) SELECT *, row_number() OVER (ORDER BY worst - best DESC, main, card_id) <= 3 AS fragile FROM x"""))
def _(t: Tables):
    from pyspark.sql import Window

    long = base(t).select("card_id", F.col("share").alias("main"), "paid", "severity").unpivot(["card_id"], ["main", "paid", "severity"], "spec", "v")
    ranks = long.withColumn("rank", F.rank().over(Window.partitionBy("spec").orderBy(F.col("v").desc()))).withColumn("rank", F.col("rank").cast("bigint"))
    return rp.rank_ranges(ranks.drop("v"))


@plan("pub_10_resolved_share", with_base("SELECT round(sum(share * unsolved) / sum(share), 6) AS no_fix, round(1 - sum(share * unsolved) / sum(share), 6) AS fix FROM card WHERE unsolved IS NOT NULL"))
def _(t: Tables):
    return rounded(rp.resolved_share(base(t)), "no_fix", "fix")


@plan("pub_11_evidence_scores", f"""WITH {CC} SELECT comment_id, round((2 * coalesce(specificity, 0) / 3 + 5e-1 * card_p + 1 * coalesce(f_workaround, 0) + 15e-1 * coalesce(greatest(f_paid, f_switched, f_abandoned), 0) + 1 * group_p + 0) / 7, 6) AS score
 FROM problems WHERE phase = 'pos' AND domain = 'web'""")
def _(t: Tables):
    rows = t.role("problems")
    evidence = cd.evidence_rows(rows).join(rows.select("comment_id", F.to_json(F.struct(F.col("card_p").alias("concrete_task"), F.col("group_p").alias("behavior_any"))).alias("probabilities_json")), "comment_id")
    return rounded(rp.evidence_scores(evidence.withColumn("lane", F.lit("breadth")), [2, 0.5, 1, 1.5, 1, 1], "breadth", "web").select("comment_id", "score"), "score")


@plan("pub_12_launch_points", with_base("""l AS (SELECT card_id, n, share, CASE WHEN card_id IN ('c01', 'c02') THEN 0 WHEN card_id > 'c22' THEN NULL ELSE paid / 10 END AS ls FROM card), r AS (SELECT *, CASE WHEN ls > 0 THEN ls / share END AS ratio FROM l)
 SELECT card_id, round(log10(share), 6) AS x, round(CASE WHEN coalesce(ls <= 0, true) THEN 0 ELSE log10(ls) END, 6) AS y, coalesce(ls <= 0, true) AS floor, round(ratio, 6) AS ratio, card_id IN (SELECT card_id FROM r WHERE n >= 100 AND ratio IS NOT NULL ORDER BY ratio, card_id LIMIT 8) AS labelled FROM r"""))
def _(t: Tables):
    rows = base(t).withColumn("launch_share", F.expr("case when card_id in ('c01', 'c02') then 0d when card_id > 'c22' then null else paid / 10 end"))
    rows = rows.withColumn("ratio", F.when(F.col("launch_share") > 0, F.col("launch_share") / F.col("share")))
    return rounded(rp.launch_points(rows), "x", "y", "ratio")


@plan("pub_13_significant_movers", with_base("SELECT card_id AS id, round(paid - workaround, 6) AS shrunk, round(paid - workaround, 6) AS est, (n % 10) / 1e2 AS p_adj, card_id < 'c05' AS hollow FROM card WHERE (n % 10) / 1e2 < 5e-2"))
def _(t: Tables):
    rows = base(t).select(F.col("card_id").alias("id"), (F.col("paid") - F.col("workaround")).alias("est"), (F.col("n") % 10 / 1e2).alias("p_adj")).withColumn("shrunk", F.lit(None).cast("double"))
    conc = rows.select("id", F.when(F.col("id") < "c05", 0.6).alias("top3_threads"))
    return rounded(rp.significant_movers(rows, conc), "shrunk", "est")


@plan("pub_14_opportunity_list", with_base("""s AS (SELECT card_id, n, unsolved, paid + severity AS score FROM card), p AS (SELECT card_id, score, row_number() OVER (ORDER BY score DESC, card_id) AS rank FROM s WHERE n >= 200 AND unsolved IS NOT NULL)
 SELECT card_id, round(score, 6) AS score, rank, rank <= 3 AS tied, abs(CAST(substr(card_id, 2, 2) AS INT) - rank) > 5 AS unstable FROM p WHERE rank <= 12"""))
def _(t: Tables):
    rows = base(t).withColumn("score", F.col("paid") + F.col("severity"))
    stability = rows.select("card_id", F.substring("card_id", 2, 2).cast("double").alias("median_rank"))
    return rounded(rp.opportunity_list(rows, stability, "score", {"unsolved": 1.0}, top=12), "score")


@plan("pub_15_bundle_view", with_base("""m AS (SELECT card_id, 'b' || substr(card_id, 3, 1) AS bundle_id, CASE WHEN substr(card_id, 3, 1) IN ('0', '1', '2') THEN 1e0 ELSE 0e0 END AS persistence FROM card), e AS (SELECT a.card_id AS a, b.card_id AS b, round(a.paid + b.paid, 6) AS score FROM card a JOIN card b ON a.card_id < b.card_id)
 SELECT x.bundle_id, a, b, score FROM e JOIN m x ON x.card_id = a JOIN m y ON y.card_id = b WHERE x.bundle_id = y.bundle_id AND x.persistence >= 5e-1"""))
def _(t: Tables):
    rows = base(t)
    members = rows.select("card_id", F.concat(F.lit("b"), F.substring("card_id", 3, 1)).alias("bundle_id"), F.when(F.substring("card_id", 3, 1).isin("0", "1", "2"), 1.0).otherwise(0.0).alias("persistence"))
    a = rows.select(F.col("card_id").alias("a"), F.col("paid").alias("pa"), F.substring("card_id", 3, 1).alias("k"))
    b = rows.select(F.col("card_id").alias("b"), F.col("paid").alias("pb"), F.substring("card_id", 3, 1).alias("k"))
    edges = a.join(b, "k").filter("a < b").select("a", "b", F.round(F.col("pa") + F.col("pb"), 6).alias("score"))
    return rp.bundle_view(members, edges)


@plan("pub_16_breadth_list", with_base("""m0 AS (SELECT card_id, domain, sum(weight) AS w FROM cc GROUP BY 1, 2), m AS (SELECT card_id, domain, w / sum(w) OVER (PARTITION BY card_id) AS share FROM m0), k AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY share DESC, domain) AS r FROM m),
 l AS (SELECT card_id, string_agg(domain || ' ' || CAST(CAST(round(share * 100) AS INT) AS VARCHAR) || '%', ', ' ORDER BY r) AS domains FROM k WHERE r <= 3 GROUP BY 1), h AS (SELECT card_id, -sum(share * log2(share)) AS entropy FROM m GROUP BY 1)
 SELECT card_id, round(entropy, 6) AS entropy, n, domains FROM h JOIN card USING (card_id) JOIN l USING (card_id) WHERE n >= 100"""))
def _(t: Tables):
    mix = es.domain_mix(coded(t)).select("card_id", "domain", "share")
    entropy = mix.groupBy("card_id").agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy")).join(base(t).select("card_id", "n"), "card_id")
    return rounded(rp.breadth_list(entropy, mix), "entropy")


@plan("pub_17_taxonomy_tree", with_base("""SELECT group_id, round(sum(share), 6) AS value, string_agg(card_id, ',' ORDER BY share DESC, card_id) AS cards FROM card GROUP BY 1
 UNION ALL SELECT '__unplaced', round(sum(CASE WHEN card_id IS NULL OR card_id = 'none' THEN weight ELSE 0 END) / sum(weight), 6), '__unplaced' FROM problems"""))
def _(t: Tables):
    rows = base(t)
    groups = rows.groupBy("group_id").agg(F.sum("share").alias("share"))
    none = F.col("card_id").isNull() | (F.col("card_id") == "none")
    unplaced = t.role("problems").agg((F.sum(F.when(none, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("share"))
    return rounded(rp.taxonomy_tree(groups, rows, unplaced).withColumn("cards", F.array_join("cards", ",")), "value")


@plan("pub_18_term_rows", """WITH t AS (SELECT p_brand AS group_id, p_name || '-' || p_type AS term, count(*) AS n_comments, count(DISTINCT p_size) AS n_authors, avg(p_retailprice) AS z FROM part GROUP BY 1, 2)
 SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY z DESC, term) AS position, term, round(z, 6) AS delta, n_comments, n_authors FROM t QUALIFY position <= 8""")
def _(t: Tables):
    terms = t.part.groupBy(F.col("p_brand").alias("group_id"), F.concat_ws("-", "p_name", "p_type").alias("term")).agg(F.count("*").alias("n_comments"), F.countDistinct("p_size").alias("n_authors"), F.avg("p_retailprice").alias("z"))
    return rounded(rp.term_rows(terms.withColumn("lo95", F.col("z") - 2).withColumn("hi95", F.col("z") + 2)), "delta")


@plan("pub_19_method_summary", f"""WITH {LOG}, {RUNS}, {LAB} SELECT 'total_calls' AS item, sum(calls)::DOUBLE AS value FROM runs UNION ALL SELECT 'total_usd', round(sum(calculated_usd), 6) FROM runs UNION ALL SELECT 'runs', count(*) FROM runs
 UNION ALL SELECT 'model:accuracy', round(avg(y), 6) FROM lab""")
def _(t: Tables):
    quality = labelled(t).agg(F.avg("y").alias("value")).select(F.lit("model").alias("system"), F.lit("accuracy").alias("metric"), "value")
    return rounded(rp.method_summary(runs(t), quality), "value")


ROBUST = "rb AS (SELECT role AS run_id, 'screen_wording' AS check_, avg(firsthand_p) AS value FROM problems GROUP BY 1)"


@plan("pub_20_wording_panel", f"WITH {CC}, {ROBUST} SELECT run_id, CASE WHEN run_id IN ('founder', 'student') THEN 'paraphrase' ELSE 'main' END AS kind, round(value, 6) AS value, round(value - 1e-2, 6) AS lo, round(value + 1e-2, 6) AS hi FROM rb")
def _(t: Tables):
    prev = t.role("problems").groupBy(F.col("role").alias("run_id")).agg(F.avg("firsthand_p").alias("value")).withColumn("check", F.lit("screen_wording")).withColumn("metric", F.lit("prevalence"))
    kappa = prev.filter("run_id IN ('founder', 'student')").withColumn("metric", F.lit("kappa"))
    rows = prev.unionByName(kappa).withColumn("lo", F.col("value") - 0.01).withColumn("hi", F.col("value") + 0.01)
    return rounded(rp.wording_panel(rows), "value", "lo", "hi")


@plan("pub_20_quality_panel", f"WITH {LAB} SELECT 'pick' AS label, round(avg(y), 6) AS value, false AS synthetic FROM lab UNION ALL SELECT 'random', round(avg(toxic), 6), false FROM lab UNION ALL SELECT 'firsthand problem f1 score', round(avg(score), 6), true FROM lab")
def _(t: Tables):
    wide = labelled(t).agg(F.avg("y").alias("a"), F.avg("toxic").alias("b"), F.avg("score").alias("c"))
    rows = wide.select(F.explode(F.array(
        F.struct(F.lit("assignment_audit").alias("label_set"), F.lit("precision_strict").alias("metric"), F.lit("pick").alias("system"), F.lit("fits").alias("question_id"), F.col("a").alias("value")),
        F.struct(F.lit("assignment_audit").alias("label_set"), F.lit("precision_strict").alias("metric"), F.lit("random").alias("system"), F.lit("fits").alias("question_id"), F.col("b").alias("value")),
        F.struct(F.lit("synthetic").alias("label_set"), F.lit("f1_score").alias("metric"), F.lit("pick").alias("system"), F.lit("firsthand_problem").alias("question_id"), F.col("c").alias("value")),
    )).alias("r")).select("r.*")
    return rounded(rp.quality_panel(rows), "value")


@plan("pub_21_display_labels", "SELECT c_custkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS display FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_name")
    labels = t.nation.filter("n_nationkey % 3 = 0").select("n_nationkey", F.lower("n_name").alias("short"))
    return rp.display_labels(rows, labels, "n_nationkey", "n_name").select("c_custkey", "display")


@plan("pub_21_missing_labels", "SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def _(t: Tables):
    labels = t.nation.filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return rp.missing_labels(t.customer, labels, "c_nationkey")


FUNNEL = """s AS (SELECT 'all' AS step, count(*) AS count FROM orders UNION ALL SELECT 'eligible', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'screened', count(*) FROM fr
 UNION ALL SELECT 'firsthand', CAST(round_even(sum(weight), 0) AS BIGINT) FROM fr WHERE firsthand UNION ALL SELECT 'placed', CAST(round_even(sum(weight), 0) AS BIGINT) FROM fr WHERE firsthand AND card_id <> 'none')"""


@plan("pub_22_funnel_ratios", f"""WITH {FUNNEL_ROWS}, {FUNNEL}, b AS (SELECT *, CASE step WHEN 'eligible' THEN 'all' WHEN 'screened' THEN 'eligible' WHEN 'firsthand' THEN 'eligible' WHEN 'placed' THEN 'firsthand' END AS base FROM s)
 SELECT b.step, b.count, b.base, round(b.count / x.count, 6) AS ratio FROM b LEFT JOIN s x ON x.step = b.base""")
def _(t: Tables):
    rows = funnel_rows(t)
    steps = cd.funnel(t.orders.withColumn("eligible", F.col("o_orderstatus") != "P"), rows, rows)
    return rounded(rp.funnel_ratios(steps), "ratio")


@plan("pub_23_card_profiles", with_base("SELECT card_id, n, round(share, 6) AS share, round(paid, 6) AS coping_paid, round(workaround, 6) AS coping_workaround, round(unsolved, 6) AS replies_unsolved, round(severity, 6) AS quality_severity FROM card"))
def _(t: Tables):
    rows = base(t)
    out = rp.card_profiles(rows.select("card_id", "n", "share"), {
        "coping": rows.select("card_id", "paid", "workaround"), "replies": rows.filter("unsolved IS NOT NULL").select("card_id", "unsolved"),
        "quality": rows.select("card_id", "severity"),
    })
    return rounded(out, "share", "coping_paid", "coping_workaround", "replies_unsolved", "quality_severity")
