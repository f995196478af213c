"""Card plans (CRD) over the coded order reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.functions.hashing import half_split
from threadgauge.operators import cards as cd
from threadgauge.plans.registry import Tables, plan
from threadgauge.plans.roles import cte

PROBLEMS = f"problems AS ({cte('problems')})"
CC = f"{PROBLEMS}, cc AS (SELECT * FROM problems WHERE card_id <> 'none' AND card_p >= 5e-1)"
UNSTATED = "('other','mixed','unclear')"


def coded(t: Tables):
    rows = t.role("problems")
    return cd.card_comments(rows.select("comment_id", "card_id", "card_p"), rows.drop("card_id", "card_p"))


@plan("crd_01_card_comments", f"WITH {CC} SELECT comment_id, card_id, card_p, author, story_id, weight FROM cc")
def _(t: Tables):
    rows = t.role("problems")
    out = cd.card_comments(rows.select("comment_id", "card_id", "card_p"), rows.select("comment_id", "author", "story_id"), rows)
    return out.select("comment_id", "card_id", "card_p", "author", "story_id", "weight")


def rate(c: str) -> str:
    return f"count(*) FILTER (f_{c} >= 5e-1) / nullif(count(f_{c}), 0)::DOUBLE"


METRICS = f"""base AS (SELECT card_id, count(*) AS n_comments, count(DISTINCT author) AS n_authors, count(DISTINCT story_id) AS n_threads, count(DISTINCT period) AS n_periods,
 count(DISTINCT CASE WHEN period <= 'P06' THEN 'H1' ELSE 'H2' END) AS n_halfyears, count(DISTINCT domain) FILTER (domain NOT IN {UNSTATED}) AS n_domains, count(DISTINCT role) FILTER (role NOT IN {UNSTATED}) AS n_roles,
 {rate('workaround')} AS workaround_rate, {rate('paid')} AS paid_rate, {rate('switched')} AS switched_rate, {rate('abandoned')} AS abandoned_rate,
 count(*) FILTER (resolution = 'unresolved') / count(resolution)::DOUBLE AS unresolved_rate, avg(specificity) AS mean_specificity, sum(weight) AS weighted_n, min(period) AS first_period, max(period) AS last_period FROM cc GROUP BY 1),
 ath AS (SELECT card_id, author, count(*) AS n FROM cc GROUP BY ALL), cap AS (SELECT card_id, CAST(sum(CASE WHEN author IS NULL THEN n ELSE least(n, 3) END) AS BIGINT) AS n_comments_capped, max(n) FILTER (author IS NOT NULL) AS ma FROM ath GROUP BY 1),
 thr AS (SELECT card_id, max(n) AS mt FROM (SELECT card_id, story_id, count(*) AS n FROM cc GROUP BY ALL) GROUP BY 1),
 metrics AS (SELECT base.*, greatest(paid_rate, switched_rate, abandoned_rate) AS commercial_rate, n_comments_capped, mt / n_comments AS max_thread_share, ma / n_comments AS max_author_share FROM base JOIN cap USING (card_id) JOIN thr USING (card_id))"""
ROUNDED = ["workaround_rate", "paid_rate", "switched_rate", "abandoned_rate", "unresolved_rate", "mean_specificity", "commercial_rate", "max_thread_share", "max_author_share"]


def rounded(df, cols, digits: int = 6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


def round_sql(cols, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@plan("crd_02_card_metrics", f"WITH {CC}, {METRICS} SELECT * REPLACE ({round_sql(ROUNDED)}) FROM metrics")
def _(t: Tables):
    return rounded(cd.card_metrics(coded(t)).drop("unsolved_rate"), ROUNDED)


@plan("crd_03_author_capped", f"WITH {CC}, {METRICS} SELECT card_id, n_comments_capped FROM cap")
def _(t: Tables):
    return cd.capped_counts(coded(t), 3)


@plan("crd_04_max_shares", f"WITH {CC}, {METRICS} SELECT card_id, round(max_thread_share, 6) AS max_thread_share, round(max_author_share, 6) AS max_author_share FROM metrics")
def _(t: Tables):
    return rounded(cd.concentration_shares(coded(t)), ["max_thread_share", "max_author_share"])


@plan("crd_05_commercial_rate", f"WITH {PROBLEMS} SELECT comment_id, greatest(f_paid, f_switched, f_abandoned) AS commercial FROM problems")
def _(t: Tables):
    return t.role("problems").select("comment_id", cd.commercial(F.col("f_paid"), F.col("f_switched"), F.col("f_abandoned")).alias("commercial"))


REPLIES = "replies AS (SELECT (event_id * 7) % 15000 AS comment_id, CAST(floor(value) AS BIGINT) % 101 / 1e2 AS solved_p FROM events)"


def replies(t: Tables):
    return t.events.select(((F.col("event_id") * 7) % 15000).alias("comment_id"), F.expr("cast(floor(value) as bigint) % 101 / 1e2").alias("solved_p"))


@plan("crd_06_unsolved_rate", f"WITH {CC}, {REPLIES}, b AS (SELECT comment_id, max(solved_p) AS s FROM replies GROUP BY 1) SELECT card_id, round(avg(CASE WHEN s >= 5e-1 THEN 0e0 ELSE 1e0 END), 6) AS unsolved_rate FROM cc JOIN b USING (comment_id) GROUP BY 1")
def _(t: Tables):
    return rounded(cd.unsolved_rates(coded(t), replies(t)), ["unsolved_rate"])


@plan("crd_07_card_domain_matrix", f"WITH {CC} SELECT card_id, domain, count(DISTINCT author) AS n_authors FROM cc WHERE domain NOT IN {UNSTATED} GROUP BY ALL")
def _(t: Tables):
    return cd.category_matrix(coded(t), "domain")


def eff(c: str) -> str:
    return f"(SELECT card_id, exp(-sum(p * ln(p))) AS effective_{c}s FROM (SELECT card_id, n / sum(n) OVER (PARTITION BY card_id) AS p FROM (SELECT card_id, count(DISTINCT author) AS n FROM src WHERE {c} NOT IN {UNSTATED} GROUP BY card_id, {c})) WHERE p > 0 GROUP BY 1)"


def conv(src: str) -> str:
    return f"SELECT card_id, coalesce(effective_domains, 0) AS effective_domains, coalesce(effective_roles, 0) AS effective_roles FROM (SELECT DISTINCT card_id FROM {src}) LEFT JOIN {eff('domain').replace('src', src)} USING (card_id) LEFT JOIN {eff('role').replace('src', src)} USING (card_id)"


@plan("crd_08_convergence", f"WITH {CC}, conv AS ({conv('cc')}) SELECT card_id, round(effective_domains, 6) AS effective_domains, round(effective_roles, 6) AS effective_roles FROM conv")
def _(t: Tables):
    return rounded(cd.convergence(coded(t)), ["effective_domains", "effective_roles"])


HALF = "CASE WHEN CAST('0x' || substr(sha256('v1:' || CAST(story_id AS VARCHAR)), 1, 2) AS INT) % 2 = 0 THEN 'explore' ELSE 'confirm' END"


def halves(t: Tables):
    return coded(t).withColumn("split", half_split("story_id", "v1"))


def half_metrics(name: str) -> str:
    out = METRICS.replace("FROM cc", f"FROM cc_{name}")
    for k in ("base", "ath", "cap", "thr", "metrics"):
        out = out.replace(f"{k} AS (", f"{k}_{name} AS (").replace(f"FROM {k} ", f"FROM {k}_{name} ").replace(f"JOIN {k} ", f"JOIN {k}_{name} ").replace(f"{k}.*", f"{k}_{name}.*")
    return f"cc_{name} AS (SELECT * FROM cc WHERE {HALF} = '{name}'), {out}"


def fails(name: str) -> str:
    return f"list_filter([CASE WHEN n_authors IS NULL OR n_authors < 10 THEN '{name}: n_authors' END, CASE WHEN n_periods < 3 THEN '{name}: n_periods' END, CASE WHEN n_domains < 2 THEN '{name}: n_domains' END, CASE WHEN max_thread_share > 3e-2 THEN '{name}: max_thread_share' END], lambda x: x IS NOT NULL)"


GATE = f"""ge AS (SELECT card_id, {fails('explore')} AS e FROM metrics_explore), gc AS (SELECT card_id, {fails('confirm')} AS c FROM metrics_confirm),
 gate AS (SELECT card_id, list_concat(coalesce(e, ['explore: missing']), coalesce(c, ['confirm: missing'])) AS reasons, coalesce(len(e) = 0, false) AS passes_explore, coalesce(len(c) = 0, false) AS passes_confirm FROM ge FULL JOIN gc USING (card_id))"""
STRICT = {**cd.CRITERIA, "max_thread_share": ("max", 0.03)}


@plan("crd_09_finding_gate", f"WITH {CC}, {half_metrics('explore')}, {half_metrics('confirm')}, {GATE} SELECT card_id, array_to_string(reasons, ';') AS reasons, passes_explore, passes_confirm, passes_explore AND passes_confirm AS candidate FROM gate")
def _(t: Tables):
    rows = halves(t)
    out = cd.finding_gate(cd.card_metrics(rows.filter("split = 'explore'")), cd.card_metrics(rows.filter("split = 'confirm'")), STRICT)
    return out.withColumn("reasons", F.array_join("reasons", ";"))


def rank_sql(metrics: str, conv_name: str) -> str:
    parts = []
    for c, w in cd.RANKING_WEIGHTS.items():
        parts.append(f"{w} * coalesce(CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE END, 0)::DOUBLE")
    return f"SELECT card_id, score, row_number() OVER (ORDER BY score DESC, card_id) AS rank FROM (SELECT card_id, {' + '.join(parts)} AS score FROM (SELECT *, n_comments_capped AS n_authors_capped FROM {metrics}) JOIN {conv_name} USING (card_id))"


@plan("crd_10_rank_cards", f"WITH {CC}, {METRICS}, conv AS ({conv('cc')}), r AS ({rank_sql('metrics', 'conv')}) SELECT card_id, round(score, 6) AS score, rank FROM r")
def _(t: Tables):
    rows = coded(t)
    out = cd.rank_cards(cd.ranking_inputs(cd.card_metrics(rows), cd.convergence(rows)))
    return out.select("card_id", F.round("score", 6).alias("score"), "rank")


@plan("crd_11_ranking_inputs", f"WITH {CC}, {METRICS}, conv AS ({conv('cc')}) SELECT card_id, n_comments_capped AS n_authors_capped, round(commercial_rate, 6) AS commercial_rate, round(effective_domains, 6) AS effective_domains FROM metrics JOIN conv USING (card_id)")
def _(t: Tables):
    rows = coded(t)
    out = cd.ranking_inputs(cd.card_metrics(rows), cd.convergence(rows))
    return rounded(out.select("card_id", "n_authors_capped", "commercial_rate", "effective_domains"), ["commercial_rate", "effective_domains"])


@plan("crd_12_findings", f"""WITH {CC}, {METRICS}, {half_metrics('explore')}, {half_metrics('confirm')}, conv AS ({conv('cc_explore')}), r AS ({rank_sql('metrics_explore', 'conv')}), {GATE.replace('3e-2', '30e-2')},
 d AS (SELECT card_id, domain AS top_domain FROM (SELECT card_id, domain, sum(weight) AS w FROM cc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY w DESC, domain) = 1),
 k AS (SELECT card_id, count(*) FILTER (verified_p < 5e-1) AS contradicting_n FROM cc GROUP BY 1)
 SELECT card_id AS finding_id, row_number() OVER (ORDER BY rank NULLS LAST, card_id) AS position, top_domain, n_comments, n_authors, n_threads, n_periods AS months_present,
 CASE WHEN passes_explore AND passes_confirm THEN 'validated' ELSE 'candidate' END AS status, contradicting_n > 0 AS contradicting, contradicting_n, round(max_thread_share, 6) AS max_thread_share
 FROM metrics LEFT JOIN r USING (card_id) LEFT JOIN gate USING (card_id) LEFT JOIN k USING (card_id) LEFT JOIN d USING (card_id) QUALIFY position <= 20""")
def _(t: Tables):
    return rounded(cd.findings(halves(t), half="split").drop("unknowns_json"), ["max_thread_share"])


@plan("crd_13_evidence", f"""WITH {PROBLEMS}, e AS (SELECT *, greatest(f_paid, f_switched, f_abandoned) AS consequence_any_p, least(greatest(specificity / 3e0, 0e0), 1e0) AS sn FROM problems WHERE phase = 'pos')
 SELECT comment_id, domain, nullif(card_id, 'none') AS subtopic, period, story_id, firsthand_p, specificity, f_workaround AS workaround_p, consequence_any_p,
 round(list_avg([firsthand_p, f_workaround, consequence_any_p, sn]), 6) AS evidence_strength, weight FROM e""")
def _(t: Tables):
    return rounded(cd.evidence_rows(t.role("problems")), ["evidence_strength"])


@plan("crd_14_finding_evidence", f"WITH {CC} SELECT card_id AS finding_id, comment_id, card_p AS match_p, CASE WHEN verified_p < 5e-1 THEN 'contradicting' ELSE 'supporting' END AS role FROM cc")
def _(t: Tables):
    return cd.finding_evidence(coded(t))


def best(key: str) -> str:
    return f"SELECT card_id, sum(w) AS score FROM (SELECT card_id, coalesce('k' || CAST({key} AS VARCHAR), 'c' || CAST(comment_id AS VARCHAR)) AS k, max(weight) AS w FROM cc GROUP BY ALL) GROUP BY 1"


@plan("crd_15_spec_ranks", f"""WITH {CC}, s AS (SELECT 'main' AS spec, card_id, sum(weight) AS score FROM cc GROUP BY card_id UNION ALL SELECT 'strict', card_id, sum(weight) FROM cc WHERE card_p >= 7e-1 GROUP BY card_id
 UNION ALL SELECT 'one_per_thread', * FROM ({best('story_id')}) UNION ALL SELECT 'one_per_author', * FROM ({best('author')}) UNION ALL SELECT 'para1', card_id, count(*) FROM problems WHERE card_id <> 'none' AND comment_id % 3 = 0 GROUP BY card_id),
 g AS (SELECT spec, card_id, coalesce(score, 0) AS score FROM (SELECT spec, card_id FROM (SELECT DISTINCT spec FROM s), (SELECT DISTINCT card_id FROM problems WHERE card_id <> 'none')) LEFT JOIN s USING (spec, card_id)),
 r AS (SELECT *, rank() OVER (PARTITION BY spec ORDER BY score DESC) AS rank, row_number() OVER (PARTITION BY spec ORDER BY score DESC, card_id) AS p FROM g)
 SELECT spec, card_id, rank FROM r WHERE card_id IN (SELECT card_id FROM r WHERE spec <> 'main' AND p <= 8 AND score > 0)""")
def _(t: Tables):
    rows = t.role("problems")
    every = rows.filter("card_id <> 'none'").select("card_id").distinct()
    return cd.spec_ranks(coded(t), every, top=8, extra={"para1": rows.filter("comment_id % 3 = 0")})


@plan("crd_16_entity_counts", f"""WITH {CC}, t AS (SELECT group_id, story_id, sum(weight) AS w FROM cc GROUP BY ALL) SELECT group_id, count(*) AS n_problems, count(DISTINCT author) AS n_authors, count(DISTINCT story_id) AS n_threads,
 (SELECT round(max(w) / sum(w), 6) FROM t WHERE t.group_id = cc.group_id) AS top_thread_share FROM cc GROUP BY 1""")
def _(t: Tables):
    return rounded(cd.entity_counts(coded(t), "group_id"), ["top_thread_share"])


FUNNEL_ROWS = f"{PROBLEMS}, fr AS (SELECT *, phase = 'pos' AND firsthand_p >= 5e-1 AS firsthand FROM problems)"


def funnel_rows(t: Tables):
    return t.role("problems").withColumn("firsthand", F.expr("phase = 'pos' AND firsthand_p >= 0.5"))


@plan("crd_17_funnel", f"""WITH {FUNNEL_ROWS} SELECT 'all' AS step, count(*) AS count FROM orders UNION ALL SELECT 'eligible', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'screened', count(*) FROM fr
 UNION ALL SELECT 'firsthand', CAST(round_even(sum(weight), 0) AS BIGINT) FROM fr WHERE firsthand UNION ALL SELECT 'placed', CAST(round_even(sum(weight), 0) AS BIGINT) FROM fr WHERE firsthand AND card_id <> 'none'""")
def _(t: Tables):
    rows = funnel_rows(t)
    return cd.funnel(t.orders.withColumn("eligible", F.col("o_orderstatus") != "P"), rows, rows)


@plan("crd_17_period_funnel", f"WITH {FUNNEL_ROWS} SELECT period, n AS comments, round(s, 6) AS firsthand_share FROM (SELECT period, count(*) AS n FROM problems GROUP BY 1) JOIN (SELECT period, sum(CASE WHEN firsthand THEN weight ELSE 0 END) / sum(weight) AS s FROM fr GROUP BY 1) USING (period)")
def _(t: Tables):
    return rounded(cd.period_funnel(t.role("problems"), funnel_rows(t)), ["firsthand_share"])


DIFFS = f"{PROBLEMS}, d AS (SELECT card_id AS id, round(avg(card_p) - 5e-1, 6) AS share, (count(*) % 100) / 1e3 AS p_adj FROM problems WHERE card_id <> 'none' GROUP BY 1)"


@plan("crd_18_change_rows", f"""WITH {DIFFS}, s AS (SELECT *, row_number() OVER (PARTITION BY sign(share) ORDER BY abs(share) DESC, id) AS n FROM d WHERE p_adj < 5e-2 AND share <> 0), k AS (SELECT id FROM s WHERE n <= 8),
 f AS (SELECT id FROM d WHERE id NOT IN (SELECT id FROM k) ORDER BY abs(share) DESC, id LIMIT greatest(0, 15 - (SELECT count(*) FROM k)))
 SELECT id, share, p_adj, id IN (SELECT id FROM k) AS significant FROM d WHERE id IN (SELECT id FROM k) OR id IN (SELECT id FROM f)""")
def _(t: Tables):
    rows = t.role("problems").filter("card_id <> 'none'")
    diffs = rows.groupBy(F.col("card_id").alias("id")).agg(F.round(F.avg("card_p") - 0.5, 6).alias("share"), (F.count("*") % 100 / 1e3).alias("p_adj"))
    return cd.change_rows(diffs, min_sig=15)


@plan("crd_19_card_domain_counts", f"""WITH {CC}, top AS (SELECT card_id FROM cc GROUP BY 1 ORDER BY count(DISTINCT author) DESC, card_id LIMIT 6), c AS (SELECT card_id, domain, count(*) AS n FROM cc WHERE card_id IN (SELECT card_id FROM top) AND phase = 'pos' GROUP BY ALL),
 k AS (SELECT domain FROM c GROUP BY 1 ORDER BY sum(n) DESC, domain LIMIT 4) SELECT card_id, domain, n FROM c WHERE domain IN (SELECT domain FROM k)""")
def _(t: Tables):
    rows = coded(t)
    metrics = rows.groupBy("card_id").agg(F.countDistinct("author").alias("n_authors"))
    return cd.card_domain_counts(cd.evidence_rows(t.role("problems")), rows.select("card_id", "comment_id"), metrics, 6, 4)
