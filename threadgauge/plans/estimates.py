"""Estimation plans (EST, TST): bootstrap twins recompute every hash draw in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.operators import bootstrap as bs
from threadgauge.operators import estimate as es
from threadgauge.operators import robust as rb
from threadgauge.plans.registry import Tables, plan
from threadgauge.plans.roles import cte, h32, h60

R = 1000  # shares, tools and launches
R_PPI = 2000
PROBLEMS = f"problems AS ({cte('problems')})"


def boot(name: str, src: str, keys: list[str], values: list[str], n_rep: int = R, seed: int = 0, fewer: int = 0) -> str:
    """CTEs giving ``<name>(rep, keys, values)`` from ``src(stratum, cluster, keys, values)``, strata of one block."""
    k = "".join(f"{c}, " for c in keys)
    p = name

    def mixed(x: str) -> str:
        return f"(xor({x} >> 16, {x}) * {bs.MIX}) % 4294967296"

    return f"""{p}_u AS (SELECT coalesce(CAST(stratum AS VARCHAR), '') AS stratum, coalesce(CAST(cluster AS VARCHAR), '') AS cluster, {k}{', '.join(f'sum({v})::DOUBLE AS {v}' for v in values)} FROM {src} GROUP BY ALL),
 {p}_ids AS (SELECT stratum, cluster, row_number() OVER (PARTITION BY stratum ORDER BY {h60(str(seed), 'stratum', 'cluster')}, cluster) - 1 AS pos FROM (SELECT DISTINCT stratum, cluster FROM {p}_u)),
 {p}_m AS (SELECT stratum, count(*) AS m FROM {p}_ids GROUP BY 1),
 {p}_x AS (SELECT stratum, rep, m, ({h32(str(seed), 'rep', 'stratum', '0')} + unnest(range(m - {fewer})) * {bs.STEP}) % 4294967296 AS x0 FROM {p}_m, (SELECT unnest(range({n_rep})) AS rep)),
 {p}_y AS (SELECT stratum, rep, m, {mixed('x0')} AS x1 FROM {p}_x), {p}_z AS (SELECT stratum, rep, m, {mixed('x1')} AS x2 FROM {p}_y),
 {p}_h AS (SELECT rep, stratum, xor(x2 >> 16, x2) % m AS pos, count(*) AS c FROM {p}_z GROUP BY ALL),
 {p}_s AS (SELECT rep, {k}{', '.join(f'sum(c * {v}) AS {v}' for v in values)} FROM (SELECT * FROM {p}_h JOIN {p}_ids USING (stratum, pos) JOIN {p}_u USING (stratum, cluster)) GROUP BY ALL),
 {p}_g AS (SELECT g.rep AS grep, {''.join(f'e.{c} AS g_{c}, ' for c in keys)}s.* FROM (SELECT unnest(range({n_rep})) AS rep) g CROSS JOIN (SELECT DISTINCT {k}1 AS one FROM {p}_u) e LEFT JOIN {p}_s s ON s.rep = g.rep{''.join(f' AND s.{c} IS NOT DISTINCT FROM e.{c}' for c in keys)}),
 {p} AS (SELECT grep AS rep, {''.join(f'g_{c} AS {c}, ' for c in keys)}{', '.join(f'coalesce({v}, 0) AS {v}' for v in values)} FROM {p}_g
 UNION ALL SELECT -1 AS rep, {k}{', '.join(f'sum({v}) AS {v}' for v in values)} FROM {p}_u GROUP BY ALL)"""


def ci(value: str, src: str, keys: str, n: str | None = None, digits: int = 6) -> str:
    """SELECT of the interval; keys with a trailing comma or empty."""
    q = {"lo95": 0.025, "lo50": 0.25, "hi50": 0.75, "hi95": 0.975}
    cols = ", ".join(f"round(quantile_cont(CASE WHEN rep >= 0 THEN {value} END, {p}), {digits}) AS {c}" for c, p in q.items())
    count = f", CAST(max(CASE WHEN rep = -1 THEN {n} END) AS BIGINT) AS n" if n else ""
    return f"SELECT {keys}round(max(CASE WHEN rep = -1 THEN {value} END), {digits}) AS est, {cols}{count} FROM {src} GROUP BY ALL"


def rounded(df, *cols: str, digits: int = 6):
    cols = cols or ("est", "lo95", "lo50", "hi50", "hi95")
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


def coded(t: Tables):
    rows = t.role("problems").withColumn("cluster", F.col("story_id"))
    real = (F.col("card_p") >= 0.5) & (F.col("card_id") != "none")
    return rows.withColumn("card_id", F.when(real, F.col("card_id"))).withColumn("group_id", F.when(real, F.col("group_id")))


CODED = f"{PROBLEMS}, coded AS (SELECT * REPLACE (CASE WHEN card_p >= 5e-1 AND card_id <> 'none' THEN card_id END AS card_id, CASE WHEN card_p >= 5e-1 AND card_id <> 'none' THEN group_id END AS group_id), story_id AS cluster FROM problems)"


@plan("est_01_unit_collapse", f"WITH {CODED} SELECT stratum, CAST(cluster AS VARCHAR) AS cluster, sum(weight) AS weight FROM coded GROUP BY ALL")
def _(t: Tables):
    return bs.collapse(coded(t), ["weight"])


LARGE = "line AS (SELECT l_returnflag AS stratum, l_orderkey AS cluster, l_quantity AS q, l_quantity * CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS o FROM lineitem)"


def line(t: Tables):
    return t.lineitem.select(
        F.col("l_returnflag").alias("stratum"), F.col("l_orderkey").alias("cluster"), F.col("l_quantity").alias("q"),
        (F.col("l_quantity") * F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("o"),
    )


@plan("est_02_cluster_bootstrap", None)
def _(t: Tables):
    return rounded(bs.resample(line(t), ["q", "o"], n_rep=R_PPI, seed=5), "q", "o", digits=4)


@plan("est_02_bootstrap_many_blocks", None)
def _(t: Tables):
    return rounded(bs.resample(coded(t), ["weight"], ["phase"], n_rep=R_PPI, seed=6, block=64), "weight", digits=4)


@plan("est_02_draws_per_replicate", f"WITH {LARGE}, m AS (SELECT stratum, count(DISTINCT cluster) AS m FROM line GROUP BY 1) SELECT rep, stratum, CAST(m AS DOUBLE) AS units FROM m, (SELECT unnest(range(-1, {R_PPI})) AS rep)")
def _(t: Tables):
    units = line(t).select("stratum", "cluster").distinct().withColumn("units", F.lit(1.0))
    return bs.resample(units, ["units"], ["stratum"], n_rep=R_PPI, seed=5, block=256)


def ratio_sql(num: str, den: str, keys: list[str], src: str = "coded", within: bool = False, seed: int = 0, n_rep: int = R) -> str:
    ks = "".join(f"{k}, " for k in keys)
    stratum = " || '~' || ".join([*keys, "stratum"]) if within else "stratum"
    return f"rs AS (SELECT {stratum} AS stratum, cluster, {ks}weight * ({num}) AS a, weight * ({den}) AS d, CASE WHEN ({num}) > 0 THEN 1 ELSE 0 END AS n FROM {src}), {boot('b', 'rs', keys, ['a', 'd', 'n'], n_rep, seed)}"


FH = "CASE WHEN firsthand_p >= 5e-1 THEN 1 ELSE 0 END"


@plan("est_03_ratio_replicates", f"WITH {CODED}, {ratio_sql(FH, '1', [])} SELECT rep, round(a / d, 9) AS ratio FROM b")
def _(t: Tables):
    out = bs.ratio_replicates(coded(t), {"fh": (F.col("firsthand_p") >= 0.5, F.lit(1.0))}, n_rep=R)
    return out.select("rep", F.round("ratio", 9).alias("ratio"))


@plan("est_04_interval", f"WITH {CODED}, {ratio_sql(FH, '1', ['domain'])} SELECT *, n < 30 AS sparse FROM ({ci('a / d', 'b', 'domain, ', 'n')})")
def _(t: Tables):
    return rounded(bs.ratio_estimates(coded(t), {"fh": (F.col("firsthand_p") >= 0.5, F.lit(1.0))}, by=["domain"], n_rep=R).drop("name"))


@plan("est_05_rao_wu", f"""WITH {CODED}, rw AS (SELECT stratum, cluster, stratum AS h, weight * {FH} * CASE WHEN half = 'H1' THEN 1 ELSE 0 END AS a, weight * CASE WHEN half = 'H1' THEN 1 ELSE 0 END AS w FROM coded),
 {boot('b', 'rw', ['h'], ['a', 'w'], R_PPI, 3, fewer=1)}, f AS (SELECT stratum AS h, count(DISTINCT cluster) AS m, 0.1::DOUBLE AS f FROM coded GROUP BY 1),
 p AS (SELECT h, a AS ta, w AS tw FROM b WHERE rep = -1), s AS (SELECT rep, sum((1 - sqrt(1 - f)) * ta + sqrt(1 - f) * m / (m - 1) * a) / sum((1 - sqrt(1 - f)) * tw + sqrt(1 - f) * m / (m - 1) * w) AS r FROM b JOIN p USING (h) JOIN f USING (h) WHERE rep >= 0 GROUP BY 1)
 SELECT round((SELECT sum(ta) / sum(tw) FROM p), 6) AS estimate, round(quantile_cont(r, 0.025), 6) AS ci_low, round(quantile_cont(r, 0.975), 6) AS ci_high,
 (SELECT count(*) FROM coded WHERE firsthand_p >= 5e-1 AND half = 'H1') AS hits, (SELECT CAST(sum(m) AS BIGINT) FROM f) AS n_clusters FROM s""")
def _(t: Tables):
    rows = coded(t).select(
        "stratum", "cluster", "weight", F.when(F.col("firsthand_p") >= 0.5, 1).otherwise(0).alias("y"),
        F.lit(0.1).alias("fraction"), (F.col("half") == "H1").alias("domain"),
    )
    return rounded(es.rao_wu(rows, n_rep=R_PPI, seed=3).select("estimate", "ci_low", "ci_high", "hits", "n_clusters"), "estimate", "ci_low", "ci_high")


TRUTH = "CASE WHEN (comment_id * 37) % 100 < firsthand_p * 80 + 10 THEN 1 ELSE 0 END"
GOLD = f"{CODED}, gold AS (SELECT *, {TRUTH} AS y, CASE WHEN stratum = '1-URGENT' THEN 25e-2 ELSE 5e-1 END AS sel FROM coded WHERE comment_id % 10 = 3)"


def gold(t: Tables):
    return coded(t).filter("comment_id % 10 = 3").select(
        "stratum", "cluster", "weight", F.col("firsthand_p").alias("yhat"), F.expr(TRUTH).alias("y"),
        F.expr("case when stratum = '1-URGENT' then 0.25d else 0.5d end").alias("sel"), "half", "phase", "comment_id", "domain",
    )


def ppi_sql(keys: list[str], all_src: str, gold_src: str, n_rep: int = R_PPI, seed: int = 0) -> str:
    k = "".join(f"{c}, " for c in keys)
    using = f"USING ({', '.join(['rep', *keys])})"
    return f"""pa AS (SELECT stratum, cluster, {k}weight AS a0, weight * yhat AS a1, weight * yhat * yhat AS a2, weight * weight AS a3 FROM {all_src}),
 pg AS (SELECT stratum, cluster, {k}weight / sel AS g0, weight / sel * y AS gy, weight / sel * yhat AS gf, weight / sel * y * yhat AS gyf, (weight / sel) * (weight / sel) AS gvv FROM {gold_src}),
 {boot('ra', 'pa', keys, ['a0', 'a1', 'a2', 'a3'], n_rep, seed)}, {boot('rg', 'pg', keys, ['g0', 'gy', 'gf', 'gyf', 'gvv'], n_rep, seed + 1)},
 pj AS (SELECT *, a1 / a0 AS naive, gy / g0 AS gold_only, gf / g0 AS mf, a2 / a0 - (a1 / a0) * (a1 / a0) AS var, gyf / g0 - gy / g0 * (gf / g0) AS cov, (g0 * g0 / gvv) / (a0 * a0 / a3) AS kish FROM ra JOIN rg {using}),
 pl AS (SELECT *, least(greatest(coalesce(CASE WHEN var > 1e-12 THEN cov / ((1 + kish) * var) END, 0), 0), 1) AS lam FROM pj), ppi AS (SELECT rep, {k}lam, naive, gold_only, lam * naive + gold_only - lam * mf AS theta FROM pl)"""


ALL_Y = "every AS (SELECT *, firsthand_p AS yhat FROM coded), goldy AS (SELECT *, firsthand_p AS yhat FROM gold)"


@plan("est_06_ppi_mean", f"""WITH {GOLD}, {ALL_Y}, {ppi_sql([], 'every', 'goldy')} SELECT round(max(theta) FILTER (rep = -1), 6) AS estimate, round(quantile_cont(theta, 0.025) FILTER (rep >= 0), 6) AS ci_low,
 round(quantile_cont(theta, 0.975) FILTER (rep >= 0), 6) AS ci_high, round(max(lam) FILTER (rep = -1), 6) AS lam, round(max(naive) FILTER (rep = -1), 6) AS naive, round(max(gold_only) FILTER (rep = -1), 6) AS gold_only FROM ppi""")
def _(t: Tables):
    rows = coded(t).withColumn("yhat", F.col("firsthand_p"))
    return rounded(es.ppi_mean(rows, gold(t), n_rep=R_PPI), "estimate", "ci_low", "ci_high", "lam", "naive", "gold_only")


PAIR_CI = "SELECT round(max(v) FILTER (rep = -1), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (rep >= 0), 6) AS ci_low, round(quantile_cont(v, 0.975) FILTER (rep >= 0), 6) AS ci_high"


@plan("est_07_ppi_ratio", f"""WITH {GOLD}, {ALL_Y}, ev AS (SELECT * REPLACE (CASE WHEN part = 'num' THEN CASE WHEN phase = 'pos' THEN yhat ELSE 0 END ELSE yhat END AS yhat) FROM every, (SELECT unnest(['num', 'den']) AS part)),
 gv AS (SELECT * REPLACE (CASE WHEN part = 'num' AND phase <> 'pos' THEN 0 ELSE yhat END AS yhat, CASE WHEN part = 'num' AND phase <> 'pos' THEN 0 ELSE y END AS y) FROM goldy, (SELECT unnest(['num', 'den']) AS part)), {ppi_sql(['part'], 'ev', 'gv')}
 {PAIR_CI} FROM (SELECT rep, max(theta) FILTER (part = 'num') / max(theta) FILTER (part = 'den') AS v FROM ppi GROUP BY 1)""")
def _(t: Tables):
    part = F.explode(F.array(F.lit("num"), F.lit("den"))).alias("part")
    off = (F.col("part") == "num") & (F.col("phase") != "pos")
    rows = coded(t).withColumn("yhat", F.col("firsthand_p")).select("*", part).withColumn("yhat", F.when(off, 0.0).otherwise(F.col("yhat")))
    labels = gold(t).select("*", part).withColumn("yhat", F.when(off, 0.0).otherwise(F.col("yhat"))).withColumn("y", F.when(off, 0).otherwise(F.col("y")))
    return rounded(es.ppi_pair(rows, labels, "part", "num", "den", "ratio", n_rep=R_PPI), "estimate", "ci_low", "ci_high")


@plan("est_08_ppi_difference", f"WITH {GOLD}, {ALL_Y}, {ppi_sql(['half'], 'every', 'goldy')} {PAIR_CI} FROM (SELECT rep, max(theta) FILTER (half = 'H2') - max(theta) FILTER (half = 'H1') AS v FROM ppi GROUP BY 1)")
def _(t: Tables):
    rows = coded(t).withColumn("yhat", F.col("firsthand_p"))
    return rounded(es.ppi_pair(rows, gold(t), "half", "H1", "H2", "difference", n_rep=R_PPI), "estimate", "ci_low", "ci_high")


def shares_sql(name: str, src: str, level: str, bucket: str, within: bool, n_rep: int = R, seed: int = 0) -> str:
    """Twin of share_replicates; ``bucket`` is a list expression."""
    stratum = "bucket || '~' || stratum" if within else "stratum"
    return f"""{name}_b AS (SELECT *, unnest({bucket}) AS bucket FROM {src}), {name}_l AS (SELECT {stratum} AS stratum, cluster, bucket, unnest(['*', {level}]) AS id, weight AS x, 1 AS n FROM {name}_b WHERE bucket IS NOT NULL),
 {name}_f AS (SELECT * FROM {name}_l WHERE id IS NOT NULL), {boot(name + '_t', name + '_f', ['bucket', 'id'], ['x', 'n'], n_rep, seed)},
 {name} AS (SELECT t.rep, t.bucket, t.id, t.x / nullif(d.x, 0) AS share, t.n FROM {name}_t t JOIN {name}_t d ON d.rep = t.rep AND d.bucket = t.bucket AND d.id = '*' WHERE t.id <> '*')"""


PERIODS = "['all', period]"
HALVES = "['all', half]"
PANEL = "['all', lower(half), 'q' || CAST((CAST(substr(period, 2, 2) AS INT) - 1) // 3 + 1 AS VARCHAR), period]"


@plan("est_09_domain_shares", f"""WITH {GOLD}, fr AS (SELECT *, firsthand_p >= 5e-1 AS firsthand FROM coded), fh AS (SELECT * FROM fr WHERE firsthand), {shares_sql('sh', 'fh', 'domain', PERIODS, True)}, nv AS ({ci('share', 'sh', 'bucket, id, ', 'n', 12)}),
 gl AS (SELECT fr.*, y = 1 AS fh, CASE WHEN comment_id % 20 = 3 THEN fr.domain ELSE 'web' END AS gd, sel FROM fr JOIN (SELECT comment_id, y, sel FROM gold) USING (comment_id)), ids AS (SELECT unnest(['web', 'data', 'hardware', 'work', 'money', 'other']) AS id, unnest(['num', 'den', 'num', 'den', 'num', 'den']) AS dummy),
 ex AS (SELECT *, unnest({PERIODS}) AS bucket FROM fr), ev AS (SELECT bucket || '~' || stratum AS stratum, cluster, bucket, id, part, weight, CASE WHEN firsthand AND (part = 'den' OR domain = id) THEN 1e0 ELSE 0e0 END AS yhat FROM ex, (SELECT id FROM ids), (SELECT unnest(['num', 'den']) AS part)),
 gx AS (SELECT *, unnest({PERIODS}) AS bucket FROM gl), gv AS (SELECT bucket || '~' || stratum AS stratum, cluster, bucket, id, part, weight, sel, CASE WHEN firsthand AND (part = 'den' OR domain = id) THEN 1e0 ELSE 0e0 END AS yhat, CASE WHEN fh AND (part = 'den' OR gd = id) THEN 1e0 ELSE 0e0 END AS y
 FROM gx, (SELECT id FROM ids), (SELECT unnest(['num', 'den']) AS part)), {ppi_sql(['bucket', 'id', 'part'], 'ev', 'gv', R)},
 rt AS (SELECT rep, bucket, id, max(theta) FILTER (part = 'num') / nullif(max(theta) FILTER (part = 'den'), 0) AS v FROM ppi GROUP BY ALL), pp AS ({ci('v', 'rt', 'bucket, id, ', None, 12)}), gc AS (SELECT bucket, count(*) AS n_gold FROM gx GROUP BY 1)
 SELECT id AS domain, bucket AS period, n, round(CASE WHEN n_gold >= 120 AND pp.est IS NOT NULL THEN pp.est ELSE nv.est END, 6) AS weighted_share, CASE WHEN n >= 30 THEN round(CASE WHEN n_gold >= 120 AND pp.est IS NOT NULL THEN pp.lo95 ELSE nv.lo95 END, 6) END AS ci_low,
 CASE WHEN n >= 30 THEN round(CASE WHEN n_gold >= 120 AND pp.est IS NOT NULL THEN pp.hi95 ELSE nv.hi95 END, 6) END AS ci_high, n < 30 AS too_few, CASE WHEN n_gold >= 120 THEN 'PPI-corrected with ' || n_gold || ' gold labels' ELSE 'model labels only' END AS qualifier
 FROM nv LEFT JOIN pp USING (bucket, id) LEFT JOIN gc USING (bucket)""")
def _(t: Tables):
    rows = coded(t).withColumn("firsthand", F.col("firsthand_p") >= 0.5)
    labels = gold(t).select("comment_id", (F.col("y") == 1).alias("fh"), F.expr("if(comment_id % 20 = 3, domain, 'web')").alias("gold_domain"), "sel")
    return rounded(es.domain_shares(rows, labels, min_gold=120, n_rep=R), "weighted_share", "ci_low", "ci_high")


def bh(src: str, keys: str, p: str = "p") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"SELECT *, least(1, min(raw) OVER ({part} ORDER BY {p} DESC, r DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM (SELECT *, {p} * count(*) OVER ({part}) / r AS raw FROM (SELECT *, row_number() OVER ({part} ORDER BY {p}) AS r FROM {src}))"


PV = "least(1, 2 * (1 + least(count(*) FILTER (rep >= 0 AND {v} <= 0), count(*) FILTER (rep >= 0 AND {v} >= 0))) / (count({v}) FILTER (rep >= 0) + 1))"


def taxonomy_sql() -> str:
    ctes, selects = [], []
    for i, (pop, cond) in enumerate((("pos", "phase = 'pos'"), ("pos+neg", "true"))):
        for j, level in enumerate(("group_id", "card_id")):
            n = f"t{i}{j}"
            ctes.append(f"{n}_src AS (SELECT * FROM coded WHERE {cond}), {shares_sql(n + 'w', n + '_src', level, HALVES, True)}, {shares_sql(n + 's', n + '_src', level, HALVES, False)}")
            ctes.append(f"{n}_d AS (SELECT rep, id, max(share) FILTER (bucket = 'H2') - max(share) FILTER (bucket = 'H1') AS diff FROM {n}s GROUP BY ALL)")
            ctes.append(f"{n}_p AS (SELECT id, {PV.format(v='diff')} AS p FROM {n}_d GROUP BY 1), {n}_q AS ({bh(n + '_p', '')})")
            ctes.append(f"{n}_a AS (SELECT bucket, {level} AS id, count(DISTINCT author) AS n_authors FROM {n}w_b GROUP BY ALL)")
            selects.append(f"SELECT '{pop}' AS population, '{level}' AS level, bucket, id, est AS share, lo95, hi95, n, coalesce(n_authors, 0) AS n_authors, NULL AS p_adj FROM ({ci('share', n + 'w', 'bucket, id, ', 'n')}) LEFT JOIN {n}_a USING (bucket, id)")
            selects.append(f"SELECT '{pop}', '{level}', 'H2_minus_H1', id, est, lo95, hi95, n, n_authors, round(p_adj, 6) FROM ({ci('diff', n + '_d', 'id, ')}) JOIN {n}_q USING (id) JOIN (SELECT id, CAST(max(n) AS BIGINT) AS n FROM {n}w WHERE bucket = 'all' AND rep = -1 GROUP BY 1) USING (id) JOIN (SELECT id, n_authors FROM {n}_a WHERE bucket = 'all') USING (id)")
    return f"WITH {CODED}, {', '.join(ctes)} {' UNION ALL '.join(selects)}"


@plan("est_10_taxonomy_shares", taxonomy_sql())
def _(t: Tables):
    return rounded(es.taxonomy_shares(coded(t), n_rep=R), "share", "lo95", "hi95", "p_adj")


@plan("est_11_share_panel", f"WITH {CODED}, {shares_sql('sh', 'coded', 'group_id', PANEL, False)} SELECT *, n < 30 AS sparse FROM ({ci('share', 'sh', 'bucket, id, ', 'n')})")
def _(t: Tables):
    return rounded(es.share_panel(coded(t), "group_id", n_rep=R))


CHANGES = f"""{shares_sql('sh', 'coded', 'card_id', HALVES, False)}, df AS (SELECT rep, id, max(share) FILTER (bucket = 'H2') - max(share) FILTER (bucket = 'H1') AS diff FROM sh GROUP BY ALL),
 cb AS (SELECT id, max(diff) FILTER (rep = -1) AS est, quantile_cont(diff, 0.025) FILTER (rep >= 0) AS lo95, quantile_cont(diff, 0.975) FILTER (rep >= 0) AS hi95, stddev_pop(diff) FILTER (rep >= 0) AS se, {PV.format(v='diff')} AS p FROM df GROUP BY 1),
 ct AS (SELECT greatest(0, var_pop(est) - avg(se * se)) AS tau2 FROM cb), ch AS (SELECT *, tau2 / (tau2 + se * se) AS factor, est * tau2 / (tau2 + se * se) AS shrunk FROM ({bh('cb', '')}), ct)"""


def change_reps(t: Tables):
    return es.difference(bs.share_replicates(coded(t), "card_id", es.half_buckets(), n_rep=R), "H1", "H2")


@plan("est_12_changes", f"WITH {CODED}, {CHANGES} SELECT id, round(est, 6) AS est, round(lo95, 6) AS lo95, round(hi95, 6) AS hi95, round(p_adj, 6) AS p_adj, round(shrunk, 6) AS shrunk FROM ch")
def _(t: Tables):
    return rounded(es.changes(change_reps(t)).drop("factor"), "est", "lo95", "hi95", "p_adj", "shrunk")


def roles_sql() -> str:
    unp = "CASE WHEN card_id IS NULL THEN 1 ELSE 0 END"
    st = "CASE WHEN role <> 'unclear' THEN 1 ELSE 0 END"
    one = ratio_sql(unp, "1", []).replace("rs AS", "rs1 AS").replace("FROM rs ", "FROM rs1 ").replace("b_", "b1_").replace(" b AS", " b1 AS")
    two = ratio_sql(st, "1", ["group_id"]).replace("rs AS", "rs2 AS").replace("FROM rs ", "FROM rs2 ").replace("b_", "b2_").replace(" b AS", " b2 AS")
    return f"""WITH {CODED}, {one}, {two}, un AS (SELECT * FROM coded WHERE card_id IS NULL), sd AS (SELECT * FROM coded WHERE role <> 'unclear' AND group_id IS NOT NULL),
 {shares_sql('ud', 'un', 'domain', "['all']", False)}, {shares_sql('ur', 'un', 'role', "['all']", False)}, {shares_sql('gr', 'sd', 'role', '[group_id]', False)}
 SELECT 'unplaced' AS measure, 'all' AS key, 'all' AS id, est, lo95, hi95, n FROM ({ci('a / d', 'b1', '', 'n')}) UNION ALL SELECT 'known_role', group_id, 'all', est, lo95, hi95, n FROM ({ci('a / d', 'b2', 'group_id, ', 'n')})
 UNION ALL SELECT 'unplaced_domain', bucket, id, est, lo95, hi95, n FROM ({ci('share', 'ud', 'bucket, id, ', 'n')}) UNION ALL SELECT 'unplaced_role', bucket, id, est, lo95, hi95, n FROM ({ci('share', 'ur', 'bucket, id, ', 'n')})
 UNION ALL SELECT 'group_role', bucket, id, est, lo95, hi95, n FROM ({ci('share', 'gr', 'bucket, id, ', 'n')})"""


@plan("est_13_unplaced_and_roles", roles_sql())
def _(t: Tables):
    return rounded(es.unplaced_and_roles(coded(t), n_rep=R), "est", "lo95", "hi95")


@plan("est_14_complaint_rates", f"""WITH {CODED}, {shares_sql('sh', 'coded', 'domain', "CASE WHEN firsthand_p >= 5e-1 THEN ['all', 'firsthand'] ELSE ['all'] END", False)},
 w AS (SELECT rep, id, max(share) FILTER (bucket = 'all') AS talk, max(share) FILTER (bucket = 'firsthand') AS complaint FROM sh GROUP BY ALL)
 SELECT id AS domain, round(max(talk) FILTER (rep = -1), 6) AS talk, round(max(complaint) FILTER (rep = -1), 6) AS complaint, round(max(complaint / talk) FILTER (rep = -1), 6) AS rate,
 round(quantile_cont(complaint / talk, 0.025) FILTER (rep >= 0), 6) AS lo95, round(quantile_cont(complaint / talk, 0.975) FILTER (rep >= 0), 6) AS hi95 FROM w GROUP BY 1""")
def _(t: Tables):
    rows = coded(t).withColumn("firsthand", F.col("firsthand_p") >= 0.5)
    return rounded(es.complaint_rates(rows, n_rep=R), "talk", "complaint", "rate", "lo95", "hi95")


def signals_sql() -> str:
    flags = {s: f"CASE WHEN f_{s} >= 5e-1 THEN 1 ELSE 0 END" for s in ("paid", "switched", "abandoned", "workaround")}
    flags["commercial"] = "CASE WHEN greatest(f_paid, f_switched, f_abandoned) >= 5e-1 THEN 1 ELSE 0 END"
    flags["severe"] = "CASE WHEN severity >= 15e-1 THEN 1 ELSE 0 END"
    flags["specific"] = "CASE WHEN specificity >= 25e-1 THEN 1 ELSE 0 END"
    values = [x for f in flags for x in (f"a_{f}", f"n_{f}")]
    src = "rs AS (SELECT stratum, cluster, card_id, weight AS d, " + ", ".join(f"weight * {e} AS a_{f}, {e} AS n_{f}" for f, e in flags.items()) + " FROM coded WHERE card_id IS NOT NULL)"
    long = " UNION ALL ".join(f"SELECT rep, card_id, '{f}' AS name, a_{f} / d AS ratio, n_{f} AS n FROM b" for f in flags)
    return f"WITH {CODED}, {src}, {boot('b', 'rs', ['card_id'], ['d', *values])}, l AS ({long}) SELECT *, n < 30 AS sparse FROM ({ci('ratio', 'l', 'card_id, name, ', 'n')})"


@plan("est_15_signal_shares", signals_sql())
def _(t: Tables):
    return rounded(es.signal_shares(coded(t).filter("card_id IS NOT NULL"), n_rep=R))


def entropy_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, -sum(CASE WHEN p > 0 AND 1 - pow(1 - p, n) > 0 THEN p * log2(p) / (1 - pow(1 - p, n)) ELSE 0 END) AS entropy FROM
 (SELECT {keys}, (1 - count(*) FILTER (x = 1) OVER (PARTITION BY {keys}) / sum(x) OVER (PARTITION BY {keys})) * x / sum(x) OVER (PARTITION BY {keys}) AS p, sum(x) OVER (PARTITION BY {keys}) AS n FROM {src} WHERE x > 0) GROUP BY ALL"""


@plan("est_16_card_breadth", f"""WITH {CODED}, br AS (SELECT card_id || '~' || stratum AS stratum, cluster, card_id, domain, 1 AS x FROM coded WHERE card_id IS NOT NULL), {boot('b', 'br', ['card_id', 'domain'], ['x'])},
 e AS ({entropy_sql('b', 'rep, card_id')}), n AS (SELECT card_id, count(*) AS n FROM coded GROUP BY 1) SELECT c.*, n, n < 100 AS sparse FROM ({ci('entropy', 'e', 'card_id, ')}) c JOIN n USING (card_id)""")
def _(t: Tables):
    return rounded(es.card_breadth(coded(t).filter("card_id IS NOT NULL"), n_rep=R))


@plan("est_16_domain_mix", f"""WITH {CODED}, c AS (SELECT card_id, domain, count(*) AS obs, sum(weight) AS w FROM coded WHERE card_id IS NOT NULL GROUP BY ALL),
 x AS (SELECT *, sum(obs) OVER (PARTITION BY card_id) * sum(obs) OVER (PARTITION BY domain) / sum(obs) OVER () AS ex, sum(w) OVER (PARTITION BY card_id) AS tw FROM c) SELECT card_id, domain, round(w / tw, 6) AS share, round((obs - ex) / sqrt(ex), 6) AS residual FROM x""")
def _(t: Tables):
    return rounded(es.domain_mix(coded(t).filter("card_id IS NOT NULL")), "share", "residual")


def top_sql(key: str, name: str) -> str:
    return f"SELECT card_id, max(w) / any_value(t) AS top1_{name}, sum(w) / any_value(t) AS top3_{name}s FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY w DESC, {key}) AS r, sum(w) OVER (PARTITION BY card_id) AS t FROM (SELECT card_id, {key}, sum(weight) AS w FROM coded WHERE card_id IS NOT NULL AND {key} IS NOT NULL GROUP BY ALL)) WHERE r <= 3 GROUP BY 1"


@plan("est_17_concentration", f"""WITH {CODED} SELECT n.card_id, n, round(top1_thread, 6) AS top1_thread, round(top3_threads, 6) AS top3_threads, round(top1_author, 6) AS top1_author, round(top3_authors, 6) AS top3_authors,
 CASE WHEN n >= 50 THEN top1_thread > 3e-1 OR top1_author > 1e-2 END AS flagged FROM (SELECT card_id, count(*) AS n FROM coded WHERE card_id IS NOT NULL GROUP BY 1) n JOIN ({top_sql('story_id', 'thread')}) USING (card_id) JOIN ({top_sql('author', 'author')}) USING (card_id)""")
def _(t: Tables):
    out = es.concentration_flags(coded(t).filter("card_id IS NOT NULL"), author_bar=0.01)
    return rounded(out, "top1_thread", "top3_threads", "top1_author", "top3_authors")


@plan("est_17_null_band", None)
def _(t: Tables):
    return rounded(es.null_band(coded(t).filter("card_id IS NOT NULL"), "story_id", sims=500, seed=2), "null_lo", "null_hi")


LAUNCH = "launches AS (SELECT c_custkey AS story_id, 'P' || lpad(CAST(c_nationkey % 12 + 1 AS VARCHAR), 2, '0') AS period, CAST(3 + c_custkey % 2 AS DOUBLE) AS weight, CASE WHEN c_custkey % 3 > 0 THEN 'c' || lpad(CAST(c_custkey % 25 AS VARCHAR), 2, '0') END AS card_id FROM customer)"
LAUNCH_REPS = f"{LAUNCH}, ll AS (SELECT period AS stratum, story_id AS cluster, unnest(CASE WHEN card_id IS NULL THEN ['__all'] ELSE [card_id, '__match', '__all'] END) AS id, weight AS x, 1 AS n FROM launches), {boot('lb', 'll', ['id'], ['x', 'n'], R, 4)}, ls AS (SELECT rep, id, x / (SELECT sum(weight) FROM launches) AS share, n FROM lb WHERE id <> '__all')"


def launches(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("story_id"), F.format_string("P%02d", F.col("c_nationkey") % 12 + 1).alias("period"),
        (F.col("c_custkey") % 2 + 3).cast("double").alias("weight"), F.when(F.col("c_custkey") % 3 > 0, F.format_string("c%02d", F.col("c_custkey") % 25)).alias("card_id"),
    )


def complaint_reps(t: Tables):
    return bs.share_replicates(coded(t), "card_id", n_rep=R)


@plan("est_18_launch_shares", f"WITH {LAUNCH_REPS} SELECT *, n < 30 AS sparse FROM ({ci('share', 'ls', 'id, ', 'n')})")
def _(t: Tables):
    return rounded(es.launch_shares(launches(t), complaint_reps(t), n_rep=R, seed=4)[0])


ONLY_ALL = "['all']"


@plan("est_18_launch_ratio", f"WITH {CODED}, {LAUNCH_REPS}, {shares_sql('sh', 'coded', 'card_id', ONLY_ALL, False)}, pr AS (SELECT rep, id, ls.share / sh.share AS ratio, ls.n FROM ls JOIN sh USING (rep, id) WHERE sh.share > 0) SELECT *, n < 30 AS sparse FROM ({ci('ratio', 'pr', 'id, ', 'n')})")
def _(t: Tables):
    return rounded(es.launch_shares(launches(t), complaint_reps(t), n_rep=R, seed=4)[1])


UNSOLVED = "us AS (SELECT *, CASE WHEN comment_id % 3 = 0 THEN NULL ELSE solved_p IS NULL OR solved_p < 5e-1 END AS unsolved, coalesce(solved_p >= 8e-1, false) AS author_says_solved FROM coded WHERE card_id IS NOT NULL)"


def unsolved_sql() -> str:
    src = "rs AS (SELECT stratum, cluster, card_id, weight * CASE WHEN unsolved THEN 1 ELSE 0 END AS a, weight * CASE WHEN author_says_solved THEN 1 ELSE 0 END AS s, weight * CASE WHEN unsolved IS NULL THEN 0 ELSE 1 END AS d FROM us)"
    long = "l AS (SELECT rep, card_id, 'unsolved' AS name, a / d AS ratio FROM b UNION ALL SELECT rep, card_id, 'author_solved', s / d FROM b)"
    return f"WITH {CODED}, {UNSOLVED}, {src}, {boot('b', 'rs', ['card_id'], ['a', 's', 'd'])}, {long} SELECT c.*, n_measured FROM ({ci('ratio', 'l', 'card_id, name, ')}) c JOIN (SELECT card_id, count(unsolved) AS n_measured FROM us GROUP BY 1) USING (card_id) WHERE n_measured >= 170"


@plan("est_19_unsolved_shares", unsolved_sql())
def _(t: Tables):
    rows = coded(t).filter("card_id IS NOT NULL").withColumn("unsolved", F.expr("case when comment_id % 3 = 0 then null else solved_p is null or solved_p < 0.5 end"))
    rows = rows.withColumn("author_says_solved", F.expr("coalesce(solved_p >= 0.8, false)"))
    return rounded(es.unsolved_shares(rows, 170, n_rep=R))


TOOLS = "tt AS (SELECT stratum, story_id, comment_id, 'tool' || CAST(comment_id % 4 AS VARCHAR) AS tool, comment_id % 3 = 0 AS is_fix, comment_id % 3 = 1 AS is_complaint FROM coded)"


def tool_threads(t: Tables):
    return coded(t).select(
        "stratum", "story_id", "comment_id", F.concat(F.lit("tool"), (F.col("comment_id") % 4).cast("string")).alias("tool"),
        (F.col("comment_id") % 3 == 0).alias("is_fix"), (F.col("comment_id") % 3 == 1).alias("is_complaint"),
    )


@plan("est_20_fix_shares", f"""WITH {CODED}, {TOOLS}, tf AS (SELECT arg_min(stratum, comment_id) AS stratum, story_id, tool, max(is_fix::INT) AS f, max(is_complaint::INT) AS c FROM tt GROUP BY story_id, tool), ts AS (SELECT tool || '~' || stratum AS stratum, story_id AS cluster, tool, f AS a, f + c AS d, f AS n FROM tf),
 {boot('b', 'ts', ['tool'], ['a', 'd', 'n'])} SELECT *, n < 30 AS sparse FROM ({ci('a / nullif(d, 0)', 'b', 'tool, ', 'n')})""")
def _(t: Tables):
    return rounded(es.fix_shares(tool_threads(t), n_rep=R).drop("name"))


COMP = ["share", "paid", "severity3", "unsolved"]
CARD_COMP = "cc AS (SELECT card_id, count(*) AS n, sum(weight) AS share, CASE WHEN card_id <> 'c03' THEN avg(f_paid) END AS paid, avg(severity) AS severity3, avg(solved_p) AS unsolved FROM coded WHERE card_id IS NOT NULL GROUP BY 1)"


def pct_sql(c: str) -> str:
    part = f"PARTITION BY {c} IS NULL"
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 - 5e-1) / count(*) OVER ({part}) END AS {c}"


def card_components(t: Tables):
    return coded(t).filter("card_id IS NOT NULL").groupBy("card_id").agg(
        F.count("*").alias("n"), F.sum("weight").alias("share"), F.avg("f_paid").alias("p"), F.avg("severity").alias("severity3"), F.avg("solved_p").alias("unsolved")
    ).withColumn("paid", F.when(F.col("card_id") != "c03", F.col("p"))).drop("p")


@plan("est_21_opportunity", f"""WITH {CODED}, {CARD_COMP}, p AS (SELECT card_id, n, {', '.join(pct_sql(c) for c in COMP)} FROM cc WHERE n >= 260) SELECT card_id, {', '.join(f'round({c}, 6) AS {c}' for c in COMP)},
 round((share + coalesce(paid, 0) + severity3 + unsolved) / CASE WHEN paid IS NULL THEN 3 ELSE 4 END, 6) AS score_balanced, round((0.5::DOUBLE * share + 3 * coalesce(paid, 0) + 2 * severity3 + 2 * unsolved) / CASE WHEN paid IS NULL THEN 4.5::DOUBLE ELSE 7.5::DOUBLE END, 6) AS score_paid_pain FROM p""")
def _(t: Tables):
    presets = {k: es.PRESETS[k] for k in ("balanced", "paid_pain")}
    return rounded(es.opportunity_scores(card_components(t), presets, COMP, 260).drop("n"), *COMP, "score_balanced", "score_paid_pain")


def stability_sql() -> str:
    comps = ["share", "change", "paid", "severity3"]
    inside = "rs AS (SELECT stratum, cluster, card_id, weight AS d, weight * CASE WHEN greatest(f_paid, f_switched, f_abandoned) >= 5e-1 THEN 1 ELSE 0 END AS p, weight * CASE WHEN severity >= 25e-1 THEN 1 ELSE 0 END AS s FROM coded WHERE card_id IS NOT NULL)"
    wide = "wd AS (SELECT rep, card_id, share, diff * factor AS change, p / d AS paid, s / d AS severity3 FROM (SELECT rep, id AS card_id, share FROM sh WHERE bucket = 'all') LEFT JOIN (SELECT rep, id AS card_id, diff FROM df) USING (rep, card_id) LEFT JOIN (SELECT id AS card_id, factor FROM ch) USING (card_id) LEFT JOIN b USING (rep, card_id) WHERE rep >= 0)"
    pct = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY rep, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY rep, {c}) - 1) / 2 - 5e-1) / count(*) OVER (PARTITION BY rep, {c} IS NULL) END AS {c}" for c in comps)
    score = "(" + " + ".join(f"coalesce({c}, 0)" for c in comps) + ") / nullif(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in comps) + ", 0)"
    return f"""WITH {CODED}, {CHANGES}, {inside}, {boot('b', 'rs', ['card_id'], ['d', 'p', 's'])}, {wide}, pc AS (SELECT rep, card_id, {pct} FROM wd), sc AS (SELECT rep, card_id, round({score}, 9) AS score FROM pc),
 rk AS (SELECT rep, card_id, rank() OVER (PARTITION BY rep ORDER BY score DESC) + (count(*) OVER (PARTITION BY rep, score) - 1) / 2 AS rank FROM sc) SELECT card_id, round(quantile_cont(rank, 0.5), 6) AS median_rank FROM rk GROUP BY 1"""


@plan("est_22_rank_stability", stability_sql())
def _(t: Tables):
    rows = coded(t)
    reps = es.component_replicates(rows, es.changes(change_reps(t)), n_rep=R)
    out = es.rank_stability(reps, ["share", "change", "paid", "severity3"], es.PRESETS["balanced"])
    return rounded(out.select("card_id", "median_rank"), "median_rank")


@plan("est_23_bundle_shares", f"""WITH {CODED}, {shares_sql('sh', 'coded', 'card_id', ONLY_ALL, False)}, mb AS (SELECT DISTINCT card_id AS id, 'b' || substr(card_id, 3, 1) AS bundle_id FROM coded WHERE card_id IS NOT NULL),
 bs AS (SELECT bundle_id, rep, sum(share) AS share, sum(n) AS n FROM mb JOIN sh USING (id) GROUP BY ALL) SELECT *, n < 30 AS sparse FROM ({ci('share', 'bs', 'bundle_id, ', 'n')})""")
def _(t: Tables):
    rows = coded(t)
    members = rows.filter("card_id IS NOT NULL").select("card_id", F.concat(F.lit("b"), F.substring("card_id", 3, 1)).alias("bundle_id")).distinct()
    return rounded(es.bundle_shares(members, bs.share_replicates(rows, "card_id", n_rep=R)))


@plan("tst_01_bootstrap_p", f"WITH {CODED}, {CHANGES} SELECT id, round(p, 9) AS p FROM cb")
def _(t: Tables):
    return rounded(rb.bootstrap_p(change_reps(t), ["id"], "diff"), "p", digits=9)


@plan("tst_02_benjamini_hochberg", f"WITH tests AS (SELECT p_partkey AS id, p_brand AS family, pow((p_partkey * 7919 % 1000 + 1) / 1001e0, 3) AS p FROM part) SELECT id, round(p_adj, 9) AS p_adj, p_adj <= 5e-2 AS rejected FROM ({bh('tests', 'family')})")
def _(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), F.expr("pow((p_partkey * 7919 % 1000 + 1) / 1001d, 3)").alias("p"))
    out = rb.benjamini_hochberg(rows, family=["family"])
    return out.select("id", F.round("p_adj", 9).alias("p_adj"), "rejected")


HEAVY = f"{CODED}, hc AS (SELECT cluster, coalesce(sum(weight), 0) AS w, coalesce(sum(weight * card_p), 0) AS wx FROM coded GROUP BY 1), hk AS (SELECT *, (SELECT sum(w) FROM hc) AS tw, (SELECT sum(wx) FROM hc) AS twx FROM hc ORDER BY wx DESC, cluster LIMIT 10)"


@plan("tst_03_leave_one_out", f"WITH {HEAVY} SELECT round(min((twx - wx) / (tw - w)), 6) AS min_stat, round(max((twx - wx) / (tw - w)), 6) AS max_stat, round(max(wx / twx), 6) AS max_share, round(any_value(twx / tw), 6) AS stat, max(wx / twx) > 1e-1 AS flagged FROM hk")
def _(t: Tables):
    return rounded(rb.leave_one_out(coded(t).withColumn("x", F.col("card_p"))), "min_stat", "max_stat", "max_share", "stat")


@plan("tst_04_drop_top_share", f"WITH {HEAVY}, k AS (SELECT *, row_number() OVER (ORDER BY wx DESC, cluster) AS r, ceil(count(*) OVER () * 0.03::DOUBLE) AS d FROM hc) SELECT count(*) AS n_clusters, round(sum(wx) / sum(w), 6) AS stat FROM k WHERE r > d")
def _(t: Tables):
    return rounded(rb.drop_top_share(coded(t).withColumn("x", F.col("card_p")), 0.03), "stat")


@plan("tst_05_author_capped_weights", f"WITH {CODED} SELECT comment_id, round(CASE WHEN author IS NULL THEN 1 ELSE least(1, 5e0 / count(*) OVER (PARTITION BY author)) END, 9) AS cap_factor FROM coded")
def _(t: Tables):
    return rounded(rb.author_capped_weights(coded(t), 5).select("comment_id", "cap_factor"), "cap_factor", digits=9)
