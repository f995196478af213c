"""Sampling plans (SMP): orders are the frame, priorities and coded labels the strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.operators import allocate as al
from threadgauge.operators import sampling as sp
from threadgauge.plans.registry import Tables, plan
from threadgauge.plans.roles import cte, h60
from threadgauge.plans.text import BIN, PAIN_SQL, TEXTS, WORDS_SQL, texts

SEED = 7
FRAME = """frame AS (SELECT o_orderkey AS comment_id, o_custkey AS story_id, o_orderpriority || '|' || o_orderstatus AS stratum FROM orders)"""
SIZES = "sizes AS (SELECT stratum, count(*) AS n_frame FROM frame GROUP BY 1)"


def frame(t: Tables):
    label = F.concat_ws("|", "o_orderpriority", "o_orderstatus")
    return t.orders.select(F.col("o_orderkey").alias("comment_id"), F.col("o_custkey").alias("story_id"), label.alias("stratum"))


def ham(src: str, n: str, key: str = "stratum") -> str:
    return f"""SELECT {key}, n_frame, CAST(fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, {key}) <= {n} - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_take
 FROM (SELECT *, CAST(floor(ex) AS BIGINT) AS fl FROM (SELECT {key}, n_frame, ({n} * n_frame) / sum(n_frame) OVER () AS ex FROM {src}))"""


def floors(src: str, n: int, floor: int) -> str:
    """Twin of the floors-and-caps allocation: two settling rounds, then the rest."""
    return f"""r1 AS ({ham(src, str(n))}), s1 AS (SELECT stratum, n_frame, least(n_frame, {floor}) AS n_take FROM r1 WHERE n_take < least(n_frame, {floor})),
 f1 AS (SELECT r1.stratum, n_frame FROM r1 WHERE stratum NOT IN (SELECT stratum FROM s1)),
 r2 AS ({ham('f1', f'({n} - (SELECT coalesce(sum(n_take), 0)::BIGINT FROM s1))')}),
 s2 AS (SELECT * FROM s1 UNION ALL SELECT stratum, n_frame, least(n_frame, {floor}) FROM r2 WHERE n_take < least(n_frame, {floor})),
 f2 AS (SELECT stratum, n_frame FROM r1 WHERE stratum NOT IN (SELECT stratum FROM s2)),
 r3 AS ({ham('f2', f'({n} - (SELECT coalesce(sum(n_take), 0)::BIGINT FROM s2))')}),
 alloc AS (SELECT stratum, n_frame, n_take FROM s2 UNION ALL SELECT stratum, n_frame, n_take FROM r3)"""


def drawn(alloc: str, seed: int = SEED, src: str = "frame", keys: str = "stratum", n: str = "n_take") -> str:
    using = ", ".join(k.strip() for k in keys.split(","))
    return f"""SELECT f.*, row_number() OVER (PARTITION BY {', '.join('f.' + k.strip() for k in keys.split(','))} ORDER BY {h60(str(seed), 'comment_id')}, comment_id) AS draw_rank
 FROM {src} f JOIN {alloc} a USING ({using}) QUALIFY draw_rank <= a.{n}"""


STORIES = "stories AS (SELECT c_custkey AS story_id, CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE CAST(floor(c_acctbal) AS BIGINT) END AS descendants FROM customer)"


def stories(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("story_id"),
        F.expr("case when c_custkey % 37 = 0 then null else cast(floor(c_acctbal) as bigint) end").alias("descendants"),
    )


@plan("smp_01_engagement_cutpoints", f"""WITH {STORIES}, o AS (SELECT descendants AS d, row_number() OVER (ORDER BY descendants) - 1 AS i, count(*) OVER () AS n FROM stories WHERE descendants IS NOT NULL)
 SELECT max(d) FILTER (i = floor((1e0/3) * (n - 1))) AS lo, max(d) FILTER (i = floor((2e0/3) * (n - 1))) AS hi FROM o""")
def _(t: Tables):
    return sp.engagement_cutpoints(stories(t))


@plan("smp_02_frame_v1", f"""WITH {STORIES} SELECT o_orderkey AS comment_id, o_custkey AS story_id, 'P' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '|' || o_orderpriority || '|' ||
 CASE WHEN descendants IS NULL THEN 'e0' WHEN descendants <= 2500 THEN 'e1' WHEN descendants <= 6000 THEN 'e2' ELSE 'e3' END AS stratum
 FROM orders LEFT JOIN stories ON story_id = o_custkey WHERE o_orderstatus <> 'F'""")
def _(t: Tables):
    rows = t.orders.select(
        F.col("o_orderkey").alias("comment_id"), F.col("o_custkey").alias("story_id"), (F.col("o_orderstatus") != "F").alias("eligible"),
        F.format_string("P%02d", F.month("o_orderdate")).alias("period"), F.col("o_orderpriority").alias("thread_type"),
    )
    return sp.frame_v1(rows, stories(t), (2500, 6000))


@plan("smp_03_frame_v2", f"""WITH {TEXTS} SELECT id AS comment_id, id % 50 AS story_id, CASE WHEN {PAIN_SQL} THEN 'pain' ELSE 'nopain' END || '|' || {BIN.format(n=WORDS_SQL.format(t='text'))} || '|' ||
 CASE WHEN id % 12 < 6 THEN 'H1' ELSE 'H2' END || '|' || CASE WHEN id % 4 = 0 THEN 'ask' WHEN id % 4 = 1 THEN 'show' WHEN id % 4 = 2 THEN 'story' ELSE 'other' END AS stratum,
 CASE WHEN CAST('0x' || substr(sha256('s:' || CAST(id % 50 AS VARCHAR)), 1, 2) AS INT) % 2 = 0 THEN 'explore' ELSE 'confirm' END AS half FROM texts WHERE id % 10 <> 0""")
def _(t: Tables):
    from threadgauge.functions import text as tx

    rows = texts(t).select(
        F.col("id").alias("comment_id"), (F.col("id") % 50).alias("story_id"), (F.col("id") % 10 != 0).alias("eligible"),
        F.format_string("P%02d", F.col("id") % 12 + 1).alias("period"), F.col("text").alias("text_norm"),
        tx.word_count(F.col("text")).alias("word_count"),
        F.expr("case id % 4 when 0 then 'ask_hn' when 1 then 'launch_hn' end").alias("thread_type"),
        F.expr("case when id % 4 = 2 then 'story' end").alias("story_thread_type"),
    )
    return sp.frame_v2(rows, "s")


@plan("smp_04_hamilton", f"WITH {FRAME}, {SIZES} {ham('sizes', '777')}")
def _(t: Tables):
    return al.hamilton(al.stratum_sizes(frame(t)), 777)


@plan("smp_05_floors_and_caps", f"WITH {FRAME}, {SIZES}, {floors('sizes', 600, 38)} SELECT stratum, n_take FROM alloc")
def _(t: Tables):
    return al.allocate(al.stratum_sizes(frame(t)), 600, 38)


@plan("smp_06_collapse", """SELECT split_part(stratum, '|', 1) || '|' || split_part(stratum, '|', 2) AS stratum, count(*) AS n FROM
 (SELECT o_orderpriority || '|' || o_orderstatus || '|' || CAST(o_custkey % 40 AS VARCHAR) AS stratum FROM orders) GROUP BY 1""")
def _(t: Tables):
    rows = t.orders.select(F.concat_ws("|", "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 40).cast("string")).alias("stratum"))
    level = al.collapse_level(rows, 600, 5)
    return rows.groupBy(al.collapse_label(F.col("stratum"), level).alias("stratum")).agg(F.count("*").alias("n"))


@plan("smp_07_stratified_draw", f"WITH {FRAME}, {SIZES}, alloc AS ({ham('sizes', '500')}) {drawn('alloc')}")
def _(t: Tables):
    rows = frame(t)
    return sp.draw(rows, al.hamilton(al.stratum_sizes(rows), 500), SEED)


SAMPLE = f"""{FRAME}, {SIZES}, {floors('sizes', 600, 30)}, d AS ({drawn('alloc')}),
 sample AS (SELECT d.*, n_frame AS n_population, n_take AS n_taken, n_take / n_frame AS inclusion_prob, n_frame / n_take AS weight FROM d JOIN alloc USING (stratum))"""


@plan("smp_08_stratified_sample", f"WITH {SAMPLE} SELECT stratum, comment_id, story_id, draw_rank, n_population, n_taken, round(inclusion_prob, 9) AS inclusion_prob, round(weight, 9) AS weight FROM sample")
def _(t: Tables):
    out = sp.stratified_sample(frame(t), 600, 30, SEED)
    return out.withColumn("inclusion_prob", F.round("inclusion_prob", 9)).withColumn("weight", F.round("weight", 9))


@plan("smp_08_weight_check", f"WITH {SAMPLE} SELECT stratum, round(sum(weight), 6) AS total, any_value(n_population) AS n_population FROM sample GROUP BY stratum")
def _(t: Tables):
    out = sp.stratified_sample(frame(t), 600, 30, SEED)
    return out.groupBy("stratum").agg(F.round(F.sum("weight"), 6).alias("total"), F.max("n_population").alias("n_population"))


@plan("smp_09_expansion", f"""WITH {FRAME}, {SIZES}, alloc AS ({ham('sizes', '300')}), first AS (SELECT * EXCLUDE draw_rank, row_number() OVER (ORDER BY {h60('7', "'order'", 'comment_id')}) AS draw_order, 1 AS batch FROM ({drawn('alloc')})),
 rest AS (SELECT * FROM frame WHERE comment_id NOT IN (SELECT comment_id FROM first)), rsize AS (SELECT stratum, count(*) AS n_frame FROM rest GROUP BY 1), more AS ({ham('rsize', '120')}),
 added AS (SELECT * EXCLUDE draw_rank, 300 + row_number() OVER (ORDER BY {h60('8', "'order'", 'comment_id')}) AS draw_order, 2 AS batch FROM ({drawn('more', 8, 'rest')})),
 grown_rows AS (SELECT comment_id, stratum, batch, draw_order FROM first UNION ALL SELECT comment_id, stratum, batch, draw_order FROM added)
 SELECT comment_id, stratum, batch, draw_order, round(n_frame / count(*) OVER (PARTITION BY stratum), 9) AS weight FROM grown_rows JOIN sizes USING (stratum)""")
def _(t: Tables):
    from threadgauge.functions.hashing import hash60
    from threadgauge.operators.spread import hash_rank

    rows = frame(t)
    first = sp.draw(rows, al.hamilton(al.stratum_sizes(rows), 300), SEED).drop("draw_rank")
    first = hash_rank(first, [], hash60(SEED, "order", F.col("comment_id")), ["comment_id"], "draw_order").withColumn("batch", F.lit(1))
    rest = rows.join(first.select("comment_id"), "comment_id", "left_anti")
    out = sp.expand(first, rows, al.hamilton(al.stratum_sizes(rest), 120), 8, 2)
    return out.select("comment_id", "stratum", "batch", "draw_order", F.round("weight", 9).alias("weight"))


@plan("smp_10_sample_manifest", f"WITH {SAMPLE} SELECT stratum, n_frame, n_take AS n_sample FROM alloc")
def _(t: Tables):
    rows = frame(t)
    return sp.sample_manifest(sp.stratified_sample(rows, 600, 30, SEED), rows)


@plan("smp_11_pilot_allocation", f"WITH {FRAME}, {SIZES} SELECT stratum, n_frame, CAST(least(n_frame, greatest(12, round_even(250 * n_frame / sum(n_frame) OVER (), 0))) AS BIGINT) AS n_take FROM sizes")
def _(t: Tables):
    return al.pilot_allocation(al.stratum_sizes(frame(t)), 250, 12)


@plan("smp_12_draw_allocated", f"WITH {FRAME}, {SIZES}, alloc AS (SELECT stratum, n_frame, least(n_frame, 17) AS n_take FROM sizes) SELECT comment_id, stratum, round(n_frame / n_take, 9) AS weight FROM ({drawn('alloc', 3)}) JOIN alloc USING (stratum)")
def _(t: Tables):
    rows = frame(t)
    given = al.stratum_sizes(rows).withColumn("n_take", F.least("n_frame", F.lit(17)))
    return sp.draw_allocated(rows, given, 3).select("comment_id", "stratum", F.round("weight", 9).alias("weight"))


PROBLEMS = f"problems AS ({cte('problems')})"
COSTS = f"""{PROBLEMS}, obs AS (SELECT comment_id, phase || '|' || role || '|' || half || '|' || domain AS stratum, CASE WHEN firsthand_p >= 5e-1 THEN 1e0 ELSE 0e0 END AS p, CAST(400 + comment_id % 300 AS DOUBLE) AS c FROM problems),
 strata AS (SELECT stratum, count(*) AS n_frame, sum(p) / count(*) AS p, sum(c) / count(*) AS c FROM obs GROUP BY 1)"""


def observed(t: Tables):
    return t.role("problems").select(
        "comment_id", F.concat_ws("|", "phase", "role", "half", "domain").alias("stratum"),
        F.when(F.col("firsthand_p") >= 0.5, 1.0).otherwise(0.0).alias("p"), (F.col("comment_id") % 300 + 400).cast("double").alias("c"),
    )


def strata(t: Tables):
    return observed(t).groupBy("stratum").agg(
        F.count("*").alias("n_frame"), (F.sum("p") / F.count("*")).alias("p"), (F.sum("c") / F.count("*")).alias("c")
    )


def greedy(src: str, budget: str, rate: str, min_n: int, key: str = "stratum") -> str:
    """Twin of the yield allocation; a recursive walk over the ordered strata."""
    return f"""o AS (SELECT *, row_number() OVER (ORDER BY -(p / c), {key}) AS i, CAST(least(n_frame, greatest({min_n}, ceil(round({rate} * n_frame, 9)))) AS BIGINT) AS base FROM {src}),
 walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST({budget} - (SELECT sum(base * c) FROM o) AS DOUBLE) AS rem, CAST(0 AS BIGINT) AS extra
 UNION ALL SELECT o.i, w.rem - greatest(0, least(o.n_frame - o.base, CAST(floor(w.rem / o.c) AS BIGINT))) * o.c, greatest(0, least(o.n_frame - o.base, CAST(floor(w.rem / o.c) AS BIGINT))) FROM walk w JOIN o ON o.i = w.i + 1),
 given AS (SELECT o.*, base + extra AS n_take FROM o JOIN walk USING (i))"""


@plan("smp_13_yield_allocation", f"WITH RECURSIVE {COSTS}, {greedy('strata', '(SELECT sum(n_frame * c) * 0.4::DOUBLE FROM strata)', '5e-2', 3)} SELECT stratum, n_frame, n_take FROM given")
def _(t: Tables):
    rows = strata(t)
    budget = rows.agg(F.sum(F.col("n_frame") * F.col("c"))).first()[0] * 0.4
    return al.yield_allocation(rows, budget, 0.05, 3).select("stratum", "n_frame", "n_take")


@plan("smp_14_design_totals", f"""WITH RECURSIVE {COSTS}, {greedy('strata', '(SELECT sum(n_frame * c) * 0.4::DOUBLE FROM strata)', '5e-2', 3)}
 SELECT CAST(sum(n_take) AS BIGINT) AS n, round(sum(n_take * p), 4) AS expected_positives, round(sum(n_take * c), 2) AS expected_tokens, round(max(n_frame / n_take), 6) AS largest_weight FROM given""")
def _(t: Tables):
    rows = strata(t)
    budget = rows.agg(F.sum(F.col("n_frame") * F.col("c"))).first()[0] * 0.4
    out = al.design_totals(al.yield_allocation(rows, budget, 0.05, 3))
    return out.select("n", F.round("expected_positives", 4).alias("expected_positives"), F.round("expected_tokens", 2).alias("expected_tokens"), F.round("largest_weight", 6).alias("largest_weight"))


def fallback_sql(sizes: str, obs: str, key: str, min_n: int, second: str, first: str) -> str:
    out = []
    for v in ("p", "c"):
        out.append(f"CASE WHEN n0{v} >= {min_n} THEN m0{v} WHEN n1{v} >= {min_n} THEN m1{v} WHEN n2{v} >= {min_n} THEN m2{v} ELSE m3{v} END AS {v}")
        out.append(f"CASE WHEN n0{v} >= {min_n} THEN {key} WHEN n1{v} >= {min_n} THEN l2 WHEN n2{v} >= {min_n} THEN l1 ELSE '*' END AS {v}_level")
    cols = {i: ", ".join(f"count({v}) AS n{i}{v}, sum({v}) / count({v}) AS m{i}{v}" for v in ("p", "c")) for i in range(4)}
    return f"""SELECT s.{key}, n_frame, {', '.join(out)} FROM (SELECT *, {second} AS l2, {first} AS l1 FROM {sizes}) s
 LEFT JOIN (SELECT {key}, {cols[0]} FROM {obs} GROUP BY 1) USING ({key}) LEFT JOIN (SELECT {second} AS l2, {cols[1]} FROM {obs} GROUP BY 1) USING (l2)
 LEFT JOIN (SELECT {first} AS l1, {cols[2]} FROM {obs} GROUP BY 1) USING (l1) CROSS JOIN (SELECT {cols[3]} FROM {obs})"""


PART2 = "split_part({k}, '|', 1) || '|' || split_part({k}, '|', 2)"
PART1 = "split_part({k}, '|', 1)"
PILOT = "comment_id % 5 = 0"


@plan("smp_15_fallback_rates", f"""WITH {COSTS}, pilot AS (SELECT * FROM obs WHERE {PILOT}),
 r AS ({fallback_sql('(SELECT stratum, n_frame FROM strata)', 'pilot', 'stratum', 25, PART2.format(k='stratum'), PART1.format(k='stratum'))})
 SELECT stratum, n_frame, round(p, 9) AS p, p_level, round(c, 6) AS c, c_level FROM r""")
def _(t: Tables):
    sizes = strata(t).select("stratum", "n_frame")
    out = al.fallback_rates(sizes, observed(t).filter(PILOT), ["p", "c"], 25)
    return out.withColumn("p", F.round("p", 9)).withColumn("c", F.round("c", 6))


POOL = "split_part(stratum, '|', 1) || '|' || split_part(stratum, '|', 2) || '|' || split_part(stratum, '|', 4)"


@plan("smp_16_pooled_allocation", f"""WITH RECURSIVE {COSTS}, pilot AS (SELECT *, {POOL} AS pooled FROM obs WHERE {PILOT}),
 merged AS (SELECT {POOL} AS pooled, CAST(sum(n_frame) AS BIGINT) AS n_frame FROM strata GROUP BY 1),
 rates AS ({fallback_sql('merged', 'pilot', 'pooled', 25, PART2.format(k='pooled'), PART1.format(k='pooled'))}),
 {greedy('rates', '(SELECT sum(n_frame * c) * 0.3::DOUBLE FROM strata)', '4e-2', 3, 'pooled')}
 SELECT s.stratum, s.n_frame, CAST(least(s.n_frame, greatest(least(s.n_frame, 3), round_even(g.n_take / g.n_frame * s.n_frame, 0))) AS BIGINT) AS n_take, g.n_take AS take_pooled
 FROM (SELECT *, {POOL} AS pooled FROM strata) s JOIN given g USING (pooled)""")
def _(t: Tables):
    sizes = strata(t)
    budget = sizes.agg(F.sum(F.col("n_frame") * F.col("c"))).first()[0] * 0.3
    out = al.pooled_allocation(sizes.select("stratum", "n_frame"), observed(t).filter(PILOT), budget, 0.04, 1.0, 25, 3)
    return out.select("stratum", "n_frame", "n_take", "take_pooled")


def capped(src: str, n: int, keys: str = "") -> str:
    """Twin of the capped allocation: three capping rounds over the open strata."""
    part = f"PARTITION BY {keys}" if keys else ""
    rounds = [f"c0 AS (SELECT *, false AS full_ FROM {src})"]
    for i in range(1, 6):
        rounds.append(
            f"c{i} AS (SELECT * EXCLUDE full_, full_ OR ({n} - coalesce(sum(n_frame) FILTER (full_) OVER ({part}), 0)) * wsum / sum(wsum) FILTER (NOT full_) OVER ({part}) >= n_frame AS full_ FROM c{i - 1})"
        )
    rounds.append(
        f"capped AS (SELECT * EXCLUDE full_, CAST(greatest(1, CASE WHEN full_ THEN n_frame ELSE round_even(({n} - coalesce(sum(n_frame) FILTER (full_) OVER ({part}), 0)) * wsum / sum(wsum) FILTER (NOT full_) OVER ({part}), 0) END) AS BIGINT) AS n_take FROM c5)"
    )
    return ", ".join(rounds)


WSUM = f"{PROBLEMS}, w AS (SELECT role || domain AS stratum, count(*) AS n_frame, sum(weight * CASE WHEN domain = 'web' THEN 40 ELSE 1 END) AS wsum FROM problems GROUP BY 1)"


@plan("smp_17_capped_allocation", f"WITH {WSUM}, {capped('w', 9000)} SELECT stratum, n_frame, wsum, n_take FROM capped")
def _(t: Tables):
    w = F.col("weight") * F.when(F.col("domain") == "web", 40).otherwise(1)
    rows = t.role("problems").groupBy(F.concat("role", "domain").alias("stratum")).agg(F.count("*").alias("n_frame"), F.sum(w).alias("wsum"))
    return al.capped_allocation(rows, 9000)


PHASE_STATS = f"""{PROBLEMS}, scr AS (SELECT comment_id, story_id, stratum, half, weight, firsthand_p, CASE WHEN firsthand_p >= 7e-1 THEN 'pos' ELSE 'neg' END AS phase FROM problems),
 st AS (SELECT phase, stratum, count(*) AS n_frame, sum(weight) AS wsum FROM scr GROUP BY ALL),
 q AS (SELECT phase, stratum, n_frame, least(n_frame, CAST(greatest(1, round_even(CASE WHEN phase = 'pos' THEN 300 ELSE 90 END * wsum / sum(wsum) OVER (PARTITION BY phase), 0)) AS BIGINT)) AS n_take FROM st)"""
TWO_PHASE = f"""{PHASE_STATS}, tp AS (SELECT comment_id, story_id, d.stratum, half, phase, weight AS w1, n_take / n_frame AS p2, weight / (n_take / n_frame) AS weight, firsthand_p
 FROM ({drawn('q', SEED, 'scr', 'phase, stratum')}) d JOIN q USING (phase, stratum))"""


def screen(t: Tables):
    return t.role("problems").select("comment_id", "story_id", "stratum", "half", "weight", "firsthand_p")


@plan("smp_18_two_phase", f"WITH {TWO_PHASE} SELECT comment_id, stratum, phase, w1, round(p2, 9) AS p2, round(weight, 6) AS weight FROM tp")
def _(t: Tables):
    out = sp.two_phase(screen(t), 300, 90, 0.7, SEED)
    return out.select("comment_id", "stratum", "phase", "w1", F.round("p2", 9).alias("p2"), F.round("weight", 6).alias("weight"))


@plan("smp_19_two_phase_top_up", f"""WITH {TWO_PHASE}, tgt AS (SELECT stratum, n_frame, least(n_frame, CAST(greatest(1, round_even(420 * wsum / sum(wsum) OVER (), 0)) AS BIGINT)) AS n_take FROM st WHERE phase = 'pos'),
 old AS (SELECT stratum, count(*) AS n_old FROM tp WHERE phase = 'pos' GROUP BY 1), pl AS (SELECT stratum, n_frame, coalesce(n_old, 0) AS n_old, greatest(0, least(n_take - coalesce(n_old, 0), n_frame - coalesce(n_old, 0))) AS n_more FROM tgt LEFT JOIN old USING (stratum)),
 rest AS (SELECT * FROM scr WHERE phase = 'pos' AND comment_id NOT IN (SELECT comment_id FROM tp)), grown AS (SELECT comment_id, 2 AS wave, stratum, weight FROM ({drawn('pl', 11, 'rest', 'stratum', 'n_more')}) d
 UNION ALL SELECT comment_id, 1, stratum, w1 FROM tp WHERE phase = 'pos')
 SELECT comment_id, stratum, 'pos' AS phase, wave, round((n_old + n_more) / n_frame, 9) AS p2, round(weight / ((n_old + n_more) / n_frame), 6) AS weight FROM grown JOIN pl USING (stratum)
 UNION ALL SELECT comment_id, stratum, phase, 1, round(p2, 9), round(weight, 6) FROM tp WHERE phase = 'neg'""")
def _(t: Tables):
    rows = screen(t)
    out = sp.expand_two_phase(sp.two_phase(rows, 300, 90, 0.7, SEED), rows, 420, 0.7, 11)
    return out.select("comment_id", "stratum", "phase", "wave", F.round("p2", 9).alias("p2"), F.round("weight", 6).alias("weight"))


@plan("smp_20_subsample", f"""WITH {SAMPLE.replace('alloc', 'alloc0').replace('r1 ', 'ra ').replace('r1.', 'ra.').replace('FROM r1', 'FROM ra').replace('s1', 'sa').replace('f1', 'fa').replace('r2', 'rb').replace('s2', 'sb').replace('f2', 'fb').replace('r3', 'rc')},
 psz AS (SELECT stratum, count(*) AS n_frame FROM sample GROUP BY 1), {floors('psz', 150, 1)}
 SELECT comment_id, stratum, round(weight * n_frame / n_take, 6) AS weight, round(1 / (weight * n_frame / n_take), 9) AS inclusion_prob FROM ({drawn('alloc', 5, '(SELECT comment_id, stratum, weight FROM sample)')}) JOIN alloc USING (stratum)""")
def _(t: Tables):
    parent = sp.stratified_sample(frame(t), 600, 30, SEED).select("comment_id", "stratum", "weight")
    out = sp.subsample(parent, 150, 5)
    return out.select("comment_id", "stratum", F.round("weight", 6).alias("weight"), F.round("inclusion_prob", 9).alias("inclusion_prob"))


@plan("smp_21_simple_sample", f"WITH {FRAME} SELECT * FROM frame ORDER BY {h60('4', 'comment_id')}, comment_id LIMIT 250")
def _(t: Tables):
    return sp.simple_sample(frame(t), 250, 4)


@plan("smp_22_pps_sample", f"""WITH {PROBLEMS} SELECT comment_id, weight FROM problems WHERE phase = 'pos' AND half = 'H1'
 ORDER BY -ln((({h60('9', 'comment_id')} >> 8) + 5e-1) / 4503599627370496) / weight, comment_id LIMIT 300""")
def _(t: Tables):
    pool = t.role("problems").filter("phase = 'pos' AND half = 'H1'").select("comment_id", "weight")
    return sp.pps_sample(pool, 300, 9).drop("clock")


@plan("smp_23_launch_sample", f"""WITH frame AS (SELECT o_orderkey AS comment_id, 'P' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS stratum FROM orders WHERE o_orderpriority = '1-URGENT'),
 {SIZES}, alloc AS (SELECT stratum, n_frame, CAST(least(n_frame, round_even(130 * n_frame / sum(n_frame) OVER (), 0)) AS BIGINT) AS n_take FROM sizes)
 SELECT comment_id AS story_id, stratum AS period, round(n_frame / n_take, 9) AS weight FROM ({drawn('alloc', 2)}) JOIN alloc USING (stratum)""")
def _(t: Tables):
    rows = t.orders.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("story_id"), F.format_string("P%02d", F.month("o_orderdate")).alias("period")
    )
    return sp.launch_sample(rows, 130, 2).withColumn("weight", F.round("weight", 9))


BANDS = {"high": (0.5, 1.01), "mid": (0.15, 0.5), "low": (0.0, 0.15)}
BAND_SIZES = {"high": 60, "mid": 50, "low": 40}
BAND_SQL = "CASE WHEN score >= 5e-1 AND score < 1.01e0 THEN 'high' WHEN score >= 15e-2 AND score < 5e-1 THEN 'mid' WHEN score >= 0 AND score < 15e-2 THEN 'low' END"


def queue_sql(src: str, seed: int) -> str:
    return f"""banded AS (SELECT comment_id, score, {BAND_SQL} AS band FROM {src}), members AS (SELECT band, count(*) AS n_members,
 least(count(*), CASE band WHEN 'high' THEN 60 WHEN 'mid' THEN 50 ELSE 40 END) AS n_take FROM banded WHERE band IS NOT NULL GROUP BY band),
 queue AS (SELECT *, row_number() OVER (ORDER BY {h60(str(seed), "'order'", 'comment_id')}) AS position,
 row_number() OVER (ORDER BY {h60(str(seed), "'repeat'", 'comment_id')}) <= round_even(count(*) OVER () * 0.1::DOUBLE, 0) AS repeated FROM
 (SELECT comment_id, score, d.band, n_take / n_members AS rate FROM ({drawn('members', seed, 'banded', 'band')}) d JOIN members USING (band)))"""


def scored(t: Tables):
    return t.role("problems").select("comment_id", F.col("firsthand_p").alias("score"))


SCORED = f"{PROBLEMS}, scored AS (SELECT comment_id, firsthand_p AS score FROM problems WHERE comment_id % 7 <> 3)"


@plan("smp_24_label_queue", f"WITH {SCORED}, {queue_sql('scored', 6)} SELECT comment_id, band, round(rate, 9) AS rate, position, repeated FROM queue")
def _(t: Tables):
    rows = scored(t)
    out = sp.label_queue(rows, BANDS, BAND_SIZES, 6, exclude=rows.filter("comment_id % 7 = 3"))
    return out.select("comment_id", "band", F.round("rate", 9).alias("rate"), "position", "repeated")


@plan("smp_25_queue_top_up", f"""WITH {SCORED}, {queue_sql('scored', 6)}, have AS (SELECT band, count(*) AS n_frame FROM queue WHERE band IN ('high', 'mid') GROUP BY 1), want AS ({ham('have', '33', 'band')}),
 rest AS (SELECT * FROM (SELECT comment_id, firsthand_p AS score, {BAND_SQL.replace('score', 'firsthand_p')} AS band FROM problems) WHERE band IN ('high', 'mid') AND comment_id NOT IN (SELECT comment_id FROM queue)),
 pool AS (SELECT band, count(*) AS n_members FROM (SELECT {BAND_SQL.replace('score', 'firsthand_p')} AS band FROM problems) GROUP BY 1),
 grown_rows AS (SELECT comment_id, band, 0 AS top_up FROM queue UNION ALL SELECT comment_id, band, 1 FROM ({drawn('want', 1006, 'rest', 'band')}))
 SELECT comment_id, band, top_up, CASE WHEN band IN ('high', 'mid') THEN round(count(*) OVER (PARTITION BY band) / n_members, 9) END AS rate FROM grown_rows JOIN pool USING (band)""")
def _(t: Tables):
    rows = scored(t)
    queue = sp.label_queue(rows, BANDS, BAND_SIZES, 6, exclude=rows.filter("comment_id % 7 = 3"))
    out = sp.top_up_queue(queue, rows, {k: BANDS[k] for k in ("high", "mid")}, 33, 1006)
    return out.select("comment_id", "band", "top_up", F.round("rate", 9).alias("rate"))


@plan("smp_26_gate_and_share", f"""WITH {PROBLEMS}, rest AS (SELECT comment_id, firsthand_p, row_number() OVER (ORDER BY {h60('3', 'comment_id')}) AS r, count(*) OVER () AS n FROM problems WHERE firsthand_p < 6e-1)
 SELECT comment_id, firsthand_p AS screen_p, 'gate' AS rule, 1e0 AS selection_prob FROM problems WHERE firsthand_p >= 6e-1
 UNION ALL SELECT comment_id, firsthand_p, 'random', round(round_even(n * 0.05::DOUBLE, 0) / n, 9) FROM rest WHERE r <= round_even(n * 0.05::DOUBLE, 0)""")
def _(t: Tables):
    rows = t.role("problems").select("comment_id", F.col("firsthand_p").alias("screen_p"))
    return sp.gate_and_share(rows, 0.6, 0.05, 3).withColumn("selection_prob", F.round("selection_prob", 9))


@plan("smp_27_gold_draws", f"""WITH {SCORED}, {queue_sql('scored', 6)}, audit AS (SELECT comment_id, CASE WHEN firsthand_p >= 6e-1 THEN 'gate' ELSE 'random' END AS rule,
 CASE WHEN firsthand_p >= 6e-1 THEN 1e0 ELSE 0.05::DOUBLE END AS sel FROM problems WHERE comment_id % 50 = 1)
 SELECT 'calibration' AS label_set, comment_id, band AS draw_stratum, round(rate, 9) AS selection_prob, 'calibration' AS purpose FROM queue
 UNION ALL SELECT 'audit', comment_id, 'faceted:' || rule, round(sel * ((SELECT count(*) FROM audit) / 4000), 9), 'audit' FROM audit""")
def _(t: Tables):
    rows = scored(t)
    queue = sp.label_queue(rows, BANDS, BAND_SIZES, 6, exclude=rows.filter("comment_id % 7 = 3"))
    audit = rows.filter("comment_id % 50 = 1")
    selection = rows.select("comment_id", F.when(F.col("score") >= 0.6, "gate").otherwise("random").alias("rule"), F.when(F.col("score") >= 0.6, 1.0).otherwise(0.05).alias("selection_prob"))
    out = sp.gold_draws(queue, audit, selection, 4000)
    return out.withColumn("selection_prob", F.round("selection_prob", 9))


@plan("smp_28_shown_card_audit", f"""WITH {PROBLEMS}, cards AS (SELECT 'c' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS card_id, CASE WHEN n_nationkey = 24 THEN 'solo' ELSE 'g' || CAST(n_regionkey AS VARCHAR) END AS group_id FROM nation),
 m AS (SELECT group_id, list(card_id ORDER BY card_id) AS mates FROM cards GROUP BY 1),
 r AS (SELECT comment_id, card_id, list_filter(mates, lambda x: x <> card_id) AS others, (({h60('21', "'coin'", 'comment_id')} >> 8) + 5e-1) / 4503599627370496 AS coin,
 {h60('21', "'card'", 'comment_id')} AS pick FROM (SELECT comment_id, card_id FROM problems) JOIN cards USING (card_id) JOIN m USING (group_id)),
 s AS (SELECT comment_id, card_id, len(others) = 0 AS forced, CASE WHEN len(others) = 0 OR coin < 5e-1 THEN card_id ELSE others[pick % len(others) + 1] END AS shown_card_id FROM r)
 SELECT *, shown_card_id = card_id AS is_pick FROM s""")
def _(t: Tables):
    cards = t.nation.select(
        F.format_string("c%02d", "n_nationkey").alias("card_id"),
        F.expr("case when n_nationkey = 24 then 'solo' else concat('g', n_regionkey) end").alias("group_id"),
    )
    queue = t.role("problems").filter("card_id IS NOT NULL AND card_id <> 'none'").select("comment_id", "card_id")
    return sp.shown_card_audit(queue, cards, 21)


@plan("smp_29_residue_sample", f"""WITH {PROBLEMS}, frame AS (SELECT comment_id, coalesce(group_id, 'none') AS stratum FROM problems WHERE card_id = 'none'), {SIZES}, alloc AS ({ham('sizes', '90')})
 SELECT comment_id, stratum FROM ({drawn('alloc', 13)})""")
def _(t: Tables):
    rows = t.role("problems").select("comment_id", "group_id", "card_id")
    return sp.residue_sample(rows, 90, 13)[0].select("comment_id", "stratum")


@plan("smp_30_top_cards_with_examples", f"""WITH {PROBLEMS}, m AS (SELECT card_id, count(DISTINCT author) AS n_authors FROM problems WHERE card_id <> 'none' GROUP BY 1 ORDER BY n_authors DESC, card_id LIMIT 10)
 SELECT card_id, n_authors, comment_id, example_no FROM m JOIN (SELECT card_id, comment_id, row_number() OVER (PARTITION BY card_id ORDER BY {h60('17', 'card_id', 'comment_id')}, comment_id) AS example_no
 FROM problems WHERE card_p >= 5e-1 QUALIFY example_no <= 5) USING (card_id)""")
def _(t: Tables):
    rows = t.role("problems").filter("card_id <> 'none'")
    metrics = rows.groupBy("card_id").agg(F.countDistinct("author").alias("n_authors"))
    return sp.top_cards_with_examples(metrics, rows.filter("card_p >= 0.5").select("card_id", "comment_id"), 10, 17)


@plan("smp_31_facet_queue", f"WITH a AS ({cte('answers')}), scored AS (SELECT comment_id, max(noul) AS score FROM a GROUP BY 1), {queue_sql('scored', 14)} SELECT comment_id, band, round(rate, 9) AS rate, repeated FROM queue")
def _(t: Tables):
    out = sp.facet_queue(t.role("answers"), BANDS, BAND_SIZES, 14)
    return out.select("comment_id", "band", F.round("rate", 9).alias("rate"), "repeated")


@plan("smp_31_merge_queue", f"""WITH scored AS (SELECT p_partkey AS comment_id, p_size / 5e1 AS score FROM part), {queue_sql('scored', 15)} SELECT comment_id, band, round(rate, 9) AS rate, repeated FROM queue""")
def _(t: Tables):
    pairs = t.part.select(F.col("p_partkey").alias("pair_id"), (F.col("p_size") / 50.0).alias("expected"))
    out = sp.merge_queue(pairs, BANDS, BAND_SIZES, 15)
    return out.select("comment_id", "band", F.round("rate", 9).alias("rate"), "repeated")


@plan("smp_32_budget_projection", f"""WITH RECURSIVE {COSTS}, tot AS (SELECT sum(n_frame * c) AS full_cost FROM strata), {greedy('strata', '(SELECT 2e5 / 1e-1)', '5e-2', 3)}
 SELECT 2e5 AS budget, true AS feasible, CAST(sum(n_take) AS BIGINT) AS n, round(sum(n_take * p), 4) AS expected_positives, round(max(n_frame / n_take), 6) AS largest_weight, round(sum(n_take * c) * 1e-1, 2) AS expected_cost FROM given
 UNION ALL SELECT 1e0, false, NULL, NULL, NULL, NULL""")
def _(t: Tables):
    out = al.budget_projection(strata(t), [1.0, 2e5], 0.1, 0.05, 3)
    return out.select("budget", "feasible", "n", F.round("expected_positives", 4).alias("expected_positives"), F.round("largest_weight", 6).alias("largest_weight"), F.round("expected_cost", 2).alias("expected_cost"))


@plan("smp_33_stratum_report", f"WITH {SAMPLE} SELECT coalesce(stratum, 'total') AS stratum, CAST(sum(n_frame) AS BIGINT) AS n_frame, CAST(sum(n_take) AS BIGINT) AS n_sample FROM alloc GROUP BY ROLLUP (stratum)")
def _(t: Tables):
    rows = frame(t)
    return sp.stratum_report(rows, sp.stratified_sample(rows, 600, 30, SEED))
