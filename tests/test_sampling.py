import random

import pytest
from pyspark.sql import functions as F

from threadgauge.functions.hashing import hash60
from threadgauge.operators import allocate as al
from threadgauge.operators import sampling as sp
from threadgauge.operators import spread


def sizes(spark, d):
    return spark.createDataFrame(list(d.items()), "stratum string, n_frame long")


def taken(df):
    return {r.stratum: r.n_take for r in df.collect()}


def frame(spark):
    return spark.range(1000).select(
        F.col("id").alias("comment_id"), (F.col("id") % 90).alias("story_id"),
        F.when(F.col("id") < 600, "A").when(F.col("id") < 900, "B").otherwise("C").alias("stratum"),
    )


def test_allocation_cases(spark):
    assert taken(al.allocate(sizes(spark, {"A": 600, "B": 300, "C": 100}), 101)) == {"A": 61, "B": 30, "C": 10}
    assert taken(al.allocate(sizes(spark, {"A": 600, "B": 300, "C": 2}), 50, 5)) == {"A": 32, "B": 16, "C": 2}
    assert taken(al.hamilton(sizes(spark, {"A": 600, "B": 300, "C": 100}), 101)) == {"A": 61, "B": 30, "C": 10}
    with pytest.raises(ValueError):
        al.allocate(sizes(spark, {"A": 5, "B": 5}), 3, 2)


def test_allocation_properties(spark):
    rng = random.Random(1)
    for _ in range(6):
        d = {f"s{i}": rng.randrange(1, 200) for i in range(rng.randrange(2, 9))}
        floor = rng.randrange(0, 4)
        n = rng.randrange(sum(min(s, floor) for s in d.values()), sum(d.values()) + 1)
        got = taken(al.allocate(sizes(spark, d), n, floor))
        assert sum(got.values()) == n and all(min(d[h], floor) <= a <= d[h] for h, a in got.items())


def test_floors_equal_repeated_proportional_rounds(spark):
    rng = random.Random(5)
    for _ in range(4):
        d = {f"s{i:02}": rng.choice([1, 2, 7, 40, 300, 2000]) for i in range(12)}
        n, floor = 250, rng.randrange(1, 16)
        pinned: dict = {}
        while True:
            free = {h: s for h, s in d.items() if h not in pinned}
            rest, whole = n - sum(pinned.values()), sum(free.values())
            part = {h: divmod(rest * s, whole) for h, s in free.items()}
            odd = sorted(free, key=lambda h: (-part[h][1], h))[: rest - sum(q for q, _ in part.values())]
            got = {h: q + (h in odd) for h, (q, _) in part.items()}
            short = {h: min(d[h], floor) for h in free if got[h] < min(d[h], floor)}
            if not short:
                break
            pinned |= short
        assert taken(al.allocate(sizes(spark, d), n, floor)) == pinned | got


def test_yield_equals_buying_unit_by_unit(spark):
    rng = random.Random(8)
    for _ in range(4):
        rows = [(f"s{i}", rng.randrange(0, 60), rng.randrange(1, 9) / 8, float(rng.randrange(1, 90))) for i in range(11)]
        need = {h: min(n, max(3, -(-n // 10))) if n else 0 for h, n, _, _ in rows}
        budget = sum(need[h] * c for h, _, _, c in rows) + rng.randrange(0, 4000)
        left = budget - sum(need[h] * c for h, _, _, c in rows)
        for h, n, _, c in sorted(rows, key=lambda r: (-r[2] / r[3], r[0])):
            while need[h] < n and c <= left:
                need[h], left = need[h] + 1, left - c
        frame = spark.createDataFrame(rows, "stratum string, n_frame long, p double, c double")
        assert taken(al.yield_allocation(frame, float(budget), 0.1, 3)) == need


def test_capped_shares_level_out(spark):
    rng = random.Random(9)
    for n in (5, 80, 400, 9000):
        rows = [(f"s{i}", rng.randrange(1, 90), float(rng.randrange(0, 500))) for i in range(14)]
        full: set = set()
        while True:
            w = sum(x for h, _, x in rows if h not in full)
            left = n - sum(s for h, s, _ in rows if h in full)
            more = {h for h, s, x in rows if h not in full and w and left * x / w >= s}
            if not more:
                break
            full |= more
        want = {h: s if h in full else max(1, round(left * x / w)) if w else 1 for h, s, x in rows}
        frame = spark.createDataFrame(rows, "stratum string, n_frame long, wsum double")
        assert taken(al.capped_allocation(frame, n)) == want


def test_residue_takes_units_from_the_tallest(spark):
    rng = random.Random(10)
    for k in (3, 14, 20, 60, 10_000):
        d = {f"s{i:02}": rng.choice([1, 1, 2, 300, 310, 1000]) for i in range(14)}
        got = taken(al.hamilton(sizes(spark, d), min(k, sum(d.values()))))
        for h in sorted(d) if k >= len(d) else []:
            if got[h] == 0:
                got[max(d, key=lambda g: (got[g], g))] -= 1
                got[h] = 1
        assert taken(al.residue_allocation(sizes(spark, d), k)) == got


def test_many_strata_stay_on_spark(spark):
    many = spark.range(50_000).selectExpr("concat('s', id) AS stratum", "id % 40 + 1 AS n_frame", "(id % 7 + 1) / 8d AS p", "id % 5 + 1d AS c", "id % 11 + 1d AS wsum")
    for out in (al.allocate(many, 300_000, 2), al.yield_allocation(many, 1_000_000.0, 0.1, 2), al.capped_allocation(many, 300_000), al.residue_allocation(many, 60_000)):
        got = out.groupBy().agg(F.count("*").alias("n"), F.min("n_take").alias("least"), F.sum("n_take").alias("total")).first()
        assert got.n == 50_000 and got.least >= 1 and got.total <= 520_000
    assert al.allocate(many, 300_000, 2).agg(F.sum("n_take")).first()[0] == 300_000


def test_yield_allocation_case(spark):
    rows = spark.createDataFrame([("a", 1000, 0.5, 100.0), ("b", 1000, 0.5, 100.0)], "stratum string, n_frame long, p double, c double")
    assert taken(al.yield_allocation(rows, 2100, 0.01, 10)) == {"a": 11, "b": 10}
    with pytest.raises(ValueError):
        al.yield_allocation(rows, 100, 0.01, 10)


def test_draw_is_exact_seeded_and_partition_free(spark):
    rows, quota = frame(spark), sizes(spark, {"A": 600, "B": 300, "C": 100}).withColumn("n_take", F.lit(37))
    a = {r.comment_id for r in sp.draw(rows, quota, 5).collect()}
    b = {r.comment_id for r in sp.draw(rows.repartition(13), quota, 5).collect()}
    c = {r.comment_id for r in sp.draw(rows, quota, 6).collect()}
    assert a == b and a != c and len(a) == 111


def test_hash_rank_equals_a_sort_with_one_dominant_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"))
    got = {(r.k, r.id): r.draw_rank for r in spread.hash_rank(rows, ["k"], hash60(1, F.col("id")), ["id"]).collect()}
    order = {}
    for r in rows.withColumn("h", hash60(1, F.col("id"))).collect():
        order.setdefault(r.k, []).append((r.h, r.id))
    want = {(k, i): n for k, v in order.items() for n, (_, i) in enumerate(sorted(v), 1)}
    assert got == want


def test_value_ranks_and_quantiles(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 == 0 else f"k{i % 4}", float(rng.randrange(0, 50))) for i in range(900)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.lo, r.mid, r.hi) for r in spread.exact_quantiles(df, ["k"], "v", {"lo": 0.025, "mid": 0.5, "hi": 0.95}).collect()}
    import numpy as np

    for k in {k for k, _ in data}:
        want = np.quantile([v for kk, v in data if kk == k], [0.025, 0.5, 0.95])
        assert np.allclose(got[k], want)
    low = spread.exact_quantiles(df, [], "v", {"q": 1 / 3}, method="lower").first().q
    assert low == np.quantile([v for _, v in data], 1 / 3, method="lower")


def test_weights_and_expansion(spark):
    rows = frame(spark)
    sample = sp.stratified_sample(rows, 101, 5, 3)
    assert sp.check_weights(sample, al.stratum_sizes(rows)).count() == 0
    first = sample.select("comment_id", "story_id", "stratum", F.lit(1).alias("batch"), F.col("draw_rank").alias("draw_order"))
    grown = sp.expand(first, rows, sizes(spark, {"A": 1, "B": 1, "C": 1}).withColumn("n_take", F.lit(7)), 4, 2)
    assert grown.count() == 122 and {r.comment_id for r in first.collect()} <= {r.comment_id for r in grown.collect()}
    assert abs(grown.agg(F.sum("weight")).first()[0] - 1000) < 1e-6


def screen(spark):
    parts = []
    for stratum, pos, neg, w in (("A", 40, 10, 10.0), ("B", 20, 30, 5.0), ("C", 15, 0, 4.0)):
        parts += [(stratum, w, 0.9)] * pos + [(stratum, w, 0.1)] * neg
    data = [(i, i % 20, s, "explore", w, p) for i, (s, w, p) in enumerate(parts)]
    return spark.createDataFrame(data, "comment_id long, story_id long, stratum string, half string, weight double, firsthand_p double")


def test_two_phase_case(spark):
    got = sp.two_phase(screen(spark), 20, 6, 0.7, 1)
    counts = {(r.phase, r.stratum): r["count"] for r in got.groupBy("phase", "stratum").count().collect()}
    assert counts == {("pos", "A"): 14, ("pos", "B"): 4, ("pos", "C"): 2, ("neg", "A"): 2, ("neg", "B"): 4}
    assert got.filter("abs(weight - w1 / p2) > 1e-9").count() == 0
    grown = sp.expand_two_phase(got, screen(spark), 40, 0.7, 2)
    assert {r.comment_id for r in got.collect()} <= {r.comment_id for r in grown.collect()}
    assert grown.filter("phase = 'neg' AND wave = 2").count() == 0


def test_pps_prefers_heavy_rows(spark):
    pool = spark.range(400).select(F.col("id").alias("comment_id"), F.when(F.col("id") < 40, 50.0).otherwise(1.0).alias("weight"))
    hits = sum(sp.pps_sample(pool, 40, s).filter("comment_id < 40").count() for s in range(4)) / 160
    assert hits > 0.6


def test_frame_v1_tiers(spark):
    comments = spark.createDataFrame([(1, 1, "P01", "story", True), (2, 9, "P01", "story", True), (3, 2, "P02", "ask_hn", False)], "comment_id long, story_id long, period string, thread_type string, eligible boolean")
    stories = spark.createDataFrame([(1, 5), (2, 50)], "story_id long, descendants long")
    assert {r.comment_id: r.stratum for r in sp.frame_v1(comments, stories, (5, 50)).collect()} == {1: "P01|story|e1", 2: "P01|story|e0"}
    cut = sp.engagement_cutpoints(spark.createDataFrame([(5,), (50,), (500,)], "descendants long")).first()
    assert (cut.lo, cut.hi) == (5, 50)


def test_ranks_follow_the_rows_not_a_fixed_number_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(spread, "RANGE_ROWS", 50)
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("k")).alias("k"), F.concat(F.lit("same-prefix-" * 4), F.col("id") % 1000).alias("v"))
    got = spread.value_ranks(rows, ["k"], "v", bucket="b")
    sizes = got.groupBy("b").agg(F.sum("n").alias("n")).collect()
    assert len(sizes) > 20 and max(r.n for r in sizes) < 400
    frame = rows.toPandas()
    for key, part in frame.groupby("k", dropna=False):
        values = sorted(part["v"])
        mine = {r.v: (r.n, r.n_below) for r in got.collect() if (r.k or "") == ("k" if key == "k" else "")}
        assert mine == {v: (values.count(v), values.index(v)) for v in set(values)}


def test_hash_buckets_grow_as_the_root_of_the_largest_key(spark):
    for n, most in ((100, 40), (40_000, 600)):
        rows = spark.range(n).withColumn("k", F.when(F.col("id") % 4 == 0, F.col("id")))
        dealt = spread._prefixed(rows, ["k"], hash60(F.lit("s"), F.col("id").cast("string")))
        sizes = dealt.groupBy("k", "__b").count().agg(F.max("count"), F.countDistinct("__b")).first()
        assert sizes[0] < most and sizes[1] <= 2 * n**0.5 + 2
    assert spread.hash_rank(spark.range(0), [], F.col("id"), ["id"]).count() == 0
