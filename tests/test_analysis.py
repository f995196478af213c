import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from threadgauge.operators import answers as an
from threadgauge.operators import cards as cd
from threadgauge.operators import discussion as ds
from threadgauge.operators import gates as gt
from threadgauge.operators import ledger as lg
from threadgauge.operators import reports as rp
from threadgauge.schemas import LEDGER, conform
from threadgauge.sources import sinks


def test_rank_order_case(spark):
    m = spark.createDataFrame([("c0001", 5, 1), ("c0002", 10, 1), ("c0003", 3, 1)], "card_id string, n_authors long, n_threads long")
    got = cd.rank_cards(m, {"n_authors": 1.0, "n_threads": 0.0}).orderBy("rank").collect()
    assert [r.card_id for r in got] == ["c0002", "c0001", "c0003"]
    with pytest.raises(ValueError):
        cd.rank_cards(m, {"nope": 1.0})


def test_card_metrics_nulls(spark):
    data = [(1, "a", "c1", 0.9, 1, "P01", None, None), (2, None, "c1", 0.9, None, "P07", 0.7, "unresolved"), (3, "a", "c1", 0.9, 1, "P01", 0.2, "resolved")]
    rows = spark.createDataFrame(data, "comment_id long, author string, card_id string, card_p double, story_id long, period string, f_paid double, resolution string")
    for c in ("f_switched", "f_abandoned", "f_workaround", "specificity"):
        rows = rows.withColumn(c, F.lit(None).cast("double"))
    rows = rows.withColumn("domain", F.lit("web")).withColumn("role", F.lit("other")).withColumn("weight", F.lit(2.0))
    r = cd.card_metrics(rows, 1).first()
    assert (r.n_comments, r.n_authors, r.n_comments_capped, r.n_threads, r.n_halfyears, r.n_roles) == (3, 1, 2, 1, 2, 0)
    assert r.paid_rate == 0.5 and r.switched_rate is None and r.commercial_rate == 0.5 and r.unresolved_rate == 0.5
    assert abs(r.max_thread_share - 2 / 3) < 1e-12 and abs(r.max_author_share - 2 / 3) < 1e-12 and r.weighted_n == 6.0


def test_merge_chain_errors(spark):
    good = spark.createDataFrame([("a", "merged_into:b"), ("b", "merged_into:c"), ("c", "approved")], "card_id string, status string")
    assert {r.card_id: r.final_id for r in an.merge_map(good).collect()} == {"a": "c", "b": "c", "c": "c"}
    for bad in ([("a", "merged_into:b"), ("b", "merged_into:a")], [("a", "merged_into:zz")]):
        with pytest.raises(ValueError):
            an.merge_map(spark.createDataFrame(bad, "card_id string, status string"))


def test_screen_table_errors(spark):
    items = spark.range(7).select(F.col("id").alias("comment_id"))
    packed = an.pack(items, 3)
    assert {(r.packed_id, r.slot, r.comment_id) for r in packed.collect()} >= {(0, "c1", 0), (0, "c3", 2), (3, "c1", 3), (6, "c1", 6)}
    answers = packed.select(F.col("packed_id").alias("comment_id"), F.concat("slot", F.lit("_firsthand_problem")).alias("question_id"), F.lit(0.5).alias("noul"), F.lit(1).alias("part"))
    done = answers.select("comment_id", "part").distinct()
    assert an.screen_table(answers, done, packed, items).count() == 7
    with pytest.raises(ValueError):
        an.screen_table(answers, done.filter("comment_id > 0"), packed, items)
    with pytest.raises(ValueError):
        an.screen_table(answers.union(answers), done, packed, items)


def naive_linkage(names, score, cut):
    clusters = [{n} for n in names]

    def dist(x, y):
        pairs = [(min(a, b), max(a, b)) for a in x for b in y]
        return sum(2 - score.get(p, 0.0) for p in pairs) / len(pairs)

    while len(clusters) > 1:
        d, i, j = min((dist(x, y), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(clusters), 2))
        if d > cut:
            break
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [clusters[i] | clusters[j]]
    return {frozenset(c) for c in clusters}


def test_average_linkage_equals_a_naive_merge(spark):
    for seed in range(2):
        rng = random.Random(seed)
        names = [f"c{i:02d}" for i in range(16)]
        score = {p: 2 * rng.random() ** 0.6 for p in itertools.combinations(names, 2) if rng.random() < 0.5}
        cards = spark.createDataFrame([(n, "g" + str(i % 3)) for i, n in enumerate(names)], "card_id string, group_id string")
        pairs = spark.createDataFrame([(a, b, s) for (a, b), s in score.items()], "a string, b string, score double")
        got = {}
        for r in ds.average_linkage(cards, pairs, 0.8).collect():
            got.setdefault(r.bundle, set()).add(r.card_id)
        assert {frozenset(c) for c in got.values()} == naive_linkage(names, score, 0.8)


def test_clique_becomes_one_bundle(spark):
    cards = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2"), ("d", "g2"), ("x", "g3"), ("y", "g3")], "card_id string, group_id string")
    pairs = spark.createDataFrame([(a, b, 2.0) for a, b in itertools.combinations("abcd", 2)], "a string, b string, score double")
    r = ds.bundles(cards, pairs).collect()
    assert len(r) == 1 and r[0].cards == ["a", "b", "c", "d"] and r[0].persistence == 1.0 and r[0].groups_spanned == 2


def test_mention_rules(spark):
    tools = spark.createDataFrame([("Go", [], "l", False), ("llama.cpp", [], "l", False), ("llama", [], "l", False), ("AWS", [], "c", False)], "name string, aliases array<string>, category string, name_case boolean")
    texts = ["I write Go every day", "just let it go", "the laws changed again", "served by llama.cpp locally"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert sorted((r.id, r.tool) for r in ds.find_mentions(df, tools).collect()) == [(0, "Go"), (3, "llama.cpp")]


def test_token_shapes(spark):
    df = spark.createDataFrame([("Using node.js, c++. gpt-5 a+ abc+ the AGENTS-",)], "t string")
    assert df.select(ds.tokens(F.col("t"), ["the"]).alias("x")).first().x == ["using", "node.js", "c++", "gpt-5", "abc", "agents"]
    words = spark.createDataFrame([(w,) for w in ("ai agents", "a1234b", "x@y.z", "go to example.com", "@me", "kafka")], "t string")
    assert [r.ok for r in words.select(ds.lexical_ok(F.col("t")).alias("ok")).collect()] == [True, False, False, False, False, True]


LOG = "run_id string, logical_call_id string, attempt int, cost_class string, status string, request_ms long, input_tokens long, cost_usd double"


def test_ledger_case(spark):
    rows = spark.createDataFrame([
        ("r", "1", 1, "calculated", "200", 10, 100, 0.1), ("r", "2", 1, "unknown", "500", 20, None, None),
        ("r", "2", 2, "calculated", "200", 30, 500, 0.5), ("r", "3", 1, "replay", None, None, 50, None),
    ], LOG)
    s = lg.ledger_summary(rows).first()
    assert (s.attempts, s.logical_calls, s.unknown_attempts, s.replays, s.retried_calls, s.input_tokens) == (3, 3, 1, 1, 1, 600)
    lone = spark.createDataFrame([("r", "1", 1, "pending", None, None, None, None)], LOG)
    s = lg.ledger_summary(lone).first()
    assert s.attempts == 1 and s.unknown_attempts == 1 and lg.status_counts(lone).first().status == "none"


def test_gates(spark, tmp_path):
    nested = spark.createDataFrame([(1, [("a", "b")])], "id long, items array<struct<author:string,ok:string>>")
    assert [r.field for r in gt.forbidden_fields("t", nested).collect()] == ["items.author"]
    texts = spark.createDataFrame([(1, "mail a.b@example.com"), (2, "see /home/me"), (3, "fine"), (4, "password = hunter22")], "id long, note string")
    assert sorted((r.row_key, r.rule) for r in gt.pattern_findings("t", texts, "id").collect()) == [(1, "email"), (2, "local_path"), (4, "assigned_secret")]
    assert gt.long_text("t", spark.createDataFrame([("x" * 100,), ("y" * 90,)], "note string")).count() == 1
    root = str(tmp_path / "site")
    sinks.publish({"t": texts.select("id")}, root, [gt.forbidden_fields])
    with pytest.raises(ValueError):
        sinks.publish({"t": texts.withColumn("author", F.lit("x"))}, root, [gt.forbidden_fields])
    assert spark.read.parquet(f"{root}/t").columns == ["id"]


def test_conform_and_replace(spark):
    with pytest.raises(ValueError):
        conform(spark.range(1), LEDGER)
    old = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.5)], "label_set string, comment_id long, selection_prob double")
    new = spark.createDataFrame([("a", 9, 1.0)], old.schema)
    assert sorted(r.comment_id for r in sinks.replace_label_sets(old, new).collect()) == [2, 9]
    with pytest.raises(ValueError):
        sinks.replace_label_sets(old, spark.createDataFrame([("a", 9, 0.0)], old.schema))


def test_display_label_cap(spark):
    rows = spark.createDataFrame([("a", "Full text")], "k string, full string")
    with pytest.raises(ValueError):
        rp.display_labels(rows, spark.createDataFrame([("a", "x" * 40)], "k string, short string"), "k", "full")


def test_tail_of_the_normal_law(spark):
    points = [0.0, 0.3, -1.0, 1.96, 4.5, -7.0, 12.0]
    got = spark.createDataFrame([(z,) for z in points], "z double").select("z", ds.two_sided_p(F.col("z")).alias("p")).collect()
    assert all(abs(r.p / math.erfc(abs(r.z) / math.sqrt(2)) - 1) < 1.3e-7 for r in got)


def test_term_counts_by_hand(spark):
    text = "Rust's build fails; c++ builds, build c++. rust build a++ 9lives node.js. +++ x"
    rows = spark.createDataFrame([("g", "ann", text), ("g", "ann", "build"), ("g", None, "build"), ("g", "", "Builds"), (None, "ann", "build"), ("g", "bob", "")], "group_id string, author string, text string")
    got = {(r.author, r.term): (r.c, r.n) for r in ds.term_counts(rows).collect()}
    assert got["ann", "build"] == (4, 2) and got["ann", "c++"] == (2, 1) and got["ann", "rust build"] == (2, 1) and got["ann", "node.js"] == (1, 1)
    assert got[None, "build"] == (1, 1) and got["", "builds"] == (1, 1) and ("ann", "x") not in got
    stats, words, totals = ds.term_stats(rows, least=2)
    kept = {r.canon: (r.cnt, r.n_comments, r.n_authors) for r in stats.collect()}
    assert kept == {"build": (7, 5, 1)}
    assert [(r.canon, r.corpus, r.display, sorted(r.words)) for r in words.collect()] == [("build", 7, "build", ["build", "builds"])]
    assert [r.n for r in totals.collect()] == [sum(c for c, _ in got.values())]


def test_only_frequent_terms_are_counted_by_author(spark):
    texts = ["red parks run", "red parks run far", "red park", "odd words here", "red glass", "red glass parks"] * 2
    rows = spark.createDataFrame([("gh"[k % 5 == 0], f"a{k % 4}", t) for k, t in enumerate(texts)], "group_id string, author string, text string")
    every = {(r.group_id, r.author, r.term): (r.c, r.n) for r in ds.term_counts(rows).collect()}
    passing = ds.frequent_classes(rows, least=4)
    some = {(r.group_id, r.author, r.term): (r.c, r.n) for r in ds.term_counts(rows, passing=passing).collect()}
    assert {t for *_, t in some} >= {"red", "parks", "red parks"} and "odd words" not in {t for *_, t in some}
    assert some == {k: v for k, v in every.items() if k[2] in {t for *_, t in some}}
    full = ds.term_counts(rows, passing=ds.frequent_classes(rows, least=1, most=64)).collect()
    assert {(r.group_id, r.author, r.term): (r.c, r.n) for r in full} == every
    whole, wide = ds.term_stats(rows), ds.term_stats(rows, least=4)
    enough = {(r.group_id, r.canon, r.cnt, r.n_comments, r.n_authors) for r in whole[0].collect() if r.n_comments >= 4}
    assert enough == {(r.group_id, r.canon, r.cnt, r.n_comments, r.n_authors) for r in wide[0].collect()}
    listed = {r.canon: (r.corpus, r.display, sorted(r.words)) for r in whole[1].collect()}
    assert all(listed[r.canon] == (r.corpus, r.display, sorted(r.words)) for r in wide[1].collect())
    assert sorted(whole[2].collect()) == sorted(wide[2].collect())
