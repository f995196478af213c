"""Ties, null keys, merged cards and shared folders on tiny frames."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from threadgauge.operators import answers as an
from threadgauge.operators import robust as rb
from threadgauge.operators import sampling as sp
from threadgauge.operators.spread import hot_lookup, ordered_rank
from threadgauge.session import shared_folder
from threadgauge.streaming import jobs


def test_leave_one_out_ranks_by_contribution(spark):
    rows = spark.createDataFrame([("a", 10.0, 0.0), ("b", 1.0, 6.0), ("c", 1.0, 2.0)], "cluster string, weight double, x double")
    r = rb.leave_one_out(rows, 1).first()
    assert r.max_share == 0.75 and r.flagged and abs(r.min_stat - 2 / 11) < 1e-12


def test_drop_top_share_ties_and_limits(spark):
    rows = spark.range(40).select(F.col("id").cast("string").alias("cluster"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("x"))
    assert tuple(rb.drop_top_share(rows, 0.1).first()) == (36, 1.0)
    assert rb.drop_top_share(rows, 0.0).first().n_clusters == 39
    with pytest.raises(ValueError):
        rb.drop_top_share(rows, 1.0)


def test_ordered_rank_is_total(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("v"))
    got = ordered_rank(rows, [F.col("v").desc(), F.col("id").asc()], "r").orderBy("r").collect()
    assert [r.r for r in got] == list(range(1, 301))
    assert [r.id for r in got] == sorted(range(300), key=lambda i: (-(i % 3), i))


def test_hot_lookup_keeps_rows_without_a_key(spark):
    left = spark.range(100).select("id", F.expr("case when id < 40 then null when id < 90 then 7 else id end").alias("k"))
    right = spark.createDataFrame([(7, "hot"), (95, "cold")], "k long, name string")
    got = {r.id: r.name for r in hot_lookup(left, right, "k").collect()}
    assert len(got) == 100 and got[3] is None and got[50] == "hot" and got[95] == "cold" and got[96] is None


def test_draws_equal_an_ordered_limit(spark):
    pool = spark.range(500).select(F.col("id").alias("comment_id"), (F.col("id") % 5 + 1.0).alias("weight"))
    want = pool.withColumn("clock", -F.log(sp.unit_interval(3, F.col("comment_id"))) / F.col("weight")).orderBy("clock").limit(60)
    assert {r.comment_id for r in sp.pps_sample(pool, 60, 3).collect()} == {r.comment_id for r in want.collect()}
    assert sp.simple_sample(pool, 700, 3).count() == 500 and sp.simple_sample(pool, 70, 3).count() == 70


def test_merge_pairs_use_active_cards_and_final_ids(spark):
    cards = spark.createDataFrame(
        [("a", "g", "approved"), ("b", "g", "approved"), ("c", "h", "approved"), ("d", "h", "retired"), ("e", "h", "merged_into:c")],
        "card_id string, group_id string, status string",
    )
    lists = spark.createDataFrame([("a", "e"), ("c", "a"), ("b", "d"), ("b", "zz"), ("e", "c")], "first string, second string")
    assert sorted(tuple(r) for r in an.merge_pairs(cards, lists, 2).collect()) == [("a", "b"), ("a", "c")]


def test_long_merge_chains_and_cycles(spark):
    chain = spark.range(50).select(
        F.col("id").cast("string").alias("card_id"), F.expr("if(id = 49, 'approved', concat('merged_into:', id + 1))").alias("status")
    )
    assert {r.final_id for r in an.merge_map(chain).collect()} == {"49"}
    for n in (1, 2, 3, 4):
        ring = spark.range(n).select(F.col("id").cast("string").alias("card_id"), F.expr(f"concat('merged_into:', (id + 1) % {n})").alias("status"))
        with pytest.raises(ValueError, match="cycle"):
            an.merge_map(ring)


def test_open_calls_are_pending(spark):
    made = spark.createDataFrame([("r", 1, 1), ("r", 2, 1)], "run_id string, logical_call_id long, attempt int").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    done = made.filter("logical_call_id = 1").select("run_id", "logical_call_id", "attempt", F.col("ts").alias("pending_ts"), F.lit("calculated").alias("cost_class"))
    assert {r.logical_call_id: r.cost_class for r in jobs.with_open_calls(done, made).collect()} == {1: "calculated", 2: "pending"}


def test_a_cluster_must_name_its_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://head:7077")
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
