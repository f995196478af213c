"""Binomial splits, replicate totals and the searches and simulations built on them, against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadgauge.operators import bootstrap as bs
from threadgauge.operators import estimate as es
from threadgauge.operators import quality as ql


def test_splits_add_up_and_are_multinomial():
    m, block, reps = 1000, 64, 4000
    counts = np.stack([bs.split_counts(3, "s", b, m, reps, block) for b in range(16)])
    assert (counts.sum(axis=0) == m).all()
    sizes = np.minimum(block, m - np.arange(16) * block)
    share = sizes / m
    error = np.sqrt(m * share * (1 - share) / reps)
    assert (np.abs(counts.mean(axis=1) - m * share) < 5 * error).all()
    assert np.allclose(counts.var(axis=1), m * share * (1 - share), rtol=0.15)
    pair = np.cov(counts[0], counts[9])[0, 1]
    assert abs(pair + m * share[0] * share[9]) < 6 * m * math.sqrt(share[0] * share[9] / reps)


def test_more_replicates_and_fewer_draws():
    few = [bs.split_counts(1, "a", b, 500, 50, 32, fewer=1) for b in range(16)]
    many = [bs.split_counts(1, "a", b, 500, 400, 32, fewer=1) for b in range(16)]
    assert all((x == y[:50]).all() for x, y in zip(few, many, strict=True)) and (np.sum(many, axis=0) == 499).all()
    assert (bs.split_counts(1, "a", 0, 1, 5, fewer=1) == 0).all()


def test_walks_stay_short_for_billions_of_units():
    n = bs.split_counts(7, "huge", 123_456, 10**12, 200)
    assert abs(n.mean() - bs.BLOCK) < 5 * math.sqrt(bs.BLOCK / 200)


def plain(units, values, entity, n_rep, seed, block, order):
    """Totals by walking over each replicate's draws one by one."""
    out = {}
    for stratum, group in units.groupby("stratum"):
        names = order[stratum]
        for b in range(-(-len(names) // block)):
            inside = names[b * block : (b + 1) * block]
            n = bs.split_counts(seed, stratum, b, len(names), n_rep, block)
            for rep in range(n_rep):
                times = bs.slot_counts(seed, stratum, b, len(inside), np.array([rep]), n[rep : rep + 1])[0]
                assert times.sum() == n[rep]
                for cluster, count in zip(inside, times, strict=True):
                    for r in group[group["cluster"] == cluster].to_dict("records"):
                        key = (rep, *[r[e] for e in entity])
                        held = out.setdefault(key, [0.0] * len(values))
                        for j, v in enumerate(values):
                            held[j] += count * r[v]
    return out


@pytest.mark.parametrize(("block", "cells"), [(4096, 1 << 21), (7, 1 << 21), (7, 64)])
def test_totals_by_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(bs, "CELLS", cells)
    rng = np.random.default_rng(4)
    rows = [(f"s{i % 2}", f"c{i % 23}", [None, "x", "y"][i % 3], float(rng.integers(1, 9)), 1.0) for i in range(120)]
    frame = spark.createDataFrame(rows, "stratum string, cluster string, kind string, w double, n double")
    got = bs.resample(frame, ["w", "n"], ["kind"], n_rep=12, seed=9, block=block).collect()
    units = pd.DataFrame(rows, columns=["stratum", "cluster", "kind", "w", "n"]).groupby(["stratum", "cluster", "kind"], dropna=False, as_index=False).sum()
    units["kind"] = units["kind"].astype(object).where(units["kind"].notna(), None)
    ids = bs.collapse(frame, ["n"]).select("stratum", "cluster")
    placed = bs.hash_rank(ids, ["stratum"], bs.hash60(9, F.col("stratum"), F.col("cluster")), ["cluster"], "pos").collect()
    order = {s: [r["cluster"] for r in sorted(placed, key=lambda r: r["pos"]) if r["stratum"] == s] for s in ("s0", "s1")}
    want = plain(units, ["w", "n"], ["kind"], 12, 9, block, order)
    assert len([r for r in got if r["rep"] == bs.POINT]) == 3
    for r in got:
        if r["rep"] >= 0:
            assert np.allclose((r["w"], r["n"]), want.get((r["rep"], r["kind"]), (0, 0)))
    for rep in range(12):
        assert math.isclose(sum(r["n"] for r in got if r["rep"] == rep), sum(v[1] for k, v in want.items() if k[0] == rep))


def test_unit_counts_per_replicate_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", i, 1.0) for i in range(300)] + [(None, 7, 1.0)], "stratum string, cluster int, n double")
    got = bs.resample(rows, ["n"], ["stratum"], n_rep=40, block=16).collect()
    assert {(r["stratum"], r["n"]) for r in got} == {("a", 300.0), (None, 1.0)} and len(got) == 82
    assert bs.resample(rows.limit(0), ["n"], n_rep=5).count() == 0


def labels(spark, n=400, levels=150):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.6)
        rows.append((y, float(np.clip(rng.integers(0, levels) / levels + 0.15 * y, 0, 1)), float(rng.integers(1, 4)), f"s{i % 3}", f"c{i % 90}"))
    return spark.createDataFrame(rows, "y int, score double, weight double, stratum string, cluster string")


def test_search_for_the_threshold_equals_all_scores_at_once(spark):
    rows = labels(spark)
    options = {"n_rep": 60, "seed": 3}
    for target in (0.95, 0.5, 1.0):
        whole = ql.threshold_by_lower_bound(rows, target, cuts=10_000, **options).first()
        assert ql.threshold_by_lower_bound(rows, target, cuts=4, **options).first() == whole and whole["threshold"] is not None
    assert ql.threshold_by_lower_bound(rows.filter("y = 0"), 0.5, **options).first()["threshold"] is None
    assert ql.threshold_by_lower_bound(rows, 1.5, cuts=4, **options).first()["threshold"] is None


@pytest.mark.parametrize(("draws", "cells"), [(1, 1), (5, 3), (40, 7), (30, 1000), (200, 50)])
def test_largest_counts_have_the_naive_distribution(monkeypatch, draws, cells):
    want = np.array([np.sort(np.bincount(np.random.default_rng([1, s]).integers(0, cells, draws), minlength=cells))[-3:].sum() for s in range(3000)])
    for held in (1 << 21, 8):
        monkeypatch.setattr(es, "DRAWN_AT_ONCE", held)
        got = np.array([sum(es.top_counts(np.random.default_rng([2, s]), draws, cells, 3)) for s in range(3000)])
        error = math.sqrt((want.var() + got.var()) / 3000)
        assert abs(got.mean() - want.mean()) <= 4 * error + 1e-9
        assert abs(got.std() - want.std()) <= 0.15 * want.std() + 1e-9


def test_null_band_equals_the_naive_simulation(spark):
    rng = np.random.default_rng(5)
    clusters = np.repeat(np.arange(40), rng.integers(1, 9, 40)).tolist()
    rows = [(i, f"k{i % 3}", c) for i, c in enumerate(clusters)] + [(-1, "k0", None)]
    frame = spark.createDataFrame(rows, "comment_id int, card_id string, story int")
    got = {r["card_id"]: r for r in es.null_band(frame, "story", sims=2000, seed=1).collect()}
    sizes = np.bincount(clusters)
    for card in ("k0", "k1", "k2"):
        n = sum(r[1] == card and r[2] is not None for r in rows)
        drawn = np.random.default_rng(6).multinomial(n, sizes / sizes.sum(), size=20_000)
        low, high = np.quantile(np.sort(drawn, axis=1)[:, -3:].sum(axis=1) / n, [0.025, 0.975])
        assert abs(got[card]["null_lo"] - low) <= 1.01 / n and abs(got[card]["null_hi"] - high) <= 1.01 / n
    assert es.null_band(frame.limit(0), "story", sims=5).count() == 0


def test_draws_are_made_once_per_replicate_table(spark):
    rows = spark.createDataFrame([(f"s{i % 2}", i % 30, f"k{i % 4}", float(1 + i % 3)) for i in range(90)], "stratum string, cluster int, kind string, weight double")
    reps = bs.share_replicates(rows, "kind", n_rep=20, seed=2)
    # A replicate table is written: readers that filter and join it find no draws in their plans.
    assert "MapInArrow" not in reps._jdf.queryExecution().toString()
    again = bs.share_replicates(rows, "kind", n_rep=20, seed=2)
    assert sorted(map(tuple, reps.collect())) == sorted(map(tuple, again.collect()))


def test_levels_share_draws_and_equal_single_levels(spark):
    rows = [(f"s{i % 2}", i % 37, f"k{i % 4}", None if i % 5 == 0 else f"g{i % 3}", float(1 + i % 3), ["h1", "h2"][i % 2]) for i in range(200)]
    frame = spark.createDataFrame(rows, "stratum string, cluster int, kind string, grp string, weight double, half string")
    options = {"buckets": F.array(F.lit("all"), "half"), "within": True, "n_rep": 15, "seed": 4, "block": 8}
    both = bs.level_replicates(frame, ["kind", "grp"], **options)
    for level in ("kind", "grp"):
        want = sorted(map(tuple, bs.share_replicates(frame, level, **options).collect()))
        got = sorted(map(tuple, both.filter(F.col("level") == level).drop("level").collect()))
        assert got == want and len(got) > 0


def test_missing_values_do_not_depend_on_the_task_count(spark):
    rows = spark.createDataFrame([("a", i, f"k{i % 3}", None if i == 77 else 1.0) for i in range(200)], "stratum string, cluster int, kind string, w double")
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted(map(str, bs.resample(rows, ["w"], ["kind"], n_rep=5, seed=1, block=64).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1] and len(found[0]) == 18


def test_pieces_of_replicates_and_kinds_of_totals_agree(spark, monkeypatch):
    rows = spark.createDataFrame([("a", i, f"k{i % 50}", float(i % 7)) for i in range(500)], "stratum string, cluster int, kind string, w double")
    want = sorted(map(tuple, bs.resample(rows, ["w"], ["kind"], n_rep=30, seed=1, block=64).collect()))
    for cells, dense in ((64, 24), (1 << 21, 0), (1 << 21, 10**9)):
        monkeypatch.setattr(bs, "CELLS", cells)
        monkeypatch.setattr(bs, "DENSE", dense)
        assert sorted(map(tuple, bs.resample(rows, ["w"], ["kind"], n_rep=30, seed=1, block=64).collect())) == want
