import numpy as np
from pyspark.sql import functions as F

from threadgauge.operators import bootstrap as bs
from threadgauge.operators import estimate as es
from threadgauge.operators import quality as ql
from threadgauge.operators import robust as rb


def units(spark, n=600):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("stratum"), (F.col("id") % 150).alias("cluster"),
        (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("one"), F.lit(1.0).alias("weight"),
    )


def test_draws_keep_stratum_counts_and_ignore_partitioning(spark):
    rows = units(spark)
    per_unit = rows.groupBy("stratum", "cluster").agg(F.sum("x").alias("x"), F.lit(1.0).alias("one"), F.first("weight").alias("weight"))
    for block in (4096, 16):
        reps = bs.resample(per_unit, ["one"], ["stratum"], n_rep=12, seed=3, block=block)
        sizes = {r.stratum: r["count"] for r in per_unit.groupBy("stratum").count().collect()}
        assert all(abs(r.one - sizes[r.stratum]) < 1e-9 for r in reps.collect())
    a = {r.rep: r.x for r in bs.resample(rows, ["x"], n_rep=5, seed=1).collect()}
    b = {r.rep: r.x for r in bs.resample(rows.repartition(11), ["x"], n_rep=5, seed=1).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_bootstrap_spread_matches_theory(spark):
    rng = np.random.default_rng(0)
    data = [("s", i, float(v)) for i, v in enumerate(rng.normal(10, 2, 500))]
    rows = spark.createDataFrame(data, "stratum string, cluster long, x double")
    reps = [r.x for r in bs.resample(rows, ["x"], n_rep=400, seed=2, block=64).filter("rep >= 0").collect()]
    want = np.std([d[2] for d in data]) * np.sqrt(500)
    assert abs(np.std(reps) / want - 1) < 0.15 and abs(np.mean(reps) / sum(d[2] for d in data) - 1) < 0.01


def test_clustered_interval_is_wider(spark):
    rows = spark.range(800).select(F.lit("s").alias("stratum"), F.col("id"), F.floor(F.col("id") / 20).alias("thread"), F.lit(1.0).alias("weight")).withColumn("y", (F.col("thread") % 2).cast("double"))

    def width(cluster):
        r = bs.ratio_estimates(rows.withColumn("cluster", F.col(cluster)), {"y": (F.col("y"), F.lit(1.0))}, n_rep=100).first()
        return r.hi95 - r.lo95

    assert width("thread") > 2 * width("id")


def test_census_has_no_width(spark):
    rows = units(spark).select("stratum", "cluster", "weight", (F.col("x") > 3).cast("int").alias("y"), F.lit(1.0).alias("fraction"), F.lit(True).alias("domain"))
    r = es.rao_wu(rows, n_rep=10).first()
    assert r.ci_low == r.estimate == r.ci_high


def test_ppi_beats_naive(spark):
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.2
    yhat = np.clip(0.8 * y + 0.1 + rng.normal(0, 0.1, y.size), 0, 1)
    rows = spark.createDataFrame([("s", i, 1.0, float(f)) for i, f in enumerate(yhat)], "stratum string, cluster long, weight double, yhat double")
    gold = spark.createDataFrame([("s", i, 1.0, float(yhat[i]), int(y[i]), 0.1) for i in range(400)], "stratum string, cluster long, weight double, yhat double, y int, sel double")
    r = es.ppi_mean(rows, gold, n_rep=60).first()
    truth = y.mean()
    assert abs(r.estimate - truth) < abs(r.naive - truth) and 0 <= r.lam <= 1 and r.ci_low < truth < r.ci_high


def test_p_values_and_bh(spark):
    reps = spark.createDataFrame([("a", i, v) for i, v in enumerate((-1.0, 1.0, 2.0, 3.0))] + [("a", -1, 9.0)], "id string, rep int, v double")
    assert rb.bootstrap_p(reps, ["id"], "v").first().p == 0.8
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    got = rb.benjamini_hochberg(spark.createDataFrame([(p,) for p in ps], "p double")).collect()
    assert sorted(r.p for r in got if r.rejected) == [0.001, 0.008]
    from threadgauge.operators.discussion import adjust_p

    wide = adjust_p(spark.createDataFrame([(p,) for p in ps], "p double")).collect()
    assert {round(r.p_adj, 9) for r in wide} == {round(r.p_adj, 9) for r in got}


def test_agreement_case(spark):
    main = [0.9, 0.8, 0.75, 0.1, 0.95, 0.2, 0.3, 0.4]
    other = [0.9, 0.8, 0.6, 0.1, 0.95, 0.2, 0.3, 0.4]
    df = spark.createDataFrame(list(zip(main, other)), "a double, b double")
    r = df.agg(*rb.kappa_columns(F.col("a") >= 0.7, F.col("b") >= 0.7)).first()
    assert r.n == 8 and r.agreement == 7 / 8 and abs(r.kappa - 0.75) < 1e-12
    assert rb.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first().spearman is None


def labelled(spark, y, s, w=None):
    w = w or [1.0] * len(y)
    return spark.createDataFrame([(a, float(b), float(c), "s", i) for i, (a, b, c) in enumerate(zip(y, s, w))], "y int, score double, weight double, stratum string, cluster long")


def test_quality_cases(spark):
    r = ql.confusion_counts(labelled(spark, [1, 1, 0, 0, 1], [0.9, 0.2, 0.8, 0.1, 0.7]), 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1)
    assert ql.threshold_for_recall(labelled(spark, [1, 1, 1, 1, 0], [0.9, 0.6, 0.4, 0.2, 0.1]), 0.75).first().threshold == 0.4
    bins = {b.bin: b for b in ql.reliability_bins(labelled(spark, [1, 0], [0.12, 0.18], [3.0, 1.0])).collect()}
    assert bins[1].n == 2 and bins[1].observed == 0.75 and abs(bins[1].mean_predicted - 0.135) < 1e-12
    assert bins[0].observed is None and len(bins) == 10
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, s string")
    assert abs(ql.choice_confusion(pairs, "t", "s")[0].first().accuracy - 2 / 3) < 1e-12
