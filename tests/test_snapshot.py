import gzip
import random

from pyspark.sql import functions as F

from threadgauge.functions import text as tx
from threadgauge.functions.hashing import half_split, sha_id63
from threadgauge.operators import snapshot as sn
from threadgauge.sources import readers


def tree(spark, items):
    return spark.createDataFrame(items, "id long, parent_id long, type string")


def roots(spark, items):
    return {r.id: (r.story_id, r.depth) for r in sn.resolve_roots(tree(spark, items)).collect()}


def test_roots_of_story_poll_and_orphan(spark):
    items = [(1, None, "story"), (2, 1, "comment"), (3, 2, "comment"), (10, None, "poll"), (11, 10, "comment"), (20, 99, "comment")]
    assert roots(spark, items) == {2: (1, 1), 3: (1, 2), 11: (10, 1), 20: (None, None)}
    assert [r.id for r in sn.missing_parents(tree(spark, items)).collect()] == [99]


def test_cycle_and_pollopt_stay_unresolved(spark):
    items = [(5, 6, "comment"), (6, 5, "comment"), (7, 8, "comment"), (8, 1, "pollopt"), (1, None, "story"), (9, 9, "comment")]
    found = roots(spark, items)
    assert found[5] == found[6] == found[7] == found[9] == (None, None)
    assert sn.missing_parents(tree(spark, items)).count() == 0


def test_random_forest_equals_a_walk(spark):
    rng = random.Random(3)
    items = [(i, None if i < 5 else rng.choice([rng.randrange(0, i), rng.randrange(0, 5), 10_000 + i]), "story" if i < 5 else "comment") for i in range(400)]
    items += [(500 + i, 0 if i == 0 else 499 + i, "comment") for i in range(70)]
    parent, kind = {i: p for i, p, _ in items}, {i: k for i, _, k in items}

    def walk(i):
        depth, at = 0, i
        while kind.get(at) == "comment":
            at, depth = parent[at], depth + 1
        return (at, depth) if kind.get(at) == "story" else (None, None)

    assert roots(spark, items) == {i: walk(i) for i, _, k in items if k == "comment"}


def test_html_and_sentences(spark):
    raw = "Tom&#x27;s &lt;b&gt; &quot;nine&quot;<p>see <b class='k'>bold</b> &amp;gt; &#252;ber<pre><code>u\n\n\n\nv</code></pre>"
    df = spark.createDataFrame([(raw,)], "h string")
    got = df.select(tx.html_to_text(F.col("h")).alias("t"), tx.html_to_text(F.col("h"), True).alias("d")).first()
    assert got.t == "Tom's <b> \"nine\"\n\nsee bold &gt; über\n\nu\n\nv"
    assert got.d == "Tom's <b> \"nine\"\n\nsee bold &gt; über"
    text = "Backups ran late. Nobody noticed! Who checks? i.e. the cron log of v3.4 was empty.\n\nLater on"
    df = spark.createDataFrame([(text,), ("Disks etc.\n\nFans",), (" ".join(f"Line {i}." for i in range(270)),)], "t string")
    first, second, third = [r.s for r in df.select(tx.split_sentences(F.col("t")).alias("s")).collect()]
    assert first == ["Backups ran late.", "Nobody noticed!", "Who checks?", "i.e. the cron log of v3.4 was empty.", "Later on"]
    assert second == ["Disks etc. Fans"]
    assert len(third) == 255 and third[-1].startswith("Line 254. Line 255.") and third[-1].endswith("Line 269.")


def test_pain_flag_gap_and_ie(spark):
    texts = ["My " + "-" * 78 + " outage", "My " + "-" * 79 + " outage", "A stuck valve, i.e. no flow at all.", "us hackers", "Outages cost me"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(tx.pain_flag(F.col("t")).alias("f")).collect()] == [True, False, False, False, True]


def test_keyword_score_stays_on_one_line(spark):
    texts = ["we spent all\nthose hours", "we spent all those hours", "fighting it\nis what we do", "fighting it is what we do", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(tx.keyword_score(F.col("t")).alias("f")).collect()] == [0.0, 1.0, 0.0, 1.0, 0.0]


def test_bins_periods_and_ids(spark):
    df = spark.createDataFrame([(n,) for n in (3, 14, 15, 59, 60, 199, 200, 5000)], "n int")
    assert [r.b for r in df.select(tx.length_bin(F.col("n")).alias("b")).collect()] == ["L0", "L0", "L1", "L1", "L2", "L2", "L3", "L3"]
    df = spark.createDataFrame([(t,) for t in (-1, 0, 99, 100, 1199, 1200)], "t long")
    assert [r.p for r in df.select(sn.window_period(F.col("t"), 0, 1200).alias("p")).collect()] == [None, "P01", "P01", "P02", "P12", None]
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7|Go").digest()[:8], "big") & (2**63 - 1)
    assert spark.range(1).select(sha_id63(F.lit(7), F.lit("Go")).alias("x")).first().x == want
    byte = hashlib.sha256(b"s:42").digest()[0]
    assert spark.range(1).select(half_split(F.lit(42), "s").alias("h")).first().h == ("explore" if byte % 2 == 0 else "confirm")


def test_raw_records_to_tables(spark, tmp_path):
    import json

    def rec(i, state="ok", **item):
        return {"id": i, "state": state, "item": {"id": i, **item} if item else None}

    lines = [
        rec(1, type="story", time=10, title="Ask HN: x"), rec(2, type="comment", parent=1, time=20, by="a", text="Hello<p>there"),
        rec(3, type="comment", parent=2, time=30, text="dead", dead=True), rec(4, type="comment", parent=2, time=30, deleted=True),
        rec(5, "null"), rec(6, type="comment", parent=1, time=500, text="late"), rec(7, type="comment", parent=1, time=40, text=""),
    ]
    path = tmp_path / "shard.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in lines))
    items = sn.normalize_items(readers.raw_records(spark, str(path)))
    table = sn.comments_table(items, sn.resolve_roots(items), 0, 120)
    got = {r.id: (r.story_id, r.thread_type, r.exclusion_reason) for r in table.collect()}
    assert got == {2: (1, "ask_hn", None), 3: (1, "ask_hn", "dead"), 4: (1, "ask_hn", "deleted"), 6: (1, "ask_hn", "out_of_window"), 7: (1, "ask_hn", "empty_text")}
    tally = sn.record_tally(items.select("id", "state", "type").unionByName(spark.createDataFrame([(5, "null", None)], "id long, state string, type string"))).first()
    assert tally.reconciled and tally.n_comments == 5 and tally.n_null == 1


def test_item_loader_rejects_unknown_ids(spark):
    import pytest

    comments = spark.createDataFrame([(1, None, 9, "a")], "id long, parent_id long, story_id long, text_norm string")
    empty = comments.filter("false")
    with pytest.raises(ValueError):
        sn.load_items(spark.createDataFrame([(2,)], "id long"), comments, empty.withColumn("title", F.lit("")), empty)


def test_broken_lines_of_a_gzip_shard(spark, tmp_path):
    lines = [
        '{"id": 5000, "state": "ok", "item": {"text": "a"}}', '{"id": 5001, "state": "o', "", '{"id": 5002, "state": "failed", "item": null}', "null", "[1]",
        '{"id": "x", "state": "ok"}', '{"id": 5004, "state": "ok", "extra": 1}', "not json",
    ]
    path = tmp_path / "shard_000005000.jsonl.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    good = readers.raw_records(spark, str(path))
    assert sorted((r.id, r.state) for r in good.collect()) == [(5000, "ok"), (5002, "failed"), (5004, "ok")]
    bad = readers.broken_lines(spark, str(path))
    found = sorted((r.position, r.id, r.shard, r.block, r.n_bytes) for r in bad.collect())
    assert found == [(n, i, 5000, 0, len(lines[n - 1])) for n, i in ((2, 5001), (5, None), (6, None), (7, None), (9, None))]
    expected = spark.createDataFrame([(5, 8), (6, 3)], "shard bigint, n_lines bigint")
    status = sn.shard_status(good, expected, 1000, broken=bad.withColumn("shard", F.expr("shard div 1000")))
    assert sorted(map(tuple, status.collect())) == [(5, 8, 3, 1, 5, "corrupt"), (6, 3, 0, 0, 0, "missing")]
    wanted = spark.range(5000, 5005)
    assert sorted(r.id for r in sn.refetch_list(wanted, good).collect()) == [5001, 5002, 5003]
