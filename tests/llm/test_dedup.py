"""Near and exact deduplication against brute force, with odd rows."""

import random

import numpy as np
import pytest
import xxhash

from threadgauge.llm import common, exact, nearcopies, simhash
from threadgauge.llm.components import components

SCHEMA = "doc_id bigint, text string, fp string, label int"


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def slow_classes(rows, max_bits=3):
    prints = [(d, slow_print(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [(d, f"{p:016x}", best.get(find(i))) for i, (d, p) in enumerate(prints)]


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, d = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        for k in range(rng.randint(1, 5)):
            text = base[:]
            for _ in range(k // 2):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((d, " ".join(text)))
            d += 1
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "Ä b"), (904, "ä b"), (905, "one two"), (906, "ONE  two"), (0, rows[0][1]), (None, rows[0][1])]
    rows.append((907, "long " * 30000 + "text"))
    rng.shuffle(rows)
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    found = simhash.near_duplicates(docs)
    got = found.select("doc_id", simhash.fingerprint_hex("fp").alias("f"), "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, slow_classes(rows)))


def test_keep_one_keeps_the_smallest(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in slow_classes(rows)})


@pytest.mark.parametrize("block", [65536, 5])
def test_links_connect_a_cloud_of_prints(spark, block):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 6)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(30):
            flips = rng.choice(64, rng.integers(1, 3), replace=False)
            value = int(b)
            for f in flips:
                value ^= 1 << int(f)
            prints.add(int(np.uint64(value & (2**64 - 1)).astype(np.int64)))
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = {(r["node"], r["label"]) for r in components(simhash.links(frame, block=block)).collect()}
    values = sorted(prints)
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    linked = {v for v in values if any(w != v and ((v ^ w) & (2**64 - 1)).bit_count() <= 3 for w in values)}
    assert got == {(v, label[v]) for v in linked}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200)]
    got = {(r["node"], r["label"]) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(200, 200), (201, 200)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
    assert exact.deduplicate(docs, exact.DigestIndex(spark)).count() == 0
    assert exact.keep_first(docs, exact.DigestIndex(spark)).count() == 0


def test_exact_dedup_over_two_batches(spark):
    first = [(5, "a  b", "x", 1), (3, "a\tb", "x", 1), (7, None, "x", 1), (8, "", "x", 1), (3, "a b", "x", 1), (None, "a b", "x", 1)]
    index = exact.DigestIndex(spark)
    got = exact.deduplicate(spark.createDataFrame(first, SCHEMA), index).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"]) for r in got) == [(-1, 3, 4), (3, 3, 4), (3, 3, 4), (5, 3, 4), (7, 7, 2), (8, 7, 2)]
    assert [r["doc_id"] for r in got if r["kept"] and r["keep_id"] == 3] == [3]
    again = exact.DigestIndex(spark, index.path, index.buckets)
    second = spark.createDataFrame([(1, "a b", "x", 1), (2, "new", "x", 1)], SCHEMA)
    got = exact.deduplicate(second, again).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in got) == [(1, 3, False), (2, 2, True)]
    assert again.rows().count() == 3


def test_keep_first_keeps_columns_and_one_of_equal_rows(spark):
    rows = [(3, "a b", "x", 1), (3, "a  b", "y", 2), (4, "c", "z", 3), (None, "c", "q", 4)]
    kept = exact.keep_first(spark.createDataFrame(rows, SCHEMA), exact.DigestIndex(spark))
    assert kept.columns == ["doc_id", "text", "fp", "label"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4]


def slow_near_copies(rows, least=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                parent[find(i)] = find(j)
    kept = {}
    for i, (d, _) in enumerate(rows):
        c = find(i)
        kept[c] = d if kept.get(c) is None else kept[c] if d is None else min(kept[c], d)
    return kept.values()


@pytest.mark.parametrize("block", [nearcopies.BLOCK, 300])
def test_pipeline_drops_near_copies_with_a_few_edited_words(spark, monkeypatch, block):
    import corpus_pipeline

    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = [r for r in corpus() if r[0] != 907]
    for i in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for k in range(6):
            text = base[:]
            for _ in range(k * len(text) // 150):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((2000 + 10 * i + k, " ".join(text)))
    rows.append((3000, "long " * 30000 + "text"))
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    monkeypatch.setattr(nearcopies.keep_one, "__defaults__", (*nearcopies.keep_one.__defaults__[:-1], block))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    want = sorted(map(str, slow_near_copies(rows)))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert simhash.keep_one(docs).count() > len(want)
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def test_near_copies_take_simhash_candidates(spark, monkeypatch):
    """Without a common MinHash band, fingerprints of the Golay keys still bring near copies together; the exact check decides."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:399], "other"]), " ".join(words[::-1])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = [nearcopies.simhash.fingerprint(t.encode(), nearcopies.WORDS) for t in texts]
    assert 0 < bin((prints[0] ^ prints[1]) & (1 << 64) - 1).count("1") <= 3 < bin((prints[0] ^ prints[2]) & (1 << 64) - 1).count("1")
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")
    assert {tuple(sorted(r)) for r in nearcopies._close_prints(nodes).collect()} == {(0, 1)}
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == [0, 2]


def shuffled(df):
    """Rows of ``df`` and rows that its exchanges wrote."""
    found, n, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            if name == "ShuffleExchangeExec":
                n += plan.metrics().apply("shuffleRecordsWritten").value()
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return found, n


@pytest.fixture
def no_broadcast(spark):
    """Small tables are joined as large ones are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_without_copies_are_not_shuffled(spark, no_broadcast, monkeypatch):
    rng = random.Random(6)
    plain = [" ".join(str(rng.randint(0, 9999)) for _ in range(30)) for _ in range(600)]
    near = [plain[k] + " end" for k in range(8)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(plain + near)], "doc_id bigint, text string")
    kept, n = shuffled(exact.keep_first(docs.union(docs.filter("doc_id < 10")), exact.DigestIndex(spark)))
    assert sorted(r["doc_id"] for r in kept) == list(range(608)) and n < 200
    compared, real = [], nearcopies.components

    def components_of(edges):
        compared.append(shuffled(edges)[1])
        return real(edges)

    monkeypatch.setattr(nearcopies, "components", components_of)
    kept, n = shuffled(nearcopies.keep_one(docs))
    assert sorted(r["doc_id"] for r in kept) == list(range(600)) and n < 200
    assert compared[1] < 200


@pytest.mark.parametrize("most", [common.SLOTS, 64])
def test_without_leaves_just_the_other_rows(spark, no_broadcast, most):
    rows = spark.range(1000).selectExpr("id as k", "id % 7 as v").union(spark.range(5).selectExpr("id as k", "id as v"))
    for gone in (set(range(0, 1000, 3)), set(), set(range(1000))):
        found = common.without(rows, spark.createDataFrame([(k,) for k in gone], "k bigint"), "k", most).collect()
        want = [(k, k % 7) for k in range(1000)] + [(k, k) for k in range(5)]
        assert sorted(map(tuple, found)) == sorted(x for x in want if x[0] not in gone)
