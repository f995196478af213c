"""Filters, extraction, archives, vector search and the pipeline."""

import base64
import hashlib
import os
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from threadgauge.llm import archive, langid, mainpage, toxicity, vptree
from threadgauge.llm.common import new_path

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, score double, predicted int"
LABELS = "doc_id bigint, quality int, toxic int"


def invented(n=500):
    rng = random.Random(6)
    plain, bad = [f"plain{c}" for c in "abcdefghijklmnop"], ["blorfa", "zigwert"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "", "!"])
        docs.append((i, " ".join(words), "en", 0.0, 0))
        labels.append((i, 1, toxic))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = invented()
    odd = [(900, None, None, 0.0, 0), (901, "", None, 0.0, 0), (902, "plaina " * 30000, None, 0.0, 0), (None, "plaina", None, 0.0, 0), docs[0]]
    frame = spark.createDataFrame(docs + odd, DOCS)
    marks = spark.createDataFrame([*labels, (1, 1, None), (5000, 1, 1)], LABELS)
    got = toxicity.toxicity(frame, marks).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    clean = toxicity.keep_clean(frame, marks)
    assert clean.columns == frame.columns


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = invented(30)
    frame, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.toxicity(frame, none).collect()} == {0.0}
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.toxicity(empty, spark.createDataFrame(labels, LABELS)).count() == 0


def test_masked_words_count_as_hits():
    strong = frozenset({"blorfa"})
    assert toxicity.word_class("bl0rf@!", strong, frozenset()) & (toxicity.MASKED | toxicity.STRONG_HIT)
    assert toxicity.word_class("You,", strong, frozenset()) == toxicity.SECOND
    assert toxicity.word_class("LOUD", strong, frozenset()) == toxicity.SHOUTED


def test_languages(spark):
    rng = random.Random(8)
    stems = {"aa": ["tulo", "veni", "karu", "osto"], "bb": ["schr", "pfund", "wirk", "zeug"], None: ["qqq"]}
    docs = [(i, " ".join(rng.choice(stems[k]) for _ in range(12)), k, 0.0, 0) for i in range(300) for k in [("aa", "bb", None)[i % 3]]]
    odd = [(900, None, "aa", 0.0, 0), (901, "", None, 0.0, 0), (902, "12 %% 34", "bb", 0.0, 0), (903, "tulo veni " * 60000, None, 0.0, 0), docs[0]]
    frame = spark.createDataFrame(docs + odd, DOCS)
    got = langid.identify(frame).collect()
    truth = {d[0]: d[2] for d in docs if d[2]}
    assert len(got) == len(docs) + len(odd)
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] >= 900} == {900: "und", 901: "und", 902: "und", 903: "aa"}
    kept = langid.keep_identified(frame)
    assert kept.columns == frame.columns and {900, 901, 902}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_language_filter_compares_the_identified_with_the_named_language(spark):
    rng = random.Random(12)
    stems = {"aa": ["tulo", "veni", "karu", "osto"], "bb": ["schr", "pfund", "wirk", "zeug"]}

    def text(lang, n=12):
        return " ".join(rng.choice(stems[lang]) for _ in range(n))

    docs = [(i, text(k), k, 0.0, 0) for i in range(300) for k in [("aa", "bb")[i % 2]]]
    unlearned = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 4 == 2)
    stay = [(900, text("aa"), None), (901, text("bb", 4000), "bb"), (902, "tulo wirk " * 20, "aa"), (903, "tulo wirk " * 20, "bb"), (unlearned, text("aa"), "cc")]
    go = [(950, text("aa"), "bb"), (951, text("bb"), "aa"), (952, text("bb", 4000), "aa"), (953, None, "aa"), (954, "12 %%", None), (None, text("aa", 40), "bb")]
    frame = spark.createDataFrame(docs + [(*r, 0.0, 0) for r in [*stay, *go, go[0], stay[0]]], DOCS)
    kept = langid.keep_identified(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([d[0] for d in [*docs, *stay, stay[0]]])
    nameless = spark.createDataFrame([(1, text("aa"), None, 0.0, 0)], DOCS)
    assert langid.keep_identified(nameless).count() == langid.keep_identified(nameless.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_letter_noise_and_unlearned_scripts_go(spark):
    rng = random.Random(21)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    noise = {}
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"):
        for n in (20, 50, 300) * 10:
            noise[1_000_000 + len(noise)] = " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(n))
    clean = [r for r in docs.orderBy("doc_id").collect() if r["text"] and r["lang"] and len(r["text"].split()) >= 60][:200]
    short = {2_000_000 + i: " ".join(r["text"].split()[20:40]) for i, r in enumerate(clean)}
    extra = spark.createDataFrame([(i, t, None) for i, t in [*noise.items(), *short.items()]], docs.schema)
    kept = {r["doc_id"] for r in langid.keep_identified(docs.union(extra)).select("doc_id").collect()}
    assert len(kept & set(noise)) <= 0.02 * len(noise)
    assert len(kept & set(short)) >= 0.97 * len(short)
    assert len(kept & {r["doc_id"] for r in clean}) >= 0.98 * len(clean)


def test_profile_of_long_text_is_the_sum_of_its_ngrams(monkeypatch):
    text = "abc défg hij " * 40
    whole = langid.profiles([text])
    monkeypatch.setattr(langid, "_CHARS_AT_ONCE", 37)
    assert np.allclose(whole, langid.profiles([text]))
    codes = langid._codes("ab")
    want = sum(
        np.prod([np.roll(langid.letter_vector(int(c), langid.DIMENSIONS), i) for i, c in enumerate(codes[k : k + 3])], axis=0)
        for k in range(len(codes) - 2)
    )
    assert np.array_equal(langid.profiles(["ab"])[0], want)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just text", "just text"),
    ("<article><h1>T &amp; U</h1><p>One, two.<p>Three&#39;s <b>bold</b>word</article><footer>foot</footer>", "T & U One, two. Three's boldword"),
    ("<body><nav>menu</nav><main><p>Real text, yes.</p><div class='reader-comments'><p>Great!</p></div></main>", "Real text, yes."),
    ("<body><script>var a='<p>x</p>';</script><p>Seen.</p><form>Mail <input></form><aside>side</aside>", "Seen."),
    ("<article><p>cut &am", "cut &am"),
    ("<div id='cookie-notice'>We use cookies, really.</div><div><p>Long enough body text, with marks. And more, of it.</p><p>x</p></div>", "Long enough body text, with marks. And more, of it. x"),
])
def test_main_text(page, text):
    assert mainpage.main_text(page or "") == text


def test_path_ratios_decide_beside_landmarks():
    long = "A long sentence of the main text, with marks, and with more of it. " * 4
    page = f"<body><div>{f'<p>{long}</p>' * 6}</div><article><p>Small teaser.</p></article></body>"
    assert mainpage.main_text(page).count("A long sentence") == 24
    page = f"<body><article><p>{long * 4}</p></article><article><p>{long}</p></article><article><p>{long}</p></article></body>"
    assert mainpage.main_text(page).count("A long sentence") == 24


@pytest.mark.parametrize("names", [
    "class='content with-sidebar'", "class='layout has-sidebar'", "class='main no-comments'", "class='post share-enabled'", "id='article-header-and-body'", "class='sidebar'",
])
def test_names_of_wrappers_keep_the_text(names):
    text = "The main text of this page, with marks. And more of it, too."
    assert mainpage.main_text(f"<body><div {names}><p>{text}</p></div></body>") == text


@pytest.mark.parametrize("name", ["ad", "site-header", "comments-list", "sidebarInner", "cookie_notice", "reader-comments", "nav-wrapper-2"])
def test_named_parts_go(name):
    text = "The main text of this page, with marks. And more of it, too."
    assert mainpage.main_text(f"<body><div><p>{text}</p></div><div class='x {name}'><p>{text} Or not.</p></div></body>") == text


def test_extract_table(spark):
    rows = [(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1), (None, None, None, 1)]
    got = mainpage.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted([str((1, "u", "a", 1))] * 2 + [str((None, None, "", 0))])


def exact_neighbours(rows, k=10):
    usable = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q in (i for i in usable if i % 100 == 0):
        near = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        out += [(q, r, i, s) for r, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_factor_one_is_exact_search(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(700)]
    rows += [(800, None), (900, [0.0] * 4), (1000, [1.0, None, 2.0, 3.0]), (1100, [float("nan")] * 4), (1200, [1.0, 2.0]), (1300, [1.0, 2.5]), (None, [1.0] * 4), (1400, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")
    got = vptree.nearest(frame, F.col("vec_id") % 100 == 0, factor=1.0, shard=150, block=3, leaf=8)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in got.collect())
    assert got == [(q, r, i, round(s, 12)) for q, r, i, s in exact_neighbours(rows)]
    assert vptree.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_with_relaxed_pruning(spark):
    from pyspark.sql import functions as F

    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in frame.collect()]
    want = {(q, i) for q, _, i, _ in exact_neighbours(rows)}
    got = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(frame, F.col("vec_id") % 100 == 0).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_archive_gives_back_exact_records(spark):
    rows = [(1, "http://a/", "x" * 50, 1), (2, "http://b/\r\nX: y", "x" * 50, 1), (3, None, None, 1), (4, "u", "", 1), (5, "u", "ä", 1), (5, "u", "ä", 1), (None, "n", "ä", 1)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    place = new_path(spark, "warc-test")
    archive.write_archive(frame, place)
    got = [tuple(r) for r in archive.read_archive(spark, place).collect()]

    def digest(t):
        return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()

    assert sorted(map(str, got)) == sorted(map(str, [
        (1, 50, digest("x" * 50), "revisit", 2), (2, 50, digest("x" * 50), "response", None), (3, 0, digest(""), "revisit", 4), (4, 0, digest(""), "response", None),
        (5, 2, digest("ä"), "response", None), (5, 2, digest("ä"), "revisit", 5), (None, 2, digest("ä"), "revisit", 5),
    ]))
    assert spark.read.parquet(f"{place}/payloads").count() == 3
    records = {}
    for r in archive.reconstruct(spark, place).collect():
        records.setdefault(r["page_id"], []).append(bytes(r["record"]))
    head, _, body = records[2][0].partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 50" in head and body == b"x" * 50 + b"\r\n\r\n"
    assert b"WARC-Target-URI: http://b/%0D%0AX: y\r\n" in head
    assert records[1][0].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    empty = new_path(spark, "warc-none")
    archive.write_archive(frame.limit(0), empty)
    assert archive.read_archive(spark, empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    now, names = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, now, FOLDER).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == names
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] and counts[2] > counts[3]
    texts = [" ".join((r["text"] or "").split()) for r in now.collect()]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}


@pytest.mark.parametrize(
    "piece",
    ["<a ", "<a href='x", "<div>x", '<a b=">"', "</b>", "<b hidden>x", '<p title="x>y', "3 < 5 ", "<script>", "<textarea></b", "<![CDATA[", "<!--", "<article>x</article>"],
)
def test_main_text_of_broken_pages_is_linear(piece):
    def seconds(size):
        page = piece * (size // len(piece))
        began = time.process_time()
        mainpage.main_text(page)
        return time.process_time() - began

    seconds(10_000)
    assert seconds(800_000) < 20 * max(seconds(100_000), 0.02)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p class='it's'>Hello, you.</p>", "Hello, you."),
        ("<p it's>Hello, you.</p>", "Hello, you."),
        ('<p title="5 > 4">Hello, you.</p>', "Hello, you."),
        ('<p title="5 > 4" class="x>Hello, you.</p>', "Hello, you."),
        ("<p>Hello, you.</p><a href='x", "Hello, you."),
        ("<p>3 < 5 &amp; 4, fine.</p>", "3 < 5 & 4, fine."),
        ("<article><header><h1>Title here.</h1></header><p>Body one. Body two.</p></article>", "Title here. Body one. Body two."),
        ("<header><h1>Site, name.</h1></header><article><p>Body one. Body two.</p></article>", "Body one. Body two."),
    ],
)
def test_main_text_markup_rules(page, text):
    assert mainpage.main_text(page) == text


class _Naive(HTMLParser):
    """Text of well-formed pages by the standard parser: everything outside the parts that the page names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag != "br":
            self.off.append((tag, tag in mainpage.UNSEEN or any(k == "class" and v in mainpage.NAMED for k, v in attrs)))

    def handle_endtag(self, tag):
        while self.off and self.off.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if not any(bad for _, bad in self.off):
            self.out.append(data)


def test_main_text_of_generated_pages_equals_the_standard_parser():
    draw = random.Random(7)
    words = "river stone, market light. window paper; engine garden? cloud letter! &amp; &eacute;t&eacute;".split()
    for _ in range(200):
        body = []
        for _ in range(draw.randint(1, 12)):
            line = " ".join(draw.choices(words, k=draw.randint(30, 60)))
            body.append(f"<p>{line} <b>{draw.choice(words)}</b></p>")
            if draw.random() < 0.4:
                part = draw.choice(["nav", "aside", "footer", "form", "div class='sidebar'", "div class='cookie'", "div class='comments'"])
                body.append(f"<{part}><a href='/x>y'>{draw.choice(words)}</a></{part.split()[0]}>")
        page = f"<html><head><title>No</title><style>p {{}}</style></head><body><nav>Home</nav><article>{''.join(body)}</article><script>var a = '<p>';</script></body></html>"
        naive = _Naive()
        naive.feed(page)
        assert mainpage.main_text(page) == " ".join(" ".join(naive.out).split())
