"""Base counts and divergence verdicts against a plain reading of the rules."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from threadgauge.llm import divergence as dv

DOCS = "doc_id bigint, text string, lang string, n_words string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LISTS = {"aa": "tulo veni karu osto mide lana".split(), "bb": "schra pfunde wirk zeug bald noch".split()}


def prose(rng, lang, n):
    words = [rng.choice(LISTS[lang]) if rng.random() < 0.5 else "".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(4, 9))) for _ in range(n)]
    return "".join(w + (".\n" if i % 13 == 12 else ", " if i % 7 == 6 else " ") for i, w in enumerate(words))


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), failed,
    )


def plain(word):
    inside = [i for i, c in enumerate(word.lower()) if c.isalnum()]
    return word.lower()[inside[0] : inside[-1] + 1] if inside else ""


def divergence(p, q):
    mean = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    return sum(x * math.log2(x / mean[k]) / 2 for d in (p, q) for k, x in d.items() if x > 0)


def histogram(items):
    counts = Counter(items)
    total = sum(counts.values())
    return {k: v / total for k, v in counts.items()}


def by_definition(docs):
    """Verdict per document from dictionaries."""
    teachers = {}
    for _, text, lang, *_ in docs:
        if lang and not base(text)[5]:
            teachers.setdefault(lang, []).append(text)
    references = {}
    for lang, texts in teachers.items():
        classes, words = Counter(), Counter()
        for t in texts:
            for k, v in histogram(dv.char_class(c) for c in t).items():
                classes[k] += v / len(texts)
            for k, v in histogram(map(plain, WORD.findall(t))).items():
                words[k] += v / len(texts) if k else 0
        top = dict(sorted(words.items(), key=lambda x: (-round(x[1], 6), x[0]))[: dv.COMMON])
        references[lang] = dict(classes), top
    out = []
    for _, text, *_ in docs:
        n, failed = base(text)[0], base(text)[5]
        nearest = []
        for classes, top in references.values():
            near = math.sqrt(divergence(histogram(dv.char_class(c) for c in text or ""), classes)) / dv.CHAR_LIMIT if n else 9
            if n >= dv.WORD_GUARD:
                mine = Counter(plain(w) if plain(w) in top else None for w in WORD.findall(text))
                share = {k: v / n for k, v in mine.items()}
                away = divergence(share, {**top, None: 1 - sum(top.values())}) - len(top) / (8 * math.log(2) * n)
                near = max(near, math.sqrt(max(away, 0)) / dv.WORD_LIMIT)
            nearest.append(near)
        out.append((not failed and min(nearest, default=0) <= 1, min(nearest, default=0)))
    return out


def documents():
    rng = random.Random(12)
    docs = [(i, prose(rng, ["aa", "bb"][i % 2], rng.randint(55, 400)), ["aa", "bb"][i % 2], "", 0) for i in range(160)]
    strange = [
        None, "", "  \n\t ", "one", "tulo " * 900, "\n".join(["tulo veni karu"] * 40), " ".join(f"{w}$$$" for w in prose(rng, "aa", 200).split()),
        " ".join("".join(rng.choice("0123456789") for _ in range(6)) for _ in range(120)), " ".join("".join(rng.choice("бвгджзклмн") for _ in range(6)) for _ in range(120)),
        prose(rng, "aa", 150).upper(), " ".join("".join(rng.choice("aeioklmnrst") for _ in range(6)) for _ in range(300)), prose(rng, "bb", 60000),
        "a\x0bb\x0cc\rd\x1ce f " * 30, "x\ny\nx\n \n \nx \n" + prose(rng, "aa", 60), "\x00 \U0001f600 é" + prose(rng, "aa", 70),
    ]
    docs += [(1000 + i, t, None, "", 0) for i, t in enumerate(strange)]
    return docs + [docs[3], (None, docs[4][1], "aa", "", 0)]


def test_rules_equal_their_definition(spark):
    docs = documents()
    got = dv.quality(spark.createDataFrame(docs, DOCS)).collect()
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    assert found == Counter((d[0], *base(d[1])) for d in docs)
    verdicts = by_definition(docs)
    clear = {d[0]: v for d, (v, near) in zip(docs, verdicts, strict=True) if abs(near - 1) > 1e-3}
    assert len(clear) > 0.9 * len(verdicts)
    assert all(r["kept"] == clear[r["doc_id"]] for r in got if r["doc_id"] in clear)
    assert all(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 160 and not r["base_failed"])
    assert not any(r["kept"] for r in got if r["doc_id"] in {1000, 1001, 1004, 1006, 1007, 1008, 1009, 1010})
    assert {r["doc_id"]: r["kept"] for r in got}[1011]


def test_kept_rows_keep_their_columns(spark):
    docs = documents()
    frame = spark.createDataFrame(docs, DOCS)
    kept = dv.keep_good(frame)
    want = Counter(r["doc_id"] for r in dv.quality(frame).collect() if r["kept"])
    assert kept.columns == frame.columns and Counter(r["doc_id"] for r in kept.collect()) == want


def test_no_rows_and_no_languages(spark):
    assert dv.quality(spark.createDataFrame([], DOCS)).count() == 0
    rng = random.Random(3)
    rows = [(1, prose(rng, "aa", 80), None, "", 0), (2, "tulo", None, "", 0)]
    got = {r["doc_id"]: r for r in dv.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and got[1]["nearest_lang"] is None and got[1]["class_distance"] is None


def test_rare_languages_are_not_learned(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, "aa", 60), "aa" if i else "zz", "", 0) for i in range(30)]
    assert dv.learn(spark.createDataFrame(rows, DOCS), language_share=0.1).languages == ("aa",)


@pytest.mark.parametrize("distinct", [3, 5000])
def test_repeated_words_by_brute_force(distinct):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 50, 700):
        codes = rng.integers(0, distinct, n)
        text = " ".join(f"w{c}" for c in codes)
        assert dv.repeated_words(codes, distinct) == base(text)[4] == dv.repeated_words(codes, (1 << 20) + distinct)
