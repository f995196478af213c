"""The phrase index against regular expressions, and with a large dictionary."""

import random
import re

from pyspark.sql import functions as F

from threadgauge.operators import discussion as ds

TOOLS = "name string, aliases array<string>, category string, name_case boolean"


def by_pattern(text, tools):
    """Two alternations, longest term first, as whole words."""
    loose, strict = {}, {}
    for name, aliases, _, forced in tools:
        for term, force in [(name, forced), *((a, False) for a in aliases)]:
            if term:
                short = len(term) <= 3 or bool(force)
                (strict if short else loose).setdefault(term if short else term.lower(), set()).add(name)
    out = set()
    for names, flags, key in ((loose, re.IGNORECASE, str.lower), (strict, 0, str)):
        if names and text:
            body = "|".join(rf"(?<!\w){re.escape(t)}(?!\w)" for t in sorted(names, key=len, reverse=True))
            for m in re.finditer(body, text, flags):
                out |= names.get(key(m.group(0)), set())
    return out


def test_phrases_equal_the_regular_expression(spark):
    rng = random.Random(5)
    atoms = ["go", "Go", "cursor", "ide", "llama", "cpp", "amazon", "web", "C", "net", "wise", "Wise", "é", "straße", "x_1", "北"]
    gaps = [" ", " ", " ", ".", ".", "-", "  ", "\n", "+", "/", "@", ""]
    tools = [
        ("Go", ["golang", "go cursor", "GO"], "a", False), ("Llama", ["llama 3", "llama"], "b", False), ("llama.cpp", ["llama.cpp-web"], "b", None),
        ("Wise", ["wise.net"], "c", True), (".net", ["C+", "+C", "@web", "c++"], "d", False), ("Web Web", ["web web web", "amazon web", "web-amazon"], "e", False),
        ("Straße", ["x_1", "é", "北", "", "é.é.é"], "f", False), ("Web", [], "g", False),
    ]
    texts = ["".join(rng.choice(atoms) + rng.choice(gaps) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    texts += [None, "", ".", "llama.cpp", "web web web web", "WISE.NET Wise wise", "Amazon Web Web", "C++", " C+ ", "xC+ C+x"]
    rows = [(i % 300, t, "same") for i, t in enumerate(texts)]
    frame, listed = spark.createDataFrame(rows, "id int, text string, other string"), spark.createDataFrame(tools, TOOLS)
    got = ds.find_mentions(frame, listed)
    assert got.columns == ["id", "other", "tool"]
    want = {(i, o, tool) for i, t, o in rows for tool in by_pattern(t, tools)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 500
    assert got.count() == len(want)
    assert ds.find_mentions(frame, listed.limit(0)).count() == 0 and ds.find_mentions(frame.limit(0), listed).count() == 0


def test_a_million_terms(spark):
    names = spark.range(1_000_000).select(
        F.concat(F.lit("tool "), F.hex("id"), F.when(F.col("id") % 3 == 0, F.lit(".io")).otherwise(F.lit(""))).alias("name"),
        F.array(F.concat(F.lit("alias"), F.col("id").cast("string"))).alias("aliases"), F.lit("x").alias("category"), F.lit(False).alias("name_case"),
    )
    texts = spark.createDataFrame([(1, "we use Tool 3E8 and TOOL FF.io daily"), (2, "alias77 beats alias999999, not alias1000000"), (3, "tool zz")], "id int, text string")
    got = {(r["id"], r["tool"]) for r in ds.find_mentions(texts, names).collect()}
    assert got == {(1, "tool 3E8"), (1, "tool FF.io"), (2, "tool 4D"), (2, "tool F423F.io")}


def test_runs_that_disagree_on_a_pain_text(spark):
    import pytest

    from threadgauge.operators import answers as an

    schema = "comment_id int, pain_sentence string"
    first, second = spark.createDataFrame([(1, "a"), (2, None)], schema), spark.createDataFrame([(1, "a"), (2, None), (3, "c")], schema)
    assert {tuple(r) for r in an.combine_pain([first, second]).collect()} == {(1, "a"), (2, None), (3, "c")}
    for other in ((1, "b"), (2, "b"), (1, None)):
        with pytest.raises(ValueError, match="disagree"):
            an.combine_pain([first, spark.createDataFrame([other], schema)])


def test_tallies_search_the_texts_once(spark, tmp_path):
    from threadgauge.plans import registry

    docs = [(k, f"tion of The nichts que edion {k}", "de", "s") for k in range(12)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("men_02_confirmed_hits", "men_04_card_tool_tally", "men_05_rekeyed_tally"):
        out = registry.queries()[name](spark, str(tmp_path))
        assert out.count() and "regexp_extract_all" not in out._jdf.queryExecution().toString()
