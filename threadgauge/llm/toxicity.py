"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: words and beginnings of words that labelled toxic
documents hold and clean ones do not, by the likelihood ratio. Lexicon, trees
and calibration each see their own part of a bounded sample of labelled rows,
so none is fooled by what another has fitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from threadgauge.llm.bpe import Memory
from threadgauge.llm.common import free_name, sole, written

MAX_PER_CLASS = 6000
LEXICON = 600
STRONG, WEAK = 32.0, 20.0
BEGINNINGS = (4, 5, 6, 7)
NEAR = 5
# Second-person words of the four languages and look-alike characters.
SECOND_PERSON = frozenset(
    "you your yours yourself ya u ur du dich dir dein deine deinen deiner euch euer ihr sie tu te toi ton ta tes vous "
    "votre vos tú ti usted ustedes vosotros vuestro tus".split()
)
LOOKALIKE = str.maketrans("0134578@$!|", "oieastbasil")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_][\d@$!*#|.+_-]+[^\W\d_]")
_JOINED = re.compile(r"[\W_]+")
STRONG_HIT, WEAK_HIT, SECOND, MASKED, SHOUTED = 1, 2, 4, 8, 16
FEATURES = (
    "strong_per_word", "weak_per_word", "strong_count", "strong_distinct", "near_second_person", "masked_per_word",
    "masked_strong", "capitals", "shouted_per_word", "exclamation_rate", "question_rate", "other_punctuation_rate", "words",
)


def terms(word: str) -> list[str]:
    """What a bare lower-case word can match: itself and its beginnings (marked by ``*``)."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def _has(word: str, lexicon: frozenset[str]) -> bool:
    return any(t in lexicon for t in terms(word))


def word_class(chunk: str, strong: frozenset[str], weak: frozenset[str]) -> int:
    """Flags of what stands between two white spaces: lexicon hits, second person, masking, capitals."""
    bare = _EDGES.sub("", chunk)
    word = bare.lower()
    flags = STRONG_HIT if _has(word, strong) else WEAK_HIT if _has(word, weak) else 0
    if not flags and not word.isalpha() and any(map(str.isalpha, word)):
        plain = _JOINED.sub("", chunk.lower().translate(LOOKALIKE))
        if _INNER.search(chunk):
            flags |= MASKED
        if _has(plain, strong):
            flags |= STRONG_HIT | MASKED
    if word in SECOND_PERSON:
        flags |= SECOND
    if len(bare) > 2 and bare.isupper():
        flags |= SHOUTED
    return flags


def text_features(text: str, classes: Memory, strong: frozenset[str], weak: frozenset[str]) -> list[float]:
    """The values of FEATURES for one whole text."""
    chunks = text.split()
    found = list(map(classes.get, chunks))
    if None in found:
        for i, flags in enumerate(found):
            if flags is None:
                found[i] = classes.get(chunks[i], -1)
                if found[i] < 0:
                    old = classes.older.get(chunks[i])
                    classes[chunks[i]] = found[i] = word_class(chunks[i], strong, weak) if old is None else old
        classes.turn()
    flags = np.array(found, dtype=np.uint8)
    n = max(len(chunks), 1)
    hit = np.flatnonzero(flags & STRONG_HIT)
    second = np.flatnonzero(flags & SECOND)
    near = 0
    if len(hit) and len(second):
        at = np.searchsorted(second, hit)
        before = np.abs(hit - second[np.maximum(at - 1, 0)])
        after = np.abs(second[np.minimum(at, len(second) - 1)] - hit)
        near = int((np.minimum(before, after) <= NEAR).sum())
    size = max(len(text), 1)
    capitals = sum(map(str.isupper, text)) if not text.isascii() else sum(text.count(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    marks = text.count("!"), text.count("?")
    other = sum(text.count(c) for c in "#$%&*@~^+=<>|\\")
    return [
        100 * len(hit) / n, 100 * int(np.count_nonzero(flags & WEAK_HIT)) / n, float(np.log1p(len(hit))),
        float(len({chunks[i].lower() for i in hit})), 100 * near / n, 100 * int(np.count_nonzero(flags & MASKED)) / n,
        float(np.count_nonzero((flags & (MASKED | STRONG_HIT)) == (MASKED | STRONG_HIT))), capitals / size,
        100 * int(np.count_nonzero(flags & SHOUTED)) / n, 100 * marks[0] / size, 100 * marks[1] / size, 100 * other / size,
        float(np.log1p(len(chunks))),
    ]


def features(text: Column, lexicon: dict[str, bool]) -> Column:
    """The features of a text column as an array; null is empty."""
    strong = frozenset(t for t, s in lexicon.items() if s)
    weak = frozenset(t for t, s in lexicon.items() if not s)
    key = hash((tuple(sorted(strong)), tuple(sorted(weak))))

    @pandas_udf("array<double>")
    def of(texts):  # noqa: ANN001, ANN202
        classes = sole(("toxicity", key), lambda: Memory(150_000))
        return texts.map(lambda t: text_features(t or "", classes, strong, weak))

    return of(F.coalesce(text.cast("string"), F.lit("")))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part, out, toxic = batch.slice(at, 64), [], []
            for text, label in zip(part.column("text"), part.column("toxic"), strict=True):
                words = {_EDGES.sub("", c).lower() for c in (text.as_py() or "").split()}
                found = {t for w in words if w for t in terms(w)}
                out.extend(found)
                toxic.extend([label.as_py()] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int32())], ["term", "toxic"])


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, bool]:
    """Terms of (text, toxic) rows that mark toxic ones, with whether the evidence is strong; at most ``size``."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    counted = rows.mapInArrow(_terms, "term string, toxic int").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")
    )
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    share = bad / (bad + good)

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    b, rest_a, rest_b = n - a, F.lit(float(bad)) - a, F.lit(float(good)) - (n - a)
    left = F.lit(float(bad + good)) - n
    ratio = 2 * (part(a, n * share) + part(b, n * (1 - share)) + part(rest_a, left * share) + part(rest_b, left * (1 - share)))
    chosen = (
        counted.filter((F.col("a") >= 3) & (a / n >= (1 + 2 * share) / 3))
        .select("term", ratio.alias("g")).filter(F.col("g") >= WEAK)
        .orderBy(F.desc("g"), "term").limit(size).collect()
    )
    return {r["term"]: r["g"] >= STRONG for r in chosen}


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon, trees, calibration; without trees every text gets ``prior``."""

    lexicon: dict[str, bool]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def score(self, df: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``df`` with a score from 0 to 1 in a new column ``name``."""
        if self.trees is None:
            return df.withColumn(name, F.lit(self.prior))
        vector, raw = self.trees.getFeaturesCol(), self.trees.getProbabilityCol()
        kept = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), features(df[text_col], self.lexicon).alias("__values"))
        scored = self.trees.transform(kept.withColumn(vector, array_to_vector("__values")))
        scored = scored.withColumn("__toxic_raw", vector_to_array(raw)[1])
        if self.calibration is not None:
            scored = self.calibration.transform(scored)
        else:
            scored = scored.withColumn("__toxic_score", F.col("__toxic_raw"))
        final = F.least(F.greatest(F.col("__toxic_score").cast("double"), F.lit(0.0)), F.lit(1.0)).alias(name)
        return scored.select(*[F.col("__row").getField(c).alias(c) for c in df.columns], final)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_per_class: int = MAX_PER_CLASS, seed: int = 7) -> ToxicityModel:
    """Fit on at most ``max_per_class`` labelled rows of each class outside the held-out fold.

    The rows with the smallest keyed hashes are taken: half for the lexicon, a
    third for the trees, the rest for the calibration. Unlabelled rows and null
    labels are left out. Without rows of both classes the model is the share of
    toxic labels (0 without any label).
    """
    usable = labels.filter("toxic IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    usable = usable.filter(~held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    present = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).distinct()
    usable = usable.join(present, "doc_id", "left_semi")
    drawn = usable.filter("toxic = 1").orderBy("h", "doc_id").limit(max_per_class).unionByName(
        usable.filter("toxic = 0").orderBy("h", "doc_id").limit(max_per_class)
    )
    drawn = written(drawn.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(6))), "tox-ids")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = written(texts.join(drawn, "doc_id").select("doc_id", "text", "toxic", "part"), "tox-rows")
    shares = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.0
    empty = ToxicityModel({}, None, None, prior)
    if len(shares) < 2:
        return empty
    lexicon = learn_lexicon(rows.filter("part < 3"))
    valued = rows.select("part", F.col("toxic").cast("double").alias("label"), array_to_vector(features(F.col("text"), lexicon)).alias("__toxic_features"))
    valued = written(valued.filter("part >= 3").coalesce(8), "tox-features")
    fit = valued.filter("part < 5")
    leaf = min(max(fit.count() // 100, 3), 40)
    if fit.select("label").distinct().count() < 2:
        return empty
    trees = GBTClassifier(
        featuresCol="__toxic_features", labelCol="label", predictionCol="__toxic_class",
        maxIter=12, maxDepth=3, stepSize=0.3, minInstancesPerNode=leaf, seed=seed, cacheNodeIds=False,
    ).fit(fit).setProbabilityCol("__toxic_p").setRawPredictionCol("__toxic_margin")
    judged = trees.transform(valued.filter("part = 5")).withColumn("__toxic_raw", vector_to_array("__toxic_p")[1])
    calibration = None
    if judged.select("label").distinct().count() == 2:
        calibration = IsotonicRegression(featuresCol="__toxic_raw", labelCol="label", predictionCol="__toxic_score").fit(judged)
    return ToxicityModel(lexicon, trees, calibration, prior)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null text is empty and scored like one. Repeated rows get equal scores; other
    columns are no input and are ignored; no rows give no rows.
    """
    model = train(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return model.score(rows).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options: int) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    name = free_name(docs, "__toxicity")
    scored = train(docs, labels, id_col, text_col, **options).score(docs, text_col, name)
    return scored.filter(F.col(name) < threshold).drop(name)
