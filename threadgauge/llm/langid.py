"""Language identification with hyperdimensional profiles.

Each letter has a random vector of plus and minus ones that depends only on the
letter. An n-gram is the elementwise product of its letters' vectors, each
rotated by its position; a text is the sum of its n-grams, a language the sum of
its training texts. The language whose prototype has the largest cosine wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from threadgauge.llm.common import free_name, sole
from threadgauge.llm.toxicity import held_out

DIMENSIONS = 512
GRAM = 3
PER_LANGUAGE = 1500
UNDETERMINED = "und"
# Dimensions where texts are turned away: noise of a cosine has a standard deviation of 1 / sqrt(dimensions).
FILTER_DIMENSIONS = 2048
NOISE = 3.3
SHARE = 1 / 3
_CUTS = tuple(1 << k for k in range(3, 15))
_CHARS_AT_ONCE = 1 << 19


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=8192)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([code, dimensions]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points; whatever lies between words is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, dtype=np.uint64)
    keep = letter | np.r_[True, letter[:-1]]
    padded = np.where(letter, codes, 32)[keep].astype(np.uint64)
    head = np.uint64(32) == padded[:1]
    return np.concatenate([padded[:0] if head.all() else np.array([32], dtype=np.uint64), padded, np.array([32], dtype=np.uint64)])


def _bundle(parts: list[tuple[int, np.ndarray]], out: np.ndarray, gram: int) -> None:
    """Add the n-grams of (row, codes) parts to the rows of ``out``."""
    shift = np.uint64(21)
    keys, owners = [], []
    for row, codes in parts:
        if len(codes) < gram:
            continue
        key = np.zeros(len(codes) - gram + 1, dtype=np.uint64)
        for i in range(gram):
            key = key << shift | codes[i : len(codes) - gram + 1 + i]
        keys.append(key)
        owners.append(np.full(len(key), row))
    if not keys:
        return
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    owner = np.concatenate(owners)
    rows, local = np.unique(owner, return_inverse=True)
    dimensions = out.shape[1]
    width = max(1, 4096 * DIMENSIONS // dimensions)
    for at in range(0, len(found), width):
        some = found[at : at + width]
        bound = np.ones((len(some), dimensions), dtype=np.int8)
        for i in range(gram):
            codes = some >> np.uint64(21 * (gram - 1 - i)) & np.uint64((1 << 21) - 1)
            letters, which = np.unique(codes, return_inverse=True)
            base = np.stack([np.roll(letter_vector(int(c), dimensions), i) for c in letters])
            bound *= base[which]
        here = (back >= at) & (back < at + width)
        counts = np.bincount(local[here] * len(some) + back[here] - at, minlength=len(rows) * len(some)).reshape(len(rows), len(some))
        out[rows] += counts.astype(np.float32) @ bound.astype(np.float32)


def profiles(texts: Sequence[str | None], dimensions: int = DIMENSIONS, gram: int = GRAM) -> np.ndarray:
    """One vector per text; zero without letters. Long texts are added up in overlapping stretches."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    held, size = [], 0
    for row, text in enumerate(texts):
        codes = _codes(text or "")
        for at in range(0, max(len(codes) - gram + 1, 0), _CHARS_AT_ONCE):
            part = codes[at : at + _CHARS_AT_ONCE + gram - 1]
            held.append((row, part))
            size += len(part)
            if size >= _CHARS_AT_ONCE:
                _bundle(held, out, gram)
                held, size = [], 0
    _bundle(held, out, gram)
    return out


def _sums(batches: Iterator[pa.RecordBatch], dimensions: int, gram: int) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            found = profiles(part.column("text").to_pylist(), dimensions, gram)
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            found = found / np.where(norm > 0, norm, 1)
            names = part.column("lang").to_pylist()
            for name in set(names):
                mine = found[[n == name for n in names]].sum(axis=0, dtype=np.float64)
                totals[name] = totals.get(name, 0) + mine
    for name, total in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(total)], ["lang", "i", "v"]
        )


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, gram: int = GRAM,
) -> dict[str, np.ndarray]:
    """Prototypes of unit length, from about ``per_language`` documents of each language outside the held-out fold.

    A document is drawn if the hash of its id is below the share that
    ``per_language`` is of its language, so rows are filtered where they lie
    and smaller languages are taken whole. Like the model, the counts per
    language reach the driver. Rows with a null
    language are left out; the model has ``dimensions`` numbers per language.
    """
    known = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).filter(F.col("lang").isNotNull() & ~held_out("doc_id", 4, 2))
    shares = {r["lang"]: per_language / r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return {}
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(1 << 31)
    sums = known.filter(draw < share).select("lang", "text").mapInArrow(
        partial(_sums, dimensions=dimensions, gram=gram), "lang string, i int, v double"
    )
    model: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():
        model.setdefault(r["lang"], np.zeros(dimensions, dtype=np.float32))[r["i"]] = r["v"]
    return {k: v / n for k, v in sorted(model.items()) if (n := np.linalg.norm(v)) > 0}


def predict(text: Column, model: dict[str, np.ndarray], gram: int = GRAM, named: Column | None = None) -> Column:
    """A struct (lang string, score double) for a text column.

    The score is the cosine with the winning prototype, at least 0; equal cosines
    go to the first language by name. ``und`` with score 0 for texts that are
    null or have no letter, and for all texts if the model is empty.

    With ``named``, a column of languages that never changes lang and score, the struct goes
    on with (best double, own double, length_class int): the cosine with the winner as it is,
    the one with the named language, and the text's length class. Best and own are null
    where lang is ``und``, own also where no learned language is named.
    """
    names = list(model)
    places = {k: i for i, k in enumerate(names)}
    matrix = np.stack(list(model.values())) if model else np.zeros((0, DIMENSIONS), dtype=np.float32)

    def answers(texts: pd.Series, claims: pd.Series) -> pd.DataFrame:
        sole("languages", int)  # lets go of what an earlier operator remembered
        rows: list[tuple[str, float, float | None, float | None]] = []
        for at in range(0, len(texts), 256):
            found = profiles(texts.iloc[at : at + 256].tolist(), matrix.shape[1], gram)
            norm = np.linalg.norm(found, axis=1)
            cosine = found @ matrix.T / np.where(norm > 0, norm, 1)[:, None]
            for c, n, claim in zip(cosine, norm, claims.iloc[at : at + 256], strict=True):
                if n > 0 and names:
                    best = int(c.argmax())
                    own = float(c[places[claim]]) if claim in places else None
                    rows.append((names[best], float(np.clip(c[best], 0, 1)), float(c[best]), own))
                else:
                    rows.append((UNDETERMINED, 0.0, None, None))
        return pd.DataFrame(rows, columns=["lang", "score", "best", "own"]).astype({"best": "Float64", "own": "Float64"})

    @pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return answers(texts, pd.Series([None] * len(texts)))[["lang", "score"]]

    @pandas_udf("lang string, score double, best double, own double, length_class int")
    def beside(texts: pd.Series, claims: pd.Series) -> pd.DataFrame:
        return answers(texts, claims).assign(length_class=[_length_class(t, gram) for t in texts])

    return of(text) if named is None else beside(text, named)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Repeated rows get equal answers; other columns are ignored; no rows give no rows.
    """
    model = train(docs, id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("p", predict(F.col("text"), model)).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def _length_class(text: str | None, gram: int) -> int:
    """Number of binary digits of the number of n-grams."""
    return max(len(_codes(text or "")) - gram + 1, 0).bit_length()


def _cut_cosines(batches: Iterator[pa.RecordBatch], model: dict[str, np.ndarray], gram: int) -> Iterator[pa.RecordBatch]:
    sole("languages", int)
    for batch in batches:
        for at in range(0, len(batch), 16):
            part = batch.slice(at, 16)
            cuts, owners = [], []
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                if lang in model:
                    mine = [text[:c] for c in _CUTS if c < len(text)] + [text]
                    cuts += mine
                    owners += [lang] * len(mine)
            found = profiles(cuts, len(next(iter(model.values()))), gram)
            norm = np.linalg.norm(found, axis=1)
            cosine = [float(v @ model[k] / n) if n > 0 else 0.0 for v, k, n in zip(found, owners, norm, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_length_class(c, gram) for c in cuts], pa.int32()), pa.array(cosine, pa.float64())], ["class", "cosine"]
            )


def thresholds(
    docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, gram: int = GRAM,
) -> dict[int, float]:
    """For each length class the least cosine of a text of a learned language.

    Held-out documents, about ``per_language`` of each language, are cut to many
    lengths; the threshold is a third of the median cosine with their own
    language, which junk among them hardly moves, and at least ``NOISE`` standard
    deviations of noise.
    """
    if not model:
        return {}
    known = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & held_out("doc_id", 4, 2))
    shares = {r["lang"]: per_language / r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return {}
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(1 << 31)
    cosines = known.filter(draw < share).select("lang", "text").mapInArrow(partial(_cut_cosines, model=model, gram=gram), "class int, cosine double")
    noise = NOISE / np.sqrt(len(next(iter(model.values()))))
    medians = cosines.groupBy("class").agg(F.percentile_approx("cosine", 0.5, 10000).alias("m")).collect()
    return {r["class"]: max(float(noise), SHARE * r["m"]) for r in medians}


def accepted(found: Column, least: dict[int, float], dimensions: int = FILTER_DIMENSIONS) -> Column:
    """Whether the language that ``predict`` found beside a named one is sure, and is the named one.

    The cosine with the winner has to reach the threshold of the text's length
    class; a class not in ``least`` takes the one below. Against the named language the
    winner has to lead by more than the noise of two cosines. Where no learned language
    is named, any winner will do.
    """
    noise = float(NOISE / np.sqrt(dimensions))
    steps = [noise] * 64
    for k in range(1, 64):
        steps[k] = float(least.get(k, steps[k - 1]))
    sure = (found["lang"] != UNDETERMINED) & (found["best"] >= F.array(*map(F.lit, steps))[found["length_class"]])
    return sure & (found["own"].isNull() | (found["best"] - found["own"] <= 2 * noise))


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float | None = None,
    per_language: int = PER_LANGUAGE, dimensions: int = FILTER_DIMENSIONS, gram: int = GRAM,
) -> DataFrame:
    """The rows of ``docs`` whose text is identified as the language they name, with their columns.

    Every text gets the language that wins (see ``predict``). Its cosine has to reach
    the threshold for the text's length (see ``thresholds``), or ``least`` for all
    lengths if given. Texts without letters, in other scripts or of letters in no
    language's order go, and so do those in another learned language than the one
    named; a row that names none, or one that was not learned, stays in any learned
    language. Texts of a few words lie close to noise, so some of either kind fall
    on the wrong side.
    """
    name = free_name(docs, "__language")
    model = train(docs, id_col, text_col, lang_col, per_language, dimensions, gram)
    limits = thresholds(docs, model, id_col, text_col, lang_col, per_language, gram) if least is None else dict.fromkeys(range(64), least)
    found = predict(F.col(text_col), model, gram, F.col(lang_col).cast("string"))
    return docs.withColumn(name, found).filter(accepted(F.col(name), limits, dimensions)).drop(name)
