"""Quality rules by divergence from language references.

A document has two histograms: the classes of its characters and its shares of
the words that are common in a language. A language's reference is the mean
histogram of its documents, learned from all of them. A document is kept if some
language is near in both by Jensen-Shannon distance; a histogram of few words is
mostly chance, so the word test has a least length and an allowance for chance.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.llm.common import free_name, sole, whole_text, written

LEAST_WORDS = 50
REPEAT_PERCENT = 50
# A language is learned if it has this share of the documents, so there are never more than its inverse.
LANGUAGE_SHARE = 1 / 512
COMMON = 48
WORD_GUARD = 100
CHAR_LIMIT = 0.26
WORD_LIMIT = 0.3
CLASSES = 11
_UNIT = 1_000_000
_AT_ONCE = 1 << 18
_VOWELS = frozenset("aeiou")
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def char_class(char: str) -> int:
    """0 blank, 1 line break, 2 vowel, 3 consonant, 4 accented, 5 other script, 6 capital, 7 digit, 8 punctuation, 9 symbol, 10 rest."""
    kind = unicodedata.category(char)
    if char in "\n\r":
        return 1
    if kind == "Zs" or char in "\t\x0b\x0c":
        return 0
    if char in SYMBOLS or kind[0] == "S":
        return 9
    if kind == "Lu":
        return 6
    if kind[0] == "L":
        return (2 if char in _VOWELS else 3) if ord(char) < 128 else 4 if ord(char) < 0x250 else 5
    return {"N": 7, "P": 8}.get(kind[0], 10)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return np.fromiter((char_class(chr(c)) for c in range(0x110000)), dtype=np.uint8, count=0x110000)


def class_counts(raw: bytes) -> np.ndarray:
    codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(CLASSES, dtype=np.int64)
    for at in range(0, len(codes), _AT_ONCE):
        out += np.bincount(_classes()[codes[at : at + _AT_ONCE]], minlength=CLASSES)
    return out


def plain_word(word: bytes) -> str:
    """A word without punctuation at its edges, in lower case; empty if nothing is left."""
    text = word.decode("utf-8", "replace").lower()
    first, last = 0, len(text)
    while first < last and not text[first].isalnum():
        first += 1
    while last > first and not text[last - 1].isalnum():
        last -= 1
    return text[first:last]


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur twice or more; ``codes`` number equal words alike."""
    if len(codes) < 4:
        return 0
    pair = codes[:-1] * distinct + codes[1:]
    if distinct > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * distinct + codes[2:]
    else:
        key = pair[:-1] * distinct + codes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), dtype=bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


@dataclass
class Measured:
    """What the rules read from one text; ``counts`` numbers its distinct words."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    distinct: list[bytes]
    counts: np.ndarray

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words


_BYTES = np.zeros((3, 256), dtype=np.int64)
_BYTES[0, [0x20, *range(0x09, 0x0E)]] = 1
_BYTES[1, 0x80:0xC0] = 1
_BYTES[2, list(SYMBOLS.encode())] = 1


def measure(raw: bytes) -> Measured:
    """Counts of a whole text. Bytes split at ASCII white space are the words; lines end at line feeds."""
    words = raw.split()
    tally = np.zeros(256, dtype=np.int64)
    for at in range(0, len(raw), _AT_ONCE):
        tally += np.bincount(np.frombuffer(raw, dtype=np.uint8, count=min(_AT_ONCE, len(raw) - at), offset=at), minlength=256)
    blank, inner, symbols = (int(x) for x in _BYTES @ tally)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    return Measured(
        len(words), len(raw) - blank - inner, symbols, len(lines) - len(set(lines)), repeated_words(codes, len(numbers)),
        list(numbers), np.bincount(codes, minlength=len(numbers)),
    )


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, mass): shares of each document in millionths, added up; a full memory is handed on."""
    sole("divergence", int)  # lets go of what an earlier operator remembered
    mass: dict[tuple[str, str, str], int] = {}

    def flush() -> pa.RecordBatch:
        keys = list(mass)
        out = pa.RecordBatch.from_pydict({
            "lang": pa.array([k[0] for k in keys], pa.string()), "kind": pa.array([k[1] for k in keys], pa.string()),
            "key": pa.array([k[2] for k in keys], pa.string()), "mass": pa.array(list(mass.values()), pa.int64()),
        })
        mass.clear()
        return out

    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw"), strict=True):
            text = raw.as_py()
            found = measure(text)
            if found.failed:
                continue
            mass[lang, "rows", ""] = mass.get((lang, "rows", ""), 0) + 1
            classes = class_counts(text)
            for i, share in enumerate(classes * _UNIT // max(int(classes.sum()), 1)):
                mass[lang, "class", str(i)] = mass.get((lang, "class", str(i)), 0) + int(share)
            for word, share in zip(found.distinct, (found.counts * _UNIT // found.n_words).tolist(), strict=True):
                key = lang, "word", plain_word(word)
                if key[2]:
                    mass[key] = mass.get(key, 0) + share
            if len(mass) > 200_000:
                yield flush()
    if mass:
        yield flush()


@dataclass(frozen=True)
class References:
    """Per language: mean shares of character classes, and of its common words with the rest at the end."""

    languages: tuple[str, ...]
    classes: np.ndarray
    words: tuple[tuple[str, ...], ...]
    shares: np.ndarray


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON, language_share: float = LANGUAGE_SHARE) -> References:
    """References from every document that has a language and passes the base rules.

    Each document counts alike whatever its length; sums are of integers, so they
    do not depend on the order of rows. Only languages with ``language_share`` of
    the documents are learned, and ``common`` words of each reach the driver.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("raw")).filter(F.col("lang").isNotNull())
    parts = known.mapInArrow(_learn, "lang string, kind string, key string, mass bigint")
    sums = written(parts.groupBy("lang", "kind", "key").agg(F.sum("mass").alias("mass")), "shares")
    rows = sums.filter("kind = 'rows'").select("lang", "mass")
    total = rows.agg(F.sum("mass")).first()[0] or 0
    sizes = {r["lang"]: r["mass"] for r in rows.filter(F.col("mass") >= total * language_share).collect()} if total else {}
    languages = tuple(sorted(sizes))
    kept = sums.filter(F.col("lang").isin(*languages)) if languages else sums.limit(0)
    order = Window.partitionBy("lang").orderBy(F.desc("mass"), "key")
    top = kept.filter("kind = 'word'").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= common)
    words: dict[str, list[tuple[str, int]]] = {name: [] for name in languages}
    for r in top.orderBy("lang", "r").collect():
        words[r["lang"]].append((r["key"], r["mass"]))
    classes, shares = np.zeros((len(languages), CLASSES)), np.zeros((len(languages), common + 1))
    for r in kept.filter("kind = 'class'").collect():
        classes[languages.index(r["lang"]), int(r["key"])] = r["mass"] / _UNIT / sizes[r["lang"]]
    for i, name in enumerate(languages):
        for j, (_, m) in enumerate(words[name]):
            shares[i, j] = m / _UNIT / sizes[name]
    shares[:, -1] = np.maximum(1 - shares[:, :-1].sum(axis=1), 0)
    classes /= np.maximum(classes.sum(axis=1, keepdims=True), 1e-12)
    return References(languages, classes, tuple(tuple(w for w, _ in words[name]) for name in languages), shares)


def js_divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits along the last axis; the distance is its root."""
    mean = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        ratio = np.divide(x, mean, out=np.ones(np.broadcast(x, mean).shape), where=x > 0)
        return (x * np.log2(ratio)).sum(axis=-1)

    return np.maximum((part(p) + part(q)) / 2, 0.0)


def chance(shares: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Divergence that a sample of ``n_words`` from the reference itself has, to first order."""
    return (np.count_nonzero(shares, axis=-1)[None, :] - 1) / (8 * np.log(2) * np.maximum(n_words, 1))[:, None]


class Judge:
    """Distances of documents to the references."""

    def __init__(self, references: References):
        self.references = references
        self.places: dict[str, list[tuple[int, int]]] = {}
        for i, words in enumerate(references.words):
            for j, word in enumerate(words):
                self.places.setdefault(word, []).append((i, j))
        self.seen: dict[bytes, list[tuple[int, int]]] = {}

    def _of(self, word: bytes) -> list[tuple[int, int]]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            found = self.seen[word] = self.places.get(plain_word(word), [])
        return found

    def word_shares(self, found: Measured) -> np.ndarray:
        out = np.zeros(self.references.shares.shape)
        for word, count in zip(found.distinct, found.counts.tolist(), strict=True):
            for i, j in self._of(word):
                out[i, j] += count
        out /= max(found.n_words, 1)
        out[:, -1] = 1 - out[:, :-1].sum(axis=1)
        return out

    def distances(self, texts: list[bytes], found: list[Measured]) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages): distance by character classes, and by common words less the part of chance."""
        classes = np.stack([class_counts(t) for t in texts]).astype(float)
        classes /= np.maximum(classes.sum(axis=1, keepdims=True), 1)
        words = np.stack([self.word_shares(f) for f in found])
        by_class = js_divergence(classes[:, None, :], self.references.classes[None, :, :])
        by_word = js_divergence(words, self.references.shares[None, :, :])
        by_word = np.maximum(by_word - chance(self.references.shares, np.array([f.n_words for f in found])), 0)
        return np.sqrt(by_class), np.sqrt(by_word)


def _judged(batches: Iterator[pa.RecordBatch], references: References, char_limit: float, word_limit: float, word_guard: int) -> Iterator[pa.RecordBatch]:
    sole("divergence", int)  # lets go of what an earlier operator remembered
    judge = Judge(references)
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            texts = [raw.as_py() for raw in part.column("raw")]
            found = [measure(t) for t in texts]
            failed = np.array([f.failed for f in found], dtype=bool)
            kept, nearest, of_class, of_word = ~failed, np.full(len(found), -1), np.full(len(found), np.nan), np.full(len(found), np.nan)
            open_rows = np.flatnonzero(kept)
            if len(references.languages) and len(open_rows):
                by_class, by_word = judge.distances([texts[i] for i in open_rows], [found[i] for i in open_rows])
                long = np.array([found[i].n_words >= word_guard for i in open_rows])[:, None]
                excess = np.maximum(by_class / char_limit, np.where(long, by_word / word_limit, 0.0))
                best = excess.argmin(axis=1)
                here = np.arange(len(best))
                kept[open_rows] = excess[here, best] <= 1
                nearest[open_rows], of_class[open_rows], of_word[open_rows] = best, by_class[here, best], by_word[here, best]
            names = [references.languages[i] if i >= 0 else None for i in nearest]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"),
                **{c: pa.array([getattr(f, c) for f in found], pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
                "base_failed": pa.array(failed), "kept": pa.array(kept), "nearest_lang": pa.array(names, pa.string()),
                "class_distance": pa.array(of_class, from_pandas=True), "word_distance": pa.array(of_word, from_pandas=True),
            })


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, nearest_lang string, class_distance double, word_distance double"
)


def judge(docs: DataFrame, references: References, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, word_guard: int = WORD_GUARD,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, verdict, nearest language and both distances of each row, by given references."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("raw"))
    return rows.mapInArrow(partial(_judged, references=references, char_limit=char_limit, word_limit=word_limit, word_guard=word_guard), SCHEMA)


def quality(docs: DataFrame, lang_col: str = "lang", **options: object) -> DataFrame:
    """One row per row of ``docs``: base counts, ``base_failed``, ``kept``, and what the verdict rests on.

    Null and empty texts have no words and fail the base rules; distances are null
    for rows that fail them. ``lang`` teaches the references and is no input of a
    verdict; null languages teach nothing. If no language was learned all that
    pass the base rules are kept. Repeated rows get equal results, equal distances
    go to the first language by name, other columns are ignored, no rows give no
    rows. Whole texts are read, however long.
    """
    return judge(docs, learn(docs, lang_col=lang_col), **options)


def keep_good(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    references = learn(docs, text_col, lang_col)
    key = free_name(docs, "__row")
    numbered = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    good = judge(numbered, references, id_col=key, text_col=text_col, **options).filter("kept").select(F.col("doc_id").alias(key))
    return numbered.join(good, key, "left_semi").drop(key)
