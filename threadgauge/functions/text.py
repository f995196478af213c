"""Column expressions over text (TXT-*). Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SENTENCES = 255

# Abbreviations that do not end a sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "cf.")

# First-person words and pain terms of the sampling design.
DESIGN_PERSON = "i|we|my|our|us|me"
DESIGN_PAIN = (
    r"spent|wasted|lost|broke|broken|breaking|keeps failing|crash(?:es|ed|ing)?|outages?|frustrat\w*|"
    r"painful|nightmare|struggl\w*|hate[sd]?|annoying|workarounds?|hack(?:s|y|ed)?|manual(?:ly)?|"
    r"spreadsheets?|switched|migrated off|cancell?ed|gave up|paying|pay for|too expensive|price hikes?|"
    r"can['’]t|cannot|couldn['’]t|no way to|stuck"
)
DESIGN_GAP = 80

# First-person words and pain terms of the keyword baseline.
BASELINE_PERSON = "i|we|my|our"
BASELINE_PAIN = (
    r"hate|annoying|frustrat\w*|broke|breaking|painful|struggl\w*|waste|wasted|"
    r"spent\b.{0,40}?\b(?:hours|days)|keeps?\s+(?:failing|crashing|breaking)|can'?t|cannot|couldn'?t|"
    r"nightmare|fighting|workaround"
)
BASELINE_GAP = 60

# Title prefixes and the thread type each stands for.
TITLE_PREFIXES = {
    "Ask HN:": "ask_hn",
    "Show HN:": "show_hn",
    "Launch HN:": "launch_hn",
    "Tell HN:": "tell_hn",
}
ROOT_TYPES = ("story", "poll", "job")

# A few frequent function words per language; decides the label of TXT-5.
STOP_WORDS = {
    "de": "der die das und ist nicht ein eine zu in mit auf für von sich den dem sie es auch",
    "en": "the and of to is that it for on with as was at by this are be have not from",
    "es": "el la los las que de en un una y por con para es no se del al lo como",
    "fr": "le la les et est une un des que dans pour qui sur pas au avec ce il du elle",
}


def _entity(text: Column, body: str, code) -> Column:
    """Replace each distinct ``&body;`` found by the character with that code point."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"&{body};"), F.lit(1)))
    return F.aggregate(
        found, text,
        lambda acc, e: F.replace(acc, F.concat(F.lit("&"), code(e)[0], F.lit(";")), code(e)[1]),
    )


def _char(hex8: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex8, 8, "0")), "UTF-32")


def unescape(text: Column) -> Column:
    """HTML entities resolved once; the ampersand goes last."""
    amp = F.regexp_replace(text, r"&(?:#38|#[xX]26);", "&amp;")
    out = F.regexp_replace(amp, "&#X", "&#x")
    out = _entity(out, r"#x([0-9a-fA-F]{1,5})", lambda e: (F.concat(F.lit("#x"), e), _char(e)))
    out = _entity(out, r"#([0-9]{1,6})", lambda e: (F.concat(F.lit("#"), e), _char(F.conv(e, 10, 16))))
    names = {n: chr(c) for n, c in name2codepoint.items() if n != "amp"}
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    out = _entity(
        out, r"([A-Za-z][A-Za-z0-9]{1,7})",
        lambda e: (e, F.coalesce(F.try_element_at(table, e), F.concat(F.lit("&"), e, F.lit(";")))),
    )
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def html_to_text(html: Column, drop_pre: bool = False) -> Column:
    """Paragraphs to blank lines, tags dropped, entities resolved once (TXT-1)."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<![a-z][^>]*>", "")
    if drop_pre:
        out = F.regexp_replace(out, r"(?is)<pre(?:\s[^>]*)?>.*?(?:</pre\s*>|$)", "")
    out = F.regexp_replace(out, r"(?is)<(?:p|pre)(?:\s[^>]*)?/?>", "\n\n")
    out = F.regexp_replace(out, r"(?is)</?[a-z][^>]*>", "")
    out = unescape(out)
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"^\n+", ""), r"(?U)\s+$", "")


def split_sentences(text: Column, most: int = MAX_SENTENCES) -> Column:
    """Sentence array; pieces after an abbreviation are joined, the tail is merged (TXT-2)."""
    ends = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    joined = F.regexp_replace(text, rf"(?iU)(?<={ends})\s+(?=\S)", " ")
    merged = F.filter(
        F.transform(
            F.split(joined, rf"(?iU)(?<=[.!?])(?<!{ends})\s+(?=\S)|\n{{2,}}"),
            lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""),
        ),
        lambda p: p != "",
    )
    head = F.slice(merged, 1, most - 1)
    tail = F.array_join(F.slice(merged, most, 1_000_000_000), " ")
    return F.when(F.size(merged) > most, F.concat(head, F.array(tail))).otherwise(merged)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Whitespace tokens (TXT-4)."""
    return F.size(words(F.coalesce(text, F.lit(""))))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _near(text: Column, person: str, pain: str, gap: int, any_char: str) -> Column:
    pattern = (
        rf"(?idU)\b(?:{person})\b{any_char}{{0,{gap}}}?(?:{pain})"
        rf"|\b(?:{pain}){any_char}{{0,{gap}}}?\b(?:{person})\b"
    )
    return text.rlike(pattern)


def pain_flag(text: Column) -> Column:
    """A first-person word within 80 characters of a pain term (TXT-6)."""
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?iU)\bi\.e\.", " ")
    term = rf"\b(?:{DESIGN_PAIN})\b"
    pattern = (
        rf"(?isU)\b(?:{DESIGN_PERSON})\b.{{0,{DESIGN_GAP}}}?{term}"
        rf"|{term}.{{0,{DESIGN_GAP}}}?\b(?:{DESIGN_PERSON})\b"
    )
    return cleaned.rlike(pattern)


def keyword_score(text: Column) -> Column:
    """1.0 when a first-person word is within 60 characters of a pain term (TXT-10)."""
    hit = _near(F.coalesce(text, F.lit("")), BASELINE_PERSON, rf"\b(?:{BASELINE_PAIN})", BASELINE_GAP, r"[^\n]")
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def length_bin(count: Column) -> Column:
    """L0 below 15 words, L1 below 60, L2 below 200, else L3 (TXT-7)."""
    return F.when(count < 15, "L0").when(count < 60, "L1").when(count < 200, "L2").otherwise("L3")


def thread_group(kind: Column) -> Column:
    """ask, show, story or other (TXT-8)."""
    return (
        F.when(kind.isin("ask_hn", "tell_hn"), "ask").when(kind.isin("show_hn", "launch_hn"), "show")
        .when(kind == "story", "story").otherwise("other")
    )


def half_year(period: Column) -> Column:
    """H1 for P01–P06, H2 for P07–P12; anything else raises (TXT-9)."""
    month = F.when(period.rlike(r"^P(0[1-9]|1[0-2])$"), F.substring(period, 2, 2).cast("int"))
    return F.when(month <= 6, "H1").when(month > 6, "H2").otherwise(
        F.raise_error(F.concat(F.lit("bad period "), F.coalesce(period, F.lit("null"))))
    )


def thread_type(kind: Column, title: Column) -> Column:
    """Thread type from item type and title prefix, case-sensitive (SNP-5)."""
    title = F.coalesce(title, F.lit(""))
    by_title = F.when(F.lit(False), F.lit(""))
    for prefix, name in TITLE_PREFIXES.items():
        by_title = by_title.when(title.startswith(prefix), name)
    return F.when(kind == "story", by_title.otherwise("story")).when(kind.isin("poll", "job"), kind).otherwise("unknown")


def launch_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(r"(?i)^\s*show\s*hn\b")


def strip_launch_prefix(title: Column) -> Column:
    """Title without the launch prefix and following punctuation (TXT-15)."""
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)^\s*show\s*hn\b\s*[:\-–—]*\s*", ""))


def bounded_snippet(title: Column, sentences: Column, first: int = 3, most: int = 300) -> Column:
    """Title and first sentences joined by spaces, cut at ``most`` characters (TXT-16)."""
    parts = F.filter(F.concat(F.array(title), F.slice(sentences, 1, first)), lambda p: p.isNotNull() & (p != ""))
    return F.rtrim(F.substring(F.array_join(parts, " "), 1, most))


def sentence_map(sentences: Column) -> Column:
    """Sentences as a map s0…s254 (TXT-17)."""
    kept = F.slice(sentences, 1, MAX_SENTENCES)
    return F.map_from_entries(
        F.transform(kept, lambda s, i: F.struct(F.concat(F.lit("s"), i.cast("string")), s))
    )


# Fixed value: characters of the parent that a question sees.
PARENT_LIMIT = 1500
STATE_FIELDS = ("comment", "parent", "sentences", "story_title", "thread_type")


def question_state(
    comment: Column, parent: Column, title: Column, kind: Column, sentences: Column,
    fields: Sequence[str] = STATE_FIELDS, parent_limit: int = PARENT_LIMIT,
) -> Column:
    """State struct of the listed fields in name order, ready for canonical JSON (TXT-17).

    Only the parent is cut, at ``parent_limit`` characters.
    """
    known = {
        "comment": comment, "parent": F.substring(F.coalesce(parent, F.lit("")), 1, parent_limit),
        "sentences": sentence_map(F.coalesce(sentences, F.array().cast("array<string>"))), "story_title": title, "thread_type": kind,
    }
    return F.struct(*[known[f].alias(f) for f in sorted(fields)])


def request_key(state_json: Column, questions_json: Column, question_set: str, model: str) -> Column:
    """sha256 over canonical JSON of model, set, question texts and state (TXT-18)."""
    head = F.lit('{"model":"' + model + '","question_set":"' + question_set + '","questions":')
    return F.sha2(F.concat(head, questions_json, F.lit(',"state":'), state_json, F.lit("}")), 256)


def option_index(option: Column) -> Column:
    """``s<k>`` to k, anything else to -1 (TXT-20)."""
    return F.when(option.rlike(r"^s[0-9]{1,9}$"), F.substring(option, 2, 9).cast("int")).otherwise(F.lit(-1))


def token_estimate(body: Column) -> Column:
    """ceil(bytes / 3.2) (TXT-21)."""
    return F.ceil(F.octet_length(body) / F.lit(3.2)).cast("bigint")


def _among(listed: list[str]):
    return lambda word: word.isin(*listed)


def language_labels(docs: DataFrame, key: str, text: str, min_words: int = 5, english_share: float = 0.2) -> DataFrame:
    """(key, lang_label): stop-word profile with the 5-word and 0.2 rules (TXT-5).

    Shares are taken over all profile hits; the language with most hits wins,
    ties by code, and English also wins with a share of at least 0.2.
    """
    cleaned = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"https?://\S+", " ")
    tokens = F.transform(words(cleaned), lambda w: F.regexp_replace(F.lower(w), r"(?U)^\W+|\W+$", ""))
    scored = docs.select(key, tokens.alias("__t"))
    hits = []
    for lang, listed in STOP_WORDS.items():
        hits.append(F.size(F.filter("__t", _among(listed.split()))).alias(lang))
    scored = scored.select(key, F.size("__t").alias("__n"), *hits)
    total = sum((F.col(c) for c in STOP_WORDS), F.lit(0))
    best = F.greatest(*[F.col(c) for c in STOP_WORDS])
    top = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in sorted(STOP_WORDS)])
    label = (
        F.when((F.col("__n") < min_words) | (total == 0), "und")
        .when(F.col("en") >= F.lit(english_share) * total, "en").otherwise(top)
    )
    return scored.select(key, label.alias("lang_label"))
