"""Replies, tool mentions, distinctive terms and card bundles (REP, MEN, TRM, BUN)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.functions.hashing import sha_id63
from threadgauge.operators.cards import union_all
from threadgauge.operators.estimate import fix_shares
from threadgauge.operators.spread import require_empty, value_ranks
from threadgauge.session import cut_lineage

NONE = "none"
TEXT_CAP = 1200


# ---- replies -----------------------------------------------------------------------


def reply_pairs(problems: DataFrame, comments: DataFrame, most: int = 5) -> DataFrame:
    """First replies and first author follow-ups per problem, by time and id (REP-1).

    ``problems``: problem_id, author. The constant rank limit is applied before
    the shuffle too, so a problem with very many replies stays cheap.
    """
    p = problems.select("problem_id", F.col("author").alias("__p"))
    rows = comments.filter("state = 'ok'").filter(F.col("text").rlike(r"\S")).select(
        F.col("id").alias("reply_id"), F.col("parent_id").alias("problem_id"), "time", "text", F.col("author").alias("__r")
    ).join(p, "problem_id")
    kind = F.when(F.coalesce(F.col("__p") == F.col("__r"), F.lit(False)), "followup").otherwise("reply")
    rows = rows.withColumn("kind", kind).drop("__p", "__r")
    order = Window.partitionBy("problem_id", "kind").orderBy("time", "reply_id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


def select_problems(assignments: DataFrame, final: DataFrame | None = None, top_cards: int | None = None, min_p: float = 0.5) -> DataFrame:
    """Comments on a real card at the cut, merged cards resolved, optionally of the largest cards (REP-2).

    ``final``: (card_id, final_id) of the taxonomy.
    """
    rows = assignments.filter((F.col("card_id") != NONE) & (F.col("card_p") >= min_p)).select("comment_id", "card_id")
    if final is not None:
        rows = rows.join(final, "card_id").select("comment_id", F.col("final_id").alias("card_id")).filter("card_id IS NOT NULL")
    if top_cards is None:
        return rows
    keep = rows.groupBy("card_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "card_id").limit(top_cards)
    return rows.join(keep.select("card_id"), "card_id", "left_semi").select("comment_id", "card_id")


def reply_items(pairs: DataFrame, sentences: DataFrame, cap: int) -> DataFrame:
    """Runner items with the first ``cap`` characters of the text, a rule of the scorer's input; problems without a sentence are skipped (REP-3)."""
    rows = pairs.join(sentences.select(F.col("comment_id").alias("problem_id"), "pain_sentence"), "problem_id")
    return rows.filter("pain_sentence IS NOT NULL").select(
        "reply_id", "problem_id", "kind", "time", F.substring("text", 1, cap).alias("text"), "pain_sentence"
    )


def unsolved_by_problem(answers: DataFrame, mapping: DataFrame, threshold: float = 0.5, check: bool = True) -> DataFrame:
    """One decision per problem with an answered item (REP-4).

    ``mapping``: reply_id, problem_id, kind, time; ``answers``: comment_id (the
    reply), question_id, noul, choice. Duplicates are an error.
    """
    used = answers.filter(F.col("question_id").isin("names_solution", "solution_kind", "author_says_solved"))
    rows = used.join(mapping, used.comment_id == mapping.reply_id).drop("comment_id")
    if check:
        require_empty(rows.groupBy("reply_id", "question_id").count().filter("count > 1"), "duplicate answers")

    def of(question: str, col: str) -> Column:
        return F.max(F.when(F.col("question_id") == question, F.col(col)))

    items = rows.groupBy("problem_id", "reply_id", "kind", "time").agg(
        of("names_solution", "noul").alias("names"), of("solution_kind", "choice").alias("solution"),
        of("author_says_solved", "choice").alias("verdict"),
    )
    reply, follow = F.col("kind") == "reply", F.col("kind") == "followup"
    named = reply & F.coalesce(F.col("names") >= threshold, F.lit(False))
    real = follow & F.col("verdict").isNotNull() & (F.col("verdict") != "unclear")
    out = items.groupBy("problem_id").agg(
        F.count(F.when(reply, 1)).alias("n_replies"), F.max(named).alias("any_solution_named"),
        F.array_sort(F.collect_set(F.when(named & (F.col("solution") != NONE), F.col("solution")))).alias("solution_kinds"),
        F.max(follow).alias("__f"), F.max_by(F.when(real, F.col("verdict")), F.when(real, F.struct("time", "reply_id"))).alias("__v"),
    )
    says = F.when(F.col("__f"), F.coalesce("__v", F.lit("unclear")))
    out = out.withColumn("author_says_solved", says)
    solved = F.coalesce(F.col("author_says_solved") == "solved", F.lit(False))
    still = F.coalesce(F.col("author_says_solved") == "still_unsolved", F.lit(False))
    unsolved = ~solved & (~F.col("any_solution_named") | still)
    return out.select(
        F.col("problem_id").alias("comment_id"), "n_replies", "any_solution_named", "solution_kinds", "author_says_solved",
        unsolved.alias("unsolved"), F.when(unsolved, 0.0).otherwise(1.0).alias("solved_p"),
    )


# ---- mentions ----------------------------------------------------------------------

SHORT = 3
SLOTS = 1 << 16
ATOM = r"(?U)\w+|\W"


def dictionary_terms(tools: DataFrame) -> DataFrame:
    """(term, tool, exact): names and aliases; short terms and ``name_case`` names match exactly (TXT-11)."""
    names = tools.select(F.col("name").alias("term"), F.col("name").alias("tool"), F.coalesce("name_case", F.lit(False)).alias("forced"))
    aliases = tools.select(F.explode("aliases").alias("term"), F.col("name").alias("tool"), F.lit(False).alias("forced"))
    terms = names.unionByName(aliases).filter("term <> ''")
    exact = (F.length("term") <= SHORT) | F.col("forced")
    return terms.select(F.when(exact, F.col("term")).otherwise(F.lower("term")).alias("term"), "tool", exact.alias("exact")).distinct()


def _is_word(atom: Column) -> Column:
    return atom.rlike(r"(?U)^\w")


def phrase_index(terms: DataFrame) -> DataFrame:
    """(term, exact, head, n): a term's first atom and number of atoms; an atom is a run of word characters or any other character."""
    listed = terms.select("term", "exact").distinct().withColumn("atoms", F.regexp_extract_all("term", F.lit(ATOM), F.lit(0)))
    return listed.select("term", "exact", F.col("atoms")[0].alias("head"), F.size("atoms").alias("n"))


def _slot(atom: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(atom)), F.lit(SLOTS)).cast("int")


def _may_start(index: DataFrame):
    """A test of atoms that passes all first atoms of the terms, by their slots in a bitmap of fixed size, and few others."""
    slots = index.select(_slot(F.col("head")).alias("s")).distinct()
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("s", F.lit(64)))
    held = {r["i"]: r["w"] for r in slots.groupBy(F.floor(F.col("s") / 64).alias("i")).agg(F.bit_or(bit).alias("w")).collect()}
    words = F.array(*[F.lit(held.get(i, 0)).cast("bigint") for i in range(SLOTS // 64)])

    def passes(atom: Column) -> Column:
        word = F.get(words, F.call_function("shiftright", _slot(atom), F.lit(6)))
        return F.call_function("shiftright", word, _slot(atom).bitwiseAND(63)).bitwiseAND(F.lit(1).cast("bigint")) == 1

    return passes


def find_mentions(texts: DataFrame, tools: DataFrame, text: str = "text") -> DataFrame:
    """Input columns but the text, plus one row per tool named in it (TXT-11).

    Whole-word occurrences start and end between atoms, so they are found by
    joins: each place of a text meets the numbers of atoms of the terms that start
    with its atom, and the phrases of those lengths meet the terms. Of what is
    found in a text, from left to right, the longest term at a place counts and
    nothing that overlaps it; exact terms and the others do not hide each other.
    A bitmap of first atoms spares most places before they become rows. A
    dictionary may be of any size: Spark broadcasts it if it is small and
    shuffles the places otherwise. Null texts name nothing.
    """
    terms = dictionary_terms(tools)
    index = phrase_index(terms)
    heads = index.groupBy("exact", "head").agg(F.collect_set("n").alias("__lengths"))
    longest = index.agg(F.max("n")).first()[0] or 0
    keep = [c for c in texts.columns if c != text]
    # Rows that agree in all other columns are told apart by their text.
    rows = texts.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(
        *keep, F.xxhash64(text).alias("__print"), F.regexp_extract_all(text, F.lit(ATOM), F.lit(0)).alias("__atoms")
    )
    passes = _may_start(index)
    some = F.filter(F.sequence(F.lit(1), F.size("__atoms")), lambda i: passes(F.get("__atoms", i - 1)))
    places = F.transform(some, lambda i: F.struct(
        i.alias("pos"), F.get("__atoms", i - 1).alias("atom"), F.get("__atoms", i - 2).alias("before"), F.slice("__atoms", i, longest + 1).alias("gram"),
    ))
    row = [*keep, "__print"]
    starts = rows.select(*row, F.explode(places).alias("__p")).filter(~F.coalesce(_is_word(F.col("__p.before")), F.lit(False)))
    both = F.explode(F.array(
        F.struct(F.lit(True).alias("exact"), F.col("__p.atom").alias("head")), F.struct(F.lit(False).alias("exact"), F.lower("__p.atom").alias("head"))
    )).alias("__h")
    starts = starts.select(*row, "__p", both).select(*row, F.col("__p.pos").alias("__pos"), F.col("__p.gram").alias("__gram"), "__h.exact", "__h.head")
    tried = starts.join(heads, ["exact", "head"]).select(*row, "exact", "__pos", "__gram", F.explode("__lengths").alias("__n"))
    tried = tried.filter((F.col("__n") <= F.size("__gram")) & ~F.coalesce(_is_word(F.get("__gram", F.col("__n"))), F.lit(False)))
    phrase = F.array_join(F.slice("__gram", F.lit(1), F.col("__n")), "")
    tried = tried.select(*row, "exact", "__pos", "__n", F.when(F.col("exact"), phrase).otherwise(F.lower(phrase)).alias("term"))
    hits = tried.join(index.select("exact", "term"), ["exact", "term"])
    found = hits.groupBy(*row, "exact").agg(
        F.sort_array(F.collect_set(F.struct(F.col("__pos").alias("pos"), (-F.col("__n")).alias("less"), "term"))).alias("__hits")
    )
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("terms"))
    taken = F.aggregate("__hits", none, lambda s, h: F.when(
        h["pos"] >= s["end"], F.struct((h["pos"] - h["less"]).alias("end"), F.array_union(s["terms"], F.array(h["term"])).alias("terms"))
    ).otherwise(s), lambda s: s["terms"])
    named = found.select(*row, "exact", F.explode(taken).alias("term"))
    return named.join(terms, ["term", "exact"]).select(*keep, "tool").distinct()


def collect_mentions(problems: DataFrame, pairs: DataFrame, tools: DataFrame) -> DataFrame:
    """Mentions in problems, replies and follow-ups; the problem's story fills a missing one (MEN-1).

    ``problems``: problem_id, card_id, story_id, stratum, time, text;
    ``pairs``: reply_id, problem_id, kind, time, text, story_id.
    """
    first = problems.select(F.col("problem_id").alias("comment_id"), "problem_id", F.lit("problem").alias("kind"), "time", "text")
    rest = pairs.select(F.col("reply_id").alias("comment_id"), "problem_id", "kind", "time", "text")
    found = find_mentions(first.unionByName(rest), tools)
    stories = pairs.select(F.col("reply_id").alias("comment_id"), F.col("story_id").alias("__s"))
    facts = problems.select("problem_id", "card_id", "story_id", F.coalesce("stratum", F.lit("unsampled")).alias("stratum"))
    rows = found.join(facts, "problem_id").join(stories, "comment_id", "left")
    return rows.select(
        sha_id63(F.col("comment_id"), F.col("tool")).alias("hit_id"), "comment_id", "problem_id", "card_id",
        F.coalesce("__s", "story_id").alias("story_id"), "stratum", "kind", "tool", "time",
    )


def confirm_items(mentions: DataFrame, pairs: DataFrame, sentences: DataFrame, cap: int) -> DataFrame:
    """One item per reply-side hit with the first ``cap`` characters of its text, a rule of the scorer's input (MEN-2)."""
    rows = mentions.filter("kind <> 'problem'").join(pairs.select(F.col("reply_id").alias("comment_id"), "text"), "comment_id")
    rows = rows.join(sentences.select(F.col("comment_id").alias("problem_id"), "pain_sentence"), "problem_id")
    return rows.select("hit_id", F.col("comment_id").alias("reply_id"), "problem_id", "tool", F.substring("text", 1, cap).alias("text"), "pain_sentence")


def confirmed_hits(answers: DataFrame, cut: float = 0.5) -> DataFrame:
    """Hits the scorer confirmed (MEN-2)."""
    return answers.filter((F.col("question_id") == "recommends") & (F.col("noul") >= cut)).select(F.col("comment_id").alias("hit_id")).distinct()


def _counted(mentions: DataFrame, confirmed: DataFrame) -> DataFrame:
    rows = mentions.join(confirmed.withColumn("__ok", F.lit(True)), "hit_id", "left")
    complaint = F.col("kind") == "problem"
    fix = ~complaint & F.coalesce("__ok", F.lit(False))
    return rows.withColumn("is_complaint", complaint).withColumn("is_fix", fix).filter("is_complaint OR is_fix").drop("__ok")


def tool_tally(mentions: DataFrame, confirmed: DataFrame, tools: DataFrame, sparse_below: int = 10, **options) -> DataFrame:
    """Threads, fix and complaint threads and fix share per tool (MEN-3)."""
    seen = mentions.select("tool").distinct()
    rows = _counted(mentions, confirmed)
    story = F.col("story_id")
    counts = rows.groupBy("tool").agg(
        F.countDistinct(story).alias("threads"), F.countDistinct(F.when(F.col("is_fix"), story)).alias("fix_threads"),
        F.countDistinct(F.when(F.col("is_complaint"), story)).alias("complaint_threads"),
    )
    share = fix_shares(rows, **options).select("tool", F.col("est").alias("fix_share"), "lo95", "hi95")
    out = seen.join(counts, "tool", "left").fillna(0, ["threads", "fix_threads", "complaint_threads"]).join(share, "tool", "left")
    return out.join(tools.select(F.col("name").alias("tool"), "category"), "tool", "left").withColumn("sparse", F.col("threads") < sparse_below)


def card_tool_tally(mentions: DataFrame, confirmed: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """Distinct threads per card, side and tool on resolved cards (MEN-4)."""
    rows = _counted(mentions.filter("card_id IS NOT NULL"), confirmed)
    if final is not None:
        rows = rows.join(final, "card_id").withColumn("card_id", F.col("final_id")).filter("card_id IS NOT NULL")
    side = F.when(F.col("is_complaint"), "blamed").otherwise("fixes")
    # A null story counts as one thread of its own kind, as a set of ids would.
    key = F.coalesce(F.col("story_id").cast("string"), F.lit("-"))
    return rows.groupBy("card_id", side.alias("side"), "tool").agg(F.countDistinct(key).alias("threads"))


def listed_tools(tally: DataFrame) -> DataFrame:
    """Tools of a card and side as one ordered list (MEN-4); tools are a bounded dictionary."""
    entry = F.struct((-F.col("threads")).alias("o"), "tool", "threads")
    return tally.groupBy("card_id", "side").agg(F.array_sort(F.collect_list(entry)).alias("t")).select(
        "card_id", "side", F.transform("t", lambda e: F.concat_ws(":", e["tool"], e["threads"].cast("string"))).alias("tools")
    )


def rekey_tally(tally: DataFrame, final: DataFrame) -> DataFrame:
    """Stored tallies summed through the merge map (MEN-5)."""
    return tally.join(final, "card_id").filter("final_id IS NOT NULL").groupBy(F.col("final_id").alias("card_id"), "side", "tool").agg(
        F.sum("threads").alias("threads")
    )


# ---- terms -------------------------------------------------------------------------

# URL endings that exclude a term.
TLDS = (
    "com|org|net|edu|gov|mil|int|io|ai|dev|app|co|me|info|biz|name|pro|xyz|so|sh|tv|gg|fm|ly|to|is|it|at|be|br|ca|ch|"
    "cl|cn|cz|de|dk|ec|ee|es|eu|fi|fr|gr|hk|hr|hu|id|ie|il|in|jp|kr|lt|lu|lv|mx|my|nl|no|nz|ph|pk|pl|pt|ro|ru|sa|se|"
    "sg|si|sk|th|tn|tr|tw|ua|uk|us|uy|vn|za"
)
# A default list of English function words; callers pass their own for other uses.
STOP = (
    "about after all also and any are because been before being but can could did does doing for from had has have having "
    "her here hers him his how into its itself just more most not now off once only other our ours out over own same she "
    "should some such than that the their theirs them then there these they this those through too under until very was "
    "were what when where which while who whom why will with would you your yours"
).split()
PRIOR_TOTAL = 500.0
# Coefficients of the Chebyshev fit of the complementary error function, constant term first.
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def tokens(text: Column, stop: Sequence[str] = STOP) -> Column:
    """Lower-case tokens of 3 to 30 characters without stop words (TXT-12)."""
    # A token ends in a letter, a digit, # or ++; what follows up to there is not its part.
    raw = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z](?:[a-z0-9+#.-]*(?:\+\+|[a-z0-9#]))?"), F.lit(0))
    return F.filter(raw, lambda t: F.length(t).between(3, 30) & ~t.isin(*stop))


def terms(t: Column) -> Column:
    """Unigrams and bigrams of a token column (TXT-12).

    Takes a column, not the expression, so tokens are computed once per text.
    """
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(t, pairs)


def lexical_ok(term: Column) -> Column:
    """No long digit run, URL, e-mail or handle (TXT-13)."""
    url = rf"(?:https?|ftp|www)\.|^www$|^(?:https?|ftp)$|\b[\w-]+\.(?:{TLDS})\b"
    return ~(term.rlike(r"\d{4,}") | term.rlike(url) | term.rlike(r"\S+@\S+") | term.rlike(r"(?:^|\s)@\w+"))


def _plural() -> Column:
    return F.col("term").endswith("s") & ~F.col("term").endswith("ss") & (F.length(F.substring_index("term", " ", -1)) > 4)


def _singular() -> Column:
    return F.expr("substring(term, 1, length(term) - 1)")


def plural_map(vocab: DataFrame) -> DataFrame:
    """(term, canon): plural to singular when the singular is in the vocabulary (TXT-14)."""
    cut = vocab.filter(_plural()).select("term", _singular().alias("canon"))
    return cut.join(vocab.select(F.col("term").alias("canon")), "canon", "left_semi").select("term", "canon")


def two_sided_p(z: Column) -> Column:
    """Normal tail 2·(1-Φ(|z|)) by a published Chebyshev fit of erfc; relative error below 1.2e-7."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.5 * x)
    fit = F.lit(0.0)
    for c in reversed(ERFC_FIT):
        fit = fit * t + F.lit(c)
    return t * F.exp(-x * x + fit)


def adjust_p(tests: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini–Hochberg adjusted p for a family of any size.

    Equal p values are merged; ranks and running minima come from range buckets.
    """
    m = tests.agg(F.count(p)).scalar()
    ranks = value_ranks(tests, [], p, bucket="__b")
    ranks = ranks.withColumn("__raw", F.col(p) * m / (F.col("n_below") + F.col("n")))
    inside = Window.partitionBy("__b").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    tails = ranks.groupBy("__b").agg(F.min("__raw").alias("__m")).withColumn("__later", F.min("__m").over(later)).select("__b", "__later")
    adj = F.least(F.lit(1.0), F.min("__raw").over(inside), F.col("__later"))
    adjusted = ranks.join(tails, "__b").select(p, adj.alias("p_adj"))
    return tests.join(adjusted, p, "left")


def _tokened(rows: DataFrame, stop: Sequence[str]) -> DataFrame:
    return rows.filter("group_id IS NOT NULL AND text <> ''").select("group_id", "author", tokens(F.col("text"), stop).alias("t"))


def _class() -> Column:
    """Hash of a term's singular: a term and its plural share it, whichever of them the vocabulary has."""
    return F.xxhash64(F.when(_plural(), _singular()).otherwise(F.col("term")))


def frequent_classes(rows: DataFrame, stop: Sequence[str] = STOP, least: int = 20, most: int = 1 << 26) -> Callable[[DataFrame], DataFrame]:
    """A filter of rows with a ``term`` that passes each term which, with its plural, ``least`` comments of a group have, and few others.

    Counting hashes moves neither terms nor authors. What passes is held in a
    bitmap of 16 slots for each class found and at most ``most`` in all, as one row
    for each 64 slots; classes that share a slot only let more terms pass.
    """
    each = _tokened(rows, stop).select("group_id", F.explode(F.array_distinct(terms(F.col("t")))).alias("term"))
    counts = each.groupBy("group_id", _class().alias("h")).agg(F.count(F.lit(1)).alias("n"))
    found = cut_lineage(counts.filter(F.col("n") >= least).select("h").distinct())
    slots = min(most, max(64, 1 << (16 * found.count()).bit_length()))

    def place(h: Column) -> Column:
        return F.pmod(h, F.lit(slots))

    def word(h: Column) -> Column:
        return F.floor(place(h) / 64).cast("int")

    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place(F.col("h")), F.lit(64)).cast("int"))
    held = cut_lineage(found.groupBy(word(F.col("h")).alias("__i")).agg(F.bit_or(bit).alias("__w")))

    def passing(spread: DataFrame) -> DataFrame:
        keyed = spread.withColumn("h", _class()).withColumn("__i", word(F.col("h")))
        return keyed.join(F.broadcast(held), "__i").filter(F.col("__w").bitwiseAND(bit) != 0).select(*spread.columns)

    return passing


def term_counts(rows: DataFrame, stop: Sequence[str] = STOP, passing: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(group_id, author, term, c, n): occurrences of a term and comments with it, by author; a row is one comment.

    In the sorted terms of a comment the first of equal ones differs from the one
    before it, so comments are counted without a key of their own and partial
    sums go ahead of the one shuffle. ``passing`` leaves terms out before it.
    """
    ordered = _tokened(rows, stop).select("group_id", "author", F.sort_array(terms(F.col("t"))).alias("term"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("term")).alias("before")
    spread = ordered.select("group_id", "author", F.inline(F.arrays_zip("term", before))).filter("term IS NOT NULL")
    first = F.col("before").isNull() | (F.col("before") != F.col("term"))
    spread = passing(spread) if passing else spread
    return spread.groupBy("group_id", "author", "term").agg(F.count(F.lit(1)).alias("c"), F.count(F.when(first, 1)).alias("n"))


def group_sizes(rows: DataFrame, stop: Sequence[str] = STOP) -> DataFrame:
    """(group_id, n): occurrences of all terms by group."""
    n = F.size("t") + F.greatest(F.size("t") - 1, F.lit(0))
    return _tokened(rows, stop).groupBy("group_id").agg(F.sum(n.cast("bigint")).alias("n")).filter("n > 0")


def term_stats(rows: DataFrame, stop: Sequence[str] = STOP, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per (group, canonical term) counts where ``least`` comments have it, per such term its forms, per group all occurrences (TRM-1).

    Most terms are rare: a first pass over the texts finds out which, so only
    those of ``least`` comments in some group are ever shuffled with their authors.
    """
    occ = cut_lineage(term_counts(rows, stop, frequent_classes(rows, stop, least) if least > 1 else None))
    by_group = cut_lineage(occ.groupBy("group_id", "term").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    corpus = by_group.groupBy("term").agg(F.sum("c").alias("c"))
    canon = cut_lineage(plural_map(corpus))
    folded = by_group.join(canon, "term", "left").withColumn("canon", F.coalesce("canon", "term"))
    counts = folded.groupBy("group_id", "canon").agg(F.sum("c").alias("cnt"), F.sum("n").alias("n_comments"))
    counts = cut_lineage(counts.filter(F.col("n_comments") >= least))
    kept = counts.select("canon").distinct()
    # A kept term and its plurals; every other form goes before it meets an author or another form.
    forms = cut_lineage(canon.join(kept, "canon", "left_semi").unionByName(kept.select(F.col("canon").alias("term"), "canon").join(canon.select("term"), "term", "left_anti")))
    words = corpus.join(forms, "term").groupBy("canon").agg(
        F.sum("c").alias("corpus"), F.min_by("term", F.struct(-F.col("c"), "term")).alias("display"),
        F.array_distinct(F.flatten(F.collect_list(F.split("term", " ")))).alias("words"),
    )
    named = occ.filter("author <> ''").join(forms, "term").select("group_id", "canon", "author").distinct()
    authors = named.groupBy("group_id", "canon").agg(F.count(F.lit(1)).alias("n_authors"))
    stats = counts.join(authors, ["group_id", "canon"], "left").withColumn("n_authors", F.coalesce("n_authors", F.lit(0)))
    return stats, words, group_sizes(rows, stop)


def anonymous_terms(stats: DataFrame, words: DataFrame, authors: DataFrame, deny: Sequence[str] = (), k_comments: int = 20, k_authors: int = 10) -> DataFrame:
    """Terms with enough comments and authors, no author name, no denied word (TRM-2)."""
    enough = cut_lineage(stats.filter((F.col("n_comments") >= k_comments) & (F.col("n_authors") >= k_authors)).join(words, "canon"))
    names = authors.select(F.lower("author").alias("word")).distinct()
    named = enough.select("canon", F.explode("words").alias("word")).distinct().join(names, "word", "left_semi").select("canon").distinct()
    denied = F.array(*[F.lit(w) for w in deny]).cast("array<string>")
    kept = enough.join(named, "canon", "left_anti").filter(lexical_ok(F.col("display")))
    return kept.filter(~F.arrays_overlap("words", denied) & ~F.array_contains(denied, F.col("display"))) if deny else kept


def distinctive_terms(rows: DataFrame, stop: Sequence[str] = STOP, deny: Sequence[str] = (), k_comments: int = 20, k_authors: int = 10, top: int = 8) -> DataFrame:
    """Top terms per group by log-odds with a Dirichlet prior, BH q under 0.05 (TRM-1)."""
    stats, words, totals = term_stats(rows, stop, k_comments)
    totals = cut_lineage(totals)
    whole = totals.agg(F.sum("n")).scalar()
    kept = anonymous_terms(stats, words, rows.filter("author IS NOT NULL"), deny, k_comments, k_authors).join(totals, "group_id")
    kept = kept.withColumn("alpha", F.lit(PRIOR_TOTAL) * F.col("corpus") / whole).withColumn("rest", F.col("corpus") - F.col("cnt"))
    dg = F.col("n") + PRIOR_TOTAL - F.col("cnt") - F.col("alpha")
    dr = whole - F.col("n") + PRIOR_TOTAL - F.col("rest") - F.col("alpha")
    kept = kept.withColumn("dg", dg).withColumn("dr", dr).filter("dg > 0 AND dr > 0")
    kept = kept.withColumn("delta", F.log((F.col("cnt") + F.col("alpha")) / F.col("dg")) - F.log((F.col("rest") + F.col("alpha")) / F.col("dr")))
    kept = kept.withColumn("sd", F.sqrt(1 / (F.col("cnt") + F.col("alpha")) + 1 / (F.col("rest") + F.col("alpha"))))
    kept = cut_lineage(kept.withColumn("z", F.col("delta") / F.col("sd")).withColumn("p", two_sided_p(F.col("z"))))
    good = adjust_p(kept).filter("p_adj < 0.05 AND z > 0")
    order = Window.partitionBy("group_id").orderBy(F.col("z").desc(), "display")
    return good.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top).select(
        "group_id", "position", F.col("display").alias("term"), "z", (F.col("delta") - 1.96 * F.col("sd")).alias("lo95"),
        (F.col("delta") + 1.96 * F.col("sd")).alias("hi95"), "n_comments", "n_authors",
    )


# ---- bundles -----------------------------------------------------------------------


def scored_pairs(scored: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """Largest expected score per undirected pair of resolved cards (BUN-1)."""
    rows = scored.select("card_a", "card_b", "expected")
    if final is not None:
        for c in ("card_a", "card_b"):
            rows = rows.join(final.select(F.col("card_id").alias(c), F.col("final_id").alias("__f")), c).withColumn(c, F.col("__f")).drop("__f")
    rows = rows.filter("card_a <> card_b AND expected IS NOT NULL")
    return rows.groupBy(F.least("card_a", "card_b").alias("a"), F.greatest("card_a", "card_b").alias("b")).agg(F.max("expected").alias("score"))


def bundle_edges(pairs: DataFrame, top: int = 8, least: float = 1.0) -> DataFrame:
    """Each card's best partners with a score at the floor, as undirected edges (BUN-1)."""
    both = pairs.select(F.col("a").alias("card"), F.col("b").alias("other"), "score").unionByName(
        pairs.select(F.col("b").alias("card"), F.col("a").alias("other"), "score")
    )
    order = Window.partitionBy("card").orderBy(F.col("score").desc(), "other")
    kept = both.withColumn("r", F.row_number().over(order)).filter((F.col("r") <= top) & (F.col("score") >= least))
    return kept.select(F.least("card", "other").alias("a"), F.greatest("card", "other").alias("b"), "score").distinct()


def average_linkage(cards: DataFrame, pairs: DataFrame, cut: float, furthest: float = 2.0) -> DataFrame:
    """(card_id, bundle): average linkage cut at a distance (BUN-2).

    Distance is 2 - score, 2 where no score is known. Every round merges all
    pairs of clusters that are each other's nearest within the cut; for average
    linkage this gives the same tree as merging one pair at a time. Only sums and
    counts per cluster pair are kept, each round from a checkpoint.
    """
    members = cards.select("card_id", F.col("card_id").alias("bundle"))
    d = F.least(F.greatest(F.lit(furthest) - F.col("score"), F.lit(0.0)), F.lit(furthest))
    links = cut_lineage(pairs.select("a", "b", d.alias("total"), F.lit(1).cast("bigint").alias("n")))
    members = cut_lineage(members)
    while True:
        size = members.groupBy("bundle").agg(F.count(F.lit(1)).alias("size"))
        sized = links.join(size.select(F.col("bundle").alias("a"), F.col("size").alias("sa")), "a").join(
            size.select(F.col("bundle").alias("b"), F.col("size").alias("sb")), "b"
        )
        mean = (F.col("total") + (F.col("sa") * F.col("sb") - F.col("n")) * furthest) / (F.col("sa") * F.col("sb"))
        close = sized.select("a", "b", mean.alias("d")).filter(F.col("d") <= cut)
        ends = close.select(F.col("a").alias("x"), F.col("b").alias("y"), "d").unionByName(close.select(F.col("b").alias("x"), F.col("a").alias("y"), "d"))
        pair_key = F.struct(F.round("d", 12).alias("d"), F.least("x", "y").alias("l"), F.greatest("x", "y").alias("h"))
        nearest = ends.groupBy("x").agg(F.min_by("y", pair_key).alias("y"))
        back = nearest.select(F.col("x").alias("y"), F.col("y").alias("x"))
        merged = nearest.join(back, ["x", "y"]).filter("x < y").select(F.col("y").alias("old"), F.col("x").alias("new"))
        merged = cut_lineage(merged)
        if merged.isEmpty():
            break
        members = cut_lineage(members.join(merged, members.bundle == merged.old, "left").select("card_id", F.coalesce("new", "bundle").alias("bundle")))
        for c in ("a", "b"):
            links = links.join(merged.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        links = links.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        links = cut_lineage(links)
    return members


def bundles(cards: DataFrame, pairs: DataFrame, cut: float = 0.8, others: Sequence[float] = (0.6, 1.0), smallest: int = 3, largest: int = 12, jaccard: float = 0.7) -> DataFrame:
    """Bundles of 3 to 12 cards with persistence over the other cuts and groups spanned (BUN-2)."""
    main = average_linkage(cards, pairs, cut)
    sizes = main.groupBy("bundle").agg(F.count(F.lit(1)).alias("n_cards"))
    kept = sizes.filter(F.col("n_cards").between(smallest, largest))
    inside = main.join(kept, "bundle")
    groups = inside.join(cards.select("card_id", "group_id"), "card_id").groupBy("bundle").agg(F.countDistinct("group_id").alias("groups_spanned"))
    hits = []
    for other in others:
        alt = average_linkage(cards, pairs, other).withColumnRenamed("bundle", "alt")
        alt_size = alt.groupBy("alt").agg(F.count(F.lit(1)).alias("n_alt"))
        shared = inside.join(alt, "card_id").groupBy("bundle", "n_cards", "alt").agg(F.count(F.lit(1)).alias("s")).join(alt_size, "alt")
        close = F.col("s") / (F.col("n_cards") + F.col("n_alt") - F.col("s")) >= jaccard
        hits.append(shared.groupBy("bundle").agg(F.max(close.cast("int")).alias("hit")))
    persistence = union_all(hits).groupBy("bundle").agg((F.sum("hit") / len(others)).alias("persistence"))
    listed = inside.groupBy("bundle").agg(F.array_sort(F.collect_list("card_id")).alias("cards"))  # at most ``largest``
    return kept.join(groups, "bundle").join(persistence, "bundle").join(listed, "bundle")
