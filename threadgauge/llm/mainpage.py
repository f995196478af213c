"""Main text of web pages by tag-path ratios.

Each text node lies at the end of a path of block tags. A page's paths get two
figures: characters per node and punctuation per node. Both are smoothed over
neighbouring nodes in page order and multiplied. Paths at or above a share of
the page's spread of that product are content. Paths through a tag, role, class
or id that names a menu, header, footer, advert, form or comments are never
content. Paths are always chosen by their figure. An article or main element is
a further weight: its paths count at least as its mean block, times the share
of the page that it holds, so a small teaser lifts nothing.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's own lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time "
    "tt u var".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea iframe object svg canvas audio video "
    "dialog menu xmp noembed noframes datalist".split()
)
LANDMARKS = ("article", "main")
CLOSES = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section "
        "table ul".split()
    ),
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option", "optgroup"}),
}
NAMED = frozenset(
    "ad ads advert adverts advertisement adverts sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside widget header masthead footer foot comment "
    "comments commentlist disqus respond reply replies discussion social share sharing related recommended recommendations newsletter subscribe "
    "subscription signup login pagination pager toolbar search skip disclaimer copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Words that qualify a part's name, and endings that only say that it is a box.
QUALIFIERS = frozenset("with has no without is not and or hide show".split())
BOXES = frozenset("wrapper wrap container inner outer list item items box area section block bar links link panel group row form menu".split())
SMOOTH = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
SHARE = 0.5


def _names_part(token: str) -> bool:
    """Whether a class or id, whole or by its last word (endings for boxes aside), is the name of a part of the page."""
    if token.lower() in NAMED:
        return True
    words = [w for w in (p.lower() for p in _PART.findall(token)) if not w.isdigit()]
    if not QUALIFIERS.isdisjoint(words):
        return False
    while len(words) > 1 and words[-1] in BOXES and words[-1] not in NAMED:
        words.pop()
    return bool(words) and words[-1] in NAMED


def _unwanted(tag: str, attributes: str, named: bool = True, in_article: bool = False) -> bool:
    """Whether a tag or (if ``named``) its names mark a part of the page that is no content.

    A header inside an article is the article's own.
    """
    if tag in UNSEEN and not (in_article and tag == "header"):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in _NAMES.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if named and name in ("class", "id"):
            if any(_names_part(t) and not (in_article and t.lower().endswith("header")) for t in value.split()):
                return True
    return False


def _after_raw(page: str, tag: str, at: int) -> int:
    """Where the page goes on after the end tag of a raw text element; the page's end if it has none."""
    end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
    return end.end() if end else len(page)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in page order, in time linear in the page.

    A quote opens a value only after ``=``. Where it is never closed, the tag
    ends at the next ``>``. Where no unquoted ``>`` follows at all, quotes count
    for nothing from that tag on. A tag without any ``>`` ends with the page, as
    do unclosed comments. Raw text elements come without their content.
    """
    at, n, quotes = 0, len(page), True

    def tag_end(start: int) -> int:
        """Position of the ``>`` of a tag whose name ends at ``start``, or -1."""
        nonlocal quotes
        i = start
        while quotes:
            m = _STOP.search(page, i)
            if m is None:
                # Happens once: from here on the first plain ``>`` counts.
                quotes = False
                break
            if not m.group(1):
                return m.start()
            closing = page.find(m.group(1), m.end())
            if closing < 0:
                # The last quote of its kind on the page, so this happens once a kind.
                return page.find(">", m.end())
            i = closing + 1
        return page.find(">", start)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", htmllib.unescape(page[at:]), ""
            return
        if start > at:
            yield "text", htmllib.unescape(page[at:start]), ""
        m = _TAG.match(page, start)
        if m:
            end = tag_end(m.end())
            if end < 0:
                return
            at, tag = end + 1, m.group(2).lower()
            if m.group(1):
                yield "close", tag, ""
                continue
            yield "open", tag, page[m.end() : end]
            if tag in RAW:
                at = _after_raw(page, tag, at)
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
        elif page.startswith("<![CDATA[", start):
            end = page.find("]]>", start + 9)
            yield "text", page[start + 9 : end if end >= 0 else n], ""
            at = end + 3 if end >= 0 else n
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else n
        else:
            yield "text", "<", ""
            at = start + 1


def blocks(page: str, named: bool = True) -> list[tuple[int, str, bool, int]]:
    """(number of the path of block tags, text, whether it may be content, number of its outermost landmark or -1) of each block in page order.

    Without ``named`` classes and ids rule nothing out. Paths are numbered by
    parent and tag, so deep pages cost no more than flat ones.
    """
    out: list[tuple[int, str, bool, int]] = []
    numbers: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, bool, int]] = []  # block tag, unwanted from here on, path
    opened: Counter[str] = Counter()
    marks: list[int] = []
    text: list[str] = []
    bad, landmarks = 0, 0

    def flush() -> None:
        if text:
            found = " ".join("".join(text).split())
            text.clear()
            if found:
                out.append((stack[-1][2] if stack else -1, found, not bad, marks[0] if marks else -1))

    def pop() -> str:
        nonlocal bad
        tag, unwanted, _ = stack.pop()
        opened[tag] -= 1
        bad -= unwanted
        if tag in LANDMARKS:
            marks.pop()
        return tag

    for kind, value, attributes in tokens(page):
        if kind == "text":
            text.append(value)
        elif kind == "close":
            if value == "br":
                text.append(" ")
                continue
            if value not in INLINE:
                flush()
            if opened[value]:
                flush()
                while pop() != value:
                    pass
        elif value in RAW:
            flush()
        elif value in VOID:
            text.append(" ")
            if value == "hr":
                flush()
        else:
            unwanted = _unwanted(value, attributes, named, opened["article"] > 0)
            if value in INLINE and not unwanted:
                continue
            flush()
            if stack and value in CLOSES.get(stack[-1][0], ()):
                pop()
            if attributes.rstrip().endswith("/") and value in INLINE:
                continue
            path = numbers.setdefault((stack[-1][2] if stack else -1, value), len(numbers))
            stack.append((value, unwanted, path))
            opened[value] += 1
            bad += unwanted
            if value in LANDMARKS:
                marks.append(landmarks)
                landmarks += 1
    flush()
    return out


def main_text(page: str, share: float = SHARE) -> str:
    """The content blocks of a page in order, joined by one space; empty if there are none."""
    found = blocks(page)
    may = [i for i, b in enumerate(found) if b[2]]
    if not may:
        # Names that leave nothing are wrong about this page.
        found = blocks(page, named=False)
        may = [i for i, b in enumerate(found) if b[2]]
    if not may:
        return ""
    paths = {p: k for k, p in enumerate(dict.fromkeys(found[i][0] for i in may))}
    own = np.array([paths[found[i][0]] for i in may])
    chars = np.array([len(found[i][1]) for i in may], dtype=float)
    marks = np.array([len(PUNCTUATION.findall(found[i][1])) for i in may], dtype=float)
    per = np.maximum(np.bincount(own), 1)
    ratios = []
    for amount in (chars, marks + 1):
        ratio = (np.bincount(own, amount) / per)[own]
        padded = np.pad(ratio, 2, mode="edge")
        ratios.append(np.convolve(padded, SMOOTH, mode="valid"))
    fused = ratios[0] * ratios[1]
    by_path = np.bincount(own, fused) / per
    by_block = by_path[own]
    owner = np.array([found[i][3] for i in may])
    inside = owner >= 0
    if inside.any():
        sums, sizes = np.bincount(owner[inside], fused[inside]), np.bincount(owner[inside])
        weight = sums / fused.sum() * sums / np.maximum(sizes, 1)
        by_block[inside] = np.maximum(by_block[inside], weight[owner[inside]])
    limit = min(share * fused.std(), by_path.max())
    return " ".join(found[i][1] for i, figure in zip(may, by_block, strict=True) if figure >= limit)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            texts = [main_text(h.as_py() or "") for h in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; ``n_chars`` counts code points.

    Null html is empty and gives an empty text. Broken markup ends where the page
    ends (rules in ``tokens``); time is linear in the page, broken or not. Repeated rows give equal texts; other columns are ignored; no rows give
    no rows.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
