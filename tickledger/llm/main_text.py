"""Main text of web pages.

A page is cut into flat text blocks. Each block is described by its word count and link density,
those of its neighbours, and where it stands; a decision tree trained on the small labelled table
below says whether it is content.
"""

from __future__ import annotations

import html
import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickledger.llm import texts as X

# Names from the HTML standard and words that sites use for parts beside the article.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
UNREAD = "script|style|noscript|template|textarea|iframe|object|svg|math|title|select"
BESIDE_TAGS = frozenset("nav footer aside form button menu dialog select option fieldset legend search".split())
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget related share "
    "sharing social subscribe newsletter signup login footer masthead topbar comment comments reply replies disqus pagination pager "
    "search toolbar".split()
)
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    rf"|<({UNREAD})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|(?=<body[\s>])|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Words that join others to a beside word without making it another thing, and words that unmake it.
PLAIN_WORDS = frozenset(
    "site main page top bottom left right global primary secondary header head box bar block list links link item items wrapper container "
    "inner section area panel post posts article articles story stories button buttons form message text body content title count author "
    "thread slot unit policy".split()
)
UNMAKING_WORDS = frozenset("with has no not without is non".split())
LEGAL = re.compile(r"\u00a9|\bcopyright\b|\ball rights reserved\b|\b(?:we|site|page|website) uses? cookies\b|\b(?:cookie|privacy) policy\b|\bterms of (?:use|service)\b", re.I)

NONE, LINKS, PROSE = [(0, 0.0)], [(3, 1.0), (20, 0.9)], [(50, 0.0), (12, 0.1)]
ANY, APART = NONE + LINKS + PROSE, NONE + LINKS
WORDS = (1, 2, 4, 7, 12, 20, 30, 45, 80, 150)
DENSITIES = (0.0, 0.15, 0.3, 0.5, 0.75, 1.0)
TEXT, MIXED, LINKED, ALL = (0.0, 0.3), (0.0, 0.5), (0.75, 1.0), (0.0, 1.0)
# Kinds of blocks, labelled by hand: words from and to, link density from and to, blocks before, blocks after,
# beside (0.5: perhaps), in an article, heading, a line of rights or cookies; content or not.
CASES = [
    # inside an article: prose of any length, whatever stands next to it, and headings
    ((1, 150), MIXED, ANY, ANY, (0,), (1,), (0,), (0,), 1),
    ((1, 20), ALL, ANY, ANY, (0,), (1,), (1,), (0, 1), 1),
    # links there: long ones and single ones are part of it, rows of short ones are menus
    ((7, 150), LINKED, ANY, ANY, (0,), (1,), (0,), (0,), 1),
    ((1, 4), LINKED, NONE + PROSE, NONE + PROSE, (0,), (1,), (0,), (0,), 1),
    ((1, 4), LINKED, ANY, LINKS, (0,), (1,), (0,), (0,), 0),
    ((1, 4), LINKED, LINKS, NONE + PROSE, (0,), (1,), (0,), (0,), 0),
    # parts beside the article, by tag, role or name
    ((1, 150), ALL, ANY, ANY, (1,), (0, 1), (0, 1), (0, 1), 0),
    # perhaps beside, by one word of a longer name: long prose is not, short texts are, but for those among prose
    ((20, 150), TEXT, ANY, ANY, (0.5,), (1,), (0,), (0, 1), 1),
    ((1, 12), TEXT, PROSE, PROSE, (0.5,), (1,), (0,), (0,), 1),
    ((1, 12), TEXT, APART, ANY, (0.5,), (1,), (0,), (0, 1), 0),
    ((1, 12), TEXT, PROSE, APART, (0.5,), (1,), (0,), (0, 1), 0),
    ((1, 20), ALL, ANY, PROSE, (0.5,), (1,), (1,), (0,), 1),
    ((1, 20), ALL, ANY, APART, (0.5,), (0, 1), (1,), (0,), 0),
    ((1, 150), (0.5, 1.0), ANY, ANY, (0.5,), (0, 1), (0,), (0, 1), 0),
    ((45, 150), TEXT, ANY, ANY, (0.5,), (0,), (0,), (0,), 1),
    ((1, 30), TEXT, ANY, ANY, (0.5,), (0,), (0,), (0, 1), 0),
    # pages without an article element: prose, and short texts that do not stand among links
    ((12, 150), TEXT, ANY, ANY, (0,), (0,), (0,), (0,), 1),
    ((1, 7), TEXT, PROSE, ANY, (0,), (0,), (0,), (0,), 1),
    ((1, 7), TEXT, APART, PROSE, (0,), (0,), (0,), (0,), 1),
    ((1, 7), TEXT, NONE, NONE, (0,), (0,), (0,), (0,), 1),
    ((1, 7), TEXT, LINKS, APART, (0,), (0,), (0,), (0,), 0),
    ((1, 7), TEXT, NONE, LINKS, (0,), (0,), (0,), (0,), 0),
    ((20, 150), (0.5, 0.5), PROSE, ANY, (0,), (0,), (0,), (0,), 1),
    ((20, 150), (0.5, 0.5), APART, APART, (0,), (0,), (0,), (0,), 0),
    ((1, 12), (0.5, 0.5), ANY, ANY, (0,), (0,), (0,), (0,), 0),
    ((1, 150), LINKED, PROSE, PROSE, (0,), (0,), (0,), (0,), 1),
    ((1, 150), LINKED, APART, ANY, (0,), (0,), (0,), (0,), 0),
    ((1, 150), LINKED, PROSE, APART, (0,), (0,), (0,), (0,), 0),
    ((1, 20), ALL, ANY, PROSE, (0,), (0,), (1,), (0,), 1),
    ((1, 20), ALL, NONE + PROSE, NONE, (0,), (0,), (1,), (0,), 1),
    ((1, 20), ALL, ANY, LINKS, (0,), (0,), (1,), (0,), 0),
    ((1, 20), ALL, LINKS, NONE, (0,), (0,), (1,), (0,), 0),
    # lines of rights and cookies without a telling name
    ((1, 45), ALL, ANY, ANY, (0,), (0,), (0, 1), (1,), 0),
    ((80, 150), TEXT, ANY, ANY, (0,), (0,), (0,), (1,), 1),
    ((1, 150), MIXED, ANY, ANY, (0,), (1,), (0,), (1,), 1),
]
LABELLED = np.array([
    (words, density, *before, *after, *place, content)
    for (least, most), (low, high), *lists, content in CASES for words in WORDS if least <= words <= most
    for density in DENSITIES if low <= density <= high for before, after, *place in product(*lists)
])


def grow(rows: np.ndarray, depth: int = 16):
    """A decision tree by Gini impurity: a share of content, or (column, threshold, below, above)."""
    y = rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for column in range(rows.shape[1] - 1):
        values = np.unique(rows[:, column])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, column] < cut
            impurity = sum(part.sum() * (s := y[part].mean()) * (1 - s) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, column, cut, low
    if best is None:
        return float(y.mean())
    _, column, cut, low = best
    return column, float(cut), grow(rows[low], depth - 1), grow(rows[~low], depth - 1)


def tree():
    return X.kept_in_worker("tree of page blocks", lambda: grow(LABELLED))


def is_content(node, features: tuple) -> bool:
    while isinstance(node, tuple):
        column, cut, below, above = node
        node = below if features[column] < cut else above
    return node >= 0.5


# How sure a part is beside the article. Entering an article or main element clears all but TAG.
CLEAR, PERHAPS, NAMED_SO, FORM, TAG = range(5)
BESIDE = (0.0, 0.5, 1.0, 1.0, 1.0)


def named_beside(value: str) -> int:
    """What a class or id says: one name of beside and plain words is enough, a word among others only hints at it."""
    found = CLEAR
    for name in value.split():
        parts = [p.lower() for p in PART.findall(name)]
        own = [p for p in parts if p in BESIDE_WORDS]
        if own and not UNMAKING_WORDS.intersection(parts):
            sure = all(p in BESIDE_WORDS or p in PLAIN_WORDS or len(p) == 1 for p in parts)
            found = max(found, NAMED_SO if sure else PERHAPS)
    return found


def beside(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is a part beside the article, by its tag or role, or by its class or id."""
    if tag == "form":
        return FORM
    if tag in BESIDE_TAGS or tag == "header" and not in_article:
        return TAG
    if "=" not in attributes or tag in ("html", "body", "main", "article"):
        return CLEAR
    found = CLEAR
    for name, *values in NAMED.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            if BESIDE_ROLES.intersection(value.lower().split()):
                return TAG
        else:
            found = max(found, named_beside(value))
    return found


def blocks(page: str) -> list[tuple[str, int, float, float, bool, bool]]:
    """(text, words, link density, beside, in article, heading) of each block that has text."""
    out: list[tuple] = []
    # tag, and how beside, whether in an article, a heading from here on
    stack: list[tuple[str, int, bool, bool]] = []
    state = (CLEAR, False, False)
    text: list[str] = []
    linked: list[str] = []
    link = False

    def flush():
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                n_linked = len(html.unescape(" ".join(linked)).split())
                out.append((" ".join(words), len(words), min(1.0, n_linked / len(words)), BESIDE[state[0]], *state[1:]))
            text.clear()
            linked.clear()

    def add(part: str):
        if part:
            text.append(part)
            if link:
                linked.append(part)

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[1]:
            if m[1].lower() in BLOCK_TAGS:
                flush()
            continue
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag == "a":
            link = not m[2]
        elif tag in ("br", "wbr", "img", "input"):
            add(" " if tag != "wbr" else "")
        elif tag in BLOCK_TAGS:
            flush()
            link = False
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option", *HEADINGS) and stack and stack[-1][0] == tag or stack and stack[-1][0] == "p":
                    stack.pop()
                state = stack[-1][1:] if stack else (CLEAR, False, False)
                if tag not in VOID:
                    article = state[1] or tag in ("article", "main")
                    # a form or a wrapper of some name around the article is not beside it
                    outer = CLEAR if article and not state[1] and state[0] < TAG else state[0]
                    stack.append((tag, max(outer, beside(tag, m[4], state[1])), article, tag in HEADINGS))
            state = stack[-1][1:] if stack else (CLEAR, False, False)
    add(page[at:])
    flush()
    return out


def main_text(page: str | None) -> str:
    """Content blocks of a page in page order, joined by an empty line.

    Neighbours count only inside the same part of the page: what follows the article says nothing
    about its last paragraph.
    """
    found = blocks(page or "")
    part = [(sure, article) for *_, sure, article, _ in found]
    measure = lambda k, own: found[k][1:3] if 0 <= k < len(found) and part[k] == own else NONE[0]
    kept = []
    for k, (text, n, density, *place) in enumerate(found):
        legal = LEGAL.search(text) is not None
        if is_content(tree(), (n, density, *measure(k - 1, part[k]), *measure(k + 1, part[k]), *place, legal)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(df: DataFrame, page: str = "html", name: str = "text") -> DataFrame:
    """``df`` with the main text of each page; null, empty and text-free pages give the empty text.

    Broken markup is read leniently: unclosed elements end with their parent, cut-off tags are
    dropped. Rows are read alone; a column with the name of the result is replaced.
    """
    column = next(i for i, c in enumerate(df.columns) if c.lower() == page.lower())

    def made(batch):
        return [pa.array([main_text(p.as_py()) for p in batch.column(column)], pa.string())]

    return X.append(df, f"{name} string", made)
