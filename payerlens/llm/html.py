"""Main text of web pages: flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. A block knows its words, its link
density and those of its neighbours, and which kinds of container it lies in, by tag
names and by whole names in class, id and role. A decision tree, grown from a small
labelled table of block shapes, says which blocks are the main text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from .common import map_arrow, small_slices, whole_text

#: Comments, markup declarations, tags (quoted values may hold ">").
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?<![^\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: White space as HTML and Unicode have it.
_BLANKS = re.compile(r"\s+")

#: Elements whose content is not text of the page.
SILENT = frozenset(
    "script style noscript template svg annotation annotation-xml iframe object canvas audio video head select textarea button".split()
)
#: Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that say what kind of place they hold.
TAG_KINDS = {
    "nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side",
    "form": "form", "dialog": "notice", "article": "main", "main": "main",
}
#: Names in class, id or role that say so.
NAME_KINDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "head": "header masthead banner topbar branding logo",
    "foot": "footer copyright colophon contentinfo legal imprint",
    "side": "sidebar aside related recommended widget rail complementary tags share social",
    "form": "form search login signup subscribe newsletter",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer toast paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion",
    "comment": "comment comments disqus reply replies respond discussion reviews",
    "main": "article content main post entry story",
}
_KIND_OF = {word: kind for kind, words in NAME_KINDS.items() for word in words.split()}
#: What such a name may end with, and begin with, and remain the name of that place.
ENDINGS = frozenset(
    "area banner bar bars body block box buttons container content form group inner item items links list menu "
    "message nav outer panel posts region section slot text thread title unit widget widgets wrap wrapper".split()
)
BEGINNINGS = frozenset("site page global primary secondary main top bottom left right".split())
#: These name a part of the article, whose head and foot are its own.
OF_ARTICLE = frozenset("article post entry story".split())
#: Tokens that begin so tell of a layout or a subject, not of a place.
NO_PLACE = ("has-", "no-", "with-", "without-", "is-", "category-", "tag-")
KINDS = ("menu", "head", "foot", "side", "form", "notice", "advert", "comment", "main")
#: Elements that keep their own place even if an outer one is left open.
_SCOPES = frozenset("article main nav header footer aside form section div body".split())

FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", *KINDS, "elsewhere")


def _kind_of_name(token: str) -> str | None:
    """The kind of place that a whole token of class, id or role names."""
    token = re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower().replace("_", "-")
    if token.startswith(NO_PLACE):
        return None
    words = [w for w in token.split("-") if w and not re.fullmatch(r"[0-9x]+", w)]
    if len(words) > 1 and words[0] in BEGINNINGS and words[1] in _KIND_OF:
        words = words[1:]
    elif len(words) > 1 and words[0] in OF_ARTICLE and words[1] in _KIND_OF:
        if _KIND_OF[words[1]] in ("menu", "head", "foot"):
            return None
        words = words[1:]
    if not words or words[0] not in _KIND_OF:
        return None
    kind = _KIND_OF[words[0]]
    return kind if all(w in ENDINGS or _KIND_OF.get(w) == kind for w in words[1:]) else None


@lru_cache(maxsize=4096)
def _kinds(tag: str, attributes: str) -> tuple[frozenset, bool]:
    """(kinds of place that a tag names, hidden)."""
    kinds = {TAG_KINDS[tag]} if tag in TAG_KINDS else set()
    # names on the main elements tell of their subject; the body is no place of its own
    if attributes and tag not in ("article", "main", "html", "body"):
        for groups in _NAMES.findall(attributes):
            kinds.update(k for k in map(_kind_of_name, "".join(groups).split()) if k)
    return frozenset(kinds), bool(attributes and _HIDDEN.search(attributes))


def blocks(page: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(text, words, words in links, place flags) of the flat blocks of a page, in order.

    Unclosed and stray tags are borne: an end tag closes the nearest open element of
    its name, if there is one inside the nearest section-like element or that itself.
    """
    out: list = []
    parts: list[str] = []
    open_tags: list[tuple[str, frozenset, bool, int]] = []
    flags: dict[str, int] = dict.fromkeys(KINDS, 0)
    links = link_words = silent = 0
    at, size = 0, len(page)

    def end_block() -> None:
        nonlocal link_words
        if parts:
            text = _BLANKS.sub(" ", "".join(parts)).strip()
            if text:
                # reader comments and menus inside an article count by the inner place
                out.append((text, text.count(" ") + 1, link_words, tuple(int(flags[k] > 0) for k in KINDS)))
            parts.clear()
        link_words = 0

    def close(count: int) -> None:
        nonlocal silent, links
        for _ in range(count):
            tag, kinds, hidden, forms = open_tags.pop()
            for k in kinds:
                flags[k] -= 1
            flags["form"] += forms
            silent -= hidden
            links -= tag == "a"

    while at < size:
        token = _TOKEN.search(page, at)
        text = page[at : token.start() if token else size]
        if text and not silent:
            text = html.unescape(text)
            parts.append(text)
            if links:
                link_words += len(text.split())
        if not token:
            break
        at = token.end()
        name = token[2]
        if not name:
            continue
        tag, attributes = name.lower(), token[3]
        if tag in BLOCKS:
            end_block()
        if token[1]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    close(len(open_tags) - i)
                    break
                if open_tags[i][0] in _SCOPES and tag not in _SCOPES:
                    break
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in ("script", "style", "textarea", "title", "noscript", "iframe"):
            # raw text: nothing inside is markup
            ending = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            if ending:
                gap = page.find(">", ending.end())
                at = size if gap < 0 else gap + 1
            elif tag in ("script", "style"):
                at = size
            continue
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th", "a"):
            # these end an open one of the same name
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    close(len(open_tags) - i)
                    break
                if open_tags[i][0] in _SCOPES or open_tags[i][0] in ("ul", "ol", "table"):
                    break
        if tag == "body":
            close(len(open_tags))
        kinds, hidden = _kinds(tag, attributes)
        hidden = hidden or tag in SILENT
        if tag == "header" and any(t[0] == "article" for t in open_tags):
            kinds = kinds - {"head"}  # the article's own
        # a form around the main part is no form
        forms = flags["form"] if "main" in kinds else 0
        flags["form"] -= forms
        open_tags.append((tag, kinds, hidden, forms))
        for k in kinds:
            flags[k] += 1
        silent += hidden
        links += tag == "a"
    end_block()
    return out


def shapes(found: list) -> np.ndarray:
    """The features of each block.

    Names of a main part count only where such blocks hold most of the words outside other
    places; then ``elsewhere`` marks the blocks outside them. A form that holds most of the
    page's words is no form.
    """
    n = len(found)
    out = np.zeros((n + 2, len(FEATURES)), np.float64)
    for i, (_, words, linked, flags) in enumerate(found, 1):
        out[i, 0], out[i, 1] = words, min(1.0, linked / words)
        out[i, 6:-1] = flags
    words, form, main = out[:, 0], out[:, FEATURES.index("form")], out[:, FEATURES.index("main")]
    if (words * form).sum() > words.sum() / 2:
        form[:] = 0
    own = words * ~out[:, 6:-2].any(axis=1)
    if (own * main).sum() > own.sum() / 2:
        out[1:-1, -1] = main[1:-1] == 0
    else:
        main[:] = 0
    out[1:-1, 2:4], out[1:-1, 4:6] = out[:-2, 0:2], out[2:, 0:2]
    return out[1:-1]


#: Shapes of blocks and of their neighbours: (words, link density).
EDGE = ((0, 0.0),)
LINKED = ((1, 1.0), (4, 1.0), (9, 0.9), (20, 0.8))
SMALL = ((1, 0.0), (4, 0.0), (8, 0.1))
TEXTS = ((12, 0.0), (30, 0.1), (90, 0.0), (250, 0.2))
#: Labelled blocks: what they are, label, kinds of place, own shapes, shapes before, shapes after.
#: Each row is shown with every choice of its shapes.
LABELLED = (
    ("paragraph", 1, "", TEXTS[1:], EDGE + LINKED + SMALL + TEXTS, EDGE + LINKED + SMALL + TEXTS),
    ("paragraph with many links", 1, "", ((25, 0.4), (60, 0.6), (200, 0.6)), SMALL + TEXTS, SMALL + TEXTS),
    ("short paragraph or list item", 1, "", (*SMALL, TEXTS[0], (6, 0.4)), SMALL + TEXTS, EDGE + SMALL + TEXTS),
    ("first words behind a menu", 1, "", (*SMALL, TEXTS[0]), LINKED, SMALL + TEXTS),
    ("headline or only block", 1, "", (*SMALL, TEXTS[0]), EDGE, EDGE + SMALL + TEXTS),
    ("last words before a menu", 1, "", (*SMALL, TEXTS[0]), SMALL + TEXTS, LINKED),
    ("link in a paragraph's place", 1, "", ((5, 0.5), (9, 0.5)), TEXTS[1:], TEXTS[1:]),
    ("menu entry", 0, "", (*LINKED, (2, 0.8), (6, 0.7)), EDGE + LINKED + SMALL, EDGE + LINKED + SMALL),
    ("link to more of the site", 0, "", LINKED, TEXTS, EDGE + LINKED + SMALL + TEXTS),
    ("link before the text", 0, "", LINKED, EDGE + LINKED + SMALL, TEXTS),
    ("list of links in one block", 0, "", ((40, 0.9), (120, 1.0)), EDGE + LINKED + SMALL + TEXTS, EDGE + LINKED + SMALL + TEXTS),
    ("label or copyright line among links", 0, "", SMALL, LINKED, EDGE + LINKED),
    ("label before links", 0, "", SMALL, EDGE, LINKED),
    ("teaser under its linked title", 0, "", ((12, 0.0), (15, 0.2)), LINKED, EDGE + LINKED),
    *(("named main part", 1, "main", LINKED + SMALL + TEXTS, EDGE + LINKED + SMALL + TEXTS, EDGE + LINKED + SMALL + TEXTS),),
    *(
        ("another place", 0, f"{kind}{more}", LINKED + SMALL + TEXTS, EDGE + LINKED + TEXTS, EDGE + LINKED + TEXTS)
        for kind in KINDS[:-1]
        for more in ("", " main", " elsewhere")
    ),
    ("outside the main part", 0, "elsewhere", LINKED + SMALL + TEXTS, EDGE + LINKED + SMALL + TEXTS, EDGE + LINKED + SMALL + TEXTS),
)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table written out."""
    rows, marks = [], []
    for _, label, text, *choices in LABELLED:
        places = [float(k in text.split()) for k in (*KINDS, "elsewhere")]
        for own, before, after in product(*choices):
            rows.append([*own, *before, *after, *places])
            marks.append(label)
    return np.array(rows, float), np.array(marks)


def grow(x: np.ndarray, y: np.ndarray, least: int = 1):
    """Binary decision tree by Gini impurity: (feature, edge, below or at, above) or a label."""
    if len(set(y.tolist())) == 1 or len(y) < 2 * least:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for edge in (values[1:] + values[:-1]) / 2:
            left = y[x[:, f] <= edge]
            right = y[x[:, f] > edge]
            if len(left) < least or len(right) < least:
                continue
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (left, right))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, edge)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, edge = best
    low = x[:, f] <= edge
    return f, float(edge), grow(x[low], y[low], least), grow(x[~low], y[~low], least)


@lru_cache(maxsize=1)
def tree():
    return grow(*labelled())


def classify(x: np.ndarray, node=None) -> np.ndarray:
    node = tree() if node is None else node
    if isinstance(node, int):
        return np.full(len(x), node)
    f, edge, low, high = node
    out = np.zeros(len(x), np.int64)
    below = x[:, f] <= edge
    for part, branch in ((below, low), (~below, high)):
        if part.any():
            out[part] = classify(x[part], branch)
    return out


def main_text(page: str) -> str:
    """The main blocks joined by a blank; empty if there are none."""
    found = blocks(page)
    if not found:
        return ""
    kept = classify(shapes(found))
    return " ".join(b[0] for b, k in zip(found, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row; null html counts as empty, repeated rows give a row each.

    An empty table gives no rows; other columns, also ones named text or n_chars, are not looked at.
    """

    def work(batches):
        for batch in small_slices(batches, "html"):
            yield [batch.column(0), batch.column(1), [main_text(t) for t in batch.column(2).to_pylist()]]

    rows = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        whole_text(pages, "html").alias("html"),
    )
    return map_arrow(rows, work, "page_id bigint, url string, text string")
