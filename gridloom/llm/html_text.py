"""Main text of HTML pages by tree scoring.

A page is parsed into a tree with the usual implied end tags.  Boilerplate goes first: elements that are menus, headers,
footers, sidebars, forms, scripts and the like by their tag or role, or by a class or id name that begins or ends with a
telling word (``cookie-banner``, ``post-comments``).  Then every paragraph (block with text of its own) passes points
for its length and commas to the blocks around it, all of them to the nearest, half to the next, less further up.  A
block's score is its points less its share of link text, plus a bonus for telling tags and names; the best block is kept,
with siblings that score well or read like paragraphs.  An ``article`` or ``main`` element around the best block counts
as the whole container.

Comments, doctypes and attributes are markup.  Character references are decoded, white space becomes one space, blocks
are joined by one space in page order; inside the kept blocks nothing else is dropped, however short or long.  A heading
inside an article's header belongs to the article, and so does an ``h1`` just before the container.  Null, empty and
blank pages, and pages of boilerplate only, give an empty text; a page without a tag is one block.  Parsing is linear in
the page and does not recurse, so depth and length are not limited.  Each row is worked on alone: repeated rows repeat
their result, an empty table gives no rows.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import in_tasks, table

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/<>"']*)(?P<attrs>(?:[^<>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/<>]*)(?P<attrs2>[^<>]*)>", re.S)
NAMES = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
COMMA = re.compile("[,،、，]")


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen")
RAW = _set("script style textarea title xmp iframe noembed noframes")  # their content is no markup
IN_HEAD = _set("title meta link script style base noscript template basefont bgsound")
INLINE = _set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
              "small span strike strong sub sup time tt u var wbr")
ENDS_P = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
              "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt")
BOUNDARY = _set("table td th caption button object template")
# An open element of the second set is ended by a start tag of the first, unless one of the third lies between.
ENDED_BY = (
    (_set("li"), _set("li"), _set("ul ol menu dir")), (_set("dd dt"), _set("dd dt"), _set("dl")),
    (_set("td th"), _set("td th"), _set("table")), (_set("tr tbody thead tfoot"), _set("td th"), _set("table")),
    (_set("tr tbody thead tfoot"), _set("tr"), _set("table")), (_set("tbody thead tfoot"), _set("tbody thead tfoot"), _set("table")),
    (_set("option optgroup"), _set("option"), _set("select")),
)
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
LEAVES = _set("p pre li dt dd blockquote figcaption summary caption tr td th address h1 h2 h3 h4 h5 h6 legend")
GONE = _set("head title script style noscript template nav footer aside form iframe svg button select option textarea object canvas "
            "audio video map menu dialog fieldset noframes noembed search datalist")
ROLES = _set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar")
TELLING = _set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox banner sponsor sponsored sponsors promo "
    "promos promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead footer "
    "colophon sidebar aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay toast "
    "paywall copyright share sharing social follow related recommended recommendations trending popular newsletter subscribe "
    "subscription signup login search form skip")
READERS = _set("comment comments commentlist disqus respond reply replies discussion")
GOOD = _set("article content main post entry story body text blog")
LEVELS, LEAST_LENGTH, SIBLING = 5, 25, 0.2
BONUS, NAMED = 25.0, 1.5  # points of an article or main element; factor of a telling name


def _telling(name: str, words: frozenset[str]) -> bool:
    parts = [w.lower() for w in WORDS.findall(name)]
    return bool(parts) and (parts[0] in words or parts[-1] in words) and parts[0] not in ("has", "no", "with", "without") and "with" not in parts


class Page:
    """Elements in page order (parents first) and the pieces of text between the tags."""

    def __init__(self, text: str):
        self.tags, self.parents, self.names = ["html"], [-1], [{}]
        self.pieces: list[tuple[int, str]] = []  # (element, text); a break between blocks is a blank
        self.stack, self.open = [0], {}  # open elements; per tag the places on the stack
        at = 0
        while (token := TOKEN.search(text, at)) is not None:
            self._text(text[at : token.start()])
            at = token.end()
            tag = token["tag"] or token["tag2"]
            if tag is None:
                continue
            tag = tag.lower()
            if token["end"] or token["end2"]:
                self._end(tag)
                continue
            attrs = token["attrs"] or token["attrs2"] or ""
            self._start(tag, attrs)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                at = close.end() if close else len(text)
                self._end(tag)
        self._text(text[at:])

    def _place(self, tags) -> int:
        """Highest place on the stack of any of the tags, -1 without one."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _cut(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.tags[self.stack.pop()]
            self.open[tag].pop()
            if tag not in INLINE:
                self._break()

    def _break(self) -> None:
        self.pieces.append((self.stack[-1], " "))

    def _text(self, piece: str) -> None:
        if not piece:
            return
        if self.open.get("head") and not piece.isspace():
            self._cut(self.open["head"][-1])
        self.pieces.append((self.stack[-1], html.unescape(piece) if "&" in piece else piece))

    def _start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "head") and (tag == "html" or len(self.tags) > 1):
            return
        if self.open.get("head") and tag not in IN_HEAD:
            self._cut(self.open["head"][-1])
        if tag == "body" and self.open.get("body"):
            return
        if tag in ENDS_P and self.open.get("p") and self.open["p"][-1] > self._place(BOUNDARY):
            self._cut(self.open["p"][-1])
        for starts, ended, between in ENDED_BY:
            if tag in starts and (place := self._place(ended)) > self._place(between):
                self._cut(place)
        if tag not in INLINE:
            self._break()
        if tag in VOID:
            return
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.names.append({k.lower(): a or b or c or "" for k, a, b, c in NAMES.findall(attrs)} if "=" in attrs else {})
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tags) - 1)

    def _end(self, tag: str) -> None:
        if tag == "br":
            return self._break()
        places = self.open.get(tag)
        if tag not in ("html", "body") and places and (tag in BOUNDARY or places[-1] > self._place(BOUNDARY)):
            self._cut(places[-1])


def _inherit(parents: list[int], own: list[bool]) -> list[bool]:
    out = list(own)
    for i in range(1, len(own)):
        out[i] = own[i] or out[parents[i]]
    return out


def _dropped(page: Page) -> list[bool]:
    """Elements that are boilerplate or inside of it."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    readers, named = [False] * n, [False] * n
    for i, names in enumerate(page.names):
        if not names or tags[i] in ("html", "body"):
            continue
        labels = [*names.get("class", "").split(), names.get("id", "")]
        readers[i] = any(_telling(x, READERS) for x in labels)
        if tags[i] not in ("article", "main"):
            named[i] = names.get("role", "").lower() in ROLES or any(_telling(x, TELLING) for x in labels)
    # What wraps an article or main element is not boilerplate, whatever it is called.
    by_readers = _inherit(parents, readers)
    around, n_main = [0] * n, 0
    for i in range(n - 1, 0, -1):
        if not by_readers[i]:
            mine = tags[i] in ("article", "main") or _names_main(page.names[i])
            n_main += mine
            around[parents[i]] += around[i] + mine
    # Pages that are one large form: without an article the form with most of the text stays.
    weight = [0] * n
    for at, text in page.pieces:
        weight[at] += len(text)
    for i in range(n - 1, 0, -1):
        if tags[i] not in ("script", "style", "head"):
            weight[parents[i]] += weight[i]
    inside = _inherit(parents, [t in ("article", "main") for t in tags])
    own = [False] * n
    for i in range(1, n):
        tag = tags[i]
        if tag == "form":
            own[i] = not around[i] and (n_main > 0 or 2 * weight[i] < weight[0])
        elif tag == "header" or (named[i] and inside[i] and _is_header(page.names[i])):
            own[i] = not around[i] and not inside[i]
        else:
            own[i] = tag in GONE or readers[i] or (named[i] and not around[i])
    out = _inherit(parents, own)
    # Of a header inside the article only the headings stay.
    header = [not out[i] and not around[i] and inside[i] and (tags[i] == "header" or (named[i] and _is_header(page.names[i])))
              for i in range(n)]
    for i, (under, heading) in enumerate(zip(_inherit(parents, header), _inherit(parents, [t in HEADINGS for t in tags]), strict=True)):
        out[i] = out[i] or (under and not heading)
    return out


def _is_header(names: dict[str, str]) -> bool:
    return any(_telling(x, frozenset({"header"})) for x in [*names.get("class", "").split(), names.get("id", "")])


def _names_main(names: dict[str, str]) -> bool:
    return names.get("role", "").lower() == "main" or names.get("itemprop", "").lower() == "articlebody"


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    n, tags, parents = len(page.tags), page.tags, page.parents
    gone = _dropped(page)
    block = list(range(n))  # nearest block of an element
    link = _inherit(parents, [t == "a" for t in tags])
    for i in range(1, n):
        block[i] = block[parents[i]] if tags[i] in INLINE else i
    length, commas, linked = [0] * n, [0] * n, [0] * n
    for at, text in page.pieces:
        if not gone[at] and (size := len(" ".join(text.split()))):
            b = block[at]
            length[b] += size
            commas[b] += len(COMMA.findall(text))
            linked[b] += size * link[at]
    points = [0.0] * n
    for i in range(n):
        if not length[i]:
            continue
        worth = (commas[i] + length[i] / 100 + (length[i] >= LEAST_LENGTH)) * (1 - linked[i] / length[i])
        # A leaf passes everything on; other blocks with text of their own are paragraph and container at once.
        at, level = (parents[i] if tags[i] in LEAVES and i else i), 0
        while at >= 0 and level < LEVELS:
            at = block[at]
            points[at] += worth * (1.0 if level == 0 else 0.5 if level == 1 else 1 / (3 * level))
            at, level = parents[at], level + 1
    whole, whole_linked = list(length), list(linked)
    for i in range(n - 1, 0, -1):
        whole[parents[i]] += whole[i]
        whole_linked[parents[i]] += whole_linked[i]

    def score(i: int) -> float:
        if gone[i] or not whole[i] or block[i] != i:
            return 0.0
        value = points[i]
        if value > 0:
            labels = [*page.names[i].get("class", "").split(), page.names[i].get("id", "")]
            if tags[i] in ("article", "main") or _names_main(page.names[i]):
                value += BONUS
            elif tags[i] != "body" and any(_telling(x, GOOD) for x in labels):
                value *= NAMED
        return value * (1 - whole_linked[i] / whole[i])

    best = max(range(n), key=lambda i: (score(i), -i))
    if score(best) <= 0:
        best = tags.index("body") if "body" in tags else 0
    at, main = best, -1
    while at > 0:
        if tags[at] == "article":
            main = at
            break
        if main < 0 and (tags[at] == "main" or _names_main(page.names[at])):
            main = at
        at = parents[at]
    best = main if main >= 0 else best
    root = [False] * n
    root[best] = True
    top = score(best)
    for i in range(1, n):
        if parents[i] == parents[best] and i != best and not gone[i] and whole[i]:
            density = whole_linked[i] / whole[i]
            if tags[best] in ("article", "main"):
                # The page says what its article is: only further articles, and a title before it, belong to it.
                root[i] = (tags[i] == tags[best] and density < 0.25 and score(i) >= SIBLING * top) or (tags[i] == "h1" and i < best)
            else:
                reads = tags[i] in ("p", "pre", "blockquote") and density < 0.25 and (whole[i] > 80 or not density)
                root[i] = reads or score(i) >= SIBLING * top or (tags[i] == "h1" and i < best)
    kept = _inherit(parents, root)
    return " ".join("".join(text if kept[at] and not gone[at] else " " for at, text in page.pieces).split())


def _texts(batches):
    for batch in batches:
        text = [main_text(x if isinstance(x, str) else None) for x in batch["html"]]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(x) for x in text]})


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``pages``."""
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    return in_tasks(rows, _texts, f"page_id {id_type}, url string, text string, n_chars long")


def op12_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
