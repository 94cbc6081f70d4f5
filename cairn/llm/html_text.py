"""Main-text extraction by tag-path ratios.

Every text node of a page has a tag path, the names from the root to the element
that holds it. Per path the page's text length and punctuation are summed and
set against the nodes that carry them: long, punctuated nodes raise both ratios,
link lists and labels lower them. The two ratios are smoothed over paths that
follow one another in the page, fused by their product, weighted by the share of
text outside links, and thresholded by a fraction of the page's standard
deviation; blocks on the chosen paths are the content.

Paths decide within what HTML itself leaves open. Elements whose meaning is not
article text (script, style, nav, aside, footer, form, a header outside an article,
hidden elements, and containers whose class, id or role names menus, adverts,
notices or reader comments) are left out with all they contain. Words that only hint
(share, tags, search, ...) make a path of their own, which the ratios then judge more strictly: its nodes need sentences.
When the page marks its article (article, main, role=main, itemprop=articleBody) the paths inside it
compete. The smallest element that holds nearly all chosen text is the content's region:
lists, quotations and captions in it are kept too unless they are mostly links, and
a heading is kept if the next text is.

The reader follows the HTML rules that decide where text belongs: attribute syntax, implied
end tags, scopes of end tags, raw text. It is linear in the page: paths are
interned node by node, open elements are found by name, and no search is repeated.

Null or empty html gives an empty text; nothing is cut or capped; repeated rows
and ties are handled row by row; other columns are ignored; one row out per row
in and no shuffle; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import map_rows

# HTML element names and the words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
FURNITURE = frozenset("nav footer aside form button dialog menu head label fieldset noscript template svg object canvas select video audio datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark math mi mn mo mrow msup msub q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag ends the open elements of these names, unless one of the second names was opened after them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
#: End tags do not reach out of these.
SCOPES = frozenset("td th caption table template object button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disqus "
    "footer login masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related "
    "replies reply respond sidebar signup skip sponsor sponsored subscribe toolbar".split()
)
#: Furniture outside an article only.
SITE_WORDS = frozenset("header topbar".split())
HINT_WORDS = frozenset("legal responses search share sharing social tags widget".split())
ARTICLE_NOT = frozenset("comment comments reply replies ad ads advert sponsored promo related".split())
STATE_WORDS = frozenset("has with without no not is".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
PUNCTUATION = ".,;:!?…。，、；：！？¿¡"

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAG_END = re.compile(r"[\s/]*>")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_LEGAL = re.compile(r"(©|\(c\)|copyright)\s*\d{4}|all rights reserved", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}

PLAIN, HINTED, AWAY = 0, 1, 2


def furniture(name: str, attrs: list[tuple[str, str]], inside_article: bool) -> int:
    """AWAY for an element that holds no article text, HINTED if only its paths can tell."""
    if name in FURNITURE or (name == "header" and not inside_article):
        return AWAY
    found = PLAIN
    for key, value in attrs:
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return AWAY
        if key == "role" and value.lower() in FURNITURE_ROLES:
            return AWAY
        if key == "style" and _UNSEEN.search(value.lower()):
            return AWAY
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for part in value.split():
                words = {w.lower() for w in _WORDS.findall(part)}
                if words & STATE_WORDS:
                    continue
                if words & (ARTICLE_NOT if name == "article" else CONTAINER_WORDS) or (words & SITE_WORDS and not inside_article and name not in HEADINGS):
                    return AWAY
                if words & HINT_WORDS:
                    found = HINTED
    return found


class Block:
    """The text between two block boundaries, with the path and the element that hold it."""

    __slots__ = ("article", "element", "link", "parts", "path", "tag", "text")

    def __init__(self, path: int, element: int, tag: str, article: bool):
        self.path, self.element, self.tag, self.article = path, element, tag, article
        self.parts, self.link, self.text = [], 0, ""


class Reader:
    """Reads a page once; ``blocks`` holds its text outside furniture, ``parents`` the tree of its block elements."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parents = [0]
        self.paths: dict[tuple[int, str, int], int] = {}
        self.stack: list[list] = []  # [name, away, article, link, path, element, block tag before]
        self.open: dict[str, list[int]] = {}
        self.scopes: list[int] = [-1]
        self.breaks: list[int] = [-1]  # depths of elements that are not inline
        self.away = self.article = self.links = 0
        self.path, self.element, self.tag = 0, 0, ""
        self.block: Block | None = None
        self.read(page)

    def depth_of(self, names: tuple[str, ...]) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    def push(self, name: str, away: int, article: int, hint: int) -> None:
        inline = name in INLINE
        depth = len(self.stack)
        self.stack.append([name, away, article, name == "a", self.path, self.element, self.tag])
        self.open.setdefault(name, []).append(depth)
        self.away, self.article, self.links = self.away + away, self.article + article, self.links + (name == "a")
        if not inline or hint:
            self.path = self.paths.setdefault((self.path, name, hint), len(self.paths) + 1)
            self.block = None
        if not inline:
            self.breaks.append(depth)
            self.parents.append(self.element)
            self.element, self.tag = len(self.parents) - 1, name
        if name in SCOPES:
            self.scopes.append(depth)

    def forget(self, entry: list) -> None:
        """Undo what an open element counts for."""
        self.away, self.article, self.links = self.away - entry[1], self.article - entry[2], self.links - entry[3]
        entry[1] = entry[2] = entry[3] = 0

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            entry = self.stack.pop()
            at = len(self.stack)
            self.forget(entry)
            spots = self.open[entry[0]]
            if spots and spots[-1] == at:
                spots.pop()
            if self.breaks[-1] == at:
                self.breaks.pop()
                self.block = None
            elif self.path != entry[4]:
                self.block = None
            self.path, self.element, self.tag = entry[4], entry[5], entry[6]
            if self.scopes[-1] == at:
                self.scopes.pop()

    def end(self, name: str) -> None:
        spots = self.open.get(name)
        if not spots:
            if name not in INLINE:
                self.block = None
            return
        depth = spots[-1]
        if name in INLINE and self.breaks[-1] > depth:  # misnested: the blocks opened since stay open
            self.forget(self.stack[depth])
            spots.pop()
        elif name in SCOPES or depth > self.scopes[-1]:
            self.pop_to(depth)

    def start(self, name: str, attrs: list[tuple[str, str]], closed: bool) -> None:
        if name in CLOSES_P:
            depth = self.depth_of(("p",))
            if depth > self.scopes[-1]:
                self.pop_to(depth)
        if name in ENDS:
            ends, limits = ENDS[name]
            depth = self.depth_of(ends)
            if depth > self.depth_of(limits):
                self.pop_to(depth)
        elif name in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        elif name == "a" and self.open.get("a"):  # links do not nest
            self.end("a")
        if name == "br" and self.block is not None:
            self.block.parts.append("\n")
        if name in VOID or (closed and name not in CLOSES_P and name not in INLINE and name not in FURNITURE):
            if name not in INLINE and name != "br":
                self.block = None
            return
        kind = furniture(name, attrs, self.article > 0)
        main = kind != AWAY and (name in ("article", "main") or any(k == "role" and v == "main" or k == "itemprop" and v == "articleBody" for k, v in attrs))
        if closed and name in FURNITURE:
            return
        self.push(name, int(kind == AWAY), int(main), int(kind == HINTED))

    def text(self, piece: str) -> None:
        if self.away:
            return
        if self.block is None:
            if not piece.strip():
                return
            self.block = Block(self.path, self.element, self.tag, self.article > 0)
            self.blocks.append(self.block)
        piece = entities.unescape(piece)
        self.block.parts.append(piece)
        if self.links:
            self.block.link += len(piece.strip())

    def read(self, page: str) -> None:
        size, at = len(page), 0
        last_end, last_cdata = page.rfind(">"), page.rfind("]]>")
        while at < size:
            spot = page.find("<", at)
            if spot < 0:
                self.text(page[at:])
                return
            if spot > at:
                self.text(page[at:spot])
            at = spot
            follows = page[at + 1 : at + 2]
            if follows in ("!", "?") or (follows == "/" and not page[at + 2 : at + 3].isalpha()):
                if page.startswith("<!--", at):
                    end = page.find("-->", at + 2)
                    at = size if end < 0 else end + 3
                elif page.startswith("<![CDATA[", at) and last_cdata > at:
                    at = page.find("]]>", at) + 3
                else:
                    at = size if last_end < at else page.find(">", at) + 1
                continue
            closing = follows == "/"
            named = _NAME.match(page, at + 1 + closing)
            if not named:
                self.text("<")
                at += 1
                continue
            if last_end < at:  # a tag that never ends
                return
            name, at, attrs = named[0].lower(), named.end(), []
            while not (end := _TAG_END.match(page, at)):
                attr = _ATTR.match(page, at)
                if not attr:
                    return
                attrs.append((attr[1].lower(), entities.unescape(attr[2] or attr[3] or attr[4] or "") if attr.lastindex > 1 else ""))
                at = attr.end()
            closed = "/" in end[0]
            at = end.end()
            if closing:
                self.end(name)
            elif name in RAW:  # its content is not markup
                if name not in INLINE:
                    self.block = None
                over = _RAW_END[name].search(page, at)
                at = over.end() if over else size
            else:
                self.start(name, attrs, closed)


def ratios(found: list[Block], smooth: int) -> dict[int, tuple[float, float, float]]:
    """Per path, in page order: the fused, smoothed ratio, the share of its text inside links, and its marks per node."""
    order: dict[int, list[float]] = {}
    for block in found:
        row = order.setdefault(block.path, [0.0, 0.0, 0.0, 0.0])
        row[0] += len(block.text)
        row[1] += sum(map(block.text.count, PUNCTUATION))
        row[2] += 1
        row[3] += min(block.link, len(block.text))
    rows = list(order.values())

    def smoothed(values: list[float]) -> list[float]:
        out = []
        for i, value in enumerate(values):
            near = values[max(0, i - smooth) : i + smooth + 1]
            out.append((value + sum(near) / len(near)) / 2)
        return out

    length, marks = smoothed([r[0] / r[2] for r in rows]), smoothed([r[1] / r[2] for r in rows])
    return {path: (a * (1 + b) * (1 - r[3] / r[0]) ** 2, r[3] / r[0], r[1] / r[2]) for path, a, b, r in zip(order, length, marks, rows, strict=True)}


def region_of(parents: list[int], held: dict[int, int], share: float = 0.9) -> list[bool]:
    """Per element, whether it lies in the smallest container with ``share`` of the text that ``held`` gives by element."""
    total = [0] * len(parents)
    for element, n in held.items():
        total[element] += n
    for element in range(len(parents) - 1, 0, -1):  # children come after their parents
        total[parents[element]] += total[element]
    least = share * total[0]
    region = max(i for i, n in enumerate(total) if n >= least)
    if held.get(region):  # an element that holds text itself: its container
        region = parents[region]
    inside = [False] * len(parents)
    for element in range(len(parents)):
        inside[element] = element == region or (element > 0 and inside[parents[element]])
    return inside


def main_text(page: str | None, smooth: int = 1, strictness: float = 0.5, marked_strictness: float = 0.1, most_links: float = 0.4) -> str:
    """The main text of one page: its content blocks, each with single spaces, joined by one space.

    Where the page marks its article, only blocks in it compete and the threshold
    is low (``marked_strictness``); elsewhere paths compete over the whole body.
    """
    if not page:
        return ""
    reader = Reader(page)
    hinted = {i for (_, _, hint), i in reader.paths.items() if hint}
    parent = {i: up for (up, _, _), i in reader.paths.items()}
    for i in sorted(parent):  # a path below a hint is hinted as well
        if parent[i] in hinted:
            hinted.add(i)
    found = []
    for block in reader.blocks:
        block.text = _SPACE.sub(" ", "".join(block.parts)).strip()
        if block.text:
            found.append(block)
    marked = [b for b in found if b.article]
    found = marked or [b for b in found if not _LEGAL.match(b.text)]
    if not found:
        return ""
    scores = ratios(found, smooth)
    values = [f for f, _, _ in scores.values()]
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((f - mean) ** 2 for f in values) / len(values))
    strict = strictness * spread
    least = marked_strictness * spread if marked else strict
    chosen = {path for path, (f, _, marks) in scores.items() if f > 0 and (f >= strict and marks >= 1 if path in hinted else f >= least)}
    held: dict[int, int] = {}
    for b in found:
        if b.path in chosen:
            held[b.element] = held.get(b.element, 0) + len(b.text)
    inside = region_of(reader.parents, held) if held else []
    keep = [False] * len(found)
    follows = False  # is the next text kept?
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        rescued = bool(inside) and inside[b.element] and b.path not in hinted and scores[b.path][1] <= most_links and b.link <= most_links * len(b.text)
        if b.tag in HEADINGS:
            keep[i] = b.path not in hinted and ((follows and (not inside or inside[b.element] or b.tag == "h1" or b.path in chosen)) or bool(marked and b.tag == "h1"))
        else:
            keep[i] = follows = b.path in chosen or rescued
    if not any(keep):  # nothing but headings
        keep = [b.path in chosen for b in found]
    return " ".join(b.text for b, ok in zip(found, keep, strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`").cast("string").alias("__html"))
    schema = T.StructType([rows.schema[0], rows.schema[1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_rows(rows, run, schema)
