"""Pages as rows: a small reader makes one row of each element; everything else works on those rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template"}
ASIDE = {"nav", "footer"}
#: An opening tag closes an open one of these, unless one of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "blockquote", "form", "main", "nav", "footer", "header"}

ELEMENT = (
    "struct<node:int,end:int,parent:int,depth:int,tag:string,attrs:map<string,string>,children:array<string>,inner:array<string>,"
    "low:int,high:int,aside:boolean,roled:boolean,above:array<int>>"
)
ELEMENT_FIELDS = ["node", "end", "parent", "depth", "tag", "attrs", "children", "inner", "low", "high", "aside", "roled", "above"]
_NODE, _END, _TAG, _ATTRS, _CHILDREN, _INNER, _LOW, _HIGH = (ELEMENT_FIELDS.index(k) for k in ("node", "end", "tag", "attrs", "children", "inner", "low", "high"))
LISTS = {"li", "ul", "ol"}
WALLS = {"body", "main", "html"}
CHROME_ROLES = {"navigation", "contentinfo", "banner"}
CLIMB = 5
ELEMENTS_A_FRAME = 5_000
#: Longer pages are cut in parts before their elements become rows.
PIECES_A_PART = 64
#: Pages are dealt to tasks of about so many bytes of HTML before they are read: a file that packs many pages is one task otherwise.
BYTES_A_TASK = 2 << 20
#: Elements whose content HTMLParser reads, or may read in later versions, in a way of its own.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}
_PLAIN_START, _PLAIN_END = re.compile("<([a-zA-Z][a-zA-Z0-9]*)>"), re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")
PIECE = "struct<text:string,aside:boolean,item:int>"


class _Reader(HTMLParser):
    """Builds the element rows and the pieces of text; unclosed elements end with what they stand in.

    An element knows which pieces stand inside it by their numbers (low to high), so a piece is kept once, however deep. A row
    is a list in the order of ELEMENT_FIELDS. Tags without attributes are told here, all others by HTMLParser.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.pieces: list[tuple[str, bool, int]] = []
        self.open: list[list] = []
        self.names: Counter = Counter()  # open elements by tag
        self.roles = self.asides = self.silent = 0  # open elements with a role of site furniture, of ASIDE, of SILENT
        self.items: list[int] = []  # the list item that text belongs to; -1 in a list outside its items
        self.climbs: list[list[int]] = [[]]  # what is above an element, by the number of those open

    def updatepos(self, i, j):
        return j  # lines are not counted

    def parse_starttag(self, i):
        if (found := _PLAIN_START.match(self.rawdata, i)) and (tag := found[1].lower()) not in RAW:
            self.handle_starttag(tag, ())
            return found.end()
        return super().parse_starttag(i)

    def parse_endtag(self, i):
        if not self.cdata_elem and (found := _PLAIN_END.match(self.rawdata, i)):
            self.handle_endtag(found[1].lower())
            return found.end()
        return super().parse_endtag(i)

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            row = self.open.pop()
            self.climbs.pop()
            tag = row[_TAG]
            row[_END], row[_HIGH] = len(self.rows) - 1, len(self.pieces)
            self.names[tag] -= 1
            self.roles -= row[_ATTRS].get("role") in CHROME_ROLES
            if tag in ASIDE:
                self.asides -= 1
            elif tag in SILENT:
                self.silent -= 1
            elif tag in LISTS:
                self.items.pop()
            if self.open and row[_INNER]:
                self.open[-1][_INNER] |= row[_INNER]

    def _close_tag(self, tags: set, stop: set) -> None:
        if not any([self.names[t] for t in tags]):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][_TAG] in tags:
                return self._close(i)
            if self.open[i][_TAG] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._close_tag(*CLOSES[tag])
        elif tag in ENDS_P and self.names["p"]:
            self._close_tag({"p"}, {"td", "th", "li", "div", "body"})
        node, pieces, parent, above = len(self.rows), len(self.pieces), -1, self.climbs[-1]
        if self.open:
            up = self.open[-1]
            parent = up[_NODE]
            if up[_CHILDREN]:
                up[_CHILDREN].add(tag)
                up[_INNER].add(tag)
            else:
                up[_CHILDREN], up[_INNER] = {tag}, {tag}
        attrs = {k: v or "" for k, v in attrs}
        row = [node, node, parent, len(self.open), tag, attrs, (), (), pieces, pieces, self.asides > 0, self.roles > 0, above]
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)
            self.climbs.append([] if tag in WALLS else [node, *above[: CLIMB - 1]])
            self.names[tag] += 1
            self.roles += attrs.get("role") in CHROME_ROLES
            if tag in ASIDE:
                self.asides += 1
            elif tag in SILENT:
                self.silent += 1
            elif tag in LISTS:
                self.items.append(node if tag == "li" else -1)

    def handle_endtag(self, tag):
        if self.names[tag]:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][_TAG] == tag:
                    return self._close(i)

    def handle_data(self, data):
        if not self.silent and (text := " ".join(data.split())):
            self.pieces.append((text, self.asides > 0, self.items[-1] if self.items else -1))


@dataclass
class Page:
    """Elements of a page in document order (lists of ELEMENT_FIELDS, see ``nodes_of``), and its pieces of text: (text, in nav or
    footer, list item)."""

    elements: list[list]
    pieces: list[tuple[str, bool, int]]

    @property
    def rows(self) -> list[dict]:
        """The elements, a dict for each."""
        return [dict(zip(ELEMENT_FIELDS, x)) for x in self.elements]


def read_page(html: str | None) -> Page:
    """One page, read to its end; a null page has no elements."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close(0)
    for row in reader.rows:
        if row[_CHILDREN]:
            row[_CHILDREN], row[_INNER] = sorted(row[_CHILDREN]), sorted(row[_INNER])
    return Page(reader.rows, reader.pieces)


def _parts(page: Page) -> Iterator[Page]:
    """A long page in parts: elements that hold about as many pieces, with the pieces from the first to the last of them.

    What makes a row of each element copies its part's pieces to it, so a part is little longer than the text of its elements.
    Elements are grouped by how many pieces they hold, in steps of two; a part ends beyond twice as many pieces or at four times
    as many elements, so that what the parts of a group keep is within a few times its pieces and elements, on deep pages too.
    """
    if len(page.pieces) <= PIECES_A_PART and len(page.elements) <= 4 * PIECES_A_PART:
        yield page
        return
    groups: dict[int, list[list]] = {}
    for row in page.elements:
        most = PIECES_A_PART << max(0, (row[_HIGH] - row[_LOW] - 1) // PIECES_A_PART).bit_length()
        groups.setdefault(most, []).append(row)
    for most, rows in groups.items():
        first, low, high = 0, rows[0][_LOW], 0
        for i, row in enumerate([*rows, None]):
            if row is None or row[_HIGH] - low > 2 * most or i - first >= 4 * most:
                for x in rows[first:i]:
                    x[_LOW], x[_HIGH] = x[_LOW] - low, x[_HIGH] - low
                yield Page(rows[first:i], page.pieces[low:high])
                if row is None:
                    break
                first, low, high = i, row[_LOW], 0
            high = max(high, row[_HIGH])


def _offsets(lists: Iterable) -> pa.Array:
    return pa.array(accumulate(map(len, lists), initial=0), pa.int32())


def _joined(lists: Iterable, kind: pa.DataType) -> pa.Array:
    return pa.array(list(chain.from_iterable(lists)), kind)


def _structs(fields: dict[str, pa.Array]) -> pa.Array:
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def _columns(rows: list, fields: list) -> dict[str, tuple]:
    return dict(zip(fields, zip(*rows))) if rows else dict.fromkeys(fields, ())


def _arrow_pages(found: list[Page]) -> tuple[pa.Array, pa.Array]:
    """The columns elements and pieces of ``parse_pages``, a field at a time."""
    of = _columns([x for p in found for x in p.elements], ELEMENT_FIELDS)
    kinds = dict.fromkeys(("node", "end", "parent", "depth", "low", "high"), pa.int32()) | {"tag": pa.string(), "aside": pa.bool_(), "roled": pa.bool_()}
    plain = {k: pa.array(of[k], kind) for k, kind in kinds.items()}
    plain["attrs"] = pa.MapArray.from_arrays(_offsets(of["attrs"]), _joined(of["attrs"], pa.string()), _joined(map(dict.values, of["attrs"]), pa.string()))
    for k, kind in (("children", pa.string()), ("inner", pa.string()), ("above", pa.int32())):
        plain[k] = pa.ListArray.from_arrays(_offsets(of[k]), _joined(of[k], kind))
    elements = _structs({k: plain[k] for k in ELEMENT_FIELDS})
    kinds = {"text": pa.string(), "aside": pa.bool_(), "item": pa.int32()}
    told = _columns([x for p in found for x in p.pieces], list(kinds))
    texts = _structs({k: pa.array(told[k], kind) for k, kind in kinds.items()})
    return pa.ListArray.from_arrays(_offsets([p.elements for p in found]), elements), pa.ListArray.from_arrays(_offsets([p.pieces for p in found]), texts)


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", whole: bool = False) -> DataFrame:
    """``(id, elements, pieces)``, a row for each page: its elements in document order and its pieces of text. Unless ``whole``,
    a page of more than PIECES_A_PART pieces (or four times as many elements) gives several rows, of some of its elements each and the pieces that they need.

    This is what to keep when a page is used more than once; ``nodes_of`` makes rows of it. Null pages and pages without
    elements give no rows. Pages are read to their end; ``usable_pages`` cuts those that a fetch would have cut. The bytes of
    all pages are summed first, and the pages dealt to a task for every BYTES_A_TASK of them.
    """

    def frame(ids: pa.Array, at: list[int], found: list[Page]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *_arrow_pages(found)], [id_col, "elements", "pieces"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, at, ready = batch.column(0), [], [], 0
            for i, text in enumerate(batch.column(1)):
                page = read_page(text.as_py())
                for part in ([page] if whole else _parts(page)) if page.elements else ():
                    at.append(i)
                    found.append(part)
                    ready += len(part.elements)
                    if ready >= ELEMENTS_A_FRAME:
                        yield frame(ids, at, found)
                        found, at, ready = [], [], 0
            if found:
                yield frame(ids, at, found)

    kind = pages.schema[id_col].dataType.simpleString()
    total = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    dealt = pages.select(id_col, html_col).repartition(max(1, math.ceil(total / BYTES_A_TASK)), id_col, html_col)
    return dealt.mapInArrow(read, f"{id_col} {kind}, elements array<{ELEMENT}>, pieces array<{PIECE}>")


def nodes_of(parsed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``(id, node, end, parent, depth, tag, attrs, children, inner, aside, roled, above, lines, loud, own)``, a row for each element.

    Elements are numbered in document order; those inside one have numbers up to its ``end``. children and inner: the
    tags right below and anywhere below; lines: the pieces of text inside (loud: those not in nav or footer; own, for
    list items: those not in a nested list). aside and roled: it stands inside nav or footer, or inside an element with a
    role of site furniture. above: the nearest elements around it, at most CLIMB, none from main or body on. The last three are cut
    out of the pieces of its part of the page only where they are used.
    """
    e = F.col("e")
    inside = F.slice("pieces", e["low"] + 1, e["high"] - e["low"])
    texts = lambda pieces: F.transform(pieces, lambda p: p["text"])
    rows = parsed.select(id_col, "pieces", F.explode("elements").alias("e"))
    return rows.select(
        id_col, *[e[c].alias(c) for c in ("node", "end", "parent", "depth", "tag", "attrs", "children", "inner", "aside", "roled", "above")], texts(inside).alias("lines"),
        texts(F.filter(inside, lambda p: ~p["aside"])).alias("loud"),
        F.when(e["tag"] == "li", texts(F.filter(inside, lambda p: p["item"] == e["node"]))).otherwise(F.array().cast("array<string>")).alias("own"),
    )


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The element rows of pages: ``nodes_of(parse_pages(pages))``."""
    return nodes_of(parse_pages(pages, id_col, html_col), id_col)


def page_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, text)``: a page's visible text, a line for each piece."""
    parsed = parse_pages(pages, id_col, html_col, whole=True)
    return parsed.select(id_col, F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("text"))


def attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))
