"""HTML pages as ordered blocks. A page is read whole by the standard library's parser inside the task that holds it."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from inkspark.sources.tables import parts

#: Elements that make blocks, with their kinds, and elements whose content is left out.
KINDS = {
    **{f"h{n}": "HEADING" for n in range(1, 7)}, "p": "PARAGRAPH", "li": "LIST_ITEM", "blockquote": "QUOTE", "pre": "CODE", "table": "TABLE",
    "figcaption": "CAPTION", "math": "FORMULA", "svg": "FIGURE", "img": "FIGURE",
}
LEFT_OUT = {"script", "style", "head", "template", "noscript"}
#: Tokens of pages that hold only text and tags as they mostly are, of elements whose content is markup: lower case, attributes in quotes.
TOKEN = re.compile(r"""([^<]+)|</([a-z][a-z0-9]*)>|<([a-z][a-z0-9]*)((?: [a-z]+=(?:'[^'"<>&]*'|"[^'"<>&]*"))*)>|(<)""")
ATTRIBUTE = re.compile(r"""([a-z]+)=['"]([^'"]*)['"]""")
ORDINARY = frozenset(KINDS) - {"math", "svg"} | set("a article aside b body br code div em footer header html i li main nav ol section small span strong sub sup tbody td tfoot th thead tr u ul".split())
SCHEMA = "ordinal int, kind string, text string, level int, flattened boolean"


def fed(make, html: str) -> HTMLParser:
    """``make()`` after all events of a page. If it holds only ordinary tags, they come from one regular expression, or else from
    the standard library's parser, with a new start."""
    parser = make()
    if "&" not in html or html[-1] == ">":
        for text, end, tag, attributes, other in TOKEN.findall(html):
            if text:
                parser.handle_data(unescape(text) if "&" in text else text)
            elif end in ORDINARY:
                parser.handle_endtag(end)
            elif tag in ORDINARY:
                parser.handle_starttag(tag, ATTRIBUTE.findall(attributes) if attributes else [])
            else:
                parser = make()
                break
        else:
            return parser
    parser.feed(html)
    parser.close()
    return parser


class Blocks(HTMLParser):
    """Collects (kind, text, level, flattened). Inside a list item, quote or table, paragraphs are part of it; table
    cells are joined by tabs and rows by line feeds, and spans over rows or columns mark the table as flattened."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.text, self.hidden, self.depth, self.flattened, self.footnote = [], None, [], 0, 0, False, 0

    def close_block(self) -> None:
        if self.open:
            kind, level = self.open
            whole = "".join(self.text)
            if kind == "TABLE":
                whole = "\n".join("\t".join(" ".join(c.split()) for c in r.split("\x1f") if c) for r in whole.split("\x1e") if r.strip("\x1f \n\t"))
            elif kind != "CODE":
                whole = " ".join(whole.split())
            if whole or kind in ("FIGURE",):
                self.found.append(("FOOTNOTE" if self.footnote and kind == "PARAGRAPH" else kind, whole, level, self.flattened))
        self.open, self.text, self.flattened = None, [], False

    def handle_starttag(self, tag, attrs):
        given = dict(attrs) if attrs else {}
        if tag in LEFT_OUT:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag in ("aside", "section") and given.get("epub:type", given.get("role", "")) in ("footnote", "doc-footnote"):
            self.footnote += 1
        elif tag in ("td", "th") and self.open and self.open[0] == "TABLE":
            self.text.append("\x1f")
            self.flattened |= any(given.get(x, "1") not in ("", "1") for x in ("rowspan", "colspan"))
        elif tag == "tr" and self.open and self.open[0] == "TABLE":
            self.text.append("\x1e")
        elif tag == "br":
            self.text.append("\n" if self.open and self.open[0] == "CODE" else " ")
        elif tag in KINDS:
            if self.open and self.open[0] in ("LIST_ITEM", "QUOTE", "TABLE") and tag not in ("li", "table") and not (self.open[0] == "LIST_ITEM" and tag[0] == "h"):
                self.text.append(" ")
                return
            self.close_block()
            self.open = (KINDS[tag], int(tag[1]) if KINDS[tag] == "HEADING" else None)
            if tag == "img":
                self.text.append(given.get("alt") or "")
                self.close_block()

    def handle_endtag(self, tag):
        if tag in LEFT_OUT:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("aside", "section"):
            self.close_block()
            self.footnote = max(0, self.footnote - 1)
        elif self.open and KINDS.get(tag) == self.open[0]:
            self.close_block()

    def handle_data(self, data):
        if not self.hidden and self.open:
            self.text.append(data)


def page_blocks(html: str | None) -> list[tuple]:
    parser = fed(Blocks, html or "")
    parser.close_block()
    return parser.found


class Links(HTMLParser):
    """(depth, label, href) of the anchors in navigation lists, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.nav, self.depth, self.href, self.text = [], 0, 0, None, []

    def handle_starttag(self, tag, attrs):
        self.nav += tag == "nav"
        self.depth += tag in ("ol", "ul") and self.nav > 0
        if tag == "a" and self.nav:
            self.href, self.text = dict(attrs).get("href", ""), []

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append((min(max(self.depth - 1, 0), 64), " ".join("".join(self.text).split()), self.href))
            self.href = None
        self.nav = max(0, self.nav - (tag == "nav"))
        self.depth = max(0, self.depth - (tag in ("ol", "ul")))

    def handle_data(self, data):
        self.text.append(data)


def page_links(html: str | None) -> list[tuple]:
    return fed(Links, html or "").found


def exploded(pages: DataFrame, read, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """(page_id, ordinal, ...) for each tuple that ``read`` finds in a page."""

    def run(batches):
        for batch in parts(batches, "html"):
            owner, ordinal, rows = [], [], []
            for i, html in enumerate(batch.column("html").to_pylist()):
                own = read(html)
                owner += [i] * len(own)
                ordinal += range(len(own))
                rows += own
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(owner, pa.int64())), pa.array(ordinal, pa.int32()), *columns], ["page_id", "ordinal", *names])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, {schema}")


def html_blocks(pages: DataFrame) -> DataFrame:
    return exploded(pages, page_blocks, ["kind", "text", "level", "flattened"], [pa.string(), pa.string(), pa.int32(), pa.bool_()], SCHEMA)


def navigation(pages: DataFrame) -> DataFrame:
    return exploded(pages, page_links, ["depth", "label", "href"], [pa.int32(), pa.string(), pa.string()], "ordinal int, depth int, label string, href string")
