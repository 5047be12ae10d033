"""A small tolerant HTML reader for use inside tasks: elements, text, and the tags that imply ends of others."""

from __future__ import annotations

import html
import re

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
START = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)

#: Fixed values of the HTML standard: elements whose content isn't markup, those without content, inline elements, and which open ones a start tag ends.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section table ul".split())


class Element:
    __slots__ = ("tag", "attributes", "parent", "children", "size")

    def __init__(self, tag: str, attributes: str, parent):
        self.tag, self.attributes, self.parent, self.children, self.size = tag, attributes, parent, [], 0

    def marks(self) -> dict[str, str]:
        """class, id, role, hidden, aria-hidden and style, lower-cased."""
        if not self.attributes:
            return {}
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(self.attributes)}


def tokens(source: str):
    """(end mark, tag, attributes) of each tag, and (None, text, "") of each text; comments and raw elements are left out.

    Every character is looked at a bounded number of times: after a quote that is never closed, tags end at the next
    ">" whatever is quoted, and after the last ">" there are no tags.
    """
    at, pattern, last = 0, TAG, source.rfind(">")
    while at < len(source):
        less = source.find("<", at)
        if less != at:
            yield None, source[at:] if less < 0 else source[at:less], ""
            if less < 0:
                return
        if source.startswith(("<!", "<?"), less):
            closing = "-->" if source.startswith("<!--", less) else ">"
            end = source.find(closing, less + len(closing))
            at = len(source) if end < 0 else end + len(closing)
            continue
        found = pattern.match(source, less) if less < last and START.match(source, less) else None
        if found is None and pattern is TAG and less < last and START.match(source, less):
            pattern = LOOSE
            found = pattern.match(source, less)
        if found is None:
            yield None, "<", ""
            at = less + 1
            continue
        mark, tag, attributes = found[1], found[2].lower(), found[3]
        at = found.end()
        if tag in RAW and not mark:
            end = re.compile(f"</{tag}\\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        else:
            yield mark, tag, attributes


def parse(source: str) -> Element:
    """The tree of a page; children are elements and strings (character references still in place)."""
    root = at = Element("#root", "", None)
    opened: dict[str, int] = {}

    def leave(to: Element) -> Element:
        """Closes all elements below ``to``."""
        up = at
        while up is not to:
            opened[up.tag] -= 1
            up = up.parent
        return to

    def nearest(wanted: set[str], stops: set[str]) -> Element:
        """Where to go on after the open elements of ``wanted`` below any of ``stops`` have ended."""
        up, found = at, None
        if any(opened.get(x) for x in wanted):
            while up is not root and up.tag not in stops:
                if up.tag in wanted:
                    found = up
                up = up.parent
        return leave(found.parent) if found is not None else at

    for mark, tag, attributes in tokens(source):
        if mark is None:
            at.children.append(tag)
        elif mark:
            up = at
            while opened.get(tag) and up.tag != tag:
                if up is root or tag in INLINE and up.tag not in INLINE:
                    break  # an inline end tag doesn't end blocks
                up = up.parent
            if opened.get(tag) and up.tag == tag:
                at = leave(up.parent)
        else:
            if tag in CLOSES_P:
                at = nearest({"p"}, {"table", "td", "th", "div", "article", "section", "body", "li", "blockquote", "main", "aside", "nav"})
            if tag in ENDS:
                at = nearest(*ENDS[tag])
            element = Element(tag, attributes, at)
            at.children.append(element)
            if tag not in VOID and not attributes.endswith("/"):
                at = element
                opened[tag] = opened.get(tag, 0) + 1
    return root


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())
