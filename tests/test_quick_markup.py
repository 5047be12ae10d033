"""The short way for ordinary tags gives what the standard library's parser gives."""

import random
from html.parser import HTMLParser

from inkspark.sources import markup


def seen(html, quick):
    class Events(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found = []

        def handle_starttag(self, tag, attrs):
            self.found.append(("start", tag, attrs))

        def handle_endtag(self, tag):
            self.found.append(("end", tag))

        def handle_data(self, data):
            self.found.append(("data", data))

    if quick:
        return markup.fed(Events, html).found
    parser = Events()
    parser.feed(html)
    parser.close()
    return parser.found


def test_same_events_as_the_standard_parser():
    rng = random.Random(3)
    parts = ["<td>", "<td colspan='2'>", '<td colspan="2" rowspan=\'\'>', "<TD>", "<td >", "<td x>", "<td/>", "</td>", "</td >", "</TD>", "</>", "<", ">", "&amp;", "& ", "a b", "\n", "<script>", "</script>", "<style>", "</style>", "<title>", "</title>",
             "<textarea>", "</textarea>", "<!-- x", "-->", "<a href='x&amp;y'>", '<a href="q">', "</a>", "<b", "<img alt='x'/>", "<p title='a>b'>", "<h1>", "</h1", "<br>", "'", '"', "<td a='1'b='2'>", "<td a='1'  b='2'>", "<plaintext>", "<noscript>"]
    for _ in range(3000):
        html = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert seen(html, True) == seen(html, False), html
    plain = [x for x in parts if x[0] != "<" or x in ("<td>", "<td colspan='2'>", "</td>", "<br>", "<h1>", "</a>", '<a href="q">')]
    for _ in range(1000):
        html = "".join(rng.choices(plain, k=rng.randrange(1, 14)))
        assert seen(html, True) == seen(html, False), html


def test_ordinary_pages_take_the_short_way():
    class Fed(HTMLParser):
        def feed(self, data):
            raise AssertionError("the long way")

    markup.fed(Fed, "<table><tr><td colspan='2'>1 &amp; 2</td><td> <b>2</b></td></tr></table>")
