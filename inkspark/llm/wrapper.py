"""Main text of web pages by wrapper induction.

Pages of a host share a template, or a few of them, one for each kind of page. All pages count how many of them hold each
text at each path (the labels from the root on). A text that enough pages share, of those that have its path, may be a
template's; some pages that hold it are kept as trees, its references, so that each kind of page has its own. Every page
of the host that has the path is aligned with them by simple tree matching, and votes on whether the text aligned is the
same in both. Texts that stay the same are the wrapper's template, those that vary its slots. A page is then aligned
with its host's wrapper: what matches the template goes, what fills slots or matches nothing is content. Menus
and the like whose words vary from page to page are no template, so elements that say what they are (nav, footer,
class "ad" and so on) go by name, unless they hold most of the text; and where a page marks its article, only that is
taken, unless it holds little of the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from inkspark.llm.common import cut, read
from inkspark.llm.markup import INLINE, Element, clean, parse

#: Elements and words of class, id and role that name what isn't main text.
DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form head iframe input label map menu nav noembed noframes noscript object script "
    "select style svg template textarea title video xmp".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer login menu modal navbar nav navigation "
    "newsletter notice pagination popup promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags toolbar widget".split())
REMARKS = frozenset("comment comments disqus replies reply respond".split())
#: Words that a name may be joined with ("ad-slot", "post-comments") and still be that name.
BESIDE = frozenset(
    "area article bar bars block blog bottom box buttons container content entry form global group head header holder icons inner item items left link "
    "links list main mobile page panel post reader right row section side site slot small space sticky strip thread top unit user wrap wrapper zone".split())
WORDS = re.compile(r"[a-z]+")
WHOLE = frozenset({"article", "main"})


@dataclass(frozen=True)
class Settings:
    """A text that ``votes`` pages or more share with a page, and ``share`` of those that have its path, has
    ``references`` pages in its host's wrapper; it is template there if as many have it at its place, and ``share`` of those
    aligned there. Wrappers of up to ``small`` bytes in all may be broadcast; larger ones meet their pages in a shuffle."""

    references: int = 3
    votes: int = 3
    share: float = 0.5
    small: int = 32 << 20


def host_of(url):
    """The url's host and port in lower case; empty if it has none, or the url is null."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def says(name: str, words: frozenset) -> bool:
    """Whether a class, id or role is one of ``words``, alone or joined with words that don't change its meaning."""
    parts = [x for x in WORDS.findall(name) if len(x) > 1]
    return any(x in words for x in parts) and all(x in words or x in BESIDE for x in parts)


def dropped(element: Element, inside: bool, base: int) -> bool:
    """Whether an element isn't main text. One that holds over half of ``base`` characters isn't dropped by a name, but
    for readers' comments."""
    if element.tag in DROPPED or element.tag == "header" and not inside:
        return True
    if not element.attributes or element.tag in ("html", "body"):
        return False
    marks = element.marks()
    if "hidden" in marks or marks.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", marks.get("style", "")):
        return True
    if element.tag in WHOLE:
        return False
    names = [x for m in ("class", "id", "role") for x in marks.get(m, "").split()]
    if any(says(x, REMARKS) for x in names):
        return True
    return 2 * element.size <= base and (
        any(says(x, NAMES) for x in names) or marks.get("role") in ("complementary", "contentinfo", "search", "banner", "navigation", "alert"))


def measured(root: Element) -> None:
    """Sets each element's size: the characters of its text without white space at the ends, but for scripts and the like."""
    order = [root]
    for element in order:
        order.extend(c for c in element.children if not isinstance(c, str) and c.tag not in DROPPED)
    for element in reversed(order):
        element.size += sum(len(c.strip()) for c in element.children if isinstance(c, str))
        if element.parent is not None:
            element.parent.size += element.size


@dataclass
class Tree:
    """A page's content tree. Leaves are blocks of text; ``block`` is a node's place among them, or -1."""

    label: list[int]
    children: list[list[int]]
    block: list[int]
    texts: list[str]


def tree_of(source: str) -> Tree:
    """What is left of a page without the elements that go by name; only its articles, if they hold most of the text."""
    root = parse(source)
    measured(root)
    articles, base = main_parts(root)
    tree = Tree([], [], [], [])

    def node(label: str, block: int = -1) -> int:
        tree.label.append(zlib.crc32(label.encode("utf-8", "replace")))
        tree.children.append([])
        tree.block.append(block)
        return len(tree.label) - 1

    def add(text: list[str], parent: int, name: str) -> None:
        whole = clean("".join(text))
        text.clear()
        if whole:
            tree.children[parent].append(node("#" + name, len(tree.texts)))
            tree.texts.append(whole)

    def walk(element: Element, parent: int, text: list[str], name: str, inside: bool) -> None:
        """Appends inline text to ``text``; a block's start and end close what came before."""
        stack = [(iter(element.children), parent, name, None)]
        while stack:
            children, own, label, closing = stack[-1]
            for child in children:
                if isinstance(child, str):
                    text.append(child)
                elif child.tag in ("br", "hr", "img", "wbr"):
                    text.append("" if child.tag == "wbr" else " ")
                elif not dropped(child, inside, base):
                    if child.tag in INLINE:
                        stack.append((iter(child.children), own, label, None))
                    else:
                        add(text, own, label)
                        made = node(child.tag + "." + child.marks().get("class", ""))
                        tree.children[own].append(made)
                        stack.append((iter(child.children), made, child.tag, made))
                    break
                elif child.tag not in INLINE:
                    add(text, own, label)
            else:
                stack.pop()
                if closing is not None:
                    add(text, own, label)

    top, text = node("#root"), []
    for article in articles or [root]:
        walk(article, top, text, article.tag, bool(articles))
        add(text, top, article.tag)
    return tree


def main_parts(root: Element) -> tuple[list[Element], int]:
    """(the article elements, or else the main elements; the size that names are weighed against).

    They are the outermost ones, and all of them. They count if they hold a quarter of the text that names leave.
    """
    found: dict[str, list[Element]] = {"article": [], "main": []}
    for kind, own in found.items():
        todo = [root]
        while todo:
            element = todo.pop()
            if element.tag == kind:
                own.append(element)
            else:
                todo.extend(c for c in reversed(element.children) if not isinstance(c, str) and not dropped(c, True, root.size))
    left, todo = 0, [root]
    while todo:
        element = todo.pop()
        left += sum(len(c.strip()) for c in element.children if isinstance(c, str))
        todo.extend(c for c in element.children if not isinstance(c, str) and not dropped(c, False, root.size))
    for own in found.values():
        held = sum(x.size for x in own)
        if own and 4 * held >= left:
            return own, held
    return [], root.size


def text_hash(text: str) -> int:
    """A signed 64-bit hash, never 0."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) or 1


class Shapes:
    """Numbers for the shapes of subtrees (labels alone), and how many nodes of two shapes match.

    Pages of a host are made of few shapes, so that most pairs are known from other pages.
    """

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.label: list[int] = []
        self.children: list[tuple[int, ...]] = []
        self.count: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def of(self, tree: Tree) -> list[int]:
        """The shape of each node; children come after their parents."""
        out = [0] * len(tree.label)
        for i in range(len(out) - 1, -1, -1):
            key = tree.label[i], tuple(out[c] for c in tree.children[i])
            if key not in self.number:
                self.number[key] = len(self.label)
                self.label.append(key[0])
                self.children.append(key[1])
                self.count.append(1 + sum(self.count[c] for c in key[1]))
            out[i] = self.number[key]
        return out

    def direct(self, a: int, b: int) -> int | None:
        """The size of two shapes, if it is known or needs no alignment."""
        if self.label[a] != self.label[b]:
            return 0
        if a == b:
            return self.count[a]
        return self.known.get((a, b)) if self.children[a] and self.children[b] else 1

    def size(self, one: int, two: int) -> int:
        """Nodes that match below and with two shapes' roots; 0 if their labels differ."""
        value = self.direct(one, two)
        if value is not None:
            return value
        stack = [(one, two, self.below(one, two))]
        while stack:
            a, b, alignment = stack[-1]
            try:
                x, y = alignment.send(value)
            except StopIteration as end:
                stack.pop()
                value = end.value
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[a, b] = value
            else:
                stack.append((x, y, self.below(x, y)))
                value = None
        return value

    def below(self, a: int, b: int):
        """Gives the size of two shapes with one label; asks for those of their children. It holds a row of the alignment and few
        rows of weights, however wide both are."""
        left, right = self.children[a], self.children[b]
        start, end = ends(left, right)
        total = 1 + sum(self.count[x] for x in left[:start] + left[len(left) - end :])
        left, right = left[start : len(left) - end], right[start : len(right) - end]
        if not left or not right:
            return total
        place = {y: k for k, y in enumerate(dict.fromkeys(right))}
        column, weights = np.array([place[y] for y in right]), {}
        best = np.zeros(len(right) + 1, np.int64)
        for x in left:
            if x not in weights:
                own = []
                for y in place:
                    n = self.direct(x, y)
                    own.append((yield x, y) if n is None else n)
                if (len(weights) + 1) * len(place) > UNLIKE:
                    weights.clear()
                weights[x] = np.array(own, np.int64)
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weights[x][column]))
        return total + int(best[-1])


#: Of hashes of paths.
FACTOR = 0x9E3779B97F4A7C15
#: Pairs of children whose table is kept whole, weights of different pairs that are kept in a list of children, sizes that are kept in all.
PAIRS, UNLIKE, KNOWN = 4_000_000, 1_000_000, 500_000


def ends(one, two) -> tuple[int, int]:
    """How many numbers two lists have in common at the start, and of the rest at the end. A heaviest alignment has them, as
    nothing weighs more with a number than itself."""
    n, m, start, end = len(one), len(two), 0, 0
    while start < min(n, m) and one[start] == two[start]:
        start += 1
    while end < min(n, m) - start and one[n - 1 - end] == two[m - 1 - end]:
        end += 1
    return start, end


def scores(one, two, weigh) -> np.ndarray:
    """The weight of the heaviest alignment of ``one`` with each start of ``two``, none at first."""
    best = np.zeros(len(two) + 1, np.int64)
    for x in one:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weigh(x)[two]))
    return best


def aligned(one: list[int], two: list[int], weigh) -> list[tuple[int, int]]:
    """Places matched in the heaviest alignment in order of two lists of numbers; weigh gives a number's weights with all numbers.

    Where the table of all pairs would be large, ``one`` is halved, and ``two`` where the heaviest alignments of both halves
    meet, until it isn't: memory grows with the lists, time with their product.
    """
    start, end = ends(one, two)
    pairs = [(k, k) for k in range(start)] + [(len(one) - k, len(two) - k) for k in range(1, end + 1)]
    if start + end == min(len(one), len(two)):
        return pairs
    other, todo = np.array(two, np.int64), [(start, len(one) - end, start, len(two) - end)]
    while todo:
        low, high, first, last = todo.pop()
        if low == high or first == last:
            continue
        if high - low > 1 and (high - low) * (last - first) > PAIRS:
            middle = (low + high) // 2
            ahead, back = scores(one[low:middle], other[first:last], weigh), scores(one[middle:high][::-1], other[first:last][::-1], weigh)
            meet = first + int(np.argmax(ahead + back[::-1]))
            todo += [(low, middle, first, meet), (middle, high, meet, last)]
            continue
        weights = [weigh(x)[other[first:last]] for x in one[low:high]]
        best = np.zeros((high - low + 1, last - first + 1), np.int64)
        for i, own in enumerate(weights):
            np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + own), out=best[i + 1, 1:])
        p, q = high - low, last - first
        while p and q:
            own = weights[p - 1][q - 1]
            if own and best[p, q] == best[p - 1, q - 1] + own:
                p, q = p - 1, q - 1
                pairs.append((low + p, first + q))
            elif best[p, q] == best[p - 1, q]:
                p -= 1
            else:
                q -= 1
    return pairs


def paths_of(tree: Tree) -> list[int]:
    """A hash of the labels from the root to each node."""
    out = list(tree.label)
    for i, own in enumerate(tree.children):
        for c in own:
            out[c] = (out[i] * FACTOR + tree.label[c]) % (1 << 63)
    return out


@dataclass
class Numbered:
    """A tree with its nodes' shapes and the hashes of their texts (0 without one)."""

    tree: Tree
    hashes: list[int]
    shape: list[int]
    whole: list[int]


def numbered(tree: Tree, hashes: list[int], shapes: Shapes) -> Numbered:
    whole = [0] * len(hashes)
    for i in range(len(whole) - 1, -1, -1):
        whole[i] = hash((tree.label[i], hashes[i], tuple(whole[c] for c in tree.children[i])))
    return Numbered(tree, hashes, shapes.of(tree), whole)


class Weights:
    """Weights of a child, by its number, with all others: twice the nodes that match, and one for equal texts. Only those with
    the children in ``right`` mean anything; ``keys`` are the (shape, texts) of each number."""

    def __init__(self, keys: list[tuple[int, int]], right: list[int], shapes: Shapes):
        self.keys, self.right, self.shapes, self.there, self.rows = keys, right, shapes, None, {}

    def __call__(self, x: int) -> np.ndarray:
        if self.there is None:
            self.there = {shape: k for k, shape in enumerate(dict.fromkeys(self.keys[y][0] for y in self.right))}
            self.column = np.array([self.there.get(shape, 0) for shape, _ in self.keys])
        own = self.keys[x][0]
        if own not in self.rows:
            if (len(self.rows) + 1) * len(self.there) > UNLIKE:
                self.rows.clear()
            self.rows[own] = np.array([2 * self.shapes.size(own, shape) for shape in self.there], np.int64)
        row = self.rows[own][self.column]
        row[x] += 1
        return row


def match(a: Numbered, b: Numbered, shapes: Shapes) -> list[tuple[int, int]]:
    """Pairs of aligned nodes: simple tree matching, the largest set that keeps labels, order and parents.

    Of alignments of a list of children that are equally large, one with more children of equal texts is taken. Lists of any
    width are aligned as a whole.
    """
    if a.tree.label[0] != b.tree.label[0]:
        return []
    out, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        out.append((i, j))
        one, two = a.tree.children[i], b.tree.children[j]
        if not one or not two:
            continue
        # A child is known by its shape and texts.
        keys: dict[tuple[int, int], int] = {}
        left = [keys.setdefault((a.shape[x], a.whole[x]), len(keys)) for x in one]
        right = [keys.setdefault((b.shape[y], b.whole[y]), len(keys)) for y in two]
        todo.extend((one[x], two[y]) for x, y in aligned(left, right, Weights(list(keys), right, shapes)))
    return out


def packed(tree: Tree) -> list[int]:
    """A skeleton as numbers: label, parent and hash of the text (0 if none) for each node."""
    parent = [0] * len(tree.label)
    for i, own in enumerate(tree.children):
        for c in own:
            parent[c] = i
    return [x for row in zip(tree.label, parent, hashes_of(tree)) for x in row]


def hashes_of(tree: Tree) -> list[int]:
    return [text_hash(tree.texts[b]) if b >= 0 else 0 for b in tree.block]


def unpacked(numbers) -> tuple[Tree, list[int]]:
    n = len(numbers) // 3
    tree = Tree(list(numbers[0::3]), [[] for _ in range(n)], [-1] * n, [])
    for i in range(1, n):
        tree.children[numbers[3 * i + 1]].append(i)
    return tree, list(numbers[2::3])


class Hosts:
    """The numbered references of the hosts that a task met last, with the shapes they are made of."""

    def __init__(self, unpack):
        self.unpack, self.shapes, self.known = unpack, Shapes(), {}

    def of(self, host: str, references) -> list:
        if len(self.known) >= 64 or max(len(self.shapes.known), len(self.shapes.label)) >= KNOWN:
            self.shapes, self.known = Shapes(), {}
        if host not in self.known:
            self.known[host] = self.unpack(references.as_py(), self.shapes)
        return self.known[host]


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, page_id, skeleton, leaves) of each page; ``leaves`` are the different (path, text) of its texts, as hashes."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found, leaves = [], []
                for source in part.column("html").to_pylist():
                    tree = tree_of(source or "")
                    found.append(packed(tree))
                    leaves.append([{"path": p, "text": t} for p, t in dict.fromkeys((p, t) for p, t in zip(paths_of(tree), found[-1][2::3]) if t)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), part.column("page_id"), pa.array(found, pa.list_(pa.int64())),
                     pa.array(leaves, pa.list_(pa.struct([("path", pa.int64()), ("text", pa.int64())])))], ["host", "page_id", "skeleton", "leaves"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("host", "page_id", "html").mapInArrow(run, f"host string, page_id {kind}, skeleton array<long>, leaves array<struct<path:long,text:long>>")


def references_of(known: DataFrame, s: Settings) -> DataFrame:
    """(host, refs): the reference pages (h, skeleton, wanted), each with the (path, text) that it stands for.

    All pages of ``known`` (host, h, skeleton, leaves) count. Of a path no more texts have references than twice the texts
    that a page has there on average, so a host has as many references as it has kinds of pages, not as it has pages.
    """
    leaves = known.select("host", "h", F.explode("leaves").alias("x")).select("host", "h", "x.path", "x.text")
    held = leaves.groupBy("host", "path", "text").agg(F.count("*").alias("n")).where(F.col("n") > s.votes)
    there = known.select("host", F.explode(F.array_distinct("leaves.path")).alias("path")).groupBy("host", "path").agg(F.count("*").alias("all"))
    shared = cut(held.join(there, ["host", "path"]).where(F.col("n") - 1 >= s.share * (F.col("all") - 1)).select("host", "path", "text"))
    least = Window.partitionBy("host", "path", "text").orderBy("h")
    chosen = leaves.join(shared, ["host", "path", "text"]).withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= s.references)
    wanted = chosen.groupBy("host", "h").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("wanted"))
    return cut(known.join(wanted, ["host", "h"]).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("h", "skeleton", "wanted"))).alias("refs")))


def wrappers(pages: DataFrame, s: Settings) -> DataFrame:
    """(host, wrapper): the host's reference skeletons, with the nodes whose texts are the template's.

    Pages of a host that have equal skeletons, texts included, vote once. A text's voters are all pages that have its path,
    whether they hold the text or not. A hot host's pages are dealt over the tasks by their skeletons; only the votes, a
    number for each reference's text, meet.
    """
    known = cut(skeletons(pages.where("host <> ''")).where(F.size("skeleton") > 3)
                .withColumn("h", F.xxhash64("skeleton")).groupBy("host", "h").agg(F.first("skeleton").alias("skeleton"), F.first("leaves").alias("leaves")))
    references = references_of(known, s)
    met = known.join(F.broadcast(references) if size_of(references, "refs") <= s.small else references, "host")

    def unpack(refs, shapes: Shapes) -> list:
        out = []
        for ref in refs:
            own, wanted = numbered(*unpacked(ref["skeleton"]), shapes), {(x["path"], x["text"]) for x in ref["wanted"]}
            nodes = {i for i, key in enumerate(zip(paths_of(own.tree), own.hashes)) if key in wanted}
            out.append((ref["h"], own, nodes, {path for path, _ in wanted}))
        return out

    def run(batches):
        hosts = Hosts(unpack)
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for i, host in enumerate(batch.column("host").to_pylist()):
                references = hosts.of(host, batch.column("refs")[i])
                own = numbered(*unpacked(batch.column("skeleton")[i].values.to_numpy().tolist()), hosts.shapes)
                h, paths = batch.column("h")[i].as_py(), set(paths_of(own.tree))
                for ref, other, nodes, wanted in references:
                    if ref == h or paths.isdisjoint(wanted):
                        continue
                    for x, y in match(other, own, hosts.shapes):
                        if x in nodes:
                            votes = sums.setdefault((host, ref, x), [0, 0])
                            votes[0] += 1
                            votes[1] += other.hashes[x] == own.hashes[y]
            rows = [(*k, *v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["host", "ref", "node", "n", "same"])

    votes = met.select("host", "h", "skeleton", "refs").mapInArrow(run, "host string, ref long, node int, n long, same long").groupBy("host", "ref", "node").agg(
        F.sum("n").alias("n"), F.sum("same").alias("same")).where((F.col("same") >= s.votes) & (F.col("same") >= s.share * F.col("n")))
    fixed = votes.groupBy("host", "ref").agg(F.sort_array(F.collect_list("node")).alias("fixed"))
    one = references.select("host", F.explode("refs").alias("r")).select("host", F.col("r.h").alias("ref"), F.col("r.skeleton").alias("skeleton"))
    return one.join(fixed, ["host", "ref"]).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("skeleton", "fixed"))).alias("wrapper"))


def size_of(rows: DataFrame, skeletons: str) -> int:
    """Bytes of all skeletons of a column of arrays of structs."""
    held = F.aggregate(skeletons, F.lit(0).cast("long"), lambda n, x: n + F.size(x["skeleton"]))
    return rows.agg(F.coalesce(F.sum(8 * held), F.lit(0))).first()[0]


def extract(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All columns of ``pages`` (page_id, url, html and any more) but html, with ``text`` and ``n_chars``.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined in page order
    by one space. A null or empty html gives an empty text. Pages whose url is null or has no host, and hosts with few
    pages, have no template: for them only elements that go by name do. Very long, wide or deeply nested pages and
    broken markup are taken whole, in time linear in their length but for alignments: memory is bounded there, and time grows
    with the product of the children of two unlike lists. Repeated rows give equal results; columns named like an output are
    replaced; an empty table gives an empty result.
    """
    pages = pages.drop("text", "n_chars", "host", "wrapper").withColumn("host", host_of(F.col("url")))
    found = cut(wrappers(pages, s))
    n = size_of(found, "wrapper")
    # Beyond the bound the wrappers meet the pages by host in a shuffle instead.
    joined = pages.join(F.broadcast(found) if n <= s.small else found, "host", "left") if n else pages.withColumn(
        "wrapper", F.lit(None).cast("array<struct<skeleton:array<bigint>,fixed:array<int>>>"))

    def unpack(wrapper, shapes: Shapes) -> list:
        out = []
        for w in wrapper:
            own = numbered(*unpacked(w["skeleton"]), shapes)
            paths = paths_of(own.tree)
            out.append((own, set(w["fixed"]), {paths[x] for x in w["fixed"]}))
        return out

    def run(batches):
        hosts = Hosts(unpack)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = []
                for i, source in enumerate(part.column("html").to_pylist()):
                    tree, gone, wrapper = tree_of(source or ""), set(), part.column("wrapper")[i]
                    if wrapper.is_valid:
                        references = hosts.of(part.column("host")[i].as_py(), wrapper)
                        own, paths = numbered(tree, hashes_of(tree), hosts.shapes), set(paths_of(tree))
                        for other, fixed, there in references:
                            if paths.isdisjoint(there):
                                continue
                            gone |= {tree.block[y] for x, y in match(other, own, hosts.shapes) if x in fixed and other.hashes[x] == own.hashes[y]}
                    texts.append(" ".join(t for k, t in enumerate(tree.texts) if k not in gone))
                keep = [c for c in part.schema.names if c not in ("html", "wrapper", "host")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keep, "text", "n_chars"])

    others = [c for c in joined.columns if c not in ("html", "wrapper", "host")]
    schema = StructType([*(joined.schema[c] for c in others), StructField("text", StringType()), StructField("n_chars", LongType())])
    return joined.mapInArrow(run, schema)


def op6_html_text(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
