"""Books: zipped packages of chapters, as a data source that reads and writes folders of them.

``spark.read.format("books").load(folder)`` lists the folder's archives in the driver, by name and size alone, and deals them to
tasks by size; a task opens one archive at a time, within ``archives.problem``'s limits, and follows container, package,
manifest and spine. A book that breaks them is one row with its error; no other book is affected.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from inkspark.sources.archives import problem
from inkspark.sources.markup import page_blocks, page_links

SCHEMA = "book string, error string, warnings array<string>, title string, language string, spine int, href string, ordinal int, kind string, text string, level int"
LINKS = "book string, error string, source string, ordinal int, depth int, label string, href string"
#: Bytes of archives to a task, and of one archive's longest entry.
SHARE, LONGEST = 64_000_000, 16_000_000
# Media types of the format.
BOOK, PACKAGE, NCX, SVG = "application/epub+zip", "application/oebps-package+xml", "application/x-dtbncx+xml", "image/svg+xml"
CONTENT = {"", "application/xhtml+xml", "text/html", "application/html+xml", SVG}


class Broken(Exception):
    """Why a book can't be read; its only argument is a code."""


@dataclass
class Item:
    href: str
    path: str | None
    media: str
    properties: list[str]
    fallback: str | None


def local(element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def named(root, name: str) -> list:
    return [e for e in root.iter() if local(e) == name]


def resolved(base: str, href: str) -> str:
    """The path inside the archive that ``href`` means beside ``base``; it may not leave the archive."""
    path = unquote(urlsplit(href).path)
    whole = posixpath.normpath(posixpath.join(posixpath.dirname(base), path)) if path else base
    if whole.startswith(("/", "../")) or whole == ".." or "\\" in whole:
        raise Broken("PATH")
    return whole


class Book:
    """An opened archive: ``items`` by id, ``spine`` as (item, linear), and what the package says of itself."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, EOFError, OSError) as error:
            raise Broken("CORRUPT") from error
        infos = self.zip.infolist()
        bad = problem(self.zip, len(content))
        if bad or len({x.filename for x in infos}) < len(infos):
            raise Broken(bad or "CORRUPT")
        if any(x.file_size > LONGEST for x in infos):
            raise Broken("BYTES")
        if any(x.flag_bits & 1 for x in infos):
            raise Broken("ENCRYPTED")
        self.names = {x.filename for x in infos}
        first = min(infos, key=lambda x: x.header_offset, default=None)
        # The media type is the first entry, stored as it is, so that no other archive passes for a book.
        if first is None or first.filename != "mimetype" or first.compress_type != zipfile.ZIP_STORED or self.read("mimetype") != BOOK.encode():
            raise Broken("MIMETYPE")
        self.package_path = self.find_package()
        self.package = self.xml(self.package_path)
        if local(self.package) != "package":
            raise Broken("PACKAGE")
        self.items, self.spine = self.manifest(), []
        self.read_spine()
        if "META-INF/encryption.xml" in self.names:
            raise Broken("ENCRYPTED")

    def read(self, name: str) -> bytes:
        if name not in self.names:
            raise Broken("MISSING")
        try:
            return self.zip.read(name)
        except zipfile.BadZipFile as error:
            raise Broken("CHECKSUM") from error
        except Exception as error:  # broken streams raise errors of many kinds
            raise Broken("CORRUPT") from error

    def xml(self, name: str):
        data = self.read(name)
        # Entities and document types of one's own can grow without bound or reach outside.
        if re.search(rb"<!\s*(?:DOCTYPE[^>]*\[|ENTITY)", data, re.I):
            raise Broken("ENTITY")
        try:
            return ElementTree.fromstring(data)
        except (ElementTree.ParseError, ValueError, LookupError) as error:
            raise Broken("XML") from error

    def find_package(self) -> str:
        if "META-INF/container.xml" not in self.names:
            raise Broken("CONTAINER")
        for root in named(self.xml("META-INF/container.xml"), "rootfile"):
            if root.get("media-type", PACKAGE) == PACKAGE and root.get("full-path"):
                path = resolved("", root.get("full-path"))
                if path in self.names:
                    return path
        raise Broken("CONTAINER")

    def manifest(self) -> dict[str, Item]:
        found, places = {}, set()
        for item in (e for m in named(self.package, "manifest")[:1] for e in m if local(e) == "item"):
            key, href = item.get("id"), item.get("href")
            if not key or not href or key in found or "#" in href:
                raise Broken("MANIFEST")
            path = None if urlsplit(href).scheme else resolved(self.package_path, href)
            if (path or href) in places or path in (self.package_path, "mimetype") or (path or "").startswith("META-INF/"):
                raise Broken("MANIFEST")
            places.add(path or href)
            found[key] = Item(href, path, item.get("media-type") or "", (item.get("properties") or "").split(), item.get("fallback") or None)
        for start in found:
            seen, at = {start}, found[start].fallback
            while at:
                if at not in found or at in seen:
                    raise Broken("FALLBACK")
                seen.add(at)
                at = found[at].fallback
        return found

    def read_spine(self) -> None:
        seen = set()
        spine = named(self.package, "spine")[:1]
        self.toc = spine[0].get("toc") if spine else None
        for ref in (e for s in spine for e in s if local(e) == "itemref"):
            key, linear = ref.get("idref"), ref.get("linear", "yes")
            if not key or key in seen or key not in self.items or linear not in ("yes", "no"):
                raise Broken("SPINE")
            seen.add(key)
            self.spine.append((self.items[key], linear == "yes"))
        if not any(linear for _, linear in self.spine):
            raise Broken("SPINE")

    def content(self, item: Item) -> Item:
        """The item, or the first of its fallbacks that can be read."""
        while item.media not in CONTENT:
            if not item.fallback:
                raise Broken("CONTENT")
            item = self.items[item.fallback]
        return item

    def meta(self, name: str) -> str | None:
        texts = [" ".join("".join(e.itertext()).split()) for e in named(self.package, name) if "purl.org/dc" in e.tag]
        return next((x for x in texts if x), None)

    def fixed(self) -> bool:
        return any(e.get("property") == "rendition:layout" and (e.text or "").strip() == "pre-paginated" for e in named(self.package, "meta"))

    def blocks(self) -> tuple[list[tuple], list[str]]:
        """((spine, href, kind, text, level) of the primary items in spine order, warnings). Items that aren't linear are checked, not read."""
        found, filled, empty = [], 0, 0
        for place, (item, linear) in enumerate(self.spine):
            content = self.content(item)
            for declared in (item, content):
                if declared.path not in self.names:
                    raise Broken("MISSING")
            if not linear:
                continue
            text = self.read(content.path).decode("utf-8", "replace")
            own = page_blocks(text)
            found += [(place, content.href, kind, words, level) for kind, words, level, _ in own]
            filled, empty = filled + bool(own), empty + (not own)
        if not found:
            raise Broken("FIXED_LAYOUT" if self.fixed() else "NO_TEXT")
        source, _ = self.navigation()
        cases = ((self.fixed(), "FIXED_LAYOUT"), (filled and empty, "PARTIAL_EXTRACTION"), (source == "NONE", "NAVIGATION_DEGRADED"))
        return found, [code for holds, code in cases if holds]

    def navigation(self) -> tuple[str, list[tuple]]:
        """(source, (depth, label, href)): of the navigation document, or of the older list, or none. Links are paths in the archive."""
        for item in self.items.values():
            if "nav" in item.properties and item.path in self.names:
                links = self.safe(item.path, page_links(self.read(item.path).decode("utf-8", "replace")))
                if links:
                    return "NAV", links
        older = self.items.get(self.toc or "") or next((x for x in self.items.values() if x.media == NCX), None)
        if older is not None and older.path in self.names:
            try:
                links = self.safe(older.path, list(self.points(self.xml(older.path))))
            except Broken:
                links = []
            if links:
                return "NCX", links
        return "NONE", []

    def points(self, root) -> Iterator[tuple]:
        waiting = [(0, e) for m in named(root, "navMap")[:1] for e in reversed(m) if local(e) == "navPoint"]
        while waiting:
            depth, point = waiting.pop()
            label = next((" ".join("".join(e.itertext()).split()) for e in point if local(e) == "navLabel"), "")
            href = next((e.get("src") for e in point if local(e) == "content"), None)
            yield min(depth, 64), label, href or ""
            waiting += [(depth + 1, e) for e in reversed(point) if local(e) == "navPoint"]

    def safe(self, base: str, links: list[tuple]) -> list[tuple]:
        """Links that lead to a place in the archive, as that place with its fragment."""
        out = []
        for depth, label, href in links:
            try:
                path = resolved(base, href)
            except Broken:
                continue
            if label and path in self.names:
                mark = urlsplit(href).fragment
                out.append((depth, label, f"{path}#{mark}" if mark else path))
        return out


def block_rows(name: str, content: bytes) -> list[tuple]:
    try:
        book = Book(content)
        blocks, warnings = book.blocks()
        about = (warnings, book.meta("title"), book.meta("language"))
        ordinals: dict[int, int] = {}
        out = []
        for place, href, kind, text, level in blocks:
            ordinals[place] = ordinals.get(place, -1) + 1
            out.append((name, None, *about, place, href, ordinals[place], kind, text, level))
        return out
    except Broken as error:
        return [(name, error.args[0], [], *[None] * 8)]


def link_rows(name: str, content: bytes) -> list[tuple]:
    try:
        source, links = Book(content).navigation()
        return [(name, None, source, i, *link) for i, link in enumerate(links)] or [(name, None, source, None, None, None, None)]
    except Broken as error:
        return [(name, error.args[0], *[None] * 5)]


def store(path: str):
    """(file system, path) of a folder by its address: of this machine, or of a store that has one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Shelf(InputPartition):
    files: list[str]


class BookReader(DataSourceReader):
    def __init__(self, options, links: bool):
        self.folder, self.links = options["path"], links

    def partitions(self):
        from pyarrow import fs

        files, folder = store(self.folder)
        found = sorted((x.path, x.size or 0) for x in files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if x.is_file and x.path.endswith(".epub"))
        shelves, room = [Shelf([])], SHARE
        for path, size in found:
            if room < size and shelves[-1].files:
                shelves, room = [*shelves, Shelf([])], SHARE
            shelves[-1].files.append(path)
            room -= size
        return shelves

    def read(self, partition):
        files, folder = store(self.folder)
        for path in partition.files:
            with files.open_input_stream(path, compression=None) as stream:
                content = stream.read()
            name = posixpath.relpath(path, folder).removesuffix(".epub")
            yield from (link_rows if self.links else block_rows)(name, content)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class BookWriter(DataSourceWriter):
    """One archive for each row (book, content), under its name; files appear once the whole job is done."""

    def __init__(self, options):
        self.folder, self.job = options["path"], uuid.uuid4().hex

    def write(self, rows):
        files, folder = store(self.folder)
        waiting = f"{folder}/_waiting-{self.job}-{uuid.uuid4().hex}"
        files.create_dir(waiting)
        done = []
        for row in rows:
            if not re.fullmatch(r"[\w.-]+", row["book"]) or row["book"].startswith("."):
                raise ValueError(f"{row['book']!r} is no name of a book")
            path = f"{waiting}/{row['book']}.epub"
            with files.open_output_stream(path, compression=None) as stream:
                stream.write(bytes(row["content"]))
            done.append(path)
        return Written(done)

    def commit(self, messages):
        files, folder = store(self.folder)
        for message in messages:
            for path in message.files if message else []:
                files.move(path, f"{folder}/{posixpath.basename(path)}")
        self.clear()

    def abort(self, messages):
        self.clear()

    def clear(self):
        from pyarrow import fs

        files, folder = store(self.folder)
        for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if not x.is_file and posixpath.basename(x.path).startswith(f"_waiting-{self.job}-"):
                files.delete_dir(x.path)


class BookSource(DataSource):
    """Option ``rows``: ``blocks`` (as read if not given) or ``links``, the navigation."""

    @classmethod
    def name(cls):
        return "books"

    def schema(self):
        return LINKS if self.options.get("rows") == "links" else SCHEMA

    def reader(self, schema):
        return BookReader(self.options, self.options.get("rows") == "links")

    def writer(self, schema, overwrite):
        return BookWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BookSource)


def bound(chapters: list[tuple[str, str]], title: str = "", fault: str | None = None) -> bytes:
    """An archive of (file name, text) chapters, whose spine runs from the last to the first and holds an auxiliary note besides;
    with ``fault``, one thing in it is other than it should be."""
    items = [f'<item id="c{i}" href="{name}" media-type="application/xhtml+xml"/>' for i, (name, _) in enumerate(chapters)]
    refs = [f'<itemref idref="c{i}"/>' for i in reversed(range(len(chapters)))] + ['<itemref idref="note" linear="no"/>']
    items += ['<item id="note" href="note.xhtml" media-type="text/html"/>', '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>']
    items += ['<item id="a" href="a.bin" media-type="x/a" fallback="b"/>', f'<item id="b" href="b.bin" media-type="x/b"{" fallback=" + chr(34) + "a" + chr(34) if fault == "FALLBACK" else ""}/>']
    refs += {"SPINE": ['<itemref idref="c0"/>'], "UNKNOWN": ['<itemref idref="nobody"/>'], "CONTENT": ['<itemref idref="a"/>']}.get(fault, [])
    layout = '<meta property="rendition:layout">pre-paginated</meta>' if fault == "FIXED_LAYOUT" else ""
    package = (f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title><dc:language>en</dc:language>{layout}</metadata>'
               f'<manifest>{"".join(items)}</manifest><spine>{"".join(refs)}</spine></package>')
    package = "<!DOCTYPE package [<!ENTITY a 'b'>]>" + package if fault == "ENTITY" else package[:-9] if fault == "XML" else package
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    links = "".join(f'<li><a href="{name}">{name}</a></li>' for name, _ in chapters)
    files = [("mimetype", "application/zip" if fault == "MIMETYPE" else BOOK), *([] if fault == "CONTAINER" else [("META-INF/container.xml", container)]), ("OPS/book.opf", package),
             ("OPS/nav.xhtml", "<nav></nav>" if fault == "NAVIGATION" else f"<nav><ol>{links}</ol></nav>"), ("OPS/note.xhtml", "<p>A note.</p>"), ("OPS/a.bin", "a"), ("OPS/b.bin", "b")]
    files += [(f"OPS/{name}", text) for name, text in (chapters[1:] if fault == "MISSING" else chapters)]
    files += {"PATH": [("../out.xhtml", "x")], "ENCRYPTED": [("META-INF/encryption.xml", "<encryption/>")], "RATIO": [("OPS/big.bin", "0" * 12_000_000)]}.get(fault, [])
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in files:
            book.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_STORED if name == "mimetype" or (fault, name) == ("CHECKSUM", "OPS/book.opf") else zipfile.ZIP_DEFLATED)
    content = bytearray(buffer.getvalue())
    if fault == "CHECKSUM":
        content[content.index(b"OPS/book.opf") + 14] ^= 0xFF
    return bytes(content[: len(content) // 2] if fault == "CORRUPT" else content)
