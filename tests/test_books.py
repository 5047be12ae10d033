"""Books: packages, spines, navigation and faults, and the data source over folders of them."""

import io
import zipfile

import pytest

from inkspark.sources import books

CHAPTERS = [("one.xhtml", "<h1>One</h1><p>first</p>"), ("two.xhtml", "<p>second</p><p>more</p>"), ("sub/three.xhtml", "<p>third</p>")]


def archive(files, stored=("mimetype",)):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in files:
            book.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def package(manifest, spine, attrs="", path="book.opf", extra=(), layout=""):
    opf = f'<package version="2.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> A  title </dc:title>{layout}</metadata><manifest>{manifest}</manifest><spine {attrs}>{spine}</spine></package>'
    container = f'<container><rootfiles><rootfile full-path="gone.opf"/><rootfile full-path="other" media-type="text/x"/><rootfile full-path="{path}"/></rootfiles></container>'
    return archive([("mimetype", books.BOOK), ("META-INF/container.xml", container), (path, opf), *extra])


def error(content):
    return books.block_rows("b", content)[0][1]


def test_spine_order_and_navigation():
    rows = books.block_rows("b", books.bound(CHAPTERS, "T"))
    assert [(r[5], r[6], r[7], r[8], r[9]) for r in rows] == [
        (0, "sub/three.xhtml", 0, "PARAGRAPH", "third"), (1, "two.xhtml", 0, "PARAGRAPH", "second"), (1, "two.xhtml", 1, "PARAGRAPH", "more"), (2, "one.xhtml", 0, "HEADING", "One"), (2, "one.xhtml", 1, "PARAGRAPH", "first")]
    assert {r[1:5] == (None, [], "T", "en") for r in rows} == {True}
    assert [r[2:] for r in books.link_rows("b", books.bound(CHAPTERS))] == [("NAV", i, 0, name, f"OPS/{name}") for i, (name, _) in enumerate(CHAPTERS)]


@pytest.mark.parametrize("fault,code", [(x, {"UNKNOWN": "SPINE"}.get(x, x)) for x in "CONTAINER SPINE UNKNOWN FALLBACK MISSING CONTENT PATH CORRUPT ENTITY XML MIMETYPE ENCRYPTED RATIO CHECKSUM".split()])
def test_faults(fault, code):
    assert error(books.bound(CHAPTERS, "T", fault)) == code


def test_warnings_and_empty_books():
    assert books.block_rows("b", books.bound(CHAPTERS, "T", "FIXED_LAYOUT"))[0][2] == ["FIXED_LAYOUT"]
    assert books.block_rows("b", books.bound(CHAPTERS, "T", "NAVIGATION"))[0][2] == ["NAVIGATION_DEGRADED"]
    assert books.block_rows("b", books.bound([*CHAPTERS, ("four.xhtml", "<div></div>")]))[0][2] == ["PARTIAL_EXTRACTION"]
    assert error(books.bound([("x.xhtml", "")])) == "NO_TEXT" and error(books.bound([("x.xhtml", "")], "", "FIXED_LAYOUT")) == "FIXED_LAYOUT"
    assert error(b"") == error(b"no archive") == "CORRUPT"


def test_packages():
    page = '<item id="p" href="p%20q.xhtml" media-type="application/xhtml+xml"/>'
    text = [("p q.xhtml", "<p>x</p>")]
    assert error(package(page, '<itemref idref="p"/>', extra=text)) is None
    for manifest, spine in ((page + page, '<itemref idref="p"/>'), (page + '<item id="q" href="./p q.xhtml"/>', '<itemref idref="p"/>'), ('<item id="p" href="p.xhtml#x"/>', '<itemref idref="p"/>'), ('<item id="p"/>', '<itemref idref="p"/>'),
                            (page + '<item id="m" href="META-INF/x"/>', '<itemref idref="p"/>'), (page + '<item id="m" href="book.opf"/>', '<itemref idref="p"/>')):
        assert error(package(manifest, spine, extra=text)) == "MANIFEST"
    for spine in ("", '<itemref idref="p" linear="no"/>', '<itemref idref="p" linear="maybe"/>', "<itemref/>"):
        assert error(package(page, spine, extra=text)) == "SPINE"
    assert error(package('<item id="p" href="../p.xhtml"/>', '<itemref idref="p"/>', extra=text)) == "PATH"
    # A fallback that can be read stands in; packages lie in folders; names count from there.
    image = '<item id="i" href="i.png" media-type="image/png" fallback="p"/><item id="p" href="p.xhtml" media-type="application/xhtml+xml"/>'
    rows = books.block_rows("b", package(image, '<itemref idref="i"/>', path="in/side/book.opf", extra=[("in/side/i.png", "x"), ("in/side/p.xhtml", "<p>y</p>")]))
    assert [(r[1], r[3], r[6], r[9]) for r in rows] == [(None, "A title", "p.xhtml", "y")]
    assert error(package(image, '<itemref idref="i"/>', extra=[("i.png", "x")])) == "MISSING"


def test_older_navigation():
    ncx = '<ncx><navMap><navPoint><navLabel><text>A</text></navLabel><content src="p.xhtml#a"/><navPoint><navLabel><text>B</text></navLabel><content src="p.xhtml"/></navPoint></navPoint><navPoint><navLabel><text>C</text></navLabel><content src="http://x/y"/></navPoint></navMap></ncx>'
    manifest = '<item id="p" href="p.xhtml"/><item id="n" href="n.ncx" media-type="application/x-dtbncx+xml"/>'
    book = package(manifest, '<itemref idref="p"/>', 'toc="n"', extra=[("p.xhtml", "<p>x</p>"), ("n.ncx", ncx)])
    assert [r[2:] for r in books.link_rows("b", book)] == [("NCX", 0, 0, "A", "p.xhtml#a"), ("NCX", 1, 1, "B", "p.xhtml")]
    assert books.block_rows("b", package(manifest, '<itemref idref="p"/>', 'toc="n"', extra=[("p.xhtml", "<p>x</p>"), ("n.ncx", "<ncx")]))[0][2] == ["NAVIGATION_DEGRADED"]


def test_data_source(spark, tmp_path, monkeypatch):
    books.register(spark)
    rows = [(f"b{i}", books.bound(CHAPTERS, f"T{i}", "XML" if i == 3 else None)) for i in range(7)]
    folder = str(tmp_path / "shelf")
    spark.createDataFrame(rows, "book string, content binary").repartition(3).write.format("books").mode("append").save(folder)
    assert sorted(x.name for x in (tmp_path / "shelf").iterdir()) == [f"b{i}.epub" for i in range(7)]
    got = spark.read.format("books").load(f"file://{folder}")
    assert got.where("error is null").count() == 30 and [tuple(r) for r in got.where("error is not null").select("book", "error", "text").collect()] == [("b3", "XML", None)]
    assert spark.read.format("books").option("rows", "links").load(folder).where("source = 'NAV'").count() == 18
    monkeypatch.setattr(books, "SHARE", 1)
    assert len(books.BookReader({"path": folder}, False).partitions()) == 7
    assert spark.read.format("books").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no name of a book"):
        spark.createDataFrame([("../x", b"")], "book string, content binary").write.format("books").mode("append").save(folder)
    assert len(list((tmp_path / "shelf").iterdir())) == 7
