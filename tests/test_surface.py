"""Functions and table functions in SQL text."""

import pytest
from pyspark.sql import functions as F

from inkspark.functions import pieces, surface
from inkspark.functions import text as t
from inkspark.sources.markup import html_blocks


@pytest.fixture(scope="module")
def named(spark):
    assert set(surface.register(spark)) == set(surface.register(spark)) >= {"json_cosine", "hard_pieces", "page_blocks"}
    return spark


def test_cosine_of_json(named):
    rows = [("[1, 0]", "[2, 0]", 1.0), ("[1,0]", "[0,1]", 0.0), ("[1.5, -2]", "[-1.5, 2]", -1.0), ("[]", "[]", None), ("[1]", "[1,2]", None), ("[0,0]", "[1,1]", None), ("[1,null]", "[1,1]", None),
            ('["1",2]', "[1,2]", None), ('{"a":1}', "[1]", None), ("7", "[7]", None), ("[1", "[1]", None), (None, "[1]", None), ("[1e308,1e308]", "[1e308,1e308]", None), ("[true]", "[1]", None), ("[[1]]", "[1]", None)]
    named.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string").createOrReplaceTempView("cosines")
    got = {r["i"]: r["c"] for r in named.sql("SELECT i, json_cosine(a, b) AS c FROM cosines").collect()}
    assert {i: None if c is None else round(c, 12) for i, c in got.items()} == {i: c for i, (*_, c) in enumerate(rows)}


def test_canonical_json_and_titles(named):
    docs = ['{"b": 1, "a": [1.50, null, {"d":"é", "c": true}]}', "[1e5 ]", '"x"', "{", "", None, "null"]
    named.createDataFrame(list(enumerate(docs)), "i int, doc string").createOrReplaceTempView("docs")
    got = [r["c"] for r in named.sql("SELECT canonical_json(doc) AS c FROM docs ORDER BY i").collect()]
    assert got == ['{"a":[1.50,null,{"c":true,"d":"é"}],"b":1}', "[1e5]", '"x"', None, None, None, "null"]
    assert named.sql("SELECT title_key('  ﬁne\t\tＴitle ') AS k, title_key(null) AS n").first().asDict() == {"k": "fine Title", "n": None}


def test_pieces_equal_columns(named):
    texts = ["", "ab", "abc" * 5, "a😀b" * 9, "😀" * 7, "é\n" * 8, None]
    rows = named.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows.createOrReplaceTempView("texts")
    got = {r["i"]: r["p"] for r in named.sql("SELECT i, transform(array_sort(collect_list(struct(p.ordinal, p.piece))), x -> x.piece) AS p FROM texts, LATERAL hard_pieces(text, 4) p GROUP BY i").collect()}
    want = {r["i"]: r["p"] for r in rows.where("text is not null").select("i", t.hard_pieces(F.col("text"), 4).alias("p")).collect()}
    assert got == want
    long = "One sentence here. " * 60 + "x" * 700
    named.createDataFrame([(long,)], "text string").createOrReplaceTempView("longs")
    for name, read in (("speech_pieces", pieces.speech_pieces), ("narration_pieces", pieces.narration_pieces)):
        assert [r["piece"] for r in named.sql(f"SELECT p.* FROM longs, LATERAL {name}(text, 420) p ORDER BY ordinal").collect()] == read(long, 420)


def test_blocks_equal_the_source(named):
    pages = named.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.createOrReplaceTempView("webpages")
    got = named.sql("SELECT page_id, b.* FROM webpages, LATERAL page_blocks(html) b")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, html_blocks(pages).select(got.columns).collect()), key=repr)
