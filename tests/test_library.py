"""Operators on fixtures that the driver's tables don't cover, and queries against SQL."""

import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from inkspark import queries as library
from inkspark.functions import text as t
from inkspark.functions import vectors as v
from inkspark.operators import decisions, metrics, relations, usage
from inkspark.plans import structure
from inkspark.sources import markup
from inkspark.streaming import events

DATA = "/root/testdata/sf0.001"
library.load()


def value(spark, column, **columns):
    row = spark.range(1)
    for name, x in columns.items():
        row = row.withColumn(name, F.lit(x))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_query_against_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    got = library.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(library.SQL[name]).df()
    assert sorted(want.columns) == columns

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return None
        return f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    rows = [sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False)) for df in (got.toPandas(), want)]
    assert rows[0] == rows[1]


def test_units_and_spans(spark):
    text = "a😀b\u0301"
    assert value(spark, t.units(F.col("s")), s=text) == 5
    assert value(spark, t.units_slice(F.col("s"), F.lit(1), F.lit(3)), s=text) == "😀"
    error = lambda a, b, q: value(spark, t.span_error(F.col("s"), F.lit(a), F.lit(b), F.lit(q)), s=text)
    assert error(1, 3, "😀") is None and error(0, 2, "a") == "SURROGATE" and error(2, 3, "x") == "SURROGATE" and error(0, 9, "a") == "RANGE" and error(0, 1, "b") == "QUOTE"


def test_text_functions(spark):
    assert value(spark, t.canonical(F.col("s")), s="\ufeff\r\n \n  first\r\rsecond\n \n") == "  first\n\nsecond"
    assert value(spark, t.budget_tokens(F.col("s")), s="中文字abc") == 4
    assert value(spark, t.spoken_millis(F.col("s")), s="") == 400
    assert value(spark, t.spoken_millis(F.col("s")), s="one two three four five, six") == math.ceil(6 / 2.6 * 1000 + 120)
    assert value(spark, t.word_tokens(F.col("s")), s="Ab1 中文c") == ["ab1", "中", "文", "c"]
    assert value(spark, t.escaped(F.col("s")), s="<a & 'b'>") == "&lt;a &amp; &apos;b&apos;&gt;"
    assert value(spark, t.srt_time(F.lit(3_723_004))) == "01:02:03,004"
    assert [value(spark, t.isbn_ok(F.col("s")), s=s) for s in ("0-306-40615-2", "978-0-306-40615-7", "0306406153", "080442957X", "x")] == [True, True, False, True, False]
    assert [value(spark, t.safe_path(F.col("s")), s=s) for s in ("a/b.xhtml", "../a", "/a", "C:/a", "a%2fb", "a//b", "")] == [True] + [False] * 6
    assert value(spark, t.redacted(F.col("s")), s="token = abc, x=1") == "token = [REDACTED], x=1"
    assert [value(spark, t.block_kind(F.col("s")), s=s) for s in ("## a", "- a", "> a", "```", "a")] == ["HEADING", "LIST_ITEM", "QUOTE", "CODE", "PARAGRAPH"]


def test_vector_functions(spark):
    arrays = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    assert value(spark, v.cosine(arrays(1.0, 0.0), arrays(2.0, 0.0))) == 1.0
    for a, b in ((arrays(), arrays()), (arrays(1.0), arrays(1.0, 2.0)), (arrays(0.0, 0.0), arrays(1.0, 1.0)), (arrays(1e308, 1e308), arrays(1e308, 1e308))):
        assert value(spark, v.cosine(a, b)) is None
    assert value(spark, v.dot(arrays(1.0), arrays(1.0, 2.0))) == float("-inf")
    assert value(spark, v.vector_error(arrays(0.0, 0.0), 2)) == "ALL_ZERO"


def test_nearest_rank(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 2, 3, 100)], "x long")
    got = rows.agg(metrics.nearest_rank("x", 0.5).alias("a"), metrics.nearest_rank("x", 0.95).alias("b"), metrics.nearest_rank("x + null", 0.5).alias("c")).first()
    assert tuple(got) == (2, 100, None)


def test_retention_edges(spark):
    people = spark.sql("select 1L user_id, timestamp'2026-01-01' activated_at, timestamp'2026-01-03' as_of")
    at = lambda s: spark.sql(f"select 1L user_id, timestamp'{s}' ts, 'click' event_type")
    result = lambda s: tuple(metrics.retention(people, at(s), ["click"], 24).first())[1:]
    assert result("2026-01-02 00:00:00") == (True, True) and result("2026-01-02 23:59:59") == (True, True)
    assert result("2026-01-03 00:00:00") == (True, False) and result("2026-01-01 23:59:59") == (True, False)
    late = people.withColumn("as_of", F.expr("timestamp'2026-01-02 23:59:59'"))
    assert metrics.retention(late, at("2026-01-02"), ["click"], 24).first()["eligible"] is False


def test_costs(spark):
    prices = spark.createDataFrame([(1, 1_000_000, 250_000, 2_000_000), (2, 1_000_000, None, 2_000_000)], "model_id long, input_rate long, cached_rate long, output_rate long")
    rows = [(1, 10, 4, 3), (1, None, None, None), (1, 1, 2, 0), (2, 5, 1, 0), (2, 5, 0, 1), (3, 1, 0, 0), (1, -1, 0, 0), (1, 10**13, 0, 0)]
    used = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, model_id long, input_tokens long, cached_tokens long, output_tokens long")
    got = {r["k"]: (r["quality"], r["cost"]) for r in usage.costed(used, prices, ["model_id"]).collect()}
    assert got == {0: ("ACTUAL", 13), 1: ("MISSING_USAGE", None), 2: ("INVALID_METERING", None), 3: ("UNPRICED", None), 4: ("ACTUAL", 7), 5: ("UNPRICED", None), 6: ("INVALID_METERING", None), 7: ("ACTUAL", 10**13)}


def test_islands(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 8, 9), (1, 1, 2), (2, 0, 1)], "k long, a long, b long")
    assert sorted(map(tuple, relations.islands(spans, ["k"], "a", "b").select("k", "a", "b", "n").collect())) == [(1, 0, 7, 3), (1, 8, 9, 1), (2, 0, 1, 1)]


def test_markup():
    html = (
        "<head><title>x</title></head><h2>A &amp; B</h2><p>one <b>two</b><br>three</p><ul><li><p>item</p> more</li></ul><pre>a\n b</pre>"
        "<table><tr><th colspan=2>h</th></tr><tr><td>1</td><td>2</td></tr></table><img alt='pic'><script>no</script><aside epub:type=footnote><p>note</p></aside>")
    assert markup.page_blocks(html) == [
        ("HEADING", "A & B", 2, False), ("PARAGRAPH", "one two three", None, False), ("LIST_ITEM", "item more", None, False), ("CODE", "a\n b", None, False),
        ("TABLE", "h\n1\t2", None, True), ("FIGURE", "pic", None, False), ("FOOTNOTE", "note", None, False)]
    assert markup.page_blocks(None) == []
    assert markup.page_links("<nav><ol><li><a href=a>A</a><ol><li><a href=b>B</a></ol></ol></nav><a href=c>C</a>") == [(0, "A", "a"), (1, "B", "b")]


def test_structure(spark):
    levels = [None, 1, 2, None, 3, 2, 1, 2]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(levels)], "doc_id long, ordinal int, level int")
    got = sorted(tuple(r)[1:] for r in structure.structure(rows).collect())
    assert got == [(1, 1, None, 5), (2, 2, 1, 4), (4, 3, 2, 4), (5, 2, 1, 5), (6, 1, None, 7), (7, 2, 6, 7)]


def test_chunks_rebuild_their_document(spark):
    texts = ["head\n" + "word " * 900 + "\nnext. " + "a. " * 700, "", "x" * 5000, "one\ntwo\nthree"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id long, text string")
    chunks = structure.chunked(docs, lambda block: len(block) < 5)
    assert structure.provenance_errors(chunks, docs).collect() == []
    assert chunks.agg(F.max("units")).first()[0] <= 1600
    broken = chunks.withColumn("content", F.when(F.col("ordinal") == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    assert {r["code"] for r in structure.provenance_errors(broken, docs).collect()} == {"HASH", "LENGTH", "TEXT"}


def test_greedy_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([("q", 1, 0.9, 5), ("q", 2, 0.8, 9), ("q", 3, 0.7, 4), ("q", 4, 0.7, 1)], "q string, id long, score double, cost long")
    assert [r["id"] for r in structure.greedy(items, "q", 10).orderBy("place").collect()] == [1, 3, 4]


def test_decisions(spark):
    span = lambda h: value(spark, decisions.byte_range(F.lit(h), F.lit(100).cast("long")))
    assert [span(h) and tuple(span(h)) for h in ("bytes=0-9", "bytes=90-", "bytes=-5", "bytes=100-", "bytes=-0", "bytes=5-2", "x")] == [(0, 9), (90, 99), (95, 99), None, None, None, None]
    assert value(spark, decisions.review_days(F.lit("DEVELOPING"), F.lit(9))) == 30
    marks = lambda *x: F.array(*map(F.lit, x))
    assert [value(spark, decisions.mastery(m)) for m in (marks("MET", "MET"), marks("MET", "PARTIAL"), marks("NOT_MET", "MET"))] == ["DEMONSTRATED", "DEVELOPING", "NEEDS_REVIEW"]


def test_breaker(spark, tmp_path):
    rows = [(k, f"2026-01-01 00:{k:02d}:00", 1, kind, 0.0, None) for k, kind in enumerate(["view", "error", "error", "view", "view", "view"])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = events.run_once(events.broken(events.event_stream(spark, str(tmp_path)), 2, 150)).orderBy("event_id").collect()
    assert [r["outcome"] for r in got] == ["PASSED", "PASSED", "PASSED", "REFUSED", "REFUSED", "PROBE"]


def test_library_stands_alone():
    """Nothing outside the subpackage needs it."""
    code = "import sys; sys.modules['inkspark.llm'] = None; from inkspark import queries; queries.load(); print(len(queries.QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 100


def test_pieces():
    import numpy as np

    from inkspark.functions import pieces

    text = "One two three. " * 80
    for cut, most in ((pieces.speech_pieces, 500), (pieces.narration_pieces, 420)):
        parts = cut(text)
        assert all(len(x) <= most for x in parts) and "".join("".join(parts).split()) == "".join(text.split()) and all(x.endswith(".") for x in parts)
    assert pieces.speech_pieces("x" * 1200) == ["x" * 500, "x" * 500, "x" * 200] and pieces.speech_pieces("") == []
    assert pieces.wrapped("aaaa中中", 2.2, 3) == ["aaaa", "中中"] and pieces.wrapped("a\nb\nc", 9, 2) is None
    assert pieces.comparable("\ufeffe\u0301\u00a0 a\u00ad\r\nb ") == "\u00e9 a b"
    assert pieces.reading_layout("One ... 1\nTwo ..... 3\nThree ... 3\nFour ... 9")[3] == ("ENTRY", "Four\t9")
    assert pieces.reading_layout("One ... 4\nTwo ... 3\nThree ... 5\nFour ... 9")[0][0] == "PARAGRAPH"
    assert [len(x[1].split(". ")) for x in pieces.reading_layout("A. B. C. D. E.")] == [3, 2]
    assert pieces.fake_embedding("") == [0.0] * 4 and abs(sum(x * x for x in pieces.fake_embedding("abcdef😀")) - 1) < 1e-12
    assert pieces.rescaled([1000, 2000], 5000) == [1000, 2000] and sum(pieces.rescaled([9000, 30_000, 1200], 10_000)) <= 11_500
    assert pieces.gained(np.array([0.5, -0.5])) == 0.2 and pieces.gained(np.zeros(3)) == 1.0


def test_soft_split_prefers_ends():
    spans = structure.soft_split("word word. " * 60, 200)
    assert spans[0][0] == 0 and spans[-1][1] == 660 and all(a[1] == b[0] and a[1] - a[0] <= 200 for a, b in zip(spans, spans[1:]))
    assert all(("word word. " * 60)[a:b].endswith(". ") for a, b in spans[:-1])


def test_reduction_and_budgets():
    import pandas as pd

    from inkspark.plans import budgets, reduction

    answer, rounds = reduction.reduce_texts([f"block {i} " + "x" * 300 for i in range(100)], 1000)
    assert rounds > 1 and answer.split(" ")[0]
    assert reduction.batches_of(["a" * 5, "b" * 5, "c" * 12], 11) == [["aaaaa", "bbbbb"], ["c" * 11], ["c"]]
    with pytest.raises(ValueError):
        reduction.reduce_texts(["a" * 30] * 3, 40, lambda g: "z" * 90)
    items = pd.DataFrame({"request": 1, "source": ["a", "a", "b", "c"], "place": range(4), "cost": [9, 2, 4, 3]})
    assert budgets.fair_choice(items, 9)["place"].tolist() == [1, 2, 3] and budgets.fair_choice(items, 8).empty
    assert budgets.fair_choice(items, 18)["place"].tolist() == [0, 1, 2, 3]


def test_archives(spark):
    import io
    import zipfile

    from inkspark.sources import archives

    def book(*names):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name in names:
                z.writestr(name, "<h1>A</h1><p>b</p><p>c</p>")
        return bytearray(buffer.getvalue())

    df = spark.createDataFrame([(1, book("text/a.xhtml")), (2, book("../a.xhtml")), (3, bytearray(b"PK no zip")), (4, None)], "page_id long, content binary")
    got = sorted((r["page_id"], r["kind"] or "", r["blocks"], r["error"]) for r in archives.entries(df).collect())
    assert got == [(1, "HEADING", 1, None), (1, "PARAGRAPH", 2, None), (2, "", 0, "PATH"), (3, "", 0, "CORRUPT"), (4, "", 0, "CORRUPT")]


def test_run_text(spark):
    """Breaks by moves of the baseline and by gaps, none twice; runs without text move the pen but make no break."""
    from inkspark.operators import records

    rows = [
        (1, 0, "Head", 0.0, 100.0, 40.0, 10.0, True), (1, 1, "first", 0.0, 80.0, 50.0, 10.0, False), (1, 2, "line", 52.0, 80.0, 40.0, 10.0, False),
        (1, 3, "s", 92.5, 83.0, 5.0, 10.0, False), (1, 4, " next", 110.0, 80.0, 40.0, 10.0, False), (1, 5, "", 200.0, 60.0, 0.0, 10.0, False),
        (1, 6, "end", 201.0, 60.0, 30.0, 10.0, False), (1, 7, None, 0.0, 40.0, 0.0, 10.0, False), (1, 8, "x  ", 0.0, 40.0, 5.0, None, True), (2, 0, "", 0.0, 0.0, 0.0, 1.0, False)]
    runs = spark.createDataFrame(rows, "page long, i int, str string, x double, y double, width double, height double, eol boolean").where("str is not null")
    assert {r["page"]: r["text"] for r in records.run_text(runs).collect()} == {1: "Head\nfirst lines nextend\nx", 2: ""}


def test_origins(spark):
    from inkspark.operators import records

    chain = [(i, i - 1 if i else None, i > 0) for i in range(70)]
    odd = [(100, 101, True), (101, 100, True), (102, 999, True), (103, None, True), (104, 3, False)]
    got = {r["id"]: (r["origin"], r["edits"], r["error"]) for r in records.origins(spark.createDataFrame(chain + odd, "id long, parent long, edited boolean")).collect()}
    assert all(got[i] == ((0, i, None) if i <= 64 else (None, None, "PARENT_INVALID")) for i in range(70))
    assert all(got[i][2] == "PARENT_INVALID" for i in (100, 101, 102, 103)) and got[104] == (104, 0, None)


def test_upsert_and_archive(spark):
    from inkspark.operators import records

    held = spark.createDataFrame([(1, "a", 5, 5), (2, "b", 6, 6)], "k long, state string, created int, at int")
    new = spark.createDataFrame([(1, "c", 3, 3), (1, "d", 4, 4), (3, "e", 9, 9)], "k long, state string, created int, at int")
    got = sorted(map(tuple, records.upserted(held, new, ["k"], ["at"], ["created"]).collect()))
    assert got == [(1, "d", 5, 4), (2, "b", 6, 6), (3, "e", 9, 9)]
    items = spark.createDataFrame([(1, None), (2, 7), (3, None)], "id long, archived_at long")
    marks = spark.createDataFrame([(1, 9), (1, 8), (2, 1), (5, 1)], "id long, at long")
    assert sorted(map(tuple, records.archived(items, marks, "id").collect()), key=str) == [(1, 8), (2, 7), (3, None)]


def test_admission_skips_what_is_refused(spark):
    from inkspark.operators import ordering

    rows = [(1, i, float(x)) for i, x in enumerate((60, 50, 40, 1, 0, -5, None or 0.5))] + [(2, 0, 100.0), (2, 1, 0.5)]
    got = ordering.admitted(spark.createDataFrame(rows, "k long, i int, cost double"), ["k"], ["i"], "cost", 100).collect()
    assert {(r["k"], r["i"]): r["within_limit"] for r in got} == {
        (1, 0): True, (1, 1): False, (1, 2): True, (1, 3): False, (1, 4): True, (1, 5): True, (1, 6): False, (2, 0): True, (2, 1): False}


def test_nearest_ranks(spark):
    from inkspark.operators import ordering

    rows = [(i % 7, None if i % 3 else i) for i in range(100)]
    got = ordering.nearest_ranks(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], [0.5, 0.95]).first()
    plain = lambda xs, p: sorted(xs)[max(0, math.ceil(p * len(xs)) - 1)]
    a, b = [r[0] for r in rows], [r[1] for r in rows if r[1] is not None]
    assert got["a_p50"] == plain(a, 0.5) and got["a_p95"] == plain(a, 0.95) and got["b_p50"] == plain(b, 0.5) and got["b_p95"] == plain(b, 0.95)
    assert ordering.nearest_ranks(spark.createDataFrame([], "a int"), ["a"], [0.5]).first()["a_p50"] is None


def test_whole_texts_are_redacted_and_compared(spark):
    import hashlib
    import re
    import unicodedata

    texts = ["Das Passwort: geheim, token=abc; PASSWORD = \"zwei Worte\" müde", "ｆｕｌｌ  ｗｉｄｔｈ ﬁn\nx ", "é" * 40 + " " + "k" * 33, None, "", "api_key:\tx authorization = y,z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from inkspark.functions import pieces

    def plain(text):
        keyed = re.sub(r"(?ai)\b(token|secret|password|api[_-]?key|authorization)([ \t\n\x0b\f\r]*[=:][ \t\n\x0b\f\r]*)(\"[^\"]*\"|[^ \t\n\x0b\f\r,;]+)", r"\1\2[REDACTED]", text)
        return re.sub(r"(?a)\b[A-Za-z0-9_-]{32,}\b", "[REDACTED]", keyed)

    got = {r["doc_id"]: (r["a"], r["b"]) for r in docs.select("doc_id", t.redacted(F.col("text")).alias("a"), pieces.compare_key("text").alias("b")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == ((None, None) if text is None else (plain(text), " ".join(unicodedata.normalize("NFKC", text).split())))
    assert hashlib.sha256(b"").hexdigest() in {r["digest"] for r in docs.select(F.sha2(pieces.compare_key("text"), 256).alias("digest")).collect()}


def test_failover_reaches_every_reason(spark):
    from inkspark.operators import admission

    good = dict(enabled=True, authority=True, sealed=True, terminal=True, unclaimed=True, may_pay=True, has_budget=True, independent=True, voice=True, error="TIMEOUT", outcome="NOT_SENT", slot="CHAT", switches=0, most=2, at=0)
    one = dict(provider="p", model="m0", connection="c", credential="v", source="WORKSPACE", capable=True, structured=True)
    chain = [one, one | {"model": "m1"}, one | {"model": "m2"}]
    cases = [
        ({}, chain, None), ({"enabled": None}, chain, "NOT_ENABLED"), ({"most": 0}, chain, "NOT_ENABLED"), ({"sealed": False}, chain, "UNSEALED_PLAN"), ({"unclaimed": False}, chain, "IN_FLIGHT"),
        ({"error": "CONTENT_REJECTED", "outcome": "UNKNOWN"}, chain, "CONTENT_POLICY_REVIEW_REQUIRED"), ({"error": "CREDENTIAL_REVOKED"}, chain, "UNSAFE_FAILURE_CLASS"), ({"outcome": "UNKNOWN"}, chain, "UNKNOWN_BILLING"),
        ({"may_pay": False}, chain, "NO_PAID_CALL_AUTHORIZATION"), ({"has_budget": False}, chain, "BUDGET_EXHAUSTED"), ({"switches": 2}, chain, "ATTEMPT_LIMIT_REACHED"), ({"most": 3}, chain, "ATTEMPT_LIMIT_REACHED"),
        ({"at": 2}, chain, "NO_BACKUP"), ({"at": -1}, chain, "NO_BACKUP"), ({}, chain[:1], "NO_BACKUP"), ({"switches": 1}, chain, "ATTEMPT_LIMIT_REACHED"), ({}, [one, one], "REPEATED_MODEL"),
        ({"at": 1, "switches": 1}, [one, chain[1], one], "REPEATED_MODEL"), ({}, [one, chain[1] | {"connection": None}], "UNPINNED_ROUTE"), ({"error": "OUTPUT_TRUNCATED"}, chain, "UNSAFE_FAILURE_CLASS"),
        ({"error": "OUTPUT_TRUNCATED", "outcome": "PAID_AND_RECONCILED"}, chain, None), ({"slot": "EMBEDDING"}, chain, "EMBEDDING_REINDEX_REQUIRED"), ({"slot": "PDF_VISUAL_STRUCTURE"}, chain, "VISION_PROVIDER_CONSENT_REQUIRED"),
        ({"slot": "BOOK_SEMANTIC_REVIEW", "independent": None}, chain, "INDEPENDENT_REVIEW_REQUIRED"), ({"slot": "SPEECH", "voice": False}, chain, "SPEECH_VOICE_MAPPING_REQUIRED"),
        ({"slot": "PODCAST_SCRIPT"}, [one, chain[1] | {"structured": False}], "INCOMPATIBLE_CAPABILITY"), ({}, [one, chain[1] | {"capable": False}], "INCOMPATIBLE_CAPABILITY")]
    schema = ("i int, enabled boolean, authority boolean, sealed boolean, terminal boolean, unclaimed boolean, may_pay boolean, has_budget boolean, independent boolean, voice boolean, error string, outcome string, slot string, "
              "switches int, most int, at int, candidates array<struct<provider:string,model:string,connection:string,credential:string,source:string,capable:boolean,structured:boolean>>")
    rows = [(i, *(good | changed).values(), [tuple(x.values()) for x in candidates]) for i, (changed, candidates, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, schema).select("i", admission.failover_hold().alias("hold")).collect()
    assert {r["i"]: r["hold"] for r in got} == {i: hold for i, (_, _, hold) in enumerate(cases)}


def test_grounding_reaches_every_code(spark):
    import hashlib

    from inkspark.operators import admission

    blocks = spark.createDataFrame([("b", "a😀 quoted text of a book"), ("long", "x" * 900)], "block string, content string")
    said = [(1, i, text, sub, direct) for i, (text, sub, direct) in enumerate([("fine", False, False), ("bare", True, False), ("When I worked at a mill", False, False), ("says quoted", True, True), ("says other", True, True), ("no quote", False, True), ("off", True, False)])]
    cited = [("e3", 3, "b", 4, 10, "quoted"), ("e4", 4, "b", 4, 10, "quoted"), ("e5", 5, "b", 0, 1, None), ("e6", 6, "b", 4, 99, "quoted"), ("e7", 6, "b", 4, 10, "other")]
    got = admission.podcast_grounding(
        spark.createDataFrame(said, "run int, utterance int, text string, substantive boolean, direct boolean"),
        spark.createDataFrame(cited, "evidence string, utterance int, block string, first int, last int, quote string"), blocks).collect()
    assert {(r["code"], r["id"]) for r in got} == {
        ("UNSUPPORTED", "1"), ("FABRICATED_BIOGRAPHY", "2"), ("QUOTE_NOT_EXACT", "4"), ("QUOTE_EVIDENCE_TEXT_MISSING", "5"), ("INVALID_OFFSETS", "e6"), ("QUOTE_EVIDENCE_MISMATCH", "e6"), ("QUOTE_EVIDENCE_MISMATCH", "e7")}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    scenes = spark.createDataFrame([(1, 1, "CLAIM", "n" * 100), (2, 1, "QUOTE", "n" * 100), (3, 1, "INTRO", "n"), (4, 1, "CLAIM", "n" * 9000)], "run int, scene int, kind string, narration string")
    held = [("v1", 1, 1, "l", "b", 4, 10, "quoted", digest("quoted")), ("v4", 4, 1, "other", "b", 0, 2, None, None), ("v5", 4, 1, "l", "b", 3, 3, None, None), ("v6", 4, 1, "l", "b", 4, 10, "quotes", "x"), ("v7", 4, 1, "l", "long", 0, 400, "x" * 400, digest("x" * 400))]
    got = admission.video_grounding(
        scenes, spark.createDataFrame(held, "evidence string, run int, scene int, lineage string, block string, first int, last int, quote string, digest string"), blocks,
        spark.createDataFrame([(1, "l"), (4, "l")], "run int, lineage string")).collect()
    every = ["GROUNDING_FOREIGN_LINEAGE", "GROUNDING_OFFSET_INVALID", "GROUNDING_QUOTE_BUDGET_EXCEEDED", "GROUNDING_QUOTE_HASH_MISMATCH", "GROUNDING_QUOTE_MISMATCH", "GROUNDING_SURROGATE_SPLIT"]
    assert {r["run"]: r["codes"] for r in got} == {1: [], 2: ["GROUNDING_EVIDENCE_REQUIRED"], 3: [], 4: every}


def test_tree_has_root_kinds_and_groups(spark):
    rows = [
        (1, 0, "intro", "PARAGRAPH", None, None), (1, 1, "# One ", "HEADING", None, None), (1, 2, "Plain title", "HEADING", None, 9), (1, 3, "text", "PARAGRAPH", None, None), (1, 4, "### Deep", "HEADING", None, None),
        (1, 5, "#nospace", "HEADING", None, 1), (1, 6, "end", "PARAGRAPH", None, None), (2, 3, "a", "PARAGRAPH", 7, None), (2, 4, "b", "PARAGRAPH", None, None), (3, 0, "x", "PARAGRAPH", None, 3)]
    got = structure.tree(spark.createDataFrame(rows, "doc_id long, ordinal int, text string, kind string, page int, level int")).orderBy("doc_id", "node").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "ROOT", 0, None, 0, 6, None), (1, 1, "CHAPTER", 1, "One", 1, 4, 0), (1, 2, "SECTION", 2, "Plain title", 2, 4, 1), (1, 3, "SUBSECTION", 3, "Deep", 4, 4, 2), (1, 4, "CHAPTER", 1, "#nospace", 5, 6, 0),
        (2, 0, "ROOT", 0, None, 3, 4, None), (2, 1, "PAGE_GROUP", 1, None, 3, 4, 0), (3, 0, "ROOT", 0, None, 0, 0, None), (3, 1, "STRUCTURAL_GROUP", 1, None, 0, 0, 0)]


def test_splits_count_utf16_units(spark):
    text = "ab😀" * 40
    pieces = value(spark, t.hard_pieces(F.col("s"), 15), s=text)
    assert "".join(pieces) == text and all(len(x.encode("utf-16-le")) // 2 <= 16 for x in pieces) and len(pieces) == 11
    assert value(spark, t.hard_pieces(F.col("s"), 4), s="abcdefghij") == ["abcd", "efgh", "ij"] and value(spark, t.hard_pieces(F.col("s"), 4), s="") == [""]
    spans = structure.soft_split(text, 15)
    units = structure.wide(text)
    assert spans[-1][1] == len(units) == 160 and all(b - a <= 15 for a, b in spans) and "".join(structure.narrow(units[a:b]) for a, b in spans) == text
    docs = spark.createDataFrame([(1, "😀" * 900 + "\nshort\n" + "x" * 10)], "doc_id long, text string")
    chunks = structure.chunked(docs, lambda block: False, 1000, 1200).collect()
    assert all(r["units"] == len(r["content"].encode("utf-16-le")) // 2 <= 1200 for r in chunks) and [r["units"] for r in chunks] == [1200, 619]
    assert structure.provenance_errors(structure.chunked(docs, lambda block: False, 1000, 1200), docs).collect() == []


def test_analysis_goes_up_by_the_narrowest_unit(spark):
    from inkspark.plans import analysis

    chunks = spark.createDataFrame([(1, k, f"c{k}", k, k) for k in range(7)] + [(2, 0, "alone", 0, 3)], "doc_id long, ordinal int, content string, first int, last int")
    nodes = spark.createDataFrame(
        [(1, 0, "ROOT", 0, 6), (1, 1, "CHAPTER", 1, 4), (1, 2, "SECTION", 2, 3), (1, 3, "SECTION", 5, 6), (2, 0, "ROOT", 0, 3)], "doc_id long, node int, kind string, first int, last int")
    answers = analysis.analysed(chunks, nodes, lambda texts: "(" + " ".join(texts) + ")", 1000)
    got = {(r["doc_id"], r["scope"], r["unit"]): (r["inputs"], r["summary"]) for r in answers.collect()}
    assert got[1, "SECTION", 2] == (2, "((c2) (c3))") and got[1, "SECTION", 3] == (2, "((c5) (c6))")
    assert got[1, "CHAPTER", 1] == (3, "((c1) ((c2) (c3)) (c4))")
    assert got[1, "BOOK", 0] == (3, "((c0) ((c1) ((c2) (c3)) (c4)) ((c5) (c6)))") and got[2, "BOOK", 0] == (1, "((alone))")
    assert analysis.incomplete(answers, chunks).collect() == []
    assert {tuple(r) for r in analysis.incomplete(answers.where("not (scope = 'CHUNK' and unit = 3)"), chunks).collect()} == {(1, "CHUNK_ANALYSIS_INCOMPLETE")}
    assert {tuple(r) for r in analysis.incomplete(answers.where("scope <> 'SECTION' or unit <> 3"), chunks).collect()} == {(1, "COVERAGE")}
