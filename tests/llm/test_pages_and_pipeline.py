import random
from collections import Counter

import pytest

import corpus_pipeline
from inkspark.llm import jaccard, registry, wrapper
from tests.llm.data import awkward, documents, frame
from tests.llm.test_near_copies import plain_fingerprint, smallest_reachable


def test_named_elements_go():
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</ul></nav><header>Site</header><div class='cookie-notice'>We use cookies</div>"
        "<div>First&nbsp;block <b>bo</b>ld&amp;<br>more<script>var t='</p>';</script></div><p>One<p>Two <a href=x>link</a><aside>Side</aside><form>Name <input></form>"
        "<table><tr><td>a<td>b</table><!-- note --><div id=comments><p>Reader says</div><footer>&copy;</footer>tail")
    assert wrapper.tree_of(html).texts == ["First block bold& more", "One", "Two link", "a", "b", "tail"]
    assert wrapper.tree_of("<p>out</p><article><header><h1>H</h1></header><p><b>x<br><p>y</article><p>after").texts == ["H", "x", "y"]
    assert wrapper.tree_of("").texts == [] and wrapper.tree_of("no tags &lt;here&gt;").texts == ["no tags <here>"]
    assert wrapper.tree_of("<div>" * 3000 + "deep" + "</div>" * 3000).texts == ["deep"]


def page(i, host="h.example"):
    return (i, f"http://{host}/{i}?q=1", f"<body><div class='top'>Welcome to our site</div><div><h1>Title {i}</h1><p>Body number {i} &amp; more</p>" + f"<p>extra part {i}</p>" * (i % 3) + "</div><div>All rights kept</div></body>")


def test_wrapper_drops_the_template(spark):
    from pyspark.sql import functions as F

    rows = [page(i) for i in range(12)] + [page(20, "alone.example"), (30, None, None), (31, "http://h.example/x", ""), (32, "nonsense", "<p>a</p>"), page(3), (None, None, "<p>no id</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "wrapper", "text", "n_chars", "skeleton", "other"):
        df = df.withColumn(name, F.lit("mine"))
    got = wrapper.extract(df).collect()
    assert len(got) == len(rows) and all(r["other"] == "mine" and r["n_chars"] == len(r["text"]) for r in got)
    texts = {r["page_id"]: r["text"] for r in got}
    assert all(texts[i] == f"Title {i} Body number {i} & more" + f" extra part {i}" * (i % 3) for i in range(12))
    assert texts[20].startswith("Welcome to our site Title 20") and texts[30] == texts[31] == "" and texts[32] == "a" and texts[None] == "no id"


def test_each_kind_of_page_has_its_template(spark):
    """Eight kinds of pages of one host, more than a text has references; and a slot of few values, which is no template."""
    rows = [(k * 100 + i, f"http://kinds.example/{k}/{i}", f"<body><p>Whole site</p><div class='k{k}'><b>Kind {k} template</b><h1>Title {k} {i}</h1><i>Topic {i % 4}</i></div></body>")
            for k in range(8) for i in range(12)]
    texts = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts == {k * 100 + i: f"Title {k} {i} Topic {i % 4}" for k in range(8) for i in range(12)}


def test_wrappers_meet_in_a_shuffle_when_large(spark):
    df = spark.createDataFrame([page(i) for i in range(8)], "page_id long, url string, html string")
    one, two = (sorted(map(str, wrapper.extract(df, wrapper.Settings(small=n)).collect())) for n in (20_000, 0))
    assert one == two
    assert wrapper.extract(df.limit(0)).collect() == []


def test_matching_is_largest():
    a, b = wrapper.tree_of("<ul><li>1<li>2<li>3</ul><p>x"), wrapper.tree_of("<ul><li>1<li>2</ul><h2>t</h2><p>y")
    assert len(aligned(a, b)) == 1 + 1 + 2 * 2 + 2


def aligned(a, b):
    shapes = wrapper.Shapes()
    return wrapper.match(*(wrapper.numbered(x, wrapper.hashes_of(x), shapes) for x in (a, b)), shapes)


def plain_matching(a, b, i=0, j=0):
    """Simple tree matching as it is defined."""
    if a.label[i] != b.label[j]:
        return 0
    one, two = a.children[i], b.children[j]
    best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for p, x in enumerate(one):
        for q, y in enumerate(two):
            best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + plain_matching(a, b, x, y))
    return 1 + best[-1][-1]


def test_matching_is_simple_tree_matching():
    rng = random.Random(4)

    def grown(depth):
        return "".join(f"<{t}>{rng.choice(['', 'x', 'y'])}{grown(depth - 1)}</{t}>" for t in rng.choices(["div", "ul", "section"], k=rng.randrange(4))) if depth else "z"

    for _ in range(60):
        a, b = (wrapper.tree_of(grown(4)) for _ in range(2))
        pairs = aligned(a, b)
        assert len(pairs) == plain_matching(a, b) and len(dict(pairs)) == len({y for _, y in pairs}) == len(pairs)
        assert all(a.label[x] == b.label[y] for x, y in pairs)


def test_wide_lists_are_aligned_whole(monkeypatch):
    a, b = (wrapper.tree_of("".join(f"<p>{x}</p>" for x in xs)) for xs in (range(2000), [*range(5), "new", *range(5, 2000)]))
    assert len(aligned(a, b)) == 1 + 2 * 2000
    monkeypatch.setattr(wrapper, "PAIRS", 100)
    a, b = (wrapper.tree_of("".join(f"<p>{x + k}</p>" for x in range(500))) for k in (0, 10_000))
    assert len(aligned(a, b)) == 1 + 2 * 500


def test_names_take_whole_words():
    for kept in ("story ad-free", "post social-science", "menu-engineering", "tagsoup", "commentary", "share-holders"):
        assert wrapper.tree_of(f"<div class='{kept}'>text</div><p>more</p>").texts == ["text", "more"]
    for gone in ("ad", "ad-slot", "box ads_left", "post-comments", "comments-list", "site-footer", "social-links"):
        assert wrapper.tree_of(f"<div class='{gone}'>x</div><p>more text</p>").texts == ["more text"]
    long = "the whole story " * 20
    assert wrapper.tree_of(f"<div class='share'><p>{long}</p></div><p>more</p>").texts == [long.strip(), "more"]
    assert wrapper.tree_of(f"<div class='comments'><p>{long}</p></div><p>more</p>").texts == ["more"]
    assert wrapper.tree_of(f"<main><p>one</p></main><main><p>two</p></main><p>out</p>").texts == ["one", "two"]
    assert wrapper.tree_of(f"<div><p>{long}</p></div><article>teaser</article>").texts == [long.strip(), "teaser"]


def test_awkward_pages_are_taken_whole(spark):
    """Deep nesting, a page of open tags, quotes that never close, and many siblings, through the whole operator."""
    deep = lambda i: "<div>" * 3000 + f"deep {i}" + "</div>" * 3000
    wide = lambda i: "<p>top</p>" + "".join(f"<p>line {i * 10_000 + k}</p>" for k in range(2000)) + "<p>end</p>"
    rows = [(i, "http://deep.example/", deep(i)) for i in range(6)] + [(10 + i, "http://wide.example/", wide(i)) for i in range(6)]
    rows += [(20, "http://x.example/", "<a " * 350_000), (21, "http://x.example/", "<b x=\"" * 120_000 + ">z"), (22, "http://x.example/", "<p>a<b x=\"q>c</b><p>d"), (23, "http://x.example/", "</i>" * 100_000 + "<i>" * 1000 + "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in wrapper.extract(df).collect()}
    assert all(texts[i] == f"deep {i}" for i in range(6))
    assert all(texts[10 + i] == " ".join(f"line {i * 10_000 + k}" for k in range(2000)) for i in range(6))
    assert texts[20].startswith("<a <a") and texts[22] == "ac d" and texts[23] == "e" and texts[21].endswith("z")


def test_pipeline_stages(spark, tmp_path):
    rows = documents(60)
    rows += [(1000 + k, rows[k % 5][1].replace("the", "the", 1), "en", "s1", 1) for k in range(12)] + awkward()
    rows = [(i, (t or "") + "\nA license line that many documents hold" if i is not None and i % 4 == 0 and t else t, *rest) for i, t, *rest in rows]
    toxic = [(2000 + k, f"the market and the grumblewort{k % 3} of green water", "en", "s2", 1) for k in range(40)]
    from tests.llm.data import SCHEMA

    spark.createDataFrame(rows + toxic, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 0) for r in rows[:60]] + [(r[0], 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(docs.collect())
    ids = [{r["doc_id"] for r in x} for x in kept]
    assert not ids[0] & {r[0] for r in toxic} and len({r[0] for r in rows[:60]} & ids[0]) >= 57
    assert Counter(r["doc_id"] for r in kept[1]) == Counter(r["doc_id"] for r in kept[0])
    assert sum("A license line" in r["text"] for r in kept[1]) == 1
    prints = [plain_fingerprint(r["text"]) for r in kept[1]]
    assert Counter(r["doc_id"] for r in kept[2]) == one_of_each([r["doc_id"] for r in kept[1]], lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    assert all(n <= 3 for n in Counter(r["doc_id"] for r in kept[3] if r["doc_id"] not in (None, 904, 905)).values())
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset", "ids_crc32"} <= set(last.columns) and last.count() >= len(ids[3])


@pytest.mark.parametrize("many", [16, 2])
def test_near_dedup_takes_all_copies_of_similarity(spark, many, monkeypatch):
    """Copies whose five-word shingles agree to 0.8 go, however many bits of their fingerprints differ."""
    monkeypatch.setattr(jaccard, "MANY", many)
    rng, rows = random.Random(21), []
    for i in range(12):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 120))]
        for k in range(5):
            own = words[:]
            for at in rng.sample(range(len(own)), k):
                own[at] = f"new{i}x{k}x{at}"
            rows.append((i * 10 + k, " ".join(own), "en", "s", 1))
    rows += [(500, "one text", "en", "s", 1), (500, "another text", "en", "s", 1), (501, None, "en", "s", 1), (None, rows[0][1], "en", "s", 1)]
    rows += [(None, "only a row without an id has this text", "en", "s", 1), rows[3]]

    def sets(text):
        w = (text or "").split()
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    held, prints = [sets(r[1]) for r in rows], [plain_fingerprint(r[1]) for r in rows]
    alike = lambda i, j: bool(held[i] and held[j]) and len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j])
    near = lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2
    assert any(alike(i, j) and not near(i, j) for i in range(len(rows)) for j in range(i))
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    assert Counter(r["doc_id"] for r in got) == one_of_each([r[0] for r in rows], lambda i, j: alike(i, j) or near(i, j))
    assert {r["text"] for r in got if r["doc_id"] == 500} == {"one text", "another text"}


def one_of_each(ids, linked):
    """How often each id stays where of each group the row of the smallest id does; none comes after all."""
    first = smallest_reachable(list(range(len(ids))), linked)
    least = {}
    for i, top in zip(ids, first):
        least[top] = min(least.get(top, (True, 0)), (i is None, i or 0))
    return Counter(None if none else i for none, i in least.values())


def test_registry_has_the_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
