import zlib

import numpy as np
import pytest

from inkspark.llm import langid, toxicity
from tests.llm.data import awkward, documents, frame


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_language_held_out(spark):
    rows = documents(120) + awkward()
    got = langid.identify(frame(spark, rows, ["score", "lang_pred", "held_out", "other"]), langid.Settings(fit_rows=1000)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == lang and by_id[i]["held_out"] == held(i) for i, _, lang, _, _ in documents(120))
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["other"] == "mine" for r in got)
    for i in (900, 901, 902, 906):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert "lang" not in got[0].asDict()


def test_language_ignores_held_out_labels(spark):
    rows = documents(60)
    changed = [(i, t, "xx" if held(i) else lang, s, n) for i, t, lang, s, n in rows]
    one, two = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(frame(spark, x)).collect()} for x in (rows, changed))
    assert one == two


def test_language_without_rows_or_labels(spark):
    assert langid.identify(frame(spark, [])).collect() == []
    got = langid.identify(frame(spark, [(1, "some words", None, "s", 10)])).collect()
    assert got[0]["lang_pred"] == "und"


def toxic_rows(n=160):
    rows, marks = [], []
    for i, (k, text, *rest) in enumerate(documents(n, 9)):
        bad = i % 4 == 0
        words = text.split(" ")
        if bad:
            words[len(words) // 2] = ["grumblewort", "snarkfoul"][i % 8 // 4]
        rows.append((k, " ".join(words), *rest))
        marks.append((k, int(bad)))
    return rows, marks


def test_toxicity_held_out_and_misspelt(spark):
    rows, marks = toxic_rows()
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    odd = awkward() + [(950, "the river and the grumblewrt of the market", "en", "s", 1)]
    got = toxicity.classify(frame(spark, rows + odd, ["score", "predicted", "other"]), labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(marks)
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in tested]) >= 0.95
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[950] > np.median([scores[k] for k, bad in marks if not bad])
    assert all(r["predicted"] == int(r["score"] >= 0.3) and r["other"] == "mine" for r in got)
    assert scores[900] == pytest.approx(scores[901])


def test_toxicity_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classify(frame(spark, []), none).collect() == []
    assert [r["score"] for r in toxicity.classify(frame(spark, [(1, "a b", None, None, 3)]), none).collect()] == [0.5]
    partly = spark.createDataFrame([(1, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    assert len(toxicity.classify(frame(spark, documents(8)), partly).collect()) == 8


def plain_grams(word, s):
    """A word's buckets by the definition: mixed polynomial hashes of marked character n-grams, and of the word as a whole."""
    mod, prime, mix = 1 << 64, 1099511628211, 0x9E3779B97F4A7C15
    points, out = [ord(c) for c in f"<{word}>"], []
    for n in range(s.shortest, s.longest + 1):
        for i in range(len(points) - n + 1):
            h = n
            for p in points[i : i + n]:
                h = (h * prime + p) % mod
            h ^= h >> 29
            h = h * mix % mod
            out.append((h ^ h >> 32) % s.buckets)
    whole = sum(p * pow(prime, i, mod) for i, p in enumerate(points)) * mix % mod
    return [*out, (whole ^ whole >> 31) % s.buckets]


def test_language_is_naive_bayes(spark):
    """Predictions and posteriors are those of a multinomial naive Bayes played through word by word."""
    import math
    from collections import Counter, defaultdict

    s = langid.Settings(buckets=512, fit_rows=10_000)
    rows = [r for r in documents(40) + awkward() if r[0] != 903] + [(700 + i, f"the le {x} rue", ["en", "fr", "de"][i % 3], "s", 9) for i, x in enumerate(["ß", "été", "12", "water", "maison", "x!"])]
    grams = lambda text: [b for w in (text or "").lower().split() if any(c.isalpha() for c in w) for b in plain_grams(w, s)]
    counts, priors = defaultdict(Counter), Counter()
    for i, text, lang, *_ in rows:
        if lang is not None and text is not None and not held(i):
            counts[lang].update(grams(text))
            priors[lang] += 1
    totals = {lang: sum(c.values()) + s.smoothing * s.buckets for lang, c in counts.items()}
    got = langid.identify(frame(spark, [(k, *r[1:]) if r[0] is None else r for k, r in enumerate(rows)]), s).collect()
    by_text = {r["text"]: r for r in got}
    for _, text, *_ in rows:
        own = grams(text)
        if not own:
            assert by_text[text]["lang_pred"] == "und"
            continue
        logs = {x: math.log(priors[x] / sum(priors.values())) + sum(math.log((counts[x][b] + s.smoothing) / totals[x]) for b in own) for x in priors}
        best = max(sorted(logs), key=logs.get)
        assert by_text[text]["lang_pred"] == best
        assert by_text[text]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-3)


def test_language_has_a_bounded_number(spark):
    rows = [(i, f"word{i % 9} text", f"l{i % 9}", "s", 9) for i in range(60)]
    langs, matrix, _ = langid.fit(frame(spark, rows), langid.Settings(most_langs=4))
    assert len(langs) == 4 and matrix.shape[1] == 4


def test_toxicity_margin_is_that_of_the_worst_window():
    import pyarrow as pa

    s = toxicity.Settings(buckets=1024)
    rng = np.random.default_rng(1)
    weights, bias = rng.normal(size=s.buckets), 0.3
    texts = ["one two three four five six seven eight", "", None, "alone", " ".join(f"w{i}" for i in range(2000)), "Same SAME same"]
    expected = []
    for text in texts:
        words = (text or "").lower().split()
        best = -np.inf
        for low in range(0, max(1, len(words)), s.window):
            grams = [b for w in words[low : low + s.window] for b in plain_grams(w, s)]
            best = max(best, (weights[grams].mean() if grams else 0) + bias)
        expected.append(best)
    assert toxicity.margins(pa.array(texts), weights, bias, s) == pytest.approx(expected)


def test_toxicity_sample_takes_what_is_there(spark):
    """Labels of documents that aren't there use up no place, long texts are in, and characters are bounded."""
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(10_000)], "doc_id long, toxic int")
    rows = [(i * 50, f"text {i} " + "long " * (20_000 if i < 3 else 1), "en", "s", 1) for i in range(200)] + [(i * 50 + 1, f"fine {i}", "en", "s", 1) for i in range(200)] + [(3, None, "en", "s", 0)]
    docs = frame(spark, rows)
    texts, marks = toxicity.sample(docs, labels, "toxic", toxicity.Settings())
    usable = [r for r in rows if r[1] and not held(r[0]) and r[0] < 10_000]
    assert sorted(texts) == sorted(r[1] for r in usable) and int(marks.sum()) == sum(r[0] % 50 == 0 for r in usable)
    texts, marks = toxicity.sample(docs, labels, "toxic", toxicity.Settings(fit_rows=20, fit_chars=150))
    assert 2 <= len(texts) <= 40 and sum(len(t) for t, m in zip(texts, marks) if not m) <= 150
