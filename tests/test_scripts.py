"""Script evaluation, each of its codes, and copies of sources at any offset."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from inkspark.operators import copies, dialogue, scripts

TURNS = "script string, turn int, host string, text string, kind string, substantive boolean, evidence array<string>, segment int"
STYLES = "script string, host_count int, debate int, formality int, interruption int, summary_density int, within_budget boolean"


def script(name, turns):
    """Turns given as (host, text[, kind[, evidence[, substantive]]])."""
    out = []
    for i, (host, text, *rest) in enumerate(turns):
        kind, evidence = (rest + ["STATEMENT", None][len(rest):])[:2] if len(rest) < 2 else rest[:2]
        out.append((name, i, host, text, kind, rest[2] if len(rest) > 2 else evidence is not None, evidence or [], i // 4))
    return out


def lengths(n, seed=0):
    """Sentences without a common word, of quite different lengths."""
    rng = random.Random(seed)
    return [" ".join(f"{chr(97 + seed % 26)}{i}x{k}" for k in range(rng.choice([2, 9, 17, 30]) + i % 7)) for i in range(n)]


SOURCE = "".join(f"passage {i} of a source that nobody should read aloud " for i in range(40))
WORDS = lengths(12, 1)
SCRIPTS = {
    "grounded": script("grounded", [("a", WORDS[0], "QUESTION"), ("a", WORDS[1], "STATEMENT", ["m1"]), ("b", "yes", "REACTION"), ("b", WORDS[3], "STATEMENT", ["m2"])]),
    "unsupported": script("unsupported", [("a", WORDS[0], "STATEMENT", [], True), ("b", WORDS[1])]),
    "fabricated": script("fabricated", [("a", "When I worked at a bank it was so", "EXAMPLE"), ("b", "我去年刚开始创业")]),
    "budget": script("budget", [("a", WORDS[0]), ("b", WORDS[1])]),
    "copied": script("copied", [("a", WORDS[0]), ("b", SOURCE[31:400].upper() + "!!!")]),
    "split copy": script("split copy", [(h, SOURCE[100 + 45 * k : 145 + 45 * k]) for k, h in enumerate("abab")]),
    # Shingles begin where the source's own do.
    "overlap": script("overlap", [("a", SOURCE[18:318] + " ".join(WORDS[:3]))]),
    "tasteless": script("tasteless", [("ab"[i % 2], "你说得对 首先 让我们深入探讨 那么问题来了？") for i in range(10)]),
    "collapse": script("collapse", [("a", x) for x in lengths(20, 2)] + [("b", "q w e r t y")]),
    "repetition": script("repetition", [("ab"[i % 2], "one two three four five six seven") for i in range(32)]),
    "cycle": script("cycle", [("abc"[i % 3], x) for i, x in enumerate(lengths(12, 3))]),
    "abandoned": script("abandoned", [("a", WORDS[4], "CHALLENGE"), ("b", WORDS[5]), ("b", WORDS[6])]),
    "answered": script("answered", [("a", WORDS[4], "CHALLENGE"), ("b", WORDS[5]), ("b", WORDS[6], "STATEMENT", ["m"])]),
    "summaries": script("summaries", [("a", "总而言之 " + WORDS[7]), ("b", WORDS[8])]),
    "formal": script("formal", [("a", "首先 " + WORDS[9]), ("b", WORDS[10])]),
    "silent": script("silent", [("aabb"[i % 4], x) for i, x in enumerate(lengths(9, 5))]),
}
STYLED = [("budget", None, None, None, None, None, False), ("summaries", None, None, None, None, 3, None), ("formal", None, None, 7, None, None, True), ("silent", None, 7, None, 2, None, None)]


def test_every_failure_and_warning(spark):
    turns = spark.createDataFrame([r for rows in SCRIPTS.values() for r in rows], TURNS)
    sources = spark.createDataFrame([(1, "before " + SOURCE), (2, ""), (3, None)], "source_id long, text string")
    got = {r["script"]: r for r in scripts.evaluation(turns, sources, spark.createDataFrame(STYLED, STYLES)).collect()}
    failures = {name: r["hard_failures"] for name, r in got.items()}
    assert failures["grounded"] == [] and got["grounded"]["grounding"] == 100 and got["grounded"]["source_copy"] == 100
    assert failures["unsupported"] == ["UNSUPPORTED_SUBSTANTIVE_CLAIM"] and got["unsupported"]["grounding"] == 0
    assert failures["fabricated"] == ["FABRICATED_BIOGRAPHY"] and got["fabricated"]["fabrication_boundary"] == 0
    assert failures["budget"] == ["CONTEXT_BUDGET_VIOLATION"] and got["budget"]["context_budget"] == 0
    assert failures["copied"] == ["SOURCE_COPY_HARD_GATE"] and got["copied"]["source_copy"] == 0 and got["copied"]["utterance_risk"] == 1
    # No turn of it is long enough by itself.
    assert failures["split copy"] == ["SOURCE_COPY_HARD_GATE"] and (got["split copy"]["utterance_risk"], got["split copy"]["segment_risk"]) == (0, 1)
    assert failures["tasteless"] == ["AI_TASTE_SEVERE"] and got["tasteless"]["ai_feel"] < 15
    assert failures["collapse"] == ["HOST_COLLAPSE"] and failures["repetition"] == ["EXTREME_REPETITION"]
    warnings = {name: r["warnings"][1:] for name, r in got.items()}
    assert all(r["warnings"][0] == "SEMANTIC_SUPPORT_NOT_ASSESSED" for r in got.values())
    seen = {w for own in warnings.values() for w in own}
    assert warnings["tasteless"][:7] == ["STRICT_ALTERNATION_HIGH", "GENERIC_AGREEMENT_DENSITY", "FORMAL_TRANSITION_DENSITY", "META_PRESENTER_DENSITY", "ADJACENT_RESTATEMENT_HIGH", "TURN_LENGTHS_TOO_SYMMETRIC", "HOSTS_TOO_SIMILAR"]
    assert "CYCLIC_SPEAKER_PATTERN_HIGH" in warnings["cycle"] and "CHALLENGE_ABANDONED" in warnings["abandoned"] and "CHALLENGE_ABANDONED" not in warnings["answered"]
    assert "SUMMARY_DENSITY_HIGH" in warnings["summaries"] and "FORMAL_TRANSITION_DENSITY" not in warnings["formal"]
    assert "CHALLENGES_MISSING" in warnings["silent"] and "SHORT_REACTIONS_MISSING" not in warnings["silent"] and "SHORT_REACTIONS_MISSING" in warnings["cycle"]
    assert "SOURCE_COPY_OVERLAP" in warnings["copied"] and "SOURCE_COPY_OVERLAP" in warnings["overlap"] and failures["overlap"] == []
    assert len(seen) == 13
    assert scripts.evaluation(turns.limit(0), sources).collect() == []


def plain_overlap(text, sources):
    norm = lambda s: re.sub(r"[\W_]+", "", s.lower())
    wide = lambda s: [s.encode("utf-16-le")[2 * i : 2 * i + 120] for i in range(0, max(0, len(s.encode("utf-16-le")) // 2 - 59), 20)]
    x, held = norm(text), [norm(s) for s in sources]
    units = len(x.encode("utf-16-le")) // 2
    if units < 60:
        return 0.0
    if units >= 120 and any(x in y for y in held):
        return 1.0
    pool = {p for y in held for p in wide(y)}
    own = wide(x)
    return sum(p in pool for p in own) / len(own)


def test_overlap_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé𝒜中") for _ in range(rng.randrange(1, 9)))
    sources = [" ".join(word() for _ in range(rng.randrange(0, 300))) for _ in range(12)] + ["ab " * 400]
    texts = [" ".join(word() for _ in range(60)) for _ in range(5)] + ["", "short", "ab" * 90, "ab" * 70 + "c"]
    for s in sources:
        for _ in range(4):
            low = rng.randrange(len(s) + 1)
            texts.append(s[low : low + rng.choice([70, 130, 200, 400])] + rng.choice(["", "", " x", "zzz" * 50]))
    frames = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(list(enumerate(sources)), "source_id long, text string")
    made = [f.withColumn("plain", copies.plain(F.col("text"))) for f in frames]
    got = {r["id"]: r["risk"] for r in copies.overlap(made[0].select("id", "plain"), ["id"], made[1].select("source_id", "plain")).collect()}
    assert got == {i: plain_overlap(t, sources) for i, t in enumerate(texts)}
    assert {0.0, 1.0} < set(got.values())
    # Runs of a long source overlap enough.
    points = np.random.default_rng(0).integers(97, 123, 3000).astype(np.uint16)
    h, width = copies.hashes(points), copies.WHOLE - copies.SHINGLE + 1
    whole = {int(x) for x in copies.probe(h)}
    assert whole == {int(h[i : i + width].min()) for i in range(len(h) - width + 1)}
    in_runs = set()
    for low in range(0, len(points) - copies.SHINGLE + 1, 700):
        in_runs |= {int(x) for x in copies.probe(copies.hashes(points[low : low + 700 + copies.WHOLE - 1]))}
    assert whole == in_runs


def test_called_back_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(s, k, " ".join(rng.choice("the of a b c d e f g h i j k l m n o p".split()) for _ in range(rng.randrange(0, 9))), [f"m{rng.randrange(40)}"] if rng.random() < 0.3 else []) for s in range(6) for k in range(40)]
    turns = spark.createDataFrame(rows, "script int, turn int, text string, evidence array<string>")
    got = {(r["script"], r["turn"]): r["called_back"] for r in dialogue.called_back(turns.where("turn % 2 = 0"), turns, 0.5).collect()}
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.5 if a | b else False
    by = {(s, k): (set(text.split()), set(ids)) for s, k, text, ids in rows}
    want = {(s, k): any(alike(by[s, k][0], by[s, j][0]) or by[s, k][1] & by[s, j][1] for j in range(k - 1)) for s, k in by if k % 2 == 0}
    assert got == {key: bool(v) for key, v in want.items()} and len(set(got.values())) == 2
