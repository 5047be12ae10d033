"""Carried budgets, frozen selections, revisions and rebased spans: each code, and brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from inkspark.operators import audits

HEX = hashlib.sha256(b"x").hexdigest()
GRANTS = "grant_id string, document string, workspace string, user string, status string, sha string, reserved long, entries array<long>, payload_digest string, extraction string, created long"
BUDGETS = "grant_id string, document string, workspace string, user string, sha string, max_reserved long, pinned string, carries boolean"
CARRIED = "grant_id string, place int, carried_id string, payload_digest string, reserved long"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def chain_digest(items):
    total = 0
    for k, item in enumerate(items):
        total = (total + int(digest("|".join(map(str, item)))[:15], 16) * pow(audits.BASE, k, audits.MODULUS)) % audits.MODULUS
    return digest(f"{len(items)}:{total}") if items else digest("0:")


def test_budget_codes(spark):
    """A document for each case: grants a, b and c were made before d, which carries them with one thing changed."""
    cases = {
        "fine": {}, "missing": {"carry": lambda c: c[1:]}, "unknown": {"carry": lambda c: [*c, ("zz", HEX, 1)]}, "reordered": {"carry": lambda c: [c[0], c[2], c[1]]}, "digest": {"carry": lambda c: [(c[0][0], HEX, c[0][2]), *c[1:]]},
        "reserved": {"carry": lambda c: [c[0], (*c[1][:2], 99), c[2]]}, "twice": {"carry": lambda c: [*c, c[0]]}, "negative": {"carry": lambda c: [(*c[0][:2], -5), *c[1:]]}, "malformed": {"carry": lambda c: [(c[0][0], "no", c[0][2]), *c[1:]]},
        "pin": {"pin": HEX}, "legacy": {"carry": lambda c: [], "carries": False}, "running": {"status": "RUNNING"}, "owner": {"user": "other"}, "sha": {"old_sha": "other"}, "entries": {"entries": [1, 2]}, "negative entry": {"entries": [-5, 105]},
        "extraction": {"extraction": "none"}, "cap": {"max": 701}, "twin": {"sha": "shared"}, "twin too": {"sha": "shared"}, "alone": {"alone": True}, "alone unpinned": {"alone": True, "carries": False}}
    grants, budgets, carried, extractions = [], [], [], []
    for case, x in cases.items():
        old = [(f"{case}-{k}", digest(f"{case}{k}"), 100) for k in "abc"]
        first = True
        for k, (i, d, r) in enumerate([] if x.get("alone") else old):
            odd = k == 0
            grants.append((i, case, "w", x.get("user", "u") if odd else "u", x.get("status", "FAILED") if odd else "SUCCEEDED", x.get("old_sha", x.get("sha", case)) if odd else x.get("sha", case), r, x.get("entries", [40, 60]) if odd else [100], d, x.get("extraction", f"e-{case}") if odd else f"e-{case}", k))
            first = False
        grants.append((f"{case}-d", case, "w", "u", "RUNNING", x.get("sha", case), 0, [], digest(case), f"e-{case}", 9))
        extractions.append((f"e-{case}", "w", case))
        own = x.get("carry", list)([] if x.get("alone") else old)
        carried += [(f"{case}-d", k, *item) for k, item in enumerate(own)]
        carries = x.get("carries", True)
        budgets.append((f"{case}-d", case, "w", "u", x.get("sha", case), x.get("max", 700), x.get("pin", chain_digest(own)) if carries else None, carries))
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((budgets, BUDGETS), (carried, CARRIED), (grants, GRANTS), (extractions, "extraction string, workspace string, document string"))]
    rows = {r["grant_id"][:-2]: r for r in audits.budget_audit(*frames, 1000).collect()}
    got = {case: r["codes"] for case, r in rows.items()}
    assert got == {
        "fine": [], "missing": ["MISSING_GRANT"], "unknown": ["UNKNOWN_GRANT", "BUDGET_EXCEEDED"], "reordered": ["REORDERED"], "digest": ["PAYLOAD_CHANGED"], "reserved": ["RESERVATION_CHANGED"], "twice": ["SHAPE", "BUDGET_EXCEEDED"],
        "negative": ["SHAPE", "RESERVATION_CHANGED"], "malformed": ["SHAPE", "PAYLOAD_CHANGED"], "pin": ["PIN_CHANGED"], "legacy": ["LEGACY_PEERS"], "running": ["STATUS"], "owner": ["OWNER"], "sha": ["PAYLOAD_CHANGED"],
        "entries": ["RESERVATION_CHANGED"], "negative entry": ["RESERVATION_CHANGED"], "extraction": ["EXTRACTION"], "cap": ["BUDGET_EXCEEDED"], "twin": ["DUPLICATE_SOURCE"], "twin too": ["DUPLICATE_SOURCE"], "alone": [], "alone unpinned": []}
    assert rows["reordered"]["first_difference"] == 1 and rows["fine"]["first_difference"] is None


def test_chains_add_up(spark):
    rows = [("g", k, f"i{k}", digest(str(k)), k * 7) for k in range(250)]
    df = spark.createDataFrame(rows, CARRIED)
    found = {r["place"]: int(r["chain"]) for r in audits.chained(df.withColumnRenamed("place", "at"), "grant_id", ["at"], audits.receipt("carried_id")).collect()}
    total = 0
    for k, (_, _, *item) in enumerate(rows):
        total = (total + int(digest("|".join(map(str, item)))[:15], 16) * pow(audits.BASE, k, audits.MODULUS)) % audits.MODULUS
        assert found[k] == total
    assert audits.budget_digests(df).first()["digest"] == chain_digest([r[2:] for r in rows])
    big = 2**39 + 12345
    assert int(spark.range(1).select(audits.power(F.lit(big).cast("long")).alias("p")).first()["p"]) == pow(audits.BASE, big, audits.MODULUS)


def test_differing_rows_against_a_plain_comparison(spark):
    rng = random.Random(4)
    for most, fanout in ((300, 4), (300, 64), (0, 4)):
        one = {(run, k): digest(f"{run}{k}") for run in "abc" for k in range(most + 1) if rng.random() < 0.9}
        two = {key: d if rng.random() < 0.97 else HEX for key, d in one.items() if key[0] == "c" or rng.random() < 0.98} | {("a", most + 5): HEX, ("d", 1): HEX}
        two |= {key: d for key, d in one.items() if key[0] == "c"}
        frames = [spark.createDataFrame([(*key, d) for key, d in x.items()], "run string, ordinal long, digest string") for x in (one, two)]
        got = {(r["run"], r["ordinal"]): (r["one"], r["two"]) for r in audits.differing(*frames, fanout=fanout).collect()}
        assert got == {key: (one.get(key), two.get(key)) for key in one.keys() | two.keys() if one.get(key) != two.get(key)}
    assert audits.differing(frames[0].limit(0), frames[0].limit(0)).collect() == []


def test_rows_of_one_ordinal_and_what_moves(spark):
    """Equal digests at one ordinal don't cancel each other, and the rows of either selection move once, as numbers."""
    one = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", 2, "y"), ("a", 3, "x"), ("a", 3, "x"), ("a", 4, "x"), ("b", 4, None), ("b", 7, None), (None, 5, "x"), ("c", None, "x")]
    two = [("a", 1, "y"), ("a", 1, "y"), ("a", 2, "y"), ("a", 2, "x"), ("a", 3, "x"), ("a", 4, "x"), ("b", 4, "x"), ("b", 6, "x"), ("b", 7, None)]
    frames = [spark.createDataFrame(x, "run string, ordinal long, digest string") for x in (one, two)]
    got = audits.unlike(*frames)
    assert {tuple(r) for r in got.collect()} == {("a", 1, 2, 2), ("a", 3, 2, 1), ("b", 4, 1, 1), ("b", 6, 0, 1)}
    assert {(r["run"], r["ordinal"]) for r in audits.differing(*frames).collect()} == {("a", 1), ("a", 3), ("b", 4), ("b", 6)}


def test_frozen_ids_that_are_there_twice_or_null(spark):
    good = digest("x")
    selection = [("r", 1, "a", good), ("r", 2, "a", "bad"), ("r", 3, "b", good), ("r", 4, "b", good), ("r", 5, None, good), ("r", 6, "c", good)]
    got = audits.frozen_audit(
        spark.createDataFrame(selection, "run string, ordinal int, artifact_id string, digest string"), spark.createDataFrame([(*x, "line") for x in selection], "run string, ordinal int, artifact_id string, digest string, lineage string"),
        spark.createDataFrame([("r", "line")], "run string, lineage string"), spark.createDataFrame([("r", "a"), ("r", "c"), ("r", None), ("r", "d")], "run string, artifact_id string"))
    assert sorted((r["ordinal"], r["code"]) for r in got.collect()) == [(1, "INVALID"), (2, "INVALID"), (3, "INVALID"), (3, "RECEIPT"), (4, "INVALID"), (4, "RECEIPT"), (5, "RECEIPT")]


def test_frozen_codes(spark):
    rows = [("r", k, f"a{k}", digest(str(k))) for k in range(20)]
    selection = [*rows[:3], ("r", 3, "a3", HEX), *rows[4:18], ("r", 18, "a17", rows[17][3]), ("r", 30, "gone", HEX), ("r", 31, "odd", "no digest")]
    artifacts = [(*row, "other" if row[1] == 5 else "line") for row in rows]
    receipts = [("r", f"a{k}") for k in range(20) if k != 7] + [("r", "a8"), ("r", "gone"), ("r", "odd")]
    got = audits.frozen_audit(
        spark.createDataFrame(selection, "run string, ordinal int, artifact_id string, digest string"), spark.createDataFrame(artifacts, "run string, ordinal int, artifact_id string, digest string, lineage string"),
        spark.createDataFrame([("r", "line")], "run string, lineage string"), spark.createDataFrame(receipts, "run string, artifact_id string"))
    assert sorted((r["ordinal"], r["code"]) for r in got.collect()) == [
        (3, "CHANGED"), (5, "LINEAGE"), (7, "RECEIPT"), (8, "RECEIPT"), (17, "INVALID"), (18, "CHANGED"), (18, "INVALID"), (19, "UNFROZEN"), (30, "INCOMPLETE"), (31, "INCOMPLETE"), (31, "INVALID")]


def test_rebased_against_brute_force(spark):
    rng, edits, spans, want = random.Random(6), [], [], []
    for block in range(40):
        places = sorted(rng.sample(range(30), rng.randrange(0, 9)))
        own = []
        while places:
            start = places.pop(0)
            finish = start if rng.random() < 0.4 or not places else places.pop(0)
            if not own or own[-1][1] < start or (own[-1][1] == start and own[-1][0] < start and finish > start):
                own.append((start, finish, "xy😀"[: rng.randrange(4)]))
        edits += [(block, *e) for e in own]
        for span in range(12):
            first = rng.randrange(29)
            last = rng.randrange(first + 1, 30)
            spans.append((block, f"s{span}", first, last))
            cut = any(first < s < last if s == f else s < last and f > first for s, f, _ in own)
            moved = sum(len(t.encode("utf-16-le")) // 2 - (f - s) for s, f, t in own if f <= first)
            want.append((block, f"s{span}", None if cut else first + moved, None if cut else last + moved, cut))
    got = audits.rebased(spark.createDataFrame(spans, "block_id int, span_id string, first int, last int"), spark.createDataFrame(edits, "block_id int, start int, finish int, text string"))
    assert sorted(map(tuple, got.select("block_id", "span_id", "first", "last", "cut").collect()), key=repr) == sorted(want, key=repr)
    assert {x[4] for x in want} == {True, False}


def test_revision_codes(spark):
    blocks = spark.createDataFrame([("b", "a text 😀 of some length"), ("c", "another")], "block_id string, content string")
    chunks = spark.createDataFrame([("b", 0, 10), ("b", 8, 20), ("c", 2, 7)], "block_id string, first int, last int")
    memories = spark.createDataFrame([("r", f"m{k}", f"content {k}") for k in range(4)], "run string, memory_id string, content string")
    reasons = {"no reason": " ", "long reason": "x" * 2001}
    cases = {
        "fine": ([("m0", None), ("m1", "new"), ("m2", "newer"), ("m3", "content 3")], []), "no reason": ([], []), "long reason": ([], []), "archive": ([], []), "no summary evidence": ([], []), "twice": ([("m0", "x"), ("m0", "y")], []), "nobody": ([("zz", "x")], []),
        "empty text": ([("m0", "  ")], []), "uncited": ([("m0", "x")], []), "range": ([], [("b", 0, 99, None)]), "pair": ([], [("b", 0, 8, None)]), "quote": ([], [("b", 0, 6, "a test")]), "block": ([], [("gone", 0, 1, None)]),
        "outside": ([], [("c", 0, 4, None)]), "across chunks": ([], [("b", 5, 20, None)]), "beyond chunks": ([], [("b", 15, 22, None)]), "changed": ([], [])}
    revisions, changes, evidence = [], [], []
    for case, (own, more) in cases.items():
        revisions.append((case, "r", reasons.get(case, "why"), "no" if case == "archive" else HEX, "summary", HEX if case == "changed" else None))
        changes += [(case, *change) for change in own]
        evidence += [(case, m, "b", 2, 6, "text") for m in dict.fromkeys(m for m, _ in own) if case != "uncited"]
        evidence += [] if case == "no summary evidence" else [(case, None, "b", 0, 6, None)]
        evidence += [(case, None, *e) for e in more]
    vectors = spark.createDataFrame([("m1", digest("new")), ("m2", digest("other"))], "memory_id string, input_hash string")
    audit, states = audits.revision_audit(
        spark.createDataFrame(revisions, "revision_id string, run string, reason string, archive_sha256 string, summary string, recorded string"), spark.createDataFrame(changes, "revision_id string, memory_id string, text string"),
        spark.createDataFrame(evidence, "revision_id string, memory_id string, block_id string, first int, last int, quote string"), memories, blocks, chunks, vectors)
    rows = {r["revision_id"]: r for r in audit.collect()}
    bad = {"no reason": ["PATCH_INVALID"], "long reason": ["PATCH_INVALID"], "archive": ["PATCH_INVALID"], "no summary evidence": ["PATCH_INVALID"], "twice": ["DUPLICATE_TARGET"], "nobody": ["TARGET_NOT_FOUND"], "empty text": ["PATCH_INVALID"], "uncited": ["PATCH_INVALID"],
           "range": ["EVIDENCE_INVALID"], "pair": ["EVIDENCE_INVALID"], "quote": ["EVIDENCE_INVALID"], "block": ["EVIDENCE_INVALID"], "outside": ["EVIDENCE_OUTSIDE_CHUNKS"], "beyond chunks": ["EVIDENCE_OUTSIDE_CHUNKS"], "changed": ["CONTENT_CHANGED"]}
    assert {case: r["codes"] for case, r in rows.items()} == {case: bad.get(case, []) for case in cases}
    parts = sorted([f"m:m{k}:{digest(f'content {k}')}" for k in range(4)] + [f"b:b:{digest('a text 😀 of some length')}"])
    assert rows["fine"]["original_hash"] == digest(",".join(parts))
    assert {r["memory_id"]: r["vector_state"] for r in states.where("revision_id = 'fine'").collect()} == {"m0": "REUSE", "m1": "REFRESHED", "m2": "REFRESH_REQUIRED", "m3": "REUSE"}


def test_packed_digests_are_half_as_long_and_apart_from_other_texts(spark):
    values = [digest("a"), digest("b"), digest("a").upper(), "", "\1" + "x" * 32, "x" * 32, None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", audits.packed(F.col("v")).alias("p"), audits.number(F.col("v")).alias("n")).collect()
    assert len({bytes(r["p"]) for r in rows if r["p"] is not None}) == 6 and rows[-1]["p"] is None
    assert all(len(r["p"]) == 33 and r["p"][0] == 1 for r in rows[:2]) and all(r["p"][0] == 0 for r in rows[2:6])
    assert rows[0]["n"] == int(digest(digest("a"))[:15], 16)
