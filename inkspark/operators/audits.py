"""Audits of what was promised against what is there: carried budgets, frozen selections, revisions and the spans they move."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.text import span_error, units
from inkspark.operators.relations import islands
from inkspark.operators.scripts import codes
from inkspark.sources.tables import checkpointed

#: Modulus and base of chained digests: sums of digest * base^place, which add up over parts in any grouping.
MODULUS, BASE, BITS = 2**61 - 1, 1_000_003, 40
DIGEST = "^[a-f0-9]{64}$"
# The most grants carried, what grants may have come to, and the limits of a revision's patch.
MOST_CARRIED = 200
#: Rows that may be broadcast; more are joined by shuffle.
FEW = 1_000_000
SETTLED = ["SUCCEEDED", "FAILED", "CANCELLED"]
REASON, TEXT, SUMMARY_EVIDENCE, CHANGES, CHANGE_EVIDENCE, KEY = 2000, 20_000, 128, 64, 32, 128


def whole(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("decimal(19,0)")


def power(place: Column) -> Column:
    """BASE^place modulo MODULUS, by the bits of ``place``."""
    squares = F.array(*(whole(pow(BASE, 2**k, MODULUS)) for k in range(BITS)))
    step = lambda product, k: F.when(F.call_function("shiftright", place, k).bitwiseAND(F.lit(1)) == 1, whole((product * squares[k]) % whole(MODULUS))).otherwise(product)
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), whole(1), step)


def number(element: Column) -> Column:
    """60 bits of an element's digest."""
    return F.conv(F.left(F.sha2(element, 256), F.lit(15)), 16, 10).cast("long")


def packed(digest: Column) -> Column:
    """Digests as bytes, half as long; other texts stay apart from them."""
    return F.when(digest.rlike(DIGEST), F.concat(F.lit(b"\1"), F.unhex(digest))).otherwise(F.concat(F.lit(b"\0"), F.encode(digest, "UTF-8")))


def chained(rows: DataFrame, key: str, order: list[str], element: Column) -> DataFrame:
    """``rows`` with ``place`` in their key's order, from 0, and ``chain``: the digest of all elements up to there."""
    return linked(rows.withColumn("_number", number(element)), key, order)


def linked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``chained`` of rows whose elements are a ``_number`` already, which alone moves."""
    by = Window.partitionBy(key).orderBy(*order)
    placed = rows.withColumn("place", (F.row_number().over(by) - 1).cast("long"))
    termed = placed.withColumn("_term", whole((whole(F.col("_number")) * power(F.col("place"))) % whole(MODULUS)))
    upto = F.sum("_term").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return termed.withColumn("chain", (upto % F.lit(str(MODULUS)).cast("decimal(38,0)")).cast("decimal(19,0)")).drop("_term", "_number")


def receipt(name: str) -> Column:
    return F.concat_ws("|", name, "payload_digest", F.col("reserved").cast("string"))


def budget_digests(carried: DataFrame) -> DataFrame:
    """(grant_id, digest) of the grants that each budget carries (grant_id, place, carried_id, payload_digest, reserved), in order."""
    chains = chained(carried.withColumnRenamed("place", "at"), "grant_id", ["at"], receipt("carried_id"))
    last = chains.groupBy("grant_id").agg(F.max(F.struct("place", "chain")).alias("x"))
    return last.select("grant_id", F.sha2(F.concat_ws(":", (F.col("x.place") + 1).cast("string"), F.col("x.chain").cast("string")), 256).alias("digest"))


def budget_audit(budgets: DataFrame, carried: DataFrame, grants: DataFrame, extractions: DataFrame, limit: int) -> DataFrame:
    """(grant_id, codes, first_difference): what is wrong with each budget, in order of the checks; empty if nothing is.

    ``budgets`` has (grant_id, document, workspace, user, sha, max_reserved, pinned, carries), ``grants`` all grants with (grant_id,
    document, workspace, user, status, sha, reserved, entries, payload_digest, extraction, created), ``extractions`` (extraction,
    workspace, document). A budget must carry each other grant of its document, as it was, settled, and in the order in which they
    were made; ``first_difference`` is the first place where the order isn't that. Failed grants count in full.
    """
    of = budgets.select(F.col("grant_id").alias("own"), "document", "workspace", "user", "sha", "max_reserved", "pinned", "carries")
    owner = of.select("own", "document", "workspace", F.col("user").alias("own_user"), F.col("sha").alias("own_sha"))
    # What only this audit asks of a grant is answered where it is, so that the answers move and not what they are about.
    total = F.when(F.exists("entries", lambda x: x.isNull() | (x < 0)), None).otherwise(F.aggregate("entries", F.lit(0).cast("long"), lambda a, x: a + x))
    settled = F.coalesce(F.col("status").isin(SETTLED), F.lit(False))
    asked = grants.select("workspace", "document", F.col("grant_id").alias("peer"), "user", F.col("sha").alias("of_sha"), "reserved", packed(F.col("payload_digest")).alias("digest"), number(receipt("grant_id")).alias("_number"), "extraction", "created", settled.alias("settled"), total.alias("total"))
    known = extractions.select("extraction", "workspace", "document").distinct().withColumn("extracted", F.lit(True))
    asked = asked.join(known, ["extraction", "workspace", "document"], "left").drop("extraction")
    peers = owner.join(asked, ["workspace", "document"]).where("own <> peer").select(
        "own", "peer", F.col("user").eqNullSafe(F.col("own_user")).alias("same_user"), F.col("of_sha").eqNullSafe(F.col("own_sha")).alias("same_sha"), "settled", "reserved", "total", "digest", "_number", F.col("extracted").isNotNull().alias("extracted"), "created")
    listed = carried.select(F.col("grant_id").alias("own"), F.col("carried_id").alias("peer"), F.col("place").alias("at"), packed(F.col("payload_digest")).alias("said_digest"), F.col("reserved").alias("said"))
    both = peers.drop("created", "_number").join(listed, ["own", "peer"], "full_outer")
    here, there = F.col("settled").isNotNull(), F.col("at").isNotNull()
    odd = F.col("total").isNull() | (F.col("total") != F.col("said"))
    counts = both.groupBy("own").agg(
        F.count_if(here & ~there).alias("missing"), F.count_if(there & ~here).alias("unknown"), F.count_if(here).alias("peers"),
        F.count_if(here & there & ~F.col("same_user")).alias("owner"), F.count_if(here & there & ~F.col("settled")).alias("status"),
        F.count_if(here & there & ~(F.col("digest").eqNullSafe(F.col("said_digest")) & F.col("same_sha"))).alias("changed"),
        F.count_if(here & there & (~F.col("reserved").eqNullSafe(F.col("said")) | F.coalesce(odd, F.lit(True)))).alias("reservation"), F.count_if(here & there & ~F.col("extracted")).alias("extraction"),
        F.count_if(there).alias("n"), F.count_distinct(F.when(there, F.col("peer"))).alias("different"), F.coalesce(F.sum("said"), F.lit(0)).alias("gross"),
        F.count_if(there & (~F.coalesce(F.startswith("said_digest", F.lit(b"\1")), F.lit(False)) | F.coalesce(F.col("said") < 0, F.lit(True)) | (F.length(F.col("peer").cast("string")) == 0))).alias("malformed"))
    twins = of.select("own", "workspace", "document", "sha").join(grants.select("workspace", "sha", F.col("document").alias("other")).distinct(), ["workspace", "sha"]).where("other <> document").select("own").distinct().withColumn("twin", F.lit(True))
    made = linked(peers.select("own", "created", "peer", "_number"), "own", ["created", "peer"]).select("own", "place", F.col("chain").alias("made"))
    said = chained(carried.withColumnRenamed("place", "at"), "grant_id", ["at"], receipt("carried_id")).select(F.col("grant_id").alias("own"), "place", "chain")
    order = said.join(made, ["own", "place"]).where("chain <> made").groupBy("own").agg(F.min("place").alias("first_difference"))
    rows = of.join(counts, "own", "left").join(twins, "own", "left").join(order, "own", "left").join(budget_digests(carried).withColumnRenamed("grant_id", "own"), "own", "left")
    zero = [c for c in counts.columns if c != "own"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    digest = F.when(F.col("carries"), F.coalesce("digest", F.sha2(F.lit("0:"), 256)))
    whole_list = (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("changed") == 0) & (F.col("reservation") == 0)
    carries = F.col("carries")
    found = codes(
        (carries & ((F.col("n") > MOST_CARRIED) | (F.col("n") != F.col("different")) | (F.col("malformed") > 0)), "SHAPE"), (~F.col("pinned").eqNullSafe(digest), "PIN_CHANGED"), (F.col("twin").isNotNull(), "DUPLICATE_SOURCE"),
        (~carries & (F.col("peers") > 0), "LEGACY_PEERS"), (carries & (F.col("missing") > 0), "MISSING_GRANT"), (F.col("unknown") > 0, "UNKNOWN_GRANT"), (F.col("owner") > 0, "OWNER"), (F.col("status") > 0, "STATUS"),
        (F.col("changed") > 0, "PAYLOAD_CHANGED"), (F.col("reservation") > 0, "RESERVATION_CHANGED"), (F.col("extraction") > 0, "EXTRACTION"), (whole_list & F.col("first_difference").isNotNull(), "REORDERED"),
        (F.col("gross") + F.col("max_reserved") > limit, "BUDGET_EXCEEDED"))
    return rows.select(F.col("own").alias("grant_id"), found.alias("codes"), F.when(whole_list, F.col("first_difference")).alias("first_difference"))


def unlike(one: DataFrame, two: DataFrame) -> DataFrame:
    """(run, ordinal, ones, twos): ordinals at which the rows (run, ordinal, digest) of two selections differ, with the number of
    either's rows; written. Rows without a run or ordinal don't count.

    All rows meet once, as 120 bits of their digests' digests, combined by tasks before they move. Where a selection
    has several rows at an ordinal, all their digests are compared.
    """
    hashed = F.sha2(F.coalesce("digest", F.lit("\0")), 256)
    bits = [F.conv(F.substr(hashed, F.lit(at), F.lit(15)), 16, 10).cast("long") for at in (1, 16)]
    placed = [df.where("run is not null and ordinal is not null").select("run", F.col("ordinal").cast("long").alias("ordinal"), "digest") for df in (one, two)]
    sides = [df.select("run", "ordinal", bits[0].alias("x"), bits[1].alias("y"), F.lit(k == 0).alias("first")) for k, df in enumerate(placed)]
    met = sides[0].union(sides[1]).groupBy("run", "ordinal").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count_if("first").alias("ones"), F.count_if(~F.col("first")).alias("twos"))
    left = checkpointed(met.where("ones <> 1 or twos <> 1 or x <> 0 or y <> 0").select("run", "ordinal", "ones", "twos"))
    several = left.where("ones > 0 and twos > 0 and ones = twos and ones > 1").select("run", "ordinal")
    n = several.count()
    if not n:
        return left
    asked = F.broadcast(several) if n <= FEW else several
    gathered = (df.join(asked, ["run", "ordinal"], "left_semi").groupBy("run", "ordinal").agg(F.sort_array(F.collect_list("digest")).alias(name)) for df, name in zip(placed, ("a", "b")))
    same = next(gathered).join(next(gathered), ["run", "ordinal"]).where("a = b").select("run", "ordinal")
    return checkpointed(left.join(same, ["run", "ordinal"], "left_anti"))


def differing(one: DataFrame, two: DataFrame, fanout: int = 64) -> DataFrame:
    """(run, ordinal, one, two): the rows (run, ordinal, digest) in which two selections differ, null where one lacks them.

    Only rows of the ranges of ``fanout`` ordinals that hold an ``unlike`` one are looked at again. Rows of one ordinal are one, with
    a digest of all.
    """
    node = F.floor(F.col("ordinal").cast("long") / fanout).alias("node")
    ranges = unlike(one, two).select("run", node).distinct()
    ranges = F.broadcast(ranges) if ranges.count() <= FEW else ranges
    sides = (df.withColumn("node", node).join(ranges, ["run", "node"], "left_semi").groupBy("run", F.col("ordinal").cast("long").alias("ordinal")).agg(F.sort_array(F.collect_list("digest")).alias("all")).select(
        "run", "ordinal", F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.sha2(F.array_join("all", ","), 256)).alias(name)) for df, name in ((one, "one"), (two, "two")))
    return next(sides).join(next(sides), ["run", "ordinal"], "full_outer").where(~F.col("one").eqNullSafe(F.col("two"))).select("run", "ordinal", "one", "two")


def frozen_audit(selection: DataFrame, artifacts: DataFrame, runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """(run, ordinal, code): rows of a frozen selection (run, ordinal, artifact_id, digest) that are no longer as they were frozen.

    ``artifacts`` (run, ordinal, artifact_id, digest, lineage) are those there are, ``runs`` (run, lineage) what they must come from,
    ``receipts`` (run, artifact_id) what was paid. Codes: INVALID (an id twice, or a digest that is none), INCOMPLETE (frozen, but gone),
    UNFROZEN (there, but not frozen), CHANGED, LINEAGE, RECEIPT (none, or more than one).
    """
    leaf = F.concat_ws("|", "artifact_id", "digest").alias("digest")
    code = F.when(F.col("twos") == 0, "INCOMPLETE").when(F.col("ones") == 0, "UNFROZEN").otherwise("CHANGED")
    changed = unlike(selection.select("run", "ordinal", leaf), artifacts.select("run", "ordinal", leaf)).select("run", "ordinal", code.alias("code"))
    frozen = selection.select("run", F.col("ordinal").cast("long").alias("ordinal"), "artifact_id", (~F.coalesce(F.col("digest").rlike(DIGEST), F.lit(False))).alias("bad"))
    named = F.col("run").isNotNull() & F.col("artifact_id").isNotNull()
    # Frozen rows and receipts of an id meet as numbers; rows of an id that is there once need no join to find their place again.
    each = frozen.where(named).select("run", "artifact_id", "ordinal", F.lit(1).alias("frozen")).union(receipts.where(named).select("run", "artifact_id", F.lit(None).cast("long"), F.lit(0)))
    ids = each.groupBy("run", "artifact_id").agg(F.sum("frozen").alias("times"), (F.count("*") - F.sum("frozen")).alias("paid"), F.max("ordinal").alias("ordinal")).where("times > 0 and (times > 1 or paid <> 1)")
    ids = checkpointed(ids)
    again = ids.where("times > 1").select("run", "artifact_id", (F.col("paid") != 1).alias("unpaid"))
    n = again.count()
    invalid, unpaid = frozen.where("bad").select("run", "ordinal"), ids.where("times = 1").select("run", "ordinal").union(frozen.where(~named).select("run", "ordinal"))
    if n:
        twice = frozen.join(F.broadcast(again) if n <= FEW else again, ["run", "artifact_id"])
        invalid, unpaid = invalid.union(twice.where("not bad").select("run", "ordinal")), unpaid.union(twice.where("unpaid").select("run", "ordinal"))
    expected = runs.withColumnRenamed("lineage", "expected")
    expected = F.broadcast(expected) if expected.count() <= FEW else expected
    strange = artifacts.join(expected, "run").where(~F.col("lineage").eqNullSafe(F.col("expected"))).select("run", F.col("ordinal").cast("long").alias("ordinal"))
    coded = [df.withColumn("code", F.lit(code)) for df, code in ((invalid, "INVALID"), (strange, "LINEAGE"), (unpaid, "RECEIPT"))]
    return reduce(DataFrame.union, [changed, *coded])


def rebased(spans: DataFrame, edits: DataFrame) -> DataFrame:
    """``spans`` (block_id, span_id, first, last) after ``edits`` (block_id, start, finish, text) of their blocks, with ``cut``.

    Edits of a block don't overlap. A span moves by what the edits before it add or take, and is ``cut``, with null places, if an
    edit takes part of it or puts text inside. Both are running sums over the block's places in order: no edit meets a span.
    """
    shift = (units(F.col("text")) - (F.col("finish") - F.col("start"))).cast("long")
    none, puts = F.lit(0).cast("long"), F.col("start") == F.col("finish")
    place = lambda df, at, rank, what, span, moved, done, begun: df.select(
        "block_id", F.col(at).cast("long").alias("at"), rank.alias("rank"), F.lit(what).alias("what"), span.alias("span_id"), moved.alias("moved"), F.lit(done).alias("done"), F.lit(begun).alias("begun"))
    nobody, key = F.lit(None).cast("string"), F.col("span_id").cast("string")
    # At one place: edits that take text end, spans end, insertions begin and end, spans begin, edits that take text begin. So an
    # insertion at a span's end or start leaves it whole, and moves it at the start.
    events = [place(edits, "finish", F.when(puts, 2).otherwise(0), "done", nobody, shift, 1, 0), place(edits, "start", F.when(puts, 2).otherwise(4), "begun", nobody, none, 0, 1),
              place(spans, "last", F.lit(1), "last", key, none, 0, 0), place(spans, "first", F.lit(3), "first", key, none, 0, 0)]
    upto = Window.partitionBy("block_id").orderBy("at", "rank", "what", "span_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = reduce(DataFrame.union, events).withColumns({c: F.sum(c).over(upto) for c in ("moved", "done", "begun")})
    at_first = summed.where("what = 'first'").select("block_id", "span_id", F.col("moved").alias("shift"), F.col("done").alias("done"))
    at_last = summed.where("what = 'last'").select("block_id", "span_id", F.col("begun").alias("begun"))
    rows = spans.withColumn("span_id", F.col("span_id").cast("string")).join(at_first, ["block_id", "span_id"]).join(at_last, ["block_id", "span_id"])
    cut = F.col("begun") > F.col("done")
    return rows.select("block_id", "span_id", *(F.when(~cut, F.col(c) + F.col("shift")).alias(c) for c in ("first", "last")), cut.alias("cut"))


def revision_audit(revisions: DataFrame, changes: DataFrame, evidence: DataFrame, memories: DataFrame, blocks: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((revision_id, codes, original_hash), (revision_id, memory_id, vector_state)) of patches to analysed books.

    ``revisions`` (revision_id, run, reason, archive_sha256, summary, recorded), ``changes`` (revision_id, memory_id, text: null if it stays),
    ``evidence`` (revision_id, memory_id: null for the summary's, block_id, first, last, quote), ``memories`` (run, memory_id, content), ``blocks``
    (block_id, content), ``chunks`` (block_id, first, last: what chunks cover), ``vectors`` (memory_id, input_hash). The original hash is
    that of the memories and blocks that the patch is about; ``recorded``, if given, must equal it. A memory's vector is REUSE while its text
    stays, REFRESHED if one of the new text is there, REFRESH_REQUIRED else.
    """
    run = revisions.select("revision_id", "run")
    targets = changes.join(run, "revision_id").join(memories, ["run", "memory_id"], "left")
    text_bad = F.col("text").isNotNull() & ((F.trim("text") == "") | (units(F.col("text")) > TEXT))
    per = evidence.groupBy("revision_id", "memory_id").agg(F.count("*").alias("n"))
    summary = per.where("memory_id is null").select("revision_id", F.col("n").alias("summary_evidence"))
    cited = targets.join(per.where("memory_id is not null"), ["revision_id", "memory_id"], "left")
    of_changes = cited.groupBy("revision_id").agg(
        F.count("*").alias("n"), F.count_distinct("memory_id").alias("different"), F.count_if(F.col("content").isNull()).alias("lost"),
        F.count_if(text_bad | ~F.coalesce(F.col("n"), F.lit(0)).between(1, CHANGE_EVIDENCE) | F.col("memory_id").isNull() | (F.length("memory_id") > KEY)).alias("bad"))
    marked = evidence.withColumn("span", F.monotonically_increasing_id()).join(blocks, "block_id", "left")
    marked = checkpointed(marked.withColumn("error", F.when(F.col("content").isNull(), "BLOCK").otherwise(
        span_error(F.col("content"), F.col("first").cast("int"), F.col("last").cast("int"), F.coalesce("quote", F.expr("decode(substring(encode(content, 'UTF-16BE'), int(2 * first + 1), int(2 * (last - first))), 'UTF-16BE')"))))))
    covered = islands(chunks.select("block_id", F.col("first").cast("long").alias("a"), F.col("last").cast("long").alias("b")), ["block_id"], "a", "b")
    inside = marked.where("error is null").join(covered.select("block_id", "a", "b"), "block_id").where("a <= first and last <= b").select("span").distinct()
    outside = marked.where("error is null").join(inside, "span", "left_anti").groupBy("revision_id").agg(F.count("*").alias("outside"))
    invalid = marked.groupBy("revision_id").agg(F.count_if(F.col("error").isNotNull()).alias("invalid"))
    # Digests of single rows are gathered, never their texts.
    about = targets.where("content is not null").select("revision_id", F.concat_ws(":", F.lit("m"), "memory_id", F.sha2("content", 256)).alias("part")).union(
        marked.where("content is not null").select("revision_id", F.concat_ws(":", F.lit("b"), F.col("block_id").cast("string"), F.sha2("content", 256))))
    original = about.distinct().groupBy("revision_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("part")), ","), 256).alias("original_hash"))
    rows = revisions
    for part in (summary, of_changes, invalid, outside, original):
        rows = rows.join(part, "revision_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("summary_evidence", "n", "different", "lost", "bad", "invalid", "outside")})
    worded = lambda c, most: F.coalesce((F.trim(c) != "") & (units(F.col(c)) <= most), F.lit(False))
    shape = worded("reason", REASON) & worded("summary", TEXT) & F.coalesce(F.col("archive_sha256").rlike(DIGEST), F.lit(False)) & F.col("summary_evidence").between(1, SUMMARY_EVIDENCE) & (F.col("n") <= CHANGES) & (F.col("bad") == 0)
    found = codes(
        (~shape, "PATCH_INVALID"), (F.col("n") != F.col("different"), "DUPLICATE_TARGET"), (F.col("lost") > 0, "TARGET_NOT_FOUND"), (F.col("invalid") > 0, "EVIDENCE_INVALID"),
        (F.col("outside") > 0, "EVIDENCE_OUTSIDE_CHUNKS"), (F.col("recorded").isNotNull() & ~F.col("recorded").eqNullSafe(F.col("original_hash")), "CONTENT_CHANGED"))
    made = vectors.select("memory_id", "input_hash").distinct().withColumn("made", F.lit(True))
    state = F.when(F.col("text").isNull() | (F.col("text") == F.col("content")), "REUSE").when(F.col("made"), "REFRESHED").otherwise("REFRESH_REQUIRED")
    states = targets.where("content is not null").withColumn("input_hash", F.sha2("text", 256)).join(made, ["memory_id", "input_hash"], "left")
    return rows.select("revision_id", found.alias("codes"), "original_hash"), states.select("revision_id", "memory_id", state.alias("vector_state"))
