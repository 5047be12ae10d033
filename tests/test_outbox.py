"""The outbox as keyed state: against a plain dispatcher, by batches, and run again."""

import random
from collections import defaultdict

from inkspark.streaming import events, outbox

SCHEMA = "entry string, at timestamp, number long, kind string, error string"


def plain(rows, lease, end):
    """An outbox played through entry by entry; leases over by ``end`` are ended."""
    by, out = defaultdict(list), []
    for entry, at, number, kind, error in rows:
        by[entry].append((at, number, kind, error))
    for entry, own in by.items():
        status, tries, until = None, 0, None
        for at, _, kind, error in [*sorted(own, key=lambda x: x[:2]), (end, 0, "END", None)]:
            if status == "PROCESSING" and at > until:
                status, said = ("FAILED", "OUTBOX_MAX_ATTEMPTS_EXCEEDED") if tries >= 5 else ("PENDING", None)
                out.append((entry, until, status, tries, said))
            if kind == "ADD" and status is None:
                status = "PENDING"
            elif kind == "CLAIM" and status == "PENDING":
                status, tries, until = "PROCESSING", tries + 1, at + lease
            elif kind == "SENT" and status == "PROCESSING":
                status = "DISPATCHED"
            elif kind == "ERROR" and status == "PROCESSING":
                status = "FAILED" if tries >= 5 else "PENDING"
                out.append((entry, at, status, tries, error or "UNEXPECTED_ERROR"))
                continue
            elif kind == "SENT" and status == "PENDING":
                out.append((entry, at, "PENDING", tries, "OUTBOX_CLAIM_LOST"))
                continue
            else:
                continue
            out.append((entry, at, status, tries, None))
    return sorted(out, key=repr)


def written(spark, rows, folder):
    from datetime import datetime, timezone

    some = [(e, datetime.fromtimestamp(at / 1000, timezone.utc), n, kind, error) for e, at, n, kind, error in rows]
    spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_dispatch_by_batches(spark, tmp_path):
    """Batches that arrive one after the other; leases over by the last event are ended by timers."""
    rng, folder, out = random.Random(4), str(tmp_path / "in"), str(tmp_path / "run")
    rows = sorted(((f"e{rng.randrange(25)}", 1_000_000 + rng.randrange(2_000) * 1000, k, rng.choice(["ADD", "CLAIM", "CLAIM", "CLAIM", "SENT", "ERROR", "ERROR"]), rng.choice([None, "no route"])) for k in range(900)), key=lambda x: x[1])
    rows.append(("last", 9_000_000, 1000, "ADD", None))
    for low in range(0, len(rows), 301):
        written(spark, rows[low : low + 301], folder)
        got = events.run_once(outbox.dispatched(spark.readStream.schema(SCHEMA).parquet(folder), 40_000), folder=out)
    seen = sorted(map(tuple, got.collect()), key=repr)
    assert seen == plain(rows, 40_000, 9_000_000)
    assert len({r[2] for r in seen}) == 4 and {"OUTBOX_MAX_ATTEMPTS_EXCEEDED", "OUTBOX_CLAIM_LOST", "no route", "UNEXPECTED_ERROR"} <= {r[4] for r in seen}
    # A run without new files, and one over the same events again, add nothing.
    assert events.run_once(outbox.dispatched(spark.readStream.schema(SCHEMA).parquet(folder), 40_000), folder=out).count() == len(seen)
    written(spark, [r for r in rows if r[3] == "ADD"], folder)
    assert events.run_once(outbox.dispatched(spark.readStream.schema(SCHEMA).parquet(folder), 40_000), folder=out).count() == len(seen)


def test_one_batch_and_timers(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"e{k % 40}", 1_000_000 + rng.randrange(1_000) * 1000, k, rng.choice(["ADD", "CLAIM", "CLAIM", "SENT", "ERROR"]), None) for k in range(600)]
    rows.append(("last", 5_000_000, 1000, "ADD", None))
    folder = str(tmp_path / "in")
    written(spark, rows, folder)
    got = events.run_once(outbox.dispatched(spark.readStream.schema(SCHEMA).parquet(folder), 30_000), folder=str(tmp_path / "run"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, 30_000, 5_000_000)
