"""Dispatch of an outbox as keyed state: claims with leases, retries, and failure after the last attempt."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Attempts before an entry fails, milliseconds of a lease, and the errors that an entry can end with besides its own.
ATTEMPTS, LEASE = 5, 60_000
EXPIRED, LOST = "OUTBOX_MAX_ATTEMPTS_EXCEEDED", "OUTBOX_CLAIM_LOST"
LONGEST_ERROR = 2000
FIELDS = ["entry", "at", "status", "attempts", "error"]
OPEN = ("PENDING", "PROCESSING")


class Entry:
    """The state of one entry; each step gives the changes (at, status, attempts, error) it makes."""

    def __init__(self, status: str | None = None, attempts: int = 0, until: int = 0):
        self.status, self.attempts, self.until = status, attempts, until

    def becomes(self, at: int, status: str, error: str | None = None) -> tuple:
        self.status = status
        return at, status, self.attempts, error

    def expire(self, now: int) -> list[tuple]:
        """A lease that is over by ``now`` gives the entry back, or fails it after its last attempt."""
        if self.status != "PROCESSING" or now <= self.until:
            return []
        return [self.becomes(self.until, *(("FAILED", EXPIRED) if self.attempts >= ATTEMPTS else ("PENDING", None)))]

    def step(self, at: int, kind: str, error: str | None, lease: int) -> list[tuple]:
        out = self.expire(at)
        if self.status is None and kind == "ADD":
            out.append(self.becomes(at, "PENDING"))
        elif self.status == "PENDING" and kind == "CLAIM":
            self.attempts, self.until = self.attempts + 1, at + lease
            out.append(self.becomes(at, "PROCESSING"))
        elif self.status == "PROCESSING" and kind == "SENT":
            out.append(self.becomes(at, "DISPATCHED"))
        elif self.status == "PROCESSING" and kind == "ERROR":
            out.append(self.becomes(at, "FAILED" if self.attempts >= ATTEMPTS else "PENDING", (error or "UNEXPECTED_ERROR")[:LONGEST_ERROR]))
        elif self.status == "PENDING" and kind == "SENT":
            out.append((at, "PENDING", self.attempts, LOST))  # the lease was over; nothing is marked
        return out


def dispatcher(lease: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = Entry(*state.get) if state.exists else Entry()
        out = []
        if state.hasTimedOut:
            out += entry.expire(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(frames)).sort_values(["ms", "number"])
            for at, kind, error in zip(rows["ms"], rows["kind"], rows["error"]):
                out += entry.step(int(at), kind, error, lease)
        state.update((entry.status, entry.attempts, entry.until))
        if entry.status == "PROCESSING":
            state.setTimeoutTimestamp(max(entry.until + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=FIELDS)

    return run


def dispatched(stream: DataFrame, lease: int = LEASE, late: str = "10 seconds") -> DataFrame:
    """(entry, at, status, attempts, error): each change of each entry, at in milliseconds.

    ``stream`` has (entry, at: timestamp, number, kind, error); kind is ADD, CLAIM, SENT or ERROR, number tells events of one time
    apart. An entry is added once: an ADD that comes again, as after a replay, changes nothing, and neither does anything after
    DISPATCHED or FAILED. A batch costs what its events cost: the state is found by key. Leases that nobody ends are ended by a
    timer of event time; events later than ``late`` behind the newest of the batches before are dropped. A SENT whose lease was over is an error, and the entry stays to be claimed again.
    """
    rows = stream.withWatermark("at", late).select(F.col("entry").cast("string").alias("entry"), "at", F.unix_millis("at").alias("ms"), F.col("number").cast("long").alias("number"), "kind", "error")
    return rows.groupBy("entry").applyInPandasWithState(
        dispatcher(lease), "entry string, at long, status string, attempts int, error string", "status string, attempts int, until long", "append", GroupStateTimeout.EventTimeTimeout)
