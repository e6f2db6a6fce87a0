"""I4: findings are offered for posting in every cycle until their receipt comes.

Two streams meet per finding: findings that may be posted (with the time their run
completed) and receipts of posted comments.  A cycle runs at every multiple of
``cycle_hours`` since the epoch; at cycle time T a finding is offered if it exists and its
run is complete (both <= T), it is younger than ``days``, and no receipt has come by T.

The state of a finding are four times (its own and its receipt's).  Findings are kept in ``SLOTS``
slots by a hash of their ids: a slot's state is read and written once per batch, and its event-time
timer stands at the next cycle of any of its findings, so an idle cycle costs nothing.  Cycles are run when
the watermark has passed them: what the streams bring in another order within the
watermark's delay gives the same offers.  A finding's state ends with its receipt, or when it
is too old.

Defined results: a finding that comes again, or a receipt that comes again, changes nothing;
a receipt that comes before its finding is kept for it ``days`` long; a receipt that comes
later than the watermark stops all further offers, but can't take back those made; a finding
that comes that late is offered at once for the cycles it has missed.  Rows without an id or a time
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OFFERS = "id string, created long, cycle int, offered long"
STATE = "ids array<string>, times array<long>"  # created, first, received and offered of each id
#: A call of the state store costs far more than a finding does; hashed ids, so no slot is hot.
SLOTS = 8192
HOUR_MS = 3_600_000
NONE = -1  # no such time yet
NEW = (NONE,) * 4


class PostingRetry(StatefulProcessor):
    """Per slot of findings: offers in cycles; all times are milliseconds since the epoch."""

    def __init__(self, cycle_hours: int, days: int):
        self.cycle, self.life = cycle_hours * HOUR_MS, days * 24 * HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slot = handle.getValueState("slot", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        states = self._stored()
        waiting = self._next(states)
        for row in rows:
            created, first, received, offered = states.get(row.id, NEW)
            if row.is_receipt:
                received = row.at_ms if received == NONE else min(received, row.at_ms)
            elif created == NONE:
                created, first = row.at_ms, -(-row.ready // self.cycle) * self.cycle
            states[row.id] = (created, first, received, offered)
        yield from self._go_on(states, waiting, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        states = self._stored()
        if states:
            yield from self._go_on(states, expiredTimerInfo.getExpiryTimeInMs(), timerValues)

    def _stored(self) -> dict[str, tuple]:
        """The findings of the slot with their times."""
        ids, times = self.slot.get() or ([], [])
        return dict(zip(ids, zip(*[iter(times)] * 4, strict=True), strict=True))

    def _next(self, states: dict[str, tuple]) -> int:
        """The timer of a slot: the first of its findings'; NONE for an empty one."""
        return min((self._timer(*s) for s in states.values()), default=NONE)

    def _timer(self, created: int, first: int, received: int, offered: int) -> int:
        """When to look at a finding next: after its next cycle, or at its end; NONE without a row."""
        if created == NONE:
            return NONE if received == NONE else received + self.life + 1
        due = first if offered == NONE else offered + self.cycle
        if received != NONE and due >= received or due >= created + self.life:
            return max(created + self.life, received if received != NONE else 0) + 1  # repeats end here
        return due + 1

    def _go_on(self, states: dict[str, tuple], waiting: int, timerValues) -> Iterator[Row]:
        """Runs the cycles that the watermark has passed and waits for the next one."""
        now = timerValues.getCurrentWatermarkInMs()
        made, left = [], {}
        for name, (created, first, received, offered) in states.items():
            while created != NONE:
                due = first if offered == NONE else offered + self.cycle
                if due >= now or due >= created + self.life or received != NONE and due >= received:
                    break
                made.append((name, created, (due - first) // self.cycle, due))
                offered = due
            if self._timer(created, first, received, offered) > now:
                left[name] = (created, first, received, offered)
        timer = self._next(left)
        if timer != waiting and waiting > now:
            self.handle.deleteTimer(waiting)
        if left:
            self.slot.update((list(left), [t for s in left.values() for t in s]))
            if timer != waiting:
                self.handle.registerTimer(timer)
        else:
            self.slot.clear()
        for name, created, cycle, due in made:
            yield Row(id=name, created=created, cycle=cycle, offered=due)

    def close(self) -> None:
        pass


def posting_offers(findings: DataFrame, receipts: DataFrame, cycle_hours: int = 24, days: int = 7, delay: str = "0 seconds") -> DataFrame:
    """``findings`` (id, created_at, ready_at: both there and run completed) and ``receipts``
    (finding_id, received_at), both streams, to offers (id, created_at, cycle, offered_at).
    ``cycle`` counts a finding's offers from 0."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    f = findings.where("id is not null and created_at is not null and ready_at is not null").select(
        "id", F.lit(False).alias("is_receipt"), ms("ready_at").alias("ready"), F.col("created_at").cast("timestamp").alias("at"))
    r = receipts.where("finding_id is not null and received_at is not null").select(
        F.col("finding_id").alias("id"), F.lit(True).alias("is_receipt"), ms("received_at").alias("ready"),
        F.col("received_at").cast("timestamp").alias("at"))
    # Without the event-time column no row is dropped for being late: a receipt counts whenever it comes.
    both = f.unionByName(r).withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at")).drop("at")
    both = both.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS)))
    out = both.groupBy("slot").transformWithState(PostingRetry(cycle_hours, days), OFFERS, "Append", "EventTime")
    return out.select("id", F.timestamp_millis("created").alias("created_at"), "cycle", F.timestamp_millis("offered").alias("offered_at"))
