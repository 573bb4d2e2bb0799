"""The scan queue as a stateful stream: what is known of each place, and when it is due again.

A place's state takes in one scan after the other.  A served scan counts the new reviews,
the run of scans without any, and clears the shortfalls; a missed one adds a shortfall, and
from the third on the place waits as if it had been scanned.  A timer in event time then
tells when the place is due: 7 days after a scan, 14 after two scans in a row without new
reviews, 30 after three and more.  A scan that counts before that sets the timer anew; a scan that comes
later finds the place due before it, whether or not the timer has gone off yet.

State and timers are in the state store, by place, and survive a restart from the
checkpoint; the places table can be given as the state to begin with.  Rows of one
micro-batch are taken in the order of their times, so that a replay in any batches gives the
same rows as long as no scan comes later than the watermark allows.  What a place has in one
batch is sorted in a task: scans of a place are days apart.

Defined results: scans without name or time are left out; a null or unknown outcome counts as
missed; a served scan without a count counts 0 reviews; an excluded place has no timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tallyloom.functions import domain

SCANS = "name string, at timestamp, outcome string, reviews long"
STATE = "last_review_count long, last_scan_new_reviews long, consecutive_no_change int, refresh_shortfalls int, scraped_at timestamp, scrape_excluded boolean, told boolean"
OUT = "name string, kind string, at timestamp, given_up boolean, cooldown_days int, last_review_count long, last_scan_new_reviews long, consecutive_no_change int, refresh_shortfalls int, scraped_at timestamp"
FIELDS = [c.split()[0] for c in STATE.split(", ")]
#: Kept by the RocksDB store, which timers and several state variables need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST_SHORTFALLS = 3


def cooldown(quiet: int) -> int:
    """Days between scans after so many scans in a row without new reviews."""
    return domain.COOLDOWN_LAST if quiet >= 3 else domain.COOLDOWN_DAYS[2] if quiet == 2 else domain.COOLDOWN_DAYS[0]


def taken_in(state: dict, at: datetime, outcome: str | None, reviews: int | None) -> dict:
    """A place's state after one scan."""
    new = dict(state)
    if outcome == "served":
        held, last = reviews or 0, state["last_review_count"] or 0
        new["last_scan_new_reviews"] = max(held - last, 0)
        new["consecutive_no_change"] = 0 if held > last else (state["consecutive_no_change"] or 0) + 1
        new["last_review_count"], new["refresh_shortfalls"], new["scraped_at"], new["told"] = held, 0, at, False
    else:
        new["refresh_shortfalls"] = (state["refresh_shortfalls"] or 0) + 1
        if new["refresh_shortfalls"] >= MOST_SHORTFALLS:
            new["scraped_at"], new["told"] = at, False
    return new


def due_at(state: dict) -> datetime | None:
    """When a place is due, unless that has been told, it is excluded or was never scanned (then it is due all along)."""
    if state["scraped_at"] is None or state["scrape_excluded"] or state["told"]:
        return None
    return state["scraped_at"] + timedelta(days=cooldown(state["consecutive_no_change"] or 0))


def _plain(at: datetime | None) -> datetime | None:
    """A time as Spark gives it, rows with a zone and states without one, in the worker's zone."""
    return at.astimezone().replace(tzinfo=None) if at is not None and at.tzinfo else at


def _millis(due: datetime | None) -> int | None:
    return None if due is None else round(due.timestamp() * 1000)


class Places(StatefulProcessor):
    """One place's state and timer."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("place", STATE)

    def _state(self) -> dict:
        state = dict(zip(FIELDS, self.held.get() or (None,) * len(FIELDS)))
        return {**state, "scraped_at": _plain(state["scraped_at"])}

    def _keep(self, state: dict, timer: int | None = None) -> None:
        """A place's new state; ``timer`` is the one that the state before had, so that none need be looked up."""
        self.held.update(tuple(state[f] for f in FIELDS))
        fresh = _millis(due_at(state))
        if timer is not None and timer != fresh:
            self.handle.deleteTimer(timer)
        if fresh is not None and timer != fresh:
            self.handle.registerTimer(fresh)

    def _row(self, name: str, kind: str, at: datetime, state: dict) -> Row:
        given_up = (state["refresh_shortfalls"] or 0) >= MOST_SHORTFALLS
        days = cooldown(state["consecutive_no_change"] or 0)
        kept = {f: state[f] for f in FIELDS if f not in ("scrape_excluded", "told")}
        return Row(name=name, kind=kind, at=at, given_up=given_up, cooldown_days=days, **kept)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self._keep({**{f: initialState[f] for f in FIELDS}, "scraped_at": _plain(initialState["scraped_at"])})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state, out = self._state(), []
        timer = _millis(due_at(state))
        for at, outcome, reviews in sorted(((_plain(r["at"]), r["outcome"], r["reviews"]) for r in rows), key=lambda r: (r[0], r[1] or "", r[2] or 0)):
            if (due := due_at(state)) is not None and due <= at:
                out.append(self._row(key[0], "due", due, state))
                state = {**state, "told": True}
            state = taken_in(state, at, outcome, reviews)
            out.append(self._row(key[0], "scanned", at, state))
        self._keep(state, timer)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state = self._state()
        if (due := due_at(state)) is not None:
            self._keep({**state, "told": True})  # its timer has gone off and goes
            yield self._row(key[0], "due", due, state)

    def close(self) -> None:
        pass


def initial(places: DataFrame) -> DataFrame:
    """The places table as states to begin with."""
    have = {f: F.col(f) if f in places.columns else F.lit(None) for f in FIELDS}
    kinds = dict(c.split() for c in STATE.split(", "))
    return places.where("name IS NOT NULL").select("name", *(c.cast(kinds[f]).alias(f) for f, c in have.items()))


def scan_queue(scans: DataFrame, places: DataFrame | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream of :data:`SCANS` as a stream of :data:`OUT`: each place after every scan, and when it is due.

    The session must keep state with :data:`PROVIDER`.
    """
    rows = scans.where("name IS NOT NULL AND at IS NOT NULL").select("name", "at", "outcome", "reviews").withWatermark("at", late)
    begin = None if places is None else initial(places).groupBy("name")
    return rows.groupBy("name").transformWithState(Places(), OUT, outputMode="Append", timeMode="EventTime", initialState=begin)


def run(scans: DataFrame, folder: str, checkpoint: str, places: DataFrame | None = None) -> None:
    """Take in all scans that have come since the last run; the queue's rows are added to ``folder``."""
    spark = scans.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        writer = scan_queue(scans, places).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
