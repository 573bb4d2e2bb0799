"""The stateful queue against plain replays, in any batches and over restarts."""

import random
from datetime import datetime, timedelta

import pytest

from tallyloom.sources import scratch
from tallyloom.streaming import queue

DAY0 = datetime(2020, 1, 1)


def replay(scans, begin):
    """Rows of a plain replay: every scan of a place in time, and due times between them."""
    out = []
    state = {n: {**dict.fromkeys(queue.FIELDS), **s} for n, s in begin.items()}
    for name in sorted({s[0] for s in scans}):
        for _, at, outcome, reviews in sorted((s for s in scans if s[0] == name), key=lambda s: s[1]):
            state[name] = queue.taken_in(state.get(name) or dict.fromkeys(queue.FIELDS), at, outcome, reviews)
            out.append((name, "scanned", at, state[name]["consecutive_no_change"], state[name]["refresh_shortfalls"], state[name]["last_review_count"]))
    return sorted(out, key=repr), state


def run(spark, batches, begin=None):
    at = scratch.folder(spark, "queue-test")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, queue.SCANS).write.parquet(f"{at}/in/b={k}")
        queue.run(spark.readStream.schema(queue.SCANS).parquet(f"{at}/in/*"), f"{at}/out", f"{at}/checkpoint", begin)
    return spark.read.schema(queue.OUT).parquet(f"{at}/out").collect()


def scanned(rows):
    return sorted(((r["name"], r["kind"], r["at"], r["consecutive_no_change"], r["refresh_shortfalls"], r["last_review_count"]) for r in rows if r["kind"] == "scanned"), key=repr)


def due(rows):
    return sorted((r["name"], r["at"]) for r in rows if r["kind"] == "due")


def test_any_batches_end_the_same(spark):
    pick = random.Random(5)
    scans = sorted(((f"p{pick.randint(0, 6)}", DAY0 + timedelta(hours=7 * k), pick.choice(["served", "missed", None]), pick.choice([None, 0, 5, 5, 9])) for k in range(40)), key=lambda s: s[1])
    begin = {"p1": {"last_review_count": 5, "consecutive_no_change": 2, "refresh_shortfalls": 2}}
    places = spark.createDataFrame([("p1", 5, 2, 2)], "name string, last_review_count long, consecutive_no_change int, refresh_shortfalls int")
    want, _ = replay(scans, begin)
    for cuts in ([40], [10, 25, 40]):
        batches = [scans[a:b] for a, b in zip([0, *cuts], cuts)]
        assert scanned(run(spark, batches, places)) == want


def test_due_after_each_cooldown(spark):
    day = lambda n: DAY0 + timedelta(days=n)
    # Never a new review: the first scan counts from 0, then 7, 14 and 30 days; an earlier scan sets the timer anew.
    scans = [("a", day(0), "served", 3), ("b", day(0), "served", 0), ("c", day(0), "missed", None)]
    rest = [[("a", day(5), "served", 3)], [("b", day(8), "served", 0)], [("b", day(24), "served", 0)], [("clock", day(53), "missed", None)], [("clock", day(55), "missed", None)]]
    got = due(run(spark, [scans, *rest]))
    # a: 3 new on day 0 (due 7) but scanned on day 5 with none (due 12); b: quiet 1, 2, 3 times; c was never served and is due all along.
    assert got == [("a", day(12)), ("b", day(7)), ("b", day(22)), ("b", day(54))]


def test_initial_state_and_odd_rows(spark):
    day = lambda n: DAY0 + timedelta(days=n)
    places = spark.createDataFrame([("old", day(-40), 3, False), ("gone", day(-40), 0, True), ("new", None, None, None), (None, day(-40), 0, False)], "name string, scraped_at timestamp, consecutive_no_change int, scrape_excluded boolean")
    got = run(spark, [[(None, day(0), "served", 1), ("x", None, "served", 1), ("y", day(0), "unheard of", 1)], [("y", day(1), "missed", None), ("y", day(2), "missed", None)], [("clock", day(20), "missed", None)]], places)
    assert due(got) == [("old", day(-10)), ("y", day(9))]
    assert [(r["name"], r["refresh_shortfalls"], r["given_up"]) for r in sorted((r for r in got if r["name"] == "y" and r["kind"] == "scanned"), key=lambda r: r["at"])] == [("y", 1, False), ("y", 2, False), ("y", 3, True)]


@pytest.mark.parametrize(("quiet", "days"), [(0, 7), (1, 7), (2, 14), (3, 30), (9, 30)])
def test_cooldown(quiet, days):
    assert queue.cooldown(quiet) == days


def test_few_calls_of_the_store():
    calls = []

    class Held:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        timers = set()

        def getValueState(self, *_):  # noqa: N802
            return Held()

        def listTimers(self):  # noqa: N802
            calls.append("list")
            return iter(self.timers)

        def registerTimer(self, at):  # noqa: N802
            calls.append("register")
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            calls.append("delete")
            self.timers.remove(at)

    places = queue.Places()
    places.init(Handle())

    def told(step):
        calls.clear()
        step()
        return list(calls), {datetime.fromtimestamp(t / 1000) for t in Handle.timers}

    begin = dict.fromkeys(queue.FIELDS) | {"scraped_at": DAY0}
    assert told(lambda: places.handleInitialState(("p",), begin, None)) == (["update", "register"], {DAY0 + timedelta(days=7)})
    scan = lambda day, outcome: lambda: list(places.handleInputRows(("p",), iter([{"at": DAY0 + timedelta(days=day), "outcome": outcome, "reviews": 1}]), None))
    assert told(scan(1, "missed")) == (["get", "update"], {DAY0 + timedelta(days=7)})
    assert told(scan(2, "served")) == (["get", "update", "delete", "register"], {DAY0 + timedelta(days=9)})
    assert told(lambda: list(places.handleExpiredTimer(("p",), None, None)))[0] == ["get", "update"]
