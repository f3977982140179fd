import datetime as dt
import math
import random
import zlib
from collections import defaultdict

import pandas as pd

from kindred.llm.panes import SHIFT, Panes, revisions

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, hour string, batch int"
HOUR, DAY = 3_600_000_000, 86_400_000_000
EPOCH = dt.datetime(1970, 1, 1)


def micros(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def brute_force(clicks, batches, grace, close):
    """The rules, batch by batch, over a plain list of rows."""
    cut, seen = defaultdict(list), set()
    for click_id, ts, arrived, kind, value, *_ in clicks:
        if ts is None or click_id in seen:
            continue
        seen.add(click_id)
        day = micros(arrived or ts) // DAY
        q = day % batches
        crc = zlib.crc32(b"" if click_id is None else str(click_id).encode())
        number = min(batches - 1, q + max(0, crc % 30 - 23))
        cents = 0 if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
        cut[number].append((click_id, "none" if kind is None else kind, micros(ts) - (day - q) * DAY, cents))
    out, live, shown, w = [], {}, {}, -math.inf
    for b in range(batches):
        new = set()
        for click_id, kind, event, cents in cut[b]:
            pane = (kind, event // HOUR)
            if w >= (pane[1] + 1 + close) * HOUR:
                out.append((b, pane[1], click_id, 1, cents, "late", kind))
            else:
                n, c = live.get(pane, (0, 0))
                live[pane] = (n + 1, c + cents)
                new.add(pane)
        for pane in list(live):
            if pane in shown:
                if pane in new:
                    out.append((b, pane[1], -1, *shown[pane], "retract", pane[0]))
                    out.append((b, pane[1], -1, *live[pane], "replace", pane[0]))
                    shown[pane] = live[pane]
            elif w >= (pane[1] + 1 + grace) * HOUR:
                shown[pane] = live[pane]
                out.append((b, pane[1], -1, *live[pane], "emit", pane[0]))
            if w >= (pane[1] + 1 + close) * HOUR:
                live.pop(pane), shown.pop(pane)
        w = max([w, *[e for _, _, e, _ in cut[b]]])
    out += [(batches - 1, hour, -1, *totals, "final", kind) for (kind, hour), totals in live.items() if (kind, hour) not in shown]
    return sorted(out, key=str)


def found(spark, clicks, batches, grace, close):
    rows = revisions(spark.createDataFrame(clicks, SCHEMA), batches, grace, close, spread=3).collect()
    names = ("batch", "hour", "click_id", "n_rows", "cents", "record", "kind")
    return sorted([tuple(r[n] for n in names) for r in rows], key=str)


def test_revisions_equal_brute_force(spark):
    draw = random.Random(3)
    clicks = []
    for i in range(400):
        arrived = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=draw.randrange(12 * 1440))
        if arrived.day % 5 == 4:  # a batch without rows of its own day
            arrived += dt.timedelta(days=1)
        ts = arrived - dt.timedelta(minutes=draw.choice([0, 5, 90, 400, 3000]))
        clicks.append((i, ts, arrived, draw.choice(["view", "view", "view", None, "buy"]), draw.choice([1.005, -2.5, 10.0, None]), "x", 7))
    clicks += clicks[:30]  # repeats
    clicks += [
        (1001, None, dt.datetime(2024, 1, 2), "view", 1.0, "x", 7),
        (1002, dt.datetime(2024, 1, 3), None, "view", float("nan"), "x", 7),
        (None, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 3, 1), "buy", 2.0, "x", 7),
        (1003, dt.datetime(1931, 5, 5, 7, 30), dt.datetime(2024, 1, 2), "view", float("inf"), "x", 7),
        (1004, dt.datetime(2023, 12, 30, 23, 59, 59, 999999), dt.datetime(2024, 1, 9), "", 3.0, "x", 7),
    ]
    want = brute_force(clicks, 5, 1, 6)
    assert {r[5] for r in want} == {"late", "emit", "retract", "replace", "final"} and any(r[1] < 0 for r in want)
    assert found(spark, clicks, 5, 1, 6) == want


def test_an_empty_table_and_an_only_row(spark):
    assert found(spark, [], 1, 2, 72) == []
    assert found(spark, [(5, dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 3), "view", 0.125, "x", 0)], 1, 2, 72) == [(0, 3, -1, 1, 13, "final", "view")]


class Recorded:
    """A state handle, its timer service and its one value, that write down what is asked of them."""

    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, name, schema):
        self.calls.append("state")
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timer = at


class At:
    """Timer values at an hour."""

    def __init__(self, hour):
        self.now = (hour * HOUR + SHIFT) // 1000

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_pane_asks_little_of_its_state():
    handle, panes, key = Recorded(), Panes(2, 72), ("view", 5, 0)
    rows = pd.DataFrame({"n": [1, 2], "cents": [10, 20]})

    def said(frames):
        calls, handle.calls = handle.calls, []
        return [tuple(r[2:5]) for f in frames for r in f.itertuples(index=False)], calls

    def ran(call, *args):
        out = list(call(*args))
        return said(out)

    panes.init(handle)
    assert said([]) == ([], ["state"])
    assert ran(panes.handleInputRows, key, iter([rows]), At(6)) == ([], ["get", "update", "timer"])
    assert handle.timer == At(8).now
    assert ran(panes.handleInputRows, key, iter([rows]), At(7)) == ([], ["get", "update"])
    assert ran(panes.handleExpiredTimer, key, At(8), None) == ([(6, 60, "emit")], ["get", "update", "timer"])
    assert handle.timer == At(78).now
    assert ran(panes.handleInputRows, key, iter([rows]), At(77)) == ([(6, 60, "retract"), (9, 90, "replace")], ["get", "update"])
    assert ran(panes.handleExpiredTimer, key, At(78), None) == ([], ["get", "clear"])
    # Due at its first rows; and never shown when it closes.
    assert ran(panes.handleInputRows, key, iter([rows]), At(8)) == ([(3, 30, "emit")], ["get", "update", "timer"])
    assert handle.timer == At(78).now
    handle.value = (3, 30, False)
    assert ran(panes.handleExpiredTimer, key, At(90), None) == ([(3, 30, "emit")], ["get", "clear"])


def test_output_files_do_not_grow_with_state_partitions(spark):
    clicks = [(i, dt.datetime(2024, 1, 1, i % 24), dt.datetime(2024, 1, 1, 23), "view", 1.0, "x", 0) for i in range(48)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        out = revisions(spark.createDataFrame(clicks, SCHEMA), 1)
        files = defaultdict(int)
        for name in out.inputFiles():
            files[name.rsplit("/", 2)[1]] += 1
        assert out.count() == 24 and max(files.values()) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
