"""State with timers: streams in several batches against plain loops, and restarts."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from pyspark.sql import functions as F
from sparkloom.streaming import counters, stateful
from sparkloom.tables import shared_dir

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
LAG = "1 second"
SCHEMA = "event_id long, user_id long, ts timestamp, ok boolean, epoch long"


def _events(seed, n=240, users=5, spread=4000):
    r = random.Random(seed)
    t = sorted(r.randrange(spread) for _ in range(n))
    return [(i, r.randrange(users) if r.random() < 0.9 else None, START + timedelta(seconds=s), r.random() < 0.15, r.choice((0, 1, 1, 2, 3))) for i, s in enumerate(t)]


def _stream(spark, tmp_path, rows, parts, order=None):
    """Files of consecutive rows, a file a micro-batch."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        _file(spark, tmp_path, rows[k * size : (k + 1) * size], k)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def _file(spark, tmp_path, rows, k):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{k:03}")


def _groups(rows):
    out = {}
    for e in sorted(rows, key=lambda e: (e[2], e[0])):
        out.setdefault(e[1], []).append(e)
    return out


def _living(rows, ttl, end):
    out = []
    for user, es in _groups(rows).items():
        run = []
        for e in [*es, None]:
            if run and (e is None or e[2] >= run[-1] + timedelta(seconds=ttl)):
                if run[-1] + timedelta(seconds=ttl) < end:
                    out.append((user, run[0], run[-1] + timedelta(seconds=ttl), len(run)))
                run = []
            run += [e[2]] if e else []
    return sorted(out, key=str)


def _decisions(rows, most, window, lock, end):
    out = []
    for user, es in _groups(rows).items():
        n, last, until = 0, None, None
        for e in es:
            if e[2] >= end:
                continue
            if until and until > e[2]:
                out.append((user, e[0], False, n, until))
            elif e[3]:
                n, last, until = 0, None, None
                out.append((user, e[0], True, 0, None))
            else:
                n = n + 1 if last and last + timedelta(seconds=window) > e[2] else 1
                last = e[2]
                until = e[2] + timedelta(seconds=lock) if n >= most else None
                out.append((user, e[0], True, n, until))
    return sorted(out, key=str)


def _fired(rows, quiet, end):
    out = []
    for user, es in _groups(rows).items():
        seen, since, fired = 0, None, 0
        for e in [*es, None]:
            if since and (e is None or since + timedelta(seconds=quiet) <= e[2]):
                at = since + timedelta(seconds=quiet)
                if at < end and seen > 0 and seen != fired:
                    out.append((user, seen, at))
                    fired = seen
                since = None
            if e and e[4] != seen:
                seen, since = e[4], e[2]
    return sorted(out, key=str)


def _rows(df):
    utc = lambda x: x.replace(tzinfo=timezone.utc) if isinstance(x, datetime) else x
    return sorted((tuple(map(utc, r)) for r in df.collect()), key=str)


@pytest.fixture(autouse=True)
def utc(monkeypatch):
    import time

    monkeypatch.setenv("TZ", "UTC")
    time.tzset()


@pytest.mark.parametrize("parts", [1, 4])
def test_streams_equal_the_plain_rule(spark, tmp_path, parts):
    rows = _events(parts)
    end = max(e[2] for e in rows) - timedelta(seconds=1)  # rows at the watermark itself are late
    events = _stream(spark, tmp_path, rows, parts)
    got = counters.run_available(stateful.living_counts(events, "ts", ["user_id"], 120, "event_id", LAG), ["user_id"], "append")
    assert _rows(got) == _living(rows, 120, end) != []
    got = counters.run_available(stateful.throttled(events, "ts", ["user_id"], "event_id", F.col("ok"), 3, 200, 90, LAG), ["user_id"], "append")
    assert _rows(got) == _decisions(rows, 3, 200, 90, end) and not all(r.allowed for r in got.collect())
    got = counters.run_available(stateful.debounced(events, "ts", ["user_id"], "event_id", F.col("epoch"), 60, LAG), ["user_id"], "append")
    assert _rows(got) == _fired(rows, 60, end) != []


def test_late_rows_within_the_delay(spark, tmp_path):
    rows = _events(9)
    r = random.Random(1)
    mixed = sorted(rows, key=lambda e: e[2] + timedelta(seconds=r.randrange(500)))
    end = max(e[2] for e in rows) - timedelta(seconds=600)
    events = _stream(spark, tmp_path, mixed, 4)
    got = counters.run_available(stateful.living_counts(events, "ts", ["user_id"], 120, "event_id", "600 seconds"), ["user_id"], "append")
    assert _rows(got) == _living(rows, 120, end) != []


def test_restart_goes_on(spark, tmp_path):
    rows = _events(5)
    end = max(e[2] for e in rows) - timedelta(seconds=1)
    folder = f"{tmp_path}/kept"
    events = _stream(spark, tmp_path, rows[:120], 2)
    make = lambda: stateful.throttled(events, "ts", ["user_id"], "event_id", F.col("ok"), 3, 200, 90, LAG)
    first = counters.run_available(make(), ["user_id"], "append", folder).count()
    _file(spark, tmp_path, rows[120:], 5)
    got = counters.run_available(make(), ["user_id"], "append", folder)
    assert _rows(got) == _decisions(rows, 3, 200, 90, end) and 0 < first < got.count()
    assert counters.run_available(make(), ["user_id"], "append", folder).count() == got.count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none").endswith(("none", "HDFSBackedStateStoreProvider"))


def test_batch_form_of_the_trigger(spark):
    rows = [e for e in _events(3) if e[1] is not None]
    end = max(e[2] for e in rows) + timedelta(microseconds=1)
    got = counters.decided(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", F.col("epoch"), 60)
    assert _rows(got) == _fired(rows, 60, end) != []


def test_changed_keys_only_and_nothing_left(spark, sf, tmp_path):
    import os

    home = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(home))
    rows = _events(2)
    events = _stream(spark, tmp_path, rows, 3)
    got = counters.run_available(counters.per_day(events, "ts", ["user_id"], "epoch"), ["user_id", "day"])
    want = {}
    for e in rows:
        want[e[1]] = want.get(e[1], 0) + 1
    assert {r.user_id: r.requests for r in got.collect()} == want
    assert len(set(os.listdir(home)) - before) == 1  # the result
