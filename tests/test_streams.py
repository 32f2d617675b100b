"""Streams against their batch twins: rows late, repeated, out of order, before 1970, and on days of 23 and 25 hours."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import chat as C
from folio.operators import reading as R
from folio.streaming import streams as X

ZONES = ["Europe/Berlin", "America/Sao_Paulo"]


def fed(spark, tmp_path, parts, schema):
    """A stream that takes one part a batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def summed(pieces):
    ms = F.floor((F.unix_micros("end") - F.unix_micros("start")) / 1000)
    return sorted(map(tuple, pieces.groupBy("user_id", "day").agg(F.sum(ms).alias("ms")).where("ms > 0").collect()))


@pytest.mark.parametrize("tz", ZONES)
@pytest.mark.parametrize("start", [dt.datetime(1969, 12, 31, 20), dt.datetime(2017, 10, 14, 20), dt.datetime(2024, 3, 30, 20)])
def test_sessions_equal_daily_reading(spark, tmp_path, tz, start):
    rng = random.Random(str(start) + tz)
    rows, at = [], start
    for _ in range(90):
        at += dt.timedelta(minutes=rng.choice([1, 7, 29, 30, 31, 200]), microseconds=rng.randrange(10**6))
        rows.append((rng.randrange(2), at, rng.choice(["tick", "tick", "tick", "CLOSE", None])))
    rows += rows[10:20]  # repeated rows
    ordered = sorted(rows, key=lambda r: r[1])
    shuffled = ordered[:]
    for i in range(0, len(shuffled) - 6, 6):  # rows change places with near ones, within the lateness that is allowed
        shuffled[i : i + 6] = rng.sample(shuffled[i : i + 6], 6)
    parts = [shuffled[i : i + 23] for i in range(0, len(shuffled), 23)]
    end = ordered[-1][1] + dt.timedelta(days=9)
    # A user of its own moves the watermark on, so that all is closed; what comes too late is dropped.
    parts += [[(9, end, "tick")], [(9, end + dt.timedelta(days=9), "tick")], [(0, ordered[0][1], "tick"), (9, end + dt.timedelta(days=10), "tick")]]
    schema = "user_id long, ts timestamp, kind string"
    got = X.drain(X.stream_sessions(fed(spark, tmp_path, parts, schema), tz=tz, late="1 day"))
    batch = X.batch_sessions(spark.createDataFrame(rows, schema))
    assert summed(got) == sorted(map(tuple, R.daily_reading(batch, tz).collect()))
    assert all(r["start"] < r["end"] for r in got.collect())


def test_four_ticks_before_1970(spark, tmp_path):
    at = [dt.datetime(1969, 7, 1, 10) + dt.timedelta(minutes=m) for m in (0, 10, 300, 305)]
    parts = [[(1, t) for t in at], [(1, dt.datetime(1971, 1, 1))], [(1, dt.datetime(1972, 1, 1))]]
    got = X.drain(X.stream_sessions(fed(spark, tmp_path, parts, "user_id long, ts timestamp")))
    assert sorted((r["start"], r["end"]) for r in got.collect()) == [(at[0], at[1]), (at[2], at[3])]


def test_a_session_goes_on_after_a_restart(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 5, 1, 0) + dt.timedelta(hours=h, minutes=m)
    schema = "user_id long, ts timestamp"
    parts = [[(1, at(23, 40)), (1, at(23, 55))], [(1, at(24, 10)), (2, at(24, 30))]]
    stream = fed(spark, tmp_path, parts, schema)
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    first = X.drain(X.stream_sessions(stream, gap_minutes=180), out=out, state=state)
    assert [(r["start"], r["end"]) for r in first.collect()] == [(at(23, 40), at(24))]  # the day that is over
    fed(spark, tmp_path / "more", [[(1, at(25, 5))], [(2, at(60))], [(2, at(61))]], schema)
    for i in range(3):
        spark.read.parquet(f"{tmp_path}/more/in/{i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i + 2}")
    again = X.drain(X.stream_sessions(stream, gap_minutes=180), out=out, state=state)
    assert {(r["user_id"], r["start"], r["end"]) for r in again.collect()} == {(1, at(23, 40), at(24)), (1, at(24), at(25, 5))}


@pytest.mark.parametrize("tz", ZONES)
def test_daily_closes_local_days(spark, tmp_path, tz):
    rng = random.Random(tz)
    starts = [dt.datetime(*d, rng.randrange(24), rng.randrange(60), 0, rng.randrange(10**6)) for d in ((1969, 12, 30), (2017, 10, 14), (2024, 3, 30), (2024, 10, 26)) for _ in range(12)]
    rows = sorted((rng.randrange(2), s, s + dt.timedelta(minutes=rng.randrange(-5, 3000))) for s in starts)
    rows = sorted(rows, key=lambda r: r[1])
    schema = "user_id long, start timestamp, end timestamp"
    last = dt.datetime(2024, 12, 1)
    stream = fed(spark, tmp_path, [rows[:20], rows[20:], [(9, last, last + dt.timedelta(seconds=1))]], schema)
    got = X.drain(X.stream_daily(stream, tz, "30 days"))
    want = R.daily_reading(spark.createDataFrame(rows, schema), tz)
    assert sorted(map(tuple, got.where("user_id < 9").collect())) == sorted(map(tuple, want.collect()))
    hours = {d: (X.local_day(u, X.ZoneInfo("Europe/Berlin"))[1] - b) // 3_600_000_000 for d, u, b in [(k, X._micros(x.astimezone(dt.UTC)) + 1, X._micros(x.astimezone(dt.UTC))) for k, x in (("short", dt.datetime(2024, 3, 31, tzinfo=X.ZoneInfo("Europe/Berlin"))), ("long", dt.datetime(2024, 10, 27, tzinfo=X.ZoneInfo("Europe/Berlin"))))]}
    assert hours == {"short": 23, "long": 25}


def test_appends_are_proved(spark, tmp_path):
    versions = [
        {"a": "xyz", "b": "pq"},
        {"a": "xyzuv", "b": "pQr"},  # b: an earlier message changed
        {"a": "xyzuv", "b": "pQrs", "c": ""},
        {"a": "xy", "b": "pQrst"},  # a: fewer
        {"a": "xyw", "b": "pQrst"},
    ]
    rows = [[(k, i, m, f"text of {m}", n) for k, v in version.items() for i, m in enumerate(v)] for n, version in enumerate(versions)]
    schema = "conversation_key string, msg_index long, id string, content string, version long"
    want, before = [], spark.createDataFrame([], schema)
    for part in rows:
        now = spark.createDataFrame(part, schema)
        keys = now.select("conversation_key").distinct()
        old = before.join(keys, "conversation_key", "left_semi")
        fresh = now.join(before.select("conversation_key").distinct(), "conversation_key", "left_anti")
        want += [tuple(r) for d in (C.tail_appended(old, now), fresh) for r in d.select("conversation_key", "msg_index", "content").distinct().collect()]
        before = now
    want = sorted(set(want))
    assert ("b", 2, "text of r") not in want and ("a", 2, "text of w") in want
    # One version a batch, and several versions in one batch.
    got = X.drain(X.stream_appends(fed(spark, tmp_path / "one", rows, schema)))
    assert sorted(map(tuple, got.collect())) == want
    got = X.drain(X.stream_appends(fed(spark, tmp_path / "all", [rows[0] + rows[1] + rows[0][:2], [r for p in rows[2:] for r in p]], schema)))
    assert sorted(map(tuple, got.collect())) == want


def test_debounce_before_1970(spark, tmp_path):
    at = [dt.datetime(1960, 1, 1) + dt.timedelta(seconds=s) for s in (0, 1, 3, 5, 7)]
    got = X.drain(X.stream_debounce(fed(spark, tmp_path, [[("k", t) for t in at]], "task_key string, ts timestamp")))
    assert sorted(r["ts"] for r in got.collect()) == [at[0], at[2], at[4]]
