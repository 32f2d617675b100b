"""Streaming twins: sessions, day totals, triggers, debouncing, gaps, change feeds and index refresh.

Streams are read as files, and ``drain`` runs one through everything that is there. Stateful
operators keep a few numbers for each key, so state grows with the keys that are open.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.operators.reading import local_pieces
from folio.operators.staging import shared_dir
from folio.sources.index_store import IndexStore


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream; zoneless instants become instants."""
    schema = spark.read.parquet(path).schema
    # A stream takes a single file only under a glob, so the last letter is put in brackets.
    df = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(df: DataFrame, mode: str = "append", out: str | None = None, state: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and read back what it wrote; with the ``out`` and ``state`` of an earlier run it goes on from there."""
    spark = df.sparkSession
    out, state = out or _folder(spark, "stream"), state or _folder(spark, "state")
    with _state_store(spark):
        running = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as timers need it; a running stream has settings of its own."""
    key, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, own)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drain_batches(df: DataFrame, each: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    df.writeStream.foreachBatch(each).option("checkpointLocation", state or _folder(df.sparkSession, "state")).trigger(availableNow=True).start().awaitTermination()


def _stateful(df: DataFrame, key: str, order: list[str], fn: Callable[[tuple, tuple, pd.DataFrame], tuple[list, tuple]], start: tuple, out: str, state: str) -> DataFrame:
    """``fn(key, state, rows in order) -> (output rows, state)`` for each key and batch."""
    names = [p.split()[0] for p in out.split(", ")]

    def run(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows, now = fn(k, held.get if held.exists else start, pd.concat(list(parts)).sort_values(order, kind="stable"))
        held.update(now)
        yield pd.DataFrame(rows, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


#: Event times are put off by 400 years, as a stream's watermark starts in 1970 and earlier rows would be late.
SHIFT_US = 146_097 * 86_400 * 1_000_000

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def _shifted(instant: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(instant) + SHIFT_US)


def _micros(t: dt.datetime) -> int:
    return (t - _EPOCH) // dt.timedelta(microseconds=1)


def local_day(us: int, zone: ZoneInfo) -> tuple[dt.date, int]:
    """The local day of an instant in microseconds, and the instant at which the next one begins."""
    day = (_EPOCH + dt.timedelta(microseconds=us)).astimezone(zone).date()
    after = day + dt.timedelta(days=1)
    return day, _micros(dt.datetime(after.year, after.month, after.day, tzinfo=zone).astimezone(dt.UTC))


class _Sessions(StatefulProcessor):
    """An open session for each user. Rows wait until the watermark has passed them, so they are taken in order of time."""

    def __init__(self, gap_us: int, tz: str):
        self.gap, self.tz = gap_us, tz

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.zone = handle, ZoneInfo(self.tz)
        self.open = handle.getValueState("open", "first long, last long")
        self.waiting = handle.getListState("waiting", "us long, ends boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._advance(key, [(r.us, r.ends) for r in rows], timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._advance(key, [], timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key: tuple, new: list[tuple[int, bool]], timer_values) -> Iterator[Row]:
        passed_ms = timer_values.getCurrentWatermarkInMs()
        passed = passed_ms * 1000 - SHIFT_US
        waiting = sorted([*((r[0], r[1]) for r in self.waiting.get()), *new])
        due, later = [w for w in waiting if w[0] <= passed], [w for w in waiting if w[0] > passed]
        first, last = self.open.get() if self.open.exists() else (None, None)
        for us, ends in due:
            if first is not None and us - last >= self.gap:
                yield from self._pieces(key, first, last)
                first = None
            if first is None:
                first = last = None if ends else us
                continue
            last = us
            # What lies before the last midnight is put out at once.
            while (next_day := local_day(first, self.zone)[1]) <= last and not ends:
                yield from self._pieces(key, first, next_day)
                first = next_day
            if ends:
                yield from self._pieces(key, first, last)
                first = last = None
        if first is not None and last + self.gap <= passed:
            yield from self._pieces(key, first, last)
            first = last = None
        if first is None:
            self.open.clear()
        else:
            self.open.update((first, last))
        if later:
            self.waiting.put(later)
        elif waiting:
            self.waiting.clear()
        times = [w[0] for w in later[:1]]
        if first is not None:
            times.append(last + self.gap)
        if times:
            self.handle.registerTimer(max(-(-(min(times) + SHIFT_US) // 1000), passed_ms + 1))

    def _pieces(self, key: tuple, first: int, last: int) -> Iterator[Row]:
        while first < last:
            day, next_day = local_day(first, self.zone)
            yield Row(user_id=key[0], day=day, start_us=first, end_us=min(last, next_day))
            first = next_day


def stream_sessions(ticks: DataFrame, gap_minutes: int = 30, tz: str = "UTC", late: str = "1 minute") -> DataFrame:
    """``(user_id, ts[, kind])`` ticks -> reading time as pieces ``(user_id, day, start, end)``, cut at midnights of ``tz``.

    A tick extends the open session unless the gap has passed since the last one; a row of kind ``close`` ends it there. Days that are
    over are put out while the session goes on; what is open at the end stays in the state. Rows may come in any order,
    late by up to ``late``; later ones are dropped. Sessions of one tick have no length and give nothing.
    """
    kind = (F.lower("kind") == "close") if "kind" in ticks.columns else F.lit(False)
    rows = ticks.where("ts is not null").select("user_id", _shifted(F.col("ts")).alias("at"), F.unix_micros("ts").alias("us"), F.coalesce(kind, F.lit(False)).alias("ends"))
    user = ticks.schema["user_id"].dataType.simpleString()
    out = rows.withWatermark("at", late).groupBy("user_id").transformWithState(_Sessions(gap_minutes * 60_000_000, tz), f"user_id {user}, day date, start_us long, end_us long", "Append", "EventTime")
    return out.select("user_id", "day", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"))


class _Days(StatefulProcessor):
    """Milliseconds of one user and day; put out when the watermark has passed the day's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sum = handle.getValueState("sum", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ms, end = self.sum.get()[0] if self.sum.exists() else 0, 0
        for r in rows:
            ms, end = ms + r.ms, r.closed_ms
        self.sum.update((ms,))
        self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.sum.exists():
            yield Row(user_id=key[0], day=key[1], ms=self.sum.get()[0])
            self.sum.clear()

    def close(self) -> None:
        pass


def stream_daily(sessions: DataFrame, tz: str = "UTC", late: str = "0 seconds") -> DataFrame:
    """Milliseconds of each user and day of ``tz``, put out when the watermark has passed the midnight that ends the day, after 23, 24 or 25 hours."""
    days = local_pieces(sessions, tz)
    closed = F.unix_millis(F.timestamp_micros(F.unix_micros("day_end") + SHIFT_US))
    pieces = days.select("user_id", "day", _shifted(F.col("begin")).alias("at"), "ms", closed.alias("closed_ms"))
    user = sessions.schema["user_id"].dataType.simpleString()
    return pieces.withWatermark("at", late).groupBy("user_id", "day").transformWithState(_Days(), f"user_id {user}, day date, ms long", "Append", "EventTime")


def stream_every_n(events: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """A range ``[start, end]`` each time a key has n more events; the rest waits in the state."""

    def fn(k: tuple, s: tuple, pdf: pd.DataFrame) -> tuple[list, tuple]:
        seen, done = s[0] + len(pdf), s[1]
        whole = (seen - done) // n
        return [(k[0], done + i * n + 1, done + (i + 1) * n) for i in range(whole)], (seen, done + whole * n)

    return _stateful(events.select(key, "ts"), key, ["ts"], fn, (0, 0), f"{key} long, start long, end long", "seen long, done long")


def stream_debounce(tasks: DataFrame, ms: int = 3000) -> DataFrame:
    """``(task_key, ts)``: the first of each key, then the first that comes ``ms`` or more after the last let through."""

    def fn(k: tuple, s: tuple, pdf: pd.DataFrame) -> tuple[list, tuple]:
        last, out = s[0], []
        for ts in pdf["ts"]:
            at = int(ts.timestamp() * 1000)
            if last is None or at - last >= ms:
                out.append((k[0], ts))
                last = at
        return out, (last,)

    return _stateful(tasks.select("task_key", "ts"), "task_key", ["ts"], fn, (None,), "task_key string, ts timestamp", "last long")


def filter_late_sample(ticks: DataFrame, interval_s: int, percent: int) -> DataFrame:
    """Ticks that are late by three seconds and half the interval at most, of which ``percent`` in 100 are kept by hash; batch or stream."""
    allowed = max(3000, max(10, interval_s) * 1000 // 2)
    late = (F.unix_micros("actual") - F.unix_micros("planned")) / 1000
    return ticks.where(late <= allowed).where(F.pmod(F.xxhash64("user_id", "planned"), F.lit(100)) < percent)


def stream_gaps(events: DataFrame, gap_minutes: int = 60) -> DataFrame:
    """Activity sessions; a gap of exactly the limit separates, as with ``time_gaps``."""
    micros = max(60, gap_minutes) * 60_000_000 - 1
    window = F.session_window("ts", f"{micros} microseconds")
    return events.withWatermark("ts", "0 seconds").groupBy("user_id", window).agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), "events")


def stream_appends(messages: DataFrame) -> DataFrame:
    """Versions of conversations -> ``(conversation_key, msg_index, content)`` that each adds to the one before.

    ``messages`` (conversation_key, msg_index, content[, id, version]): a version is in one batch whole; several in
    a batch are told apart by ``version``, in its order. The state has the number of messages of the last version and a hash
    chain over their ids (the content where there are none). Where the first so many ids of the next version give another hash,
    or there are fewer, something earlier has changed: it adds nothing, and is what the next one is held against. As ``chat.tail_appended``.
    """
    own = "id" if "id" in messages.columns else "content"
    version = F.col("version").cast("long") if "version" in messages.columns else F.lit(0).cast("long")
    rows = messages.select("conversation_key", F.col("msg_index").cast("long").alias("msg_index"), F.col("content").cast("string").alias("content"), F.coalesce(F.col(own).cast("string"), F.lit("")).alias("id"), version.alias("version"))

    def fn(k: tuple, s: tuple, pdf: pd.DataFrame) -> tuple[list, tuple]:
        count, chain = s
        out = []
        for _, part in pdf.groupby("version", sort=True):
            part = part.drop_duplicates("msg_index")
            links = [""]
            for i in part["id"]:
                links.append(hashlib.sha256(f"{links[-1]}\n{i}".encode()).hexdigest())
            if len(part) >= count and links[count] == chain:
                out += [(k[0], i, c) for i, c in zip(part["msg_index"][count:], part["content"][count:], strict=True)]
            count, chain = len(part), links[-1]
        return out, (count, chain)

    key = messages.schema["conversation_key"].dataType.simpleString()
    return _stateful(rows, "conversation_key", ["version", "msg_index"], fn, (0, ""), f"conversation_key {key}, msg_index long, content string", "count long, chain string")


def stream_index_refresh(updates: DataFrame, refresh: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """Each batch of ``(book_id, target)`` as one call with the largest target of each book, and the batch's number."""
    drain_batches(updates, lambda batch, n: refresh(batch.groupBy("book_id").agg(F.max("target").alias("target")), n), state)


def stream_store_refresh(updates: DataFrame, store: IndexStore, chapters: DataFrame, chunker: Callable[..., DataFrame], name: str = "refresh", state: str | None = None) -> None:
    """Keep an index on disk up to a stream of ``(book_id, target)``. ``name`` and ``state`` are one stream's own: a batch that it repeats changes nothing."""
    stream_index_refresh(updates, lambda targets, n: store.refresh(targets, chapters, chunker, f"{name}-{n}"), state)


def rollback(underlines: DataFrame, rollbacks: DataFrame) -> DataFrame:
    return underlines.join(rollbacks.select("generation_id").distinct(), "generation_id", "left_anti")


class RollbackLog:
    """Generations that were taken back, a folder for each batch under ``path``; underlines are left as they are and read through it."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "long"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def _folders(self) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []

    def generations(self, besides: str | None = None) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in self._folders() if n != besides]
        schema = f"generation_id {self.kind}"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def append(self, rollbacks: DataFrame, batch: str) -> None:
        """Add the generations that no other batch has; a batch that is repeated replaces its own folder."""
        name = f"batch-{batch}"
        new = rollbacks.select(F.col("generation_id").cast(self.kind).alias("generation_id")).where("generation_id is not null").distinct()
        new.join(self.generations(besides=name), "generation_id", "left_anti").write.mode("overwrite").parquet(f"{self.path}/{name}")

    def read(self, underlines: DataFrame) -> DataFrame:
        return rollback(underlines, self.generations())

    def compact(self, underlines: DataFrame, save: Callable[[DataFrame], None]) -> None:
        """Have ``save`` write the underlines that are left, then forget the batches that they were read through; later ones stay."""
        names = self._folders()
        save(self.read(underlines))
        for n in names:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stream_rollback(rollbacks: DataFrame, log: RollbackLog, name: str = "rollback", state: str | None = None) -> None:
    """Log each generation of a stream of rollbacks once; a batch writes nothing else."""
    drain_batches(rollbacks, lambda batch, n: log.append(batch, f"{name}-{n}"), state)


def batch_sessions(ticks: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions ``(user_id, start, end)`` of a whole table of ticks, those still open included; ``reading.daily_reading`` of them is the batch twin of ``stream_sessions``."""
    ends = F.coalesce(F.lower("kind") == "close", F.lit(False)) if "kind" in ticks.columns else F.lit(False)
    rows = ticks.where("ts is not null").select("user_id", "ts", ends.alias("_ends"))
    order = Window.partitionBy("user_id").orderBy("ts", "_ends")
    apart = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) >= gap_minutes * 60_000_000) | F.lag("_ends").over(order)
    named = rows.withColumn("_n", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("_s", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("user_id", "_s").agg(F.min("ts").alias("start"), F.max("ts").alias("end")).drop("_s")
