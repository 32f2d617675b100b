"""Streaming queries over the events and conversations tables, each drained once."""

from pyspark.sql import functions as F

from folio.operators.segments import chunk_chapters
from folio.plans.intervals import _OFFSETS
from folio.plans.registry import query
from folio.sources.index_store import IndexStore
from folio.streaming import streams as X


def _events(t):
    t.spark.conf.set("spark.sql.session.timeZone", "UTC")
    return X.read_stream(t.spark, f"{t._dir}/events.parquet")


@query(
    "stream_sessions",
    """with w as (select epoch_us(max(ts)) // 1000 * 1000 - 60000000 as w from events),
        g as (select user_id, epoch_us(ts) as us, event_type = 'error' as ends from events where epoch_us(ts) <= (select w from w)),
        n as (select *, case when us - lag(us) over o < 1800000000 and not lag(ends) over o then 0 else 1 end as n from g window o as (partition by user_id order by us, ends)),
        s as (select *, sum(n) over (partition by user_id order by us, ends rows unbounded preceding) as s from n),
        m as (select user_id, min(us) as a, max(us) as b, bool_or(ends) as ends from s group by user_id, s),
        d as (select *, unnest(range(a // 86400000000, (b - 1) // 86400000000 + 1)) as d from m where b > a)
        select user_id, cast(make_timestamp(d * 86400000000) as date) as day, greatest(a, d * 86400000000) as start_us, least(b, (d + 1) * 86400000000) as end_us from d
        where ends or b + 1800000000 <= (select w from w) or (d + 1) * 86400000000 <= b""",
)
def stream_sessions(t):
    """Errors close a session."""
    ticks = _events(t).select("user_id", "ts", F.expr("if(event_type = 'error', 'close', 'tick')").alias("kind"))
    return X.drain(X.stream_sessions(ticks)).select("user_id", "day", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@query(
    "stream_daily",
    """with p as (select user_id, greatest(ts, d) as a, least(ts + to_microseconds(1000 * cast(round(value * 60000) as bigint)), d + interval 1 day) as b from (
         select user_id, ts, value, unnest(generate_series(date_trunc('day', ts), date_trunc('day', ts + to_microseconds(1000 * cast(round(value * 60000) as bigint)) - interval 1 microsecond), interval 1 day)) as d from events where value > 0))
       select user_id, cast(date_trunc('day', a) as date) as day, cast(sum((epoch_us(b) - epoch_us(a)) // 1000) as bigint) as ms from p where date_trunc('day', a) + interval 1 day <= (select date_trunc('millisecond', max(a)) from p) group by all""",
)
def stream_daily(t):
    end = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 60000).cast("long") * 1000)
    return X.drain(X.stream_daily(_events(t).where("value > 0").select("user_id", F.col("ts").alias("start"), end.alias("end"))))


@query("stream_every_n", """select user_id, i * 10 + 1 as start, (i + 1) * 10 as "end" from (select user_id, unnest(range(count(*) // 10)) as i from events group by 1)""")
def stream_every_n(t):
    return X.drain(X.stream_every_n(_events(t), 10))


@query(
    "stream_debounce",
    """with k as (select user_id || ':' || event_type as task_key, list([ts] order by ts) as l from events group by 1),
         f as (select task_key, list_reduce(l, lambda o, r: case when epoch_ms(r[1]) - epoch_ms(o[-1]) >= 3600000 then list_concat(o, r) else o end) as kept from k)
       select task_key, epoch_us(unnest(kept)) as us from f""",
)
def stream_debounce(t):
    tasks = _events(t).select(F.concat_ws(":", "user_id", "event_type").alias("task_key"), "ts")
    return X.drain(X.stream_debounce(tasks, 3_600_000)).select("task_key", F.unix_micros("ts").alias("us"))


@query("filter_late_ticks", "select event_id, user_id from {ticks} where (epoch_us(actual) - epoch_us(planned)) / 1000.0 <= 10000")
def filter_late_ticks(t):
    return X.filter_late_sample(t.ticks, 20, 100).select("event_id", "user_id")


@query("stream_late_sample")
def stream_late_sample(t):
    ticks = _events(t).select("event_id", "user_id", F.col("ts").alias("planned"), F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 100).cast("long") * 1000).alias("actual"))
    return X.drain(X.filter_late_sample(ticks, 20, 30).select("event_id", "user_id"))


@query(
    "stream_gaps",
    """with g as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < 3600000000 then 0 else 1 end as new from events),
       s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g),
       w as (select user_id, min(ts) as start, max(ts) as last, count(*) as events from s group by user_id, s)
       select user_id, epoch_us(start) // 1000 as start_ms, events from w where last + interval 1 hour - interval 1 microsecond <= (select date_trunc('millisecond', max(ts)) from events)""",
)
def stream_gaps(t):
    return X.drain(X.stream_gaps(_events(t))).select("user_id", F.unix_millis("start").alias("start_ms"), "events")


@query("stream_appends", "select conversation_key, msg_index, content from {messages}")
def stream_appends(t):
    c = X.read_stream(t.spark, f"{t._dir}/conversations.parquet")
    return X.drain(X.stream_appends(c.select(F.col("conv_id").alias("conversation_key"), F.col("turn").alias("msg_index"), F.col("text").alias("content"))))


@query(
    "stream_index_refresh",
    f"""with {_OFFSETS}, t as (select user_id as book_id, max(cast(floor(value * 10) as bigint)) as target from events group by 1),
        b as (select book_id, max(clean_total) as total from offsets group by 1)
        select t.book_id, least(target, total) as target from t join b on b.book_id = t.book_id where least(target, total) > 0""",
)
def stream_index_refresh(t):
    store = IndexStore(t.spark, X._folder(t.spark, "index"))
    updates = _events(t).select(F.col("user_id").alias("book_id"), F.floor(F.col("value") * 10).alias("target"))
    X.stream_store_refresh(updates, store, t.chapters, chunk_chapters)
    return store.meta().select("book_id", F.col("indexed_up_to").alias("target"))


@query("stream_rollback", "select event_id, event_id % 500 as generation_id from events where event_id % 500 not in (select user_id from events where event_type = 'error')")
def stream_rollback(t):
    underlines = t.events.select("event_id", F.expr("event_id % 500").alias("generation_id"))
    log = X.RollbackLog(t.spark, X._folder(t.spark, "rollbacks"))
    X.stream_rollback(_events(t).where("event_type = 'error'").select(F.col("user_id").alias("generation_id")), log)
    return log.read(underlines).select("event_id", "generation_id")
