"""Queries over sessions, progress and goals."""

import datetime as dt

from pyspark.sql import functions as F

from folio.operators import reading as R
from folio.plans.registry import query

DAY = dt.date(2024, 1, 17)

_DAILY = """daily as (
    select user_id, cast(d as date) as day,
           sum((epoch_us(least("end", d + interval 1 day)) - epoch_us(greatest(start, d))) // 1000) as ms
    from (select user_id, start, "end", unnest(generate_series(date_trunc('day', start), date_trunc('day', "end" - interval 1 microsecond), interval 1 day)) as d
          from {sessions} where "end" > start)
    group by all having ms > 0)"""

_BY_BOOK = """by_book as (select user_id, book_id, sum((epoch_us("end") - epoch_us(start)) // 1000) as ms from {sessions} where "end" > start group by all)"""


@query("daily_reading", f"with {_DAILY} select user_id, day, cast(ms as bigint) as ms from daily")
def daily_reading(t):
    return R.daily_reading(t.sessions)


@query("reading_by_book", f"with {_BY_BOOK} select user_id, book_id, cast(ms as bigint) as ms from by_book")
def reading_by_book(t):
    return R.reading_by_book(t.sessions)


@query("total_hours", f"with {_DAILY} select user_id, round(sum(ms) / 3600000.0, 6) as hours from daily group by user_id")
def total_hours(t):
    return R.total_hours(R.daily_reading(t.sessions)).select("user_id", F.round("hours", 6).alias("hours"))


@query("completions", "select user_id, book_id, epoch_us(min(ts)) // 1000 as reached_ms from {progress_events} where progress >= 100 group by all")
def completions(t):
    return R.completions(t.progress_events).select("user_id", "book_id", F.unix_millis("reached_at").alias("reached_ms"))


@query(
    "goal_progress",
    """select g.user_id, count(*) as goal_books, count(c.book_id) as completed, round(100.0 * count(c.book_id) / count(*), 6) as percent
       from {goals} g left join (select distinct user_id, book_id from {progress_events} where progress >= 100) c
       on c.user_id = g.user_id and c.book_id = g.book_id group by all""",
)
def goal_progress(t):
    return R.goal_progress(t.goals, R.completions(t.progress_events)).withColumn("percent", F.round("percent", 6))


@query(
    "week_view",
    f"""with {_DAILY} select u.user_id, w.day, cast(coalesce(ms, 0) as bigint) as ms, round(least(coalesce(ms, 0) / 3600000.0, 8), 6) as hours,
        case when coalesce(ms, 0) <= 0 then 0 when ms < 3600000 then 1 when ms <= 10800000 then 2 else 3 end as tier
        from (select distinct user_id from daily) u cross join (select cast(unnest(generate_series(date '2024-01-15', date '2024-01-21', interval 1 day)) as date) as day) w
        left join daily d on d.user_id = u.user_id and d.day = w.day""",
)
def week_view(t):
    return R.week_view(R.daily_reading(t.sessions), DAY).withColumn("hours", F.round("hours", 6))


@query(
    "month_calendar",
    f"""with {_DAILY}, cells as (select unnest(range(35)) as cell), g as (
          select cell, case when cell between 1 and 31 then date '2024-01-01' + cast(cell - 1 as integer) end as day from cells)
        select u.user_id, cell, g.day, case when g.day is not null then cast(coalesce(ms, 0) as bigint) end as ms,
               case when g.day is null then null when coalesce(ms, 0) <= 0 then 0 when ms < 3600000 then 1 when ms <= 10800000 then 2 else 3 end as tier
        from (select distinct user_id from daily) u cross join g left join daily d on d.user_id = u.user_id and d.day = g.day""",
)
def month_calendar(t):
    return R.month_calendar(R.daily_reading(t.sessions), DAY)


@query(
    "current_streak",
    f"""with {_DAILY}, r as (select user_id, day, date_diff('day', day, date '2024-01-17') as ago,
          row_number() over (partition by user_id order by day desc) - 1 as n from daily where day <= date '2024-01-17')
        select u.user_id, cast(coalesce(sum(case when ago = n then 1 else 0 end), 0) as bigint) as streak
        from (select distinct user_id from daily) u left join r on r.user_id = u.user_id group by all""",
)
def current_streak(t):
    return R.current_streak(R.daily_reading(t.sessions), DAY).withColumn("streak", F.col("streak").cast("long"))


@query(
    "recent_completed",
    """select c.user_id, c.book_id, title, epoch_us(reached) // 1000 as reached_ms from (
         select user_id, book_id, min(ts) as reached from {progress_events} where progress >= 100 group by all) c
       join {books} b on b.book_id = c.book_id order by reached desc, c.user_id, c.book_id limit 5""",
)
def recent_completed(t):
    found = R.recent_completed(R.completions(t.progress_events), t.books)
    return found.select("user_id", "book_id", "title", F.unix_millis("reached_at").alias("reached_ms"))


@query(
    "most_read",
    f"""with {_BY_BOOK} select b.book_id, title, author, cast(sum(ms) as bigint) as ms from by_book r join {{books}} b on b.book_id = r.book_id
        group by all order by ms desc, b.book_id limit 5""",
)
def most_read(t):
    return R.most_read(R.reading_by_book(t.sessions), t.books)


@query(
    "most_recent_book",
    """select user_id, book_id, epoch_us(ts) // 1000 as last_ms from (
         select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from {progress_events}) where n = 1""",
)
def most_recent_book(t):
    return R.most_recent_book(t.progress_events).select("user_id", "book_id", F.unix_millis("last_read_at").alias("last_ms"))


@query(
    "attach_books",
    f"""with {_BY_BOOK} select r.book_id, user_id, cast(ms as bigint) as ms, title, author from by_book r join {{books}} b on b.book_id = r.book_id""",
)
def attach_books(t):
    return R.attach_books(R.reading_by_book(t.sessions), t.books)


@query(
    "keep_known_books",
    f"""with {_BY_BOOK} select book_id, user_id, cast(ms as bigint) as ms from by_book where book_id in (select book_id from {{books}} where book_id % 2 = 0)""",
)
def keep_known_books(t):
    return R.keep_known_books(R.reading_by_book(t.sessions), t.books.where("book_id % 2 = 0"))


@query(
    "progress_pct",
    """select event_id, p.book_id, cast(round(greatest(0.0, least(100.0, case when full_text_length > 0 then global_char_offset / full_text_length * 100 else 0 end))) as bigint) as percent
       from {positions} p join {books} b on b.book_id = p.book_id""",
)
def progress_pct(t):
    joined = t.positions.join(t.books.select("book_id", "full_text_length"), "book_id")
    return joined.select("event_id", "book_id", R.progress_pct(F.col("global_char_offset"), F.col("full_text_length")).alias("percent"))
