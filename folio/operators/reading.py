"""Reading statistics: sessions to days, totals, goals, calendars, streaks and rankings.

Days are local days of an explicit time zone. Sessions are split at local midnights, so days
with a change of clocks have their true length.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def _local(ts: Column, tz: str) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp_ntz"))


def _instant(local: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit(tz), F.current_timezone(), local.cast("timestamp_ntz")).cast("timestamp")


def local_pieces(sessions: DataFrame, tz: str = "UTC") -> DataFrame:
    """Sessions cut at local midnights: ``(user_id, day, begin, until, day_end, ms)``; those that end before they start are left out."""
    good = sessions.where("end > start")
    first, last = F.to_date(_local(F.col("start"), tz)), F.to_date(_local(F.col("end") - F.expr("interval 1 microsecond"), tz))
    days = good.withColumn("day", F.explode(F.sequence(first, last)))
    # Sessions within one day need no clipping; the others are cut at local midnights.
    begin, day_end = F.greatest("start", _instant(F.col("day"), tz)), _instant(F.date_add("day", 1), tz)
    until = F.least("end", day_end)
    ms = F.floor((F.unix_micros(until) - F.unix_micros(begin)) / 1000)
    return days.select("user_id", "day", begin.alias("begin"), until.alias("until"), day_end.alias("day_end"), ms.alias("ms"))


def daily_reading(sessions: DataFrame, tz: str = "UTC") -> DataFrame:
    """``(user_id, day, ms)``: reading time by local day; sessions that end before they start are left out."""
    return local_pieces(sessions, tz).groupBy("user_id", "day").agg(F.sum("ms").alias("ms")).where("ms > 0")


def reading_by_book(sessions: DataFrame) -> DataFrame:
    ms = F.floor((F.unix_micros("end") - F.unix_micros("start")) / 1000)
    return sessions.where("end > start").groupBy("user_id", "book_id").agg(F.sum(ms).alias("ms"))


def total_hours(daily: DataFrame) -> DataFrame:
    good = F.when(F.col("ms") > 0, F.col("ms"))
    return daily.groupBy("user_id").agg((F.coalesce(F.sum(good), F.lit(0)) / float(HOUR_MS)).alias("hours"))


def completions(events: DataFrame) -> DataFrame:
    """Books that ever reached 100 %, and when first; they stay complete whatever comes later."""
    return events.where("progress >= 100").groupBy("user_id", "book_id").agg(F.min("ts").alias("reached_at"))


def goal_progress(goals: DataFrame, done: DataFrame) -> DataFrame:
    """Share of each user's goal books that are complete, in percent; 0 for an empty goal."""
    flags = done.select("user_id", "book_id", F.lit(1).alias("hit")).distinct()
    joined = goals.select("user_id", "book_id").distinct().join(flags, ["user_id", "book_id"], "left")
    return joined.groupBy("user_id").agg(
        F.count("book_id").alias("goal_books"),
        F.count("hit").alias("completed"),
        F.coalesce(F.count("hit") / F.nullif(F.count("book_id"), F.lit(0)) * 100, F.lit(0.0)).alias("percent"),
    )


def _tier(ms: Column) -> Column:
    return F.when(ms.isNull(), F.lit(None)).when(ms <= 0, 0).when(ms < HOUR_MS, 1).when(ms <= 3 * HOUR_MS, 2).otherwise(3)


def week_view(daily: DataFrame, day: dt.date) -> DataFrame:
    """Seven rows from Monday for each user: ms, hours (8 at most) and tier, zeros included."""
    monday = day - dt.timedelta(days=day.weekday())
    users = daily.select("user_id").distinct()
    spine = users.withColumn("day", F.explode(F.sequence(F.lit(monday), F.lit(monday + dt.timedelta(days=6)))))
    here = daily.where(F.col("day").between(monday, monday + dt.timedelta(days=6)))
    ms = F.coalesce("ms", F.lit(0))
    return spine.join(here, ["user_id", "day"], "left").select("user_id", "day", ms.alias("ms"), F.least(ms / float(HOUR_MS), F.lit(8.0)).alias("hours"), _tier(ms).alias("tier"))


def month_calendar(daily: DataFrame, month: dt.date) -> DataFrame:
    """A Sunday-first grid: cells from 0, empty ones before and after the month up to whole weeks."""
    first = month.replace(day=1)
    last = (first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)
    lead = (first.weekday() + 1) % 7
    cells = -(-(lead + last.day) // 7) * 7
    spine = daily.select("user_id").distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    at = F.col("cell") - lead
    dated = spine.withColumn("day", F.when((at >= 0) & (at < last.day), F.date_add(F.lit(first), at)))
    ms = F.when(F.col("day").isNotNull(), F.coalesce("ms", F.lit(0)))
    return dated.join(daily.where(F.col("day").between(first, last)), ["user_id", "day"], "left").select("user_id", "cell", "day", ms.alias("ms"), _tier(ms).alias("tier"))


def current_streak(daily: DataFrame, today: dt.date) -> DataFrame:
    """Days with reading in a row up to ``today``; 0 for users who have not read today."""
    read = daily.where((F.col("ms") > 0) & (F.col("day") <= today)).select("user_id", "day").distinct()
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))
    run = read.withColumn("hit", (F.datediff(F.lit(today), "day") == back - 1).cast("int")).groupBy("user_id").agg(F.sum("hit").alias("streak"))
    return daily.select("user_id").distinct().join(run, "user_id", "left").select("user_id", F.coalesce("streak", F.lit(0)).alias("streak"))


def attach_books(df: DataFrame, books: DataFrame) -> DataFrame:
    """Title and author beside a book_id; unknown books go."""
    return df.join(books.select("book_id", "title", "author"), "book_id")


def keep_known_books(df: DataFrame, books: DataFrame) -> DataFrame:
    return df.join(books.select("book_id"), "book_id", "left_semi")


def recent_completed(done: DataFrame, books: DataFrame, n: int = 5) -> DataFrame:
    return attach_books(done, books).orderBy(F.desc("reached_at"), "user_id", "book_id").limit(n)


def most_read(by_book: DataFrame, books: DataFrame, n: int = 5) -> DataFrame:
    totals = by_book.groupBy("book_id").agg(F.sum("ms").alias("ms")).where("ms > 0")
    return attach_books(totals, books).orderBy(F.desc("ms"), "book_id").limit(n)


def most_recent_book(events: DataFrame) -> DataFrame:
    latest = F.max(F.struct("ts", "event_id", "book_id"))
    return events.groupBy("user_id").agg(latest.alias("m")).select("user_id", F.col("m.book_id").alias("book_id"), F.col("m.ts").alias("last_read_at"))


def progress_pct(offset: Column, total: Column) -> Column:
    raw = F.when(total > 0, offset / total * 100).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("long")
