"""Replies of language models as tables: bubbles, underlines and quiz questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import WS, compact, strip

_UNDERLINE = r"(?s)<underline>(.*?)</underline>"


def bubbles(reply: Column) -> Column:
    """Bubble texts: tagged ones, else marked lines, else all lines, without list numbers."""
    tagged = F.regexp_extract_all(reply, F.lit(r"(?s)<bubble>(.*?)</bubble>"), F.lit(1))
    plain = F.regexp_replace(F.regexp_replace(reply, _UNDERLINE, ""), r"</?bubble>", "")
    lines = F.split(plain, "\n")
    marked = F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*\[气泡\]")), lambda x: F.regexp_replace(x, r"^\s*\[气泡\]\s*", ""))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)、])\s*", ""))
    chosen = F.when(F.size(tagged) > 0, tagged).when(F.size(marked) > 0, marked).otherwise(bare)
    return F.filter(F.transform(chosen, compact), lambda x: x != "")


_COMMENT = r"(?:\[评论\]|【评论】)"


def comment_text(reply: Column) -> Column:
    """The lines marked as comments, one under the other; where no line is marked, the reply without marks. Null stays null."""
    whole = strip(reply)
    line = f"^{_COMMENT}{WS}*([^\\r\u2028\u2029]*)\\z"
    marked = F.transform(F.filter(F.split(whole, "\n"), lambda x: x.rlike(line)), lambda x: strip(F.regexp_extract(x, line, 1)))
    return F.when(F.size(marked) > 0, F.array_join(marked, "\n")).otherwise(strip(F.regexp_replace(whole, f"(?m)^{_COMMENT}{WS}*", "")))


def sticky_note(reply: Column) -> Column:
    """The note in its tag, else in the first code fence, else the whole reply; at most one blank line in a row. Null stays null."""
    tagged = F.regexp_extract(reply, r"(?is)<sticky_note>(.*?)</sticky_note>", 1)
    fenced = F.regexp_extract(reply, f"(?is)```(?:text|markdown)?{WS}*(.*?)```", 1)
    chosen = F.when(tagged != "", tagged).when(fenced != "", fenced).otherwise(reply)
    return strip(F.regexp_replace(F.regexp_replace(strip(chosen), "\r\n", "\n"), "\n{3,}", "\n\n"))


def parse_replies(df: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """``keys``, ``bubbles`` (cut to ``most``, the last repeated up to ``least``), the first underlined text, ``comment`` and ``sticky_note``."""
    found = bubbles(F.col("reply"))
    low, high = min(least, most), max(least, most)
    cut = F.slice(found, 1, max(high, 1))
    padded = F.when(F.size(cut) == 0, cut).when(F.size(cut) < low, F.concat(cut, F.array_repeat(F.element_at(cut, -1), F.lit(low) - F.size(cut)))).otherwise(cut)
    return df.select(*keys, padded.alias("bubbles"), F.nullif(strip(F.regexp_extract("reply", _UNDERLINE, 1)), F.lit("")).alias("underline"), comment_text(F.col("reply")).alias("comment"), sticky_note(F.col("reply")).alias("sticky_note"))


def parse_quiz_json(text: Column) -> Column:
    """Questions of the outermost JSON array in a text; those without a question, two options or a valid answer go."""
    raw = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    kind = "array<struct<question:string,options:array<string>,correct:array<int>,type:string>>"
    return F.filter(
        F.coalesce(F.from_json(raw, kind), F.array().cast(kind)),
        lambda q: q.isNotNull() & (strip(F.coalesce(q["question"], F.lit(""))) != "") & (F.size(F.coalesce(q["options"], F.array().cast("array<string>"))) > 1)
        & (F.size(F.coalesce(q["correct"], F.array().cast("array<int>"))) > 0) & F.forall(q["correct"], lambda i: (i >= 0) & (i < F.size(q["options"]))),
    )


def position_from_progress(books: DataFrame) -> DataFrame:
    """Chapter and offset from stored values, else from the percentage."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("progress", F.lit(0.0)) / 100))
    chapter = F.least(F.floor(share * F.col("chapter_count")), F.greatest(F.col("chapter_count") - 1, F.lit(0)))
    return books.withColumn("chapter_index", F.coalesce("chapter_index", chapter)).withColumn("global_char_offset", F.coalesce("global_char_offset", F.floor(share * F.col("full_text_length"))))
