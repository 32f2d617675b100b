"""Sessions, ranges, conversations and streams on rows written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folio.operators import chat as C
from folio.operators import intervals as I
from folio.operators import library as L
from folio.operators import reading as R
from folio.operators import replies as P
from folio.operators import strokes
from folio.sources import corpus
from folio.streaming import streams as X

T0 = dt.datetime(2024, 1, 31, 23, 0)


def sessions(spark, rows):
    return spark.createDataFrame(rows, "user_id long, book_id long, start timestamp, end timestamp")


def test_days(spark):
    h = dt.timedelta(hours=1)
    got = R.daily_reading(sessions(spark, [(1, 1, T0, T0 + h), (2, 1, T0, T0 + 50 * h), (3, 1, T0, T0), (4, 1, T0 + h, T0)]))
    by = {(r["user_id"], str(r["day"])): r["ms"] / 3_600_000 for r in got.collect()}
    assert by == {(1, "2024-01-31"): 1, (2, "2024-01-31"): 1, (2, "2024-02-01"): 24, (2, "2024-02-02"): 24, (2, "2024-02-03"): 1}


def test_days_with_changed_clocks(spark):
    start = dt.datetime(2024, 3, 30, 23, 0)  # midnight in Berlin; the day has 23 hours
    got = R.daily_reading(sessions(spark, [(1, 1, start, start + dt.timedelta(hours=24))]), "Europe/Berlin")
    assert {str(r["day"]): r["ms"] / 3_600_000 for r in got.collect()} == {"2024-03-31": 23, "2024-04-01": 1}


def test_streak(spark):
    day = lambda s: dt.date.fromisoformat(s)
    rows = [(1, day("2024-03-01"), 5), (1, day("2024-02-29"), 5), (1, day("2024-02-28"), 5), (1, day("2024-02-26"), 5), (2, day("2024-02-29"), 5), (3, day("2024-03-01"), 0)]
    got = R.current_streak(spark.createDataFrame(rows, "user_id long, day date, ms long"), day("2024-03-01"))
    assert {r["user_id"]: r["streak"] for r in got.collect()} == {1: 3, 2: 0, 3: 0}


def ranges(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "k long, start long, end long, color string")


def spans(df):
    return [(r["start"], r["end"], r["color"]) for r in df.orderBy("start", "end", "color").collect()]


def test_merge_ranges(spark):
    assert spans(I.merge_ranges(ranges(spark, [(0, 5, "a"), (5, 9, "a"), (3, 3, "a")]), ["k"])) == [(0, 9, "a")]
    assert spans(I.merge_ranges(ranges(spark, [(0, 5, "a"), (2, 6, "b"), (4, 9, "a")]), ["k"])) == [(0, 5, "a"), (2, 6, "b"), (4, 9, "a")]
    once = I.merge_ranges(ranges(spark, [(0, 5, "a"), (4, 7, "a"), (9, 10, "a")]), ["k"])
    assert spans(I.merge_ranges(once, ["k"])) == spans(once)


@pytest.mark.parametrize(
    ("old", "stroke", "new"),
    [
        ([(0, 10, "a")], (2, 5, "a"), [(0, 2, "a"), (5, 10, "a")]), ([(0, 4, "a")], (2, 6, "b"), [(0, 2, "a"), (2, 6, "b")]), ([], (6, 2, "a"), [(2, 6, "a")]),
        ([(0, 3, "a"), (3, 6, "b")], (1, 5, "a"), [(0, 1, "a"), (5, 6, "b")]), ([(0, 3, "a")], (3, 5, "a"), [(0, 5, "a")]), ([(0, 3, "a")], (2, 2, "a"), [(0, 3, "a")]),
    ],
)
def test_strokes(spark, old, stroke, new):
    assert spans(strokes.apply_strokes(ranges(spark, old), ranges(spark, [stroke]), ["k"])) == new


def test_overlaps_come_once_across_buckets(spark):
    b = I.BUCKET
    left = spark.createDataFrame([(1, 0, 5 * b, "l"), (1, b - 1, b + 1, "m"), (1, 7, 7, "e")], "k long, start long, end long, n string")
    right = spark.createDataFrame([(1, b, 4 * b, "r"), (1, 5 * b, 6 * b, "s")], "k long, start long, end long, n string")
    got = I.overlap_join(left, right, ["k"])
    assert sorted((r["n"], r["n_r"]) for r in got.collect()) == [("l", "r"), ("m", "r")]
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_merging_three_conversations(spark):
    key = "book:1::persona:{}::character:c"
    at = lambda ms: dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [(1, key.format("a"), " Ann ", "Bo", 1, at(5)), (2, key.format("b"), "ann", "BO", 0, at(2_000_000)), (3, key.format("c"), "Ann", "bo", 1, at(1_500_000)), (4, key.format("d"), "", "bo", 9, at(1)), (5, key.format("e"), " ", "bo", 9, at(1))]
    df = spark.createDataFrame(rows, "ordinal long, conversation_key string, persona_name string, character_name string, message_count long, updated_at timestamp")
    got = {r["conversation_key"]: (r["message_count"], r["updated_ms"], r["merged"]) for r in C.merge_conversations(df).collect()}
    # The second beats the first; merged they have one message and the later time, which the third does not beat.
    assert got == {key.format("b"): (1, 2_000_000, 3), key.format("d"): (9, 1, 1), key.format("e"): (9, 1, 1)}
    assert key.format("c") in {r["conversation_key"] for r in C.merge_conversations(df, key.format("c")).collect()}


def test_gaps(spark):
    at = [0, 3599, 3599 + 3600, 3599 + 3600 + 3601]
    df = spark.createDataFrame([("k", i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(at)], "conversation_key string, id long, ts timestamp")
    assert [r["separated"] for r in C.time_gaps(df).orderBy("id").collect()] == [False, False, True, True]


def test_summary_ranges_wait(spark):
    df = spark.createDataFrame([("a", 25, 3), ("b", 5, 5), ("c", 9, 0)], "conversation_key string, total long, cursor long")
    assert [(r[0], r["start"], r["end"]) for r in C.summary_ranges(df, 10).orderBy("conversation_key", "start").collect()] == [("a", 4, 13), ("a", 14, 23)]


def test_unique_names(spark):
    new = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id long, name string")
    old = spark.createDataFrame([("A",), ("A (2)",)], "name string")
    assert {r["id"]: r["name"] for r in L.unique_names(new, old).collect()} == {1: "A (3)", 2: "A (4)", 3: "B"}


def test_quiz_scores_take_repeated_answers(spark):
    df = spark.createDataFrame([(1, 1, [1, 1], [1, 2]), (1, 2, [2], [1]), (1, 3, None, [0])], "session_id long, question_id long, answer array<int>, correct array<int>")
    r = L.score_quizzes(df).first()
    assert (r["questions"], r["correct"], r["answered"], r["percent"], r["incomplete"]) == (3, 1, 2, 33, True)


def test_replies(spark):
    rows = [(1, "<bubble> a </bubble> x <bubble>b</bubble>"), (2, "[气泡] one\nother\n[气泡] two"), (3, "1. x\n- y\n\nz"), (4, "")]
    got = {r["k"]: r["bubbles"] for r in P.parse_replies(spark.createDataFrame(rows, "k int, reply string"), ["k"], 3, 3).collect()}
    assert got == {1: ["a", "b", "b"], 2: ["one", "two", "two"], 3: ["x", "y", "z"], 4: []}


def test_comments_and_sticky_notes(spark):
    rows = [
        (1, " [评论] one \nskip\n【评论】two", "pre <STICKY_NOTE> a\r\nb\n\n\n\nc </sticky_note>"),
        (2, "no mark\nsecond", "x ```text\n note\n``` y ```z```"),
        (3, "[评论] a\r\n[评论] b\r\nc", "<sticky_note></sticky_note> ```k```"),
        (4, "", "  "),
        (5, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, c string, s string")
    got = {r["k"]: (r["a"], r["b"]) for r in df.select("k", P.comment_text(F.col("c")).alias("a"), P.sticky_note(F.col("s")).alias("b")).collect()}
    assert got == {1: ("one\ntwo", "a\nb\n\nc"), 2: ("no mark\nsecond", "note"), 3: ("a\r\nb\r\nc", "k"), 4: ("", ""), 5: (None, None)}


def test_segments_with_underlines_and_formulas(spark):
    ranged = "book_id long, chapter_key string, start long, end long"
    p = spark.createDataFrame([(1, "c", 0, 10, 30), (1, "c", 1, 31, 40)], "book_id long, chapter_key string, paragraph_index long, start long, end long")
    h = spark.createDataFrame([(1, "c", 0, 14, "red", 1), (1, "c", 18, 35, "blue", 2)], f"{ranged}, color string, range_id long")
    u = spark.createDataFrame([(1, "c", 12, 16), (1, "c", 22, 24), (1, "c", 33, 33)], ranged)
    m = spark.createDataFrame([(1, "c", 0, 10, 13, "x^2", True), (1, "c", 1, 7, 99, "y", False)], "book_id long, chapter_key string, paragraph_index long, start long, end long, content string, display boolean")
    rows = I.annotate_segments(p, h, u, m).collect()
    got = sorted((r["paragraph_index"], r["start"], r["end"], r["color"], r["underlined"], r["math"], r["display"]) for r in rows)
    assert got == [
        (0, 10, 12, "red", False, None, None),
        (0, 12, 14, "red", True, None, None),
        (0, 14, 16, None, True, None, None),
        (0, 16, 18, None, False, None, None),
        (0, 18, 20, "blue", False, None, None),
        (0, 20, 23, None, False, "x^2", True),  # the underline's border at 22 does not cut the formula
        (0, 23, 24, "blue", True, None, None),
        (0, 24, 30, "blue", False, None, None),
        (1, 31, 35, "blue", False, None, None),
        (1, 35, 38, None, False, None, None),
        (1, 38, 40, None, False, "y", False),
    ]
    assert I.annotate_segments(p, h.limit(0), u.limit(0), m.limit(0)).count() == 2


def test_quiz_json(spark):
    rows = [('```json\n[{"question":"q","options":["a","b"],"correct":[1]}]\n```',), ("[broken",), ('[{"question":"q","correct":[0]}]',), ("none",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(F.size(P.parse_quiz_json(F.col("t")))).collect()] == [1, 0, 0, 0]


def test_archives_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        corpus.restore_archive(spark, f"file://{tmp_path}/none")
    corpus.export_archive(spark, {"t": spark.range(3)}, f"file://{tmp_path}/a", "now")
    assert corpus.restore_archive(spark, f"file://{tmp_path}/a")["t"].count() == 3


def test_transcripts_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", "x: 1\ny: 2"), ("b", "")], "conversation_key string, text string")
    corpus.write_transcripts(df, f"file://{tmp_path}/lines")
    assert sorted(map(tuple, spark.read.json(f"file://{tmp_path}/lines").collect())) == [("a", "x: 1\ny: 2"), ("b", "")]
    corpus.write_transcripts(df, f"file://{tmp_path}/folders", folders=True)
    assert (tmp_path / "folders" / "conversation_key=a").is_dir()


def test_archives_of_old_and_bad_rows(spark, tmp_path):
    at = f"file://{tmp_path}"
    settings = spark.createDataFrame([("chat_history", '{"k1":{"messages":[{"t":"a"}]},"":{},"k2":7}'), ("theme", "dark"), ("chat_history", "{broken"), (None, "x")], "key string, value string")
    images = spark.createDataFrame([("i1", "data:x"), ("i2", "http://x"), (None, "data:y")], "image_ref string, data_url string")
    none = spark.createDataFrame([], "conversation_key string, bucket string")
    corpus.export_archive(spark, {"settings": settings, "images": images, "conversations": none}, f"{at}/a", "now")
    got = corpus.restore_archive(spark, f"{at}/a")
    assert [tuple(r) for r in got["conversations"].collect()] == [("k1", '{"messages":[{"t":"a"}]}')]
    assert [tuple(r) for r in got["settings"].collect()] == [("theme", "dark")]
    assert [r[0] for r in got["images"].collect()] == ["i1"]
    # Chats of its own make an archive ignore the old ones.
    own = spark.createDataFrame([("k9", "{}"), ("k8", "[]")], "conversation_key string, bucket string")
    corpus.export_archive(spark, {"settings": settings, "conversations": own}, f"{at}/b", "now")
    assert [r[0] for r in corpus.restore_archive(spark, f"{at}/b")["conversations"].collect()] == ["k9"]
    assert corpus.restore_archive(spark, f"{at}/b", rules={})["conversations"].count() == 2
    # A restore replaces what was there, and empties what the archive lacks.
    corpus.replace_all({"images": spark.createDataFrame([("old", "data:z")], images.schema), "books": spark.createDataFrame([("b",)], "book_id string")}, f"{at}/live")
    corpus.replace_all(got, f"{at}/live", {"books": "book_id string", "images": "image_ref string, data_url string"})
    live = corpus.live_tables(spark, f"{at}/live")
    assert [r[0] for r in live["images"].collect()] == ["i1"] and live["books"].count() == 0
    corpus.export_archive(spark, {"t": spark.range(1)}, f"{at}/c", "")
    with pytest.raises(ValueError):
        corpus.restore_archive(spark, f"{at}/c")


