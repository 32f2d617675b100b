"""The index on disk against the index as a DataFrame; the log of rollbacks."""

import pathlib

import pytest
from pyspark.sql import functions as F

from folio.operators import retrieval as R
from folio.operators.intervals import chapter_offsets
from folio.operators.segments import chunk_chapters
from folio.operators.staging import cut
from folio.sources.index_store import IndexStore
from folio.streaming import streams as X

TEXT = "A sentence of some length stands here, number {}. " * 3


def book(b, chapters=3, mark=""):
    return [(b, c, f"T{c}", "\n".join(mark + TEXT.replace("{}", str(i)) for i in range(c * 3 + 8))) for c in range(chapters)]


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"book_id {kind}, chapter_index int, title string, content string")


def targets(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"book_id {kind}, target long")


def files(path, book=""):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob(f"chunks/book_id={book}*/*.parquet")}


def both(df):
    return sorted(map(tuple, df.collect()), key=str)


COLUMNS = ["book_id", "chunk_id", "chapter_index", "start_offset", "end_offset", "text"]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_store_equals_frames_and_touches_its_books_alone(spark, tmp_path, kind):
    name = (lambda i: i) if kind == "long" else (lambda i: f"b/{i}: x")
    old = frame(spark, [r for b in range(4) for r in book(name(b))], kind)
    new = frame(spark, [*book(name(0)), *book(name(1), mark="Changed "), *[(name(2), 0, "T", "short")], *book(name(3), 5)], kind)
    store = IndexStore(spark, f"file://{tmp_path}/index", kind)
    chunks, meta = chunk_chapters(old.limit(0)), store.meta()
    for i, (chapters, rows) in enumerate([(old, [(name(b), 700) for b in range(4)]), (old, [(name(0), 10**6), (name(0), 800), (name(9), 5), (name(1), 0)]), (new, [(name(1), 900), (name(2), 900)]), (new, [(name(3), 10**6)])]):
        before = files(tmp_path / "index")
        wanted = targets(spark, rows, kind)
        chunks, meta = (cut(df) for df in R.refresh_index(wanted, chapters, chunks, meta, chunk_chapters))
        assert store.refresh(wanted, chapters, chunk_chapters, f"t-{i}")
        assert both(store.chunks().select(COLUMNS)) == both(chunks.select(COLUMNS)) and both(store.meta()) == both(meta.select(store.meta().columns))
        if i == 1:  # one book went on
            after = files(tmp_path / "index")
            assert {f.split("/")[1] for f, _ in after.items() ^ before.items()} == {f.split("/")[1] for f in files(tmp_path / "index", "0" if kind == "long" else "b%2F0%3A x")}
        held = files(tmp_path / "index")
        assert not store.refresh(wanted, chapters, chunk_chapters, f"t-{i}")  # the batch again
        assert i != 1 or store.refresh(wanted, chapters, chunk_chapters) and files(tmp_path / "index") == held  # nothing left to do
    assert store.chunks().where(F.col("book_id") == name(2)).count() == 0
    store.delete_books(targets(spark, [(name(0), 0), (name(1), 0)], kind))
    assert {r[0] for r in store.chunks().select("book_id").collect()} == {name(3)}
    assert {r[0] for r in store.meta().select("book_id").collect()} == {name(2), name(3)}
    store.replace_books(store.chunks().where("start_offset = 0"))
    assert store.chunks().count() == 1


def test_a_batch_that_failed_half_way_is_repeated(spark, tmp_path, monkeypatch):
    chapters = frame(spark, [*book(1), *book(2)])
    store, other = (IndexStore(spark, f"file://{tmp_path}/{n}") for n in ("a", "b"))
    for s in (store, other):
        s.refresh(targets(spark, [(1, 600), (2, 500)]), chapters, chunk_chapters, "0")
    broken = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(store, "_replace_meta", broken)
        store.refresh(targets(spark, [(1, 10**6)]), chapters, chunk_chapters, "1")
    assert not store.done("1")
    for s in (store, other):
        assert s.refresh(targets(spark, [(1, 10**6)]), chapters, chunk_chapters, "1")
    assert both(store.chunks().select(COLUMNS)) == both(other.chunks().select(COLUMNS)) and both(store.meta()) == both(other.meta())


def test_stream_of_targets_equals_a_full_rebuild(spark, tmp_path):
    chapters = frame(spark, [*book(1), *book(2), *book(3)])
    ends = {(r["book_id"], r["chapter_index"]): r["clean_end"] for r in chapter_offsets(chapters).collect()}
    steps = [[(1, ends[1, 0]), (2, ends[2, 1])], [(1, ends[1, 1]), (1, ends[1, 0]), (7, 50)], [(2, ends[2, 0]), (1, ends[1, 1])], [(3, 10**6)]]
    for i, rows in enumerate(steps[:2]):
        targets(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    store = IndexStore(spark, f"file://{tmp_path}/index")
    stream = lambda: spark.readStream.schema("book_id long, target long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    X.stream_store_refresh(stream(), store, chapters, chunk_chapters, state=f"{tmp_path}/state")
    for i, rows in enumerate(steps[2:], 2):
        targets(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    X.stream_store_refresh(stream(), store, chapters, chunk_chapters, state=f"{tmp_path}/state")  # goes on from its checkpoint
    last = targets(spark, [(1, ends[1, 1]), (2, ends[2, 1]), (3, 10**6)])
    whole, meta = R.refresh_index(last, chapters, chunk_chapters(chapters.limit(0)), store.meta().limit(0), chunk_chapters)
    assert both(store.chunks().select(COLUMNS)) == both(whole.select(COLUMNS)) and both(store.meta()) == both(meta.select(store.meta().columns))


def test_rollbacks_are_logged_once(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([(i,) for i in ids], "generation_id long")
    underlines = spark.createDataFrame([(i, i % 7 if i % 11 else None) for i in range(50)], "event_id long, generation_id long")
    log = X.RollbackLog(spark, f"file://{tmp_path}/log")
    stream = lambda: spark.readStream.schema("generation_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for i, ids in enumerate([[1, 1, 2], [2, 3, None]]):
        rows(ids).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    X.stream_rollback(stream(), log, state=f"{tmp_path}/state")
    assert sorted(r[0] for r in log.generations().collect()) == [1, 2, 3]
    rows([3, 5]).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    X.stream_rollback(stream(), log, state=f"{tmp_path}/state")
    assert sorted(r[0] for r in log.generations().collect()) == [1, 2, 3, 5]
    log.append(rows([3, 5]), "rollback-2")  # the batch again
    assert sorted(r[0] for r in log.generations().collect()) == [1, 2, 3, 5]
    left = {r["event_id"] for r in log.read(underlines).collect()}
    assert left == {i for i in range(50) if i % 11 == 0 or i % 7 not in (1, 2, 3, 5)}
    saved = []
    log.compact(underlines, lambda df: saved.append({r["event_id"] for r in df.collect()}))
    assert saved == [left] and log.generations().count() == 0 and log.read(underlines).count() == 50
