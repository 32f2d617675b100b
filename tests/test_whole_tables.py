"""Registered queries that SQL cannot say, over their whole tables against plain Python."""

import math
import re
from datetime import timedelta

import duckdb
import xxhash

from folio.plans import registry
from folio.plans.fixtures import oracle

SF = "/root/testdata/sf0.001"
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
NUMBERS = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
ROMAN = re.compile("m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
LETTERS = dict(i=1, v=5, x=10, l=50, c=100, d=500, m=1000)


def roman(word):
    if not word or not ROMAN.fullmatch(word):
        return word
    values = [LETTERS[c] for c in word]
    return str(sum(-v if v < n else v for v, n in zip(values, [*values[1:], 0], strict=True)))


def heading_key(text):
    """For headings without Chinese numerals."""
    words = re.sub(r"""[()\[\]{},.;:!?`~"'‘’\\/|<>+=*^%$#@&_\-‐-―　]+""", " ", text.lower()).split()
    out, run = [], []

    def close():
        named = [w for w in run if w != "and"]
        if not named:
            out.extend(run)
        else:
            now = total = 0
            for w in named:
                if w == "hundred":
                    now = (now or 1) * 100
                elif w == "thousand":
                    now, total = 0, total + (now or 1) * 1000
                else:
                    now += NUMBERS[w]
            out.append(str(total + now))
        run.clear()

    for w in map(roman, words):
        if w in NUMBERS or w in ("and", "hundred", "thousand"):
            run.append(w)
        else:
            close()
            out.append(w)
    close()
    return " ".join(out)


def test_heading_keys(spark):
    got = {(r.book_id, r.chapter_index): (r.title_key, r.line_key) for r in registry.QUERIES["heading_keys"](spark, SF).collect()}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = c.execute(oracle("select book_id, chapter_index, title, split_part(content, chr(10), 1) from {chapters}")).fetchall()
    assert got == {(b, i): (heading_key(title), heading_key(line)) for b, i, title, line in rows}


def test_stream_late_sample(spark):
    got = sorted((r.event_id, r.user_id) for r in registry.QUERIES["stream_late_sample"](spark, SF).collect())
    want = []
    for event, user, ts, value in duckdb.sql(f"select event_id, user_id, epoch_us(ts), value from '{SF}/events.parquet'").fetchall():
        late = math.floor(abs(value) * 100 + 0.5) * (1 if value >= 0 else -1)
        # Two values are hashed one behind the other, each with the hash so far as its seed.
        h = 42
        for v in (user, ts):
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
        signed = h - (1 << 64) if h >= 1 << 63 else h
        if timedelta(milliseconds=late) <= timedelta(seconds=10) and signed % 100 < 30:
            want.append((event, user))
    assert got == sorted(want)


def test_embed(spark):
    rows = registry.QUERIES["embed"](spark, SF).collect()
    assert len(rows) == duckdb.sql(f"select count(*) from '{SF}/embeddings.parquet'").fetchall()[0][0]
    assert {(r.dims, r.norm2) for r in rows} == {(256, 1.0)}
