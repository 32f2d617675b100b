"""Hard negatives, token counts and importance resampling against plain Python, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import counting, importance, negatives

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, asks boolean, vector array<float>"


def mined(rows):
    """Brute force over (vec_id, label, asks, vector)."""
    ok = {}
    for i, label, asks, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own = (label, [math.floor(256 * float(np.float32(x))) for x in v], bool(asks))
            ok[i] = min(ok.get(i, own), own)
    dim = max((len(v) for _, v, _ in ok.values()), default=0)
    ids = sorted(ok)
    m = np.array([ok[i][1] + [0] * (dim - len(ok[i][1])) for i in ids], dtype=np.int64).reshape(len(ids), dim)
    out = []
    for a, anchor in enumerate(ids):
        if ok[anchor][2]:
            s = m @ m[a]
            order = sorted((x for x in range(len(ids)) if x != a), key=lambda x: (-s[x], ids[x]))
            for p in [x for x in order if ok[ids[x]][0] == ok[anchor][0]][:5]:
                hits = [x for x in order if ok[ids[x]][0] != ok[anchor][0] and 50 * s[p] <= 100 * s[x] <= 95 * s[p]]
                out += [(anchor, ids[p], r, ids[x], s[p], s[x]) for r, x in enumerate(hits[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_mining_over_many_cells_and_copies(spark, monkeypatch, seed):
    for name, value in (("BLOCK", 40), ("SPLITS", 12), ("LEAF", 6), ("PACK", 9), ("GATHER", 20), ("BROADCAST_BLOCKS", 3 * (seed == 1))):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 6))
    rows = [(i, int(rng.integers(4)), i % 20 == 0, (centres[rng.integers(9)] + rng.normal(size=6) * 0.3).tolist()) for i in range(900)]
    rows += [(1000 + i, i % 2, i % 50 == 0, [1.0, 0.5, -0.25, 0.0, 0.0, 2.0]) for i in range(300)]
    rows = [(i, label, asks, np.float32(v).tolist()) for i, label, asks, v in rows]
    got = negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_mining_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, True, [1.0, 0.0]), (1, 1, False, [0.9, 0.1]), (2, 2, False, [0.7, 0.0]), (3, 2, False, [0.7]), (4, 2, False, []), (5, None, False, [0.7, 0.0]), (6, 2, False, None), (7, 2, False, [nan, 0.1])]
    rows += [(8, 2, False, [inf, 0.1]), (9, 2, False, [None, 0.7]), (None, 2, True, [0.7, 0.0]), (10, 3, None, [0.7, 0.0]), (10, 3, None, [0.7, 0.0]), (11, 7, True, [0.1, 0.1]), (12, 1, False, [-1.0, 0.0]), (13, 2, False, [1e30, 0.0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", query string")
    want = mined([r if r[0] != 13 else (13, 2, False, [negatives.LARGEST / 256, 0.0]) for r in rows])
    assert sorted(map(tuple, negatives.mine(docs).collect())) == want and want
    assert negatives.mine(docs.limit(0)).collect() == []
    assert negatives.mine(docs.where("vec_id = 6")).columns == negatives.mine(docs).columns


def test_pruning_leaves_something_out():
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(c * 40, 2, size=(200, 4)) for c in range(-3, 4)]).astype(np.int32)
    space = negatives.Space(4, int((vectors.astype(np.int64) ** 2).sum(1).max()))
    points = space.rows(vectors)
    tree, order = negatives.Tree.build(points, space)
    tree = negatives.Tree.of_bytes(*tree.to_bytes())
    v, seen = vectors[order], []
    one = lambda x, t: np.array([x], dtype=t)
    q = vectors[700]
    scores = v.astype(np.int64) @ q
    top = np.sort(scores)[-4]
    asked = negatives.Asked(one(-1, np.int64), one(0, np.int32), one(1, np.int32), one(True, np.bool_), one(top, float), one(1e9, float), one(0, np.int32), q[None])

    class Watched(np.ndarray):
        def __getitem__(self, at):
            seen.append(at)
            return super().__getitem__(at)

    hits = negatives.search(tree, points[order].view(Watched), np.arange(len(v)), np.ones(len(v), dtype=np.int32), asked, space, 4)
    assert sorted(hits[1].tolist()) == np.sort(scores)[-4:].tolist()
    read = sum(a[0].stop - a[0].start for a in seen if isinstance(a, tuple) and isinstance(a[0], slice) and a[0].stop)
    assert read < len(v) / 2


PIECES = ["plain words here", "it's  two   blanks", "\n\nlines\r\n\tand tabs ", "x  y", "　 wide", "a \x1c b", "café 中文 \U0001f600", "<|endoftext|>", " <|endoftext|> ", "<|endoftext|>x", "12,345.6", "don't\x0bstop", "​zero", "  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(counting.default_tokenizer())


def test_pieces_add_up(library, monkeypatch):
    monkeypatch.setattr(counting, "STRETCH", 50)
    monkeypatch.setattr(counting, "KEPT_PIECES", 20)
    rng = random.Random(4)
    with open(counting.default_tokenizer(), "rb") as f:
        count = counting.Counter("x.json", f.read())
    assert not count.whole
    texts = ["".join(rng.choice([*PIECES, " ", "\n", "a", "."]) for _ in range(rng.randrange(30))) for _ in range(600)] + ["long " * 200, "x" * 3000, ""]
    assert count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_and_cache(spark, library, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate(PIECES)] + [(50, None), (51, ""), (None, "plain words here"), (0, "plain words here"), (52, "word " * 40_000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, n_tokens string")
    cache = counting.CountCache(spark, f"file://{tmp_path}/cache")
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted(((i, len((t or "").encode()), n(t)) for i, t in rows), key=str)
    assert sorted(map(tuple, counting.count_tokens(docs, cache).collect()), key=str) == want
    version = counting.tokenizer_version(counting.default_tokenizer())
    stored = cache.rows(version).count()
    assert stored == len({t or "" for _, t in rows})

    asked = []
    plain = counting.encode_counts
    monkeypatch.setattr(counting, "encode_counts", lambda packed, path: plain(packed, path).withColumn("n_tokens", F.col("n_tokens") + F.lit(0)) if not asked.append(packed.count()) else None)
    more = docs.unionByName(spark.createDataFrame([(60, "new text"), (61, "new text")], "doc_id long, text string"), allowMissingColumns=True)
    for misses in (100_000, 0):
        monkeypatch.setattr(counting, "BROADCAST_MISSES", misses)
        got = sorted(map(tuple, counting.count_tokens(more, cache).collect()), key=str)
        assert got == sorted([*want, (60, 8, n("new text")), (61, 8, n("new text"))], key=str)
    assert asked == [1]  # one distinct miss, then none
    cache.append(cache.rows(version), version)  # a batch stored twice
    assert counting.count_tokens(more, cache).count() == len(got)
    assert counting.count_tokens(docs.limit(0), cache).collect() == []
    lowered = counting.count_tokens(docs, cache, normalise=lambda c: F.upper(c)).where("doc_id = 0").first()
    assert lowered["n_tokens"] == n(PIECES[0].upper())
    cache.forget()
    assert cache.rows(version).count() == 0


def test_op12(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counting.op12_counts(spark, SF).collect()}
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert got == {i: (len(texts[i].encode()), n, n > 512) for i, n in want.items()}


def grams(text, order):
    ws = re.findall(importance.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(ws[i : i + g]) for g in range(1, order + 1) for i in range(len(ws) - g + 1)], len(ws)


@pytest.mark.parametrize(("order", "stretch"), [(1, 1 << 20), (3, 1 << 20), (3, 16)])
def test_resampling_equals_plain_python(spark, monkeypatch, order, stretch):
    monkeypatch.setattr(importance, "STRETCH", stretch)
    monkeypatch.setattr(importance, "KEPT", 30)
    monkeypatch.setattr(importance, "TOGETHER", 25)
    rng = random.Random(order)
    lines = ["Same line again", "", "  ", "Café 中文 UP", "a-b_c 12", "Été ONE two", *(" ".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(20))]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for i in range(120)] + [(200, None), (None, "Same line again\n" * 9), (7, "x y z " * 30), (7, "x y z " * 30), (201, "solo")]
    target = [("a b c\nd e f g",), ("Same line",), (None,)]
    docs = spark.createDataFrame([(*r, "q", "q") for r in rows], "doc_id long, text string, times string, bucket string")
    got = importance.resample(docs, spark.createDataFrame(target, "text string"), order=order, buckets=97, percent=30)
    bucket = lambda f: zlib.crc32(f.encode()) % 97
    s = collections.Counter(bucket(f) for _, t in rows for f in grams(t, order)[0])
    t = collections.Counter(bucket(f) for (x,) in target for f in grams(x, order)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 97) / ((s[b] + 1) * (t.total() + 97)))) for b in range(97)]
    want = []
    for i, x in rows:
        own, n = grams(x, order)
        w = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, n, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    ranked = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = ranked[: 30 * len(ranked) // 100]
    found = [tuple(r) for r in got.collect()]
    assert sorted((r[:5] for r in found), key=str) == sorted(want, key=str)
    assert [r[:5] for r in sorted((r for r in found if r[5]), key=lambda r: r[5])] == drawn
    assert sorted(r[5] for r in found if r[5]) == list(range(1, len(drawn) + 1)) and drawn


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(none, one).collect() == []
    assert [tuple(r) for r in importance.resample(one, none, buckets=5).select("n_words", "rank").collect()] == [(2, None)]
    assert {b: n for b, n in importance.bucket_counts(one, 2, 1000).collect()} == collections.Counter(zlib.crc32(f) % 1000 for f in (b"a", b"b", b"a b"))
