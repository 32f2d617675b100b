import random

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_dedup_finds_all_similar_pairs(spark):
    rng = random.Random(7)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in range(60):  # a chain of edits and copies with two to eight words of 200 changed
        words = [f"w{rng.randrange(500)}" for _ in range(200)] if i % 6 == 0 else texts[10_000 + i - 1 - rng.randrange(i % 6)].split()
        for _ in range(rng.randrange(2, 9) if i % 6 else 0):
            words[rng.randrange(200)] = f"x{rng.randrange(500)}"
        texts[10_000 + i] = " ".join(words)
    texts[20_000], texts[20_001] = " ", "\n"
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    shingles, ids = {k: sets(t) for k, t in texts.items()}, sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = shingles[a], shingles[b]
            if 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    want = {k for k in ids if find(k) == k}
    frame = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in texts.items()], docs.schema)
    got = pipeline.near_dedup(spark, frame, SF)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == want and len(want) < len(ids)
