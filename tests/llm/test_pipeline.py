import hashlib
import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from folio.llm import bpe, queries
from folio.llm.common import drop_staged, staged

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for _, stage in pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before and docs.count() > 0
    assert docs.select("doc_id").distinct().count() < n
    got = pipeline.run(spark, SF)
    assert got.count() == docs.count()
    drop_staged(spark)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_groups(texts):
    """Smallest id of each text's group, by all pairs of whole sets of five-word shingles."""
    words = {d: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def targets_of(sizes):
    """Shares by weight, none above twice its source's size, by halving the range of the common level."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 4.0 * sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in names) < 1.5 * sum(sizes.values()) else (low, level)
    return {s: min(2 * sizes[s], high * weight[s]) for s in names}


def test_every_stage_against_plain_python(spark):
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: [(r["doc_id"], r["text"] or "", r["source"]) for r in df.collect()]

    kept = staged(stages["quality_rules"](spark, docs, SF))
    judged = {r["doc_id"]: r for r in queries.QUERIES["op7_rules"](spark, SF).collect()}
    held = rows(kept)
    assert sorted(d for d, _, _ in held) == sorted(d for d, r in judged.items() if r["kept"])
    assert all(len(WORD.findall(t)) >= 20 for _, t, _ in held)

    alone = staged(stages["exact_dedup"](spark, kept, SF))
    last = {}
    for d, t, _ in held:
        last[t] = max(d, last.get(t, d))
    held = rows(alone)
    assert sorted(d for d, _, _ in held) == sorted(last.values())

    apart = staged(stages["near_dedup"](spark, alone, SF))
    groups = near_groups({d: t for d, t, _ in held})
    held = rows(apart)
    assert sorted(d for d, _, _ in held) == sorted(set(groups.values()))

    mixed = staged(stages["mix_sources"](spark, apart, SF))
    size = {d: len(WORD.findall(t)) for d, t, _ in held}
    source = {d: s for d, _, s in held}
    before, after, copies = Counter(), Counter(), Counter(d for d, _, _ in rows(mixed))
    for d, n in size.items():
        before[source[d]] += n
        after[source[d]] += n * copies[d]
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    for s, target in targets_of(before).items():
        assert abs(after[s] - target) <= max(n for d, n in size.items() if source[d] == s) / 2 + 1e-6

    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = []
    for d, t, _ in rows(mixed):
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    # run() learns, deduplicates and mixes anew and comes to the same rows.
    got = pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    drop_staged(spark)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_every_query_is_named_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
