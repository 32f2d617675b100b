"""The registered queries at the smallest scale: against their SQL, or against plain Python over the same rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from folio.llm import bpe, licenses, pii, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = run(spark, name)
    cols = sorted(got.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want, key=str)


def test_op1(spark, texts):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    rows = run(spark, "op1_pii").collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, texts[r["doc_id"]]) if ok(m[0])] for k, p, ok in kinds]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(s) for s in spans]
        assert r["base_sha256"] == sha(",".join(x for s in spans for x in s))
        found = r["spans"].split(",") if r["spans"] else []
        assert set(found) >= {x for s in spans for x in s}
        order = [(["email", "ip", "card", "phone"].index(x.split(":")[0]), int(x.split(":")[1])) for x in found]
        assert order == sorted(order)


def fingerprint(text):
    words = WORD.findall(low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op2(spark, texts):
    fps = {d: fingerprint(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = sorted(map(tuple, run(spark, "op2_simhash").select("doc_id", "fingerprint", "component_id").collect()))
    assert got == [(d, f"{fps[d]:016x}", find(d)) for d in ids]


def test_op4(spark, texts):
    library = Tokenizer.from_file(bpe.default_tokenizer())
    rows = run(spark, "op4_bpe").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_op5(spark, texts):
    rows = run(spark, "op5_licenses").collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(texts[r["doc_id"]]))
        at = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in licenses.PHRASES}
        every = [i for v in at.values() for i in v]
        base = sorted({licenses.PHRASES[p] for p, v in at.items() if v})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(every), min(every, default=None), max(every, default=None))
        assert r["base_labels"] == ",".join(base)
        found = r["labels"].split(",") if r["labels"] else []
        assert set(found) >= set(base) and found == sorted(set(found)) and 0 <= r["score"] <= 1


def test_op6(spark, texts):
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    rows = run(spark, "op6_mixing").collect()
    assert len(rows) == len(docs)
    sizes, taken, targets, longest = {}, {}, {}, {}
    for r in rows:
        n, s = len(WORD.findall(texts[r["doc_id"]])), docs[r["doc_id"]]
        assert r["size"] == n and r["taken"] <= 2 * n
        sizes[s], taken[s], targets[s] = sizes.get(s, 0) + n, taken.get(s, 0) + r["taken"], r["target"]
        longest[s] = max(longest.get(s, 0), n)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest[s] / 2 + 1e-6 and targets[s] <= 2 * sizes[s] + 1e-6
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = run(spark, "op6_mixing").select(*rows[0].__fields__).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_op7(spark, texts):
    rows = run(spark, "op7_rules").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        seen: dict = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        again = len({p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 8)})
        counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), again)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        failed = len(words) < 20 or 100 * again > 30 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_op8(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] is not None}
    rows = run(spark, "op8_quality").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    right = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(right) >= 0.8
