"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import bpe, exact, licenses, mixing, pii, quality, rules, simhash, substring, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, _size int, th int, _row int, _kept int"
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, and columns whose names the operators use inside."""
    say = "The cat sat on the mat and the dog lay by the door while rain fell over the quiet town all night long until the sun came up again and everyone woke to a new and bright day."
    texts = [None, "", " \t\n", "one", say, say, say + " More.", LONG, "x" * 100_000, "Mail a@b.com or +1 (555) 123-4567", "ΑΣ É 😀 中文"]
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", 0, "d", 1, 1, 1, 1) for i, t in enumerate(texts)]
    rows += [(4, say, "en", "s1", 0, "d", 1, 1, 1, 1), (None, say, *[None] * 8), (None, *[None] * 9)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 0), (7, None, 0), (None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")


def test_pii(spark, docs):
    got = pii.find_pii(docs)
    assert got.count() == docs.count()
    found = {r["doc_id"]: r["spans"] for r in got.where("doc_id = 9").collect()}[9]
    assert [(s["kind"], s["base"]) for s in found] == [(0, True), (3, True)]
    assert pii.redact("Mail a@b.com or +1 (555) 123-4567", found) == "Mail [email] or [phone]"
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_pii_base_equals_plain_patterns():
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    random.seed(5)
    pool = ["@", ".", "a", "b.c", "+", "1", "25", "255.1.2", "4111 1111 1111 1111", "-", " ", "(", ")", "é", "+49 30 1234567", "x@y.z@q.w"]
    for _ in range(3000):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 14)))
        want = [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
        assert [(k, a, b) for k, a, b, base in pii.candidates(text) if base] == want, text


def test_pii_labelers_learn_that_failing_sums_are_no_cards():
    counts = {"2|+++0+|2": 100, "2|--+0+|2": 100, "3|+++0+|1": 100, "3|-+00+|1": 5}
    p = pii.fit(counts)
    assert p["2|+++0+|2"] > 0.9 and p["2|--+0+|2"] < 0.5


def test_simhash(spark, docs):
    got = simhash.near_groups(docs)
    assert got.count() == docs.count()
    by = {r["doc_id"]: (r["fp"], r["component_id"]) for r in got.where("doc_id is not null").collect()}
    assert by[0] == by[1] == by[2] == (0, 0)
    assert by[4][1] == by[5][1] == 4
    assert simhash.near_groups(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs.where("doc_id is not null"))
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 0 and kept.subtract(docs).count() == 0


@pytest.mark.parametrize("hot", [2048, 3])
def test_simhash_finds_every_pair(spark, hot):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = set(base.tolist())
    for b in base[:12].tolist():
        for _ in range(25):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                x ^= 1 << bit
            codes.add(x)
    codes = np.array(sorted(codes), dtype=np.uint64)
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.connected_components(simhash.link_forest(fps, hot)).collect()}
    parent = {int(c): int(c) for c in codes.view(np.int64)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, c in enumerate(codes):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ c) <= 2) + i + 1:
            a, b = find(int(codes.view(np.int64)[i])), find(int(codes.view(np.int64)[j]))
            parent[max(a, b)] = min(a, b)
    assert all(roots.get(c, c) == find(c) for c in parent)


def test_gray_index_prunes_nothing_that_is_near():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 12, 900, dtype=np.uint64))
    index = simhash.GrayIndex(codes)
    q, hit = index.near(index.codes, 2)
    want = np.argwhere(np.bitwise_count(index.codes[:, None] ^ index.codes[None]) <= 2)
    assert sorted(zip(q.tolist(), hit.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_substring(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(substring.brute_force([r["text"] for r in rows]))
    got = substring.remove_repeats(docs)
    assert sorted((r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()) == want
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_substring_random(spark):
    random.seed(3)
    rows = []
    for i in range(300):
        n, v = random.choice([0, 3, 34, 35, 36, 60, 200]), random.choice([1, 2, 40])
        w = [f"w{random.randrange(v)}" for _ in range(n)]
        if rows and random.random() < 0.5:
            old = random.choice(rows)[1].split()
            k = random.randrange(len(old) + 1)
            w = w[: n // 2] + old[k : k + random.choice([34, 35, 50])] + w[n // 2 :]
        rows.append((i // 2, " ".join(w)))
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted((rows[i][0], *x) for i, x in enumerate(substring.brute_force([r[1] for r in rows])))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()) == want


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    exact_one = Tokenizer.from_file(bpe.default_tokenizer())
    got = bpe.encode_documents(docs)
    assert got.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    for r in got.where("doc_id is not null").collect():
        ids = exact_one.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == exact_one.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_bpe_odd_texts():
    import json

    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    own, library = bpe.Bpe(json.load(open(path, encoding="utf-8"))), Tokenizer.from_file(path)
    random.seed(1)
    letters = "abcdeéÉßİΣσǅ ſĶ́ '’stre123½²\u3000\u2028\u1680\x85\x1c\x00\ufeff<|endoftext|>\n\t!?#中文あ😀ﬁ"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    for t in [*texts, "<|endoftext|>x<|startoftext|> <|STARTOFTEXT|>", "a" * 3000, "ab" * 2000 + "!" * 900]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(own.encode(t)).decode() == library.decode(ids, skip_special_tokens=False)


def _license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_licenses(spark, docs):
    more = spark.createDataFrame(
        [
            (100, "Released under the MIT License. All Rights RESERVED, cc-by cc by"),
            (101, "the license of the mit was not released"),
            (102, "filler " * 500 + "This work is licensed under the GNU General Public License, version 3."),
            (103, "licensed under the apache license version 2"),
        ],
        "doc_id long, text string",
    )
    every = docs.select("doc_id", "text").unionByName(more)
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(every).collect()}
    for r in every.collect():
        words = _license_words(r["text"])
        places = [i for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        row = got[r["doc_id"], len(words)]
        assert (row["n_base"], row["first_word"], row["last_word"]) == (len(places), min(places, default=None), max(places, default=None))
    labels = {k[0]: r["labels"] for k, r in got.items()}
    assert labels[100] == "cc-by,mit,reserved" and labels[101] == "" and labels[102] == "gpl,gpl-3.0" and labels[103] == ""
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_join_equals_brute_force(spark):
    random.seed(4)
    vocabulary = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["filler", "noise"]
    rows = []
    for i in range(300):
        words = [random.choice(vocabulary) for _ in range(random.randint(0, 150))]
        if i % 2:
            own = random.choice(licenses.TEMPLATES)[1].split()
            words[:0] = [w for w in own if random.random() < 0.97]
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: set(r["found"]) for r in licenses.template_matches(licenses._rows(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, text in rows:
        words, want = text.split(), set()
        for at in range(0, max(len(words) - licenses.BLOCK // 2, 1), licenses.BLOCK // 2):
            block = set(words[at : at + licenses.BLOCK])
            want |= {label for label, t in licenses.TEMPLATES if len(block & set(t.split())) >= licenses.THRESHOLD * len(set(t.split())) - 1e-9}
        assert got.get(i, set()) == want


def test_mixing(spark, docs):
    got = mixing.mix_sizes(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sizes(docs.repartition(5)).collect()), key=str)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.subtract(docs).count() == 0
    assert mixing.mix_sizes(docs.limit(0)).count() == 0


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 50, "d": 700, None: 300, "e": 0}
    totals = spark.createDataFrame([(k, v) for k, v in sizes.items()], "_source string, source_size long")
    got = {r["_source"]: r["target"] for r in mixing.source_targets(totals).collect()}
    order = ["a", "b", "c", "d", "e", None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        share = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * share > 2 * sizes[s]}
        if not full:
            want |= {s: weight[s] * share for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert got == pytest.approx(want)


def test_mixing_comes_near_each_target(spark):
    random.seed(6)
    rows = [(i, "w " * random.randint(0, 40), random.choice(["a", "b", "c", None])) for i in range(4000)]
    got = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 40


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    cover = {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_rules_counts(spark, docs, labels):
    random.seed(7)
    more = [(1000 + i, " ".join(random.choice("ab#\n") * random.randint(1, 3) for _ in range(random.randint(0, 80)))) for i in range(200)]
    every = docs.select("doc_id", "text").where("doc_id is not null").distinct().unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in rules.judge(every, labels).collect()}
    for r in every.collect():
        m = got[r["doc_id"]]
        assert (m["_n_words"], m["_word_chars"], m["_n_symbols"], m["_n_dup_lines"], m["_n_repeat_words"]) == _counts(r["text"])
        assert not (m["_base_failed"] and m["_kept"])


def test_rules_learn_a_list(spark, docs, labels):
    good = "plain words of a text that is as it should be and goes on for a while with other words here".split()
    rows, marks = [], []
    for i in range(600):
        random.seed(i)
        words = random.sample(good, len(good)) + [f"n{i}"]
        if i % 4 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words + words[:7])))
        marks.append((i, int(i % 4 != 0)))
    every, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    learned = rules.learn(every, known)
    assert learned
    assert sorted(r["doc_id"] for r in rules.keep_good(every, known).collect()) == [i for i in range(600) if i % 4]
    assert rules.learn(docs, labels.limit(0)) == [] and rules.learn(docs, labels) == []
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.subtract(docs).count() == 0 and kept.count() > 0
    assert rules.judge(docs.limit(0), labels).count() == 0


def test_quality(spark, docs, labels):
    vectors, net = quality.fit(docs, labels)
    rows = quality.score(docs, vectors, net).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs.limit(0), vectors, net).count() == 0
    held = docs.select("doc_id", quality.held_out().alias("h")).where("doc_id is not null").collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)


def test_quality_on_held_out_rows(spark):
    random.seed(8)
    good, bad = [f"good{i}" for i in range(60)], [f"BAD{i}!!" for i in range(60)]
    rows, marks = [], []
    for i in range(800):
        y = i % 3 > 0
        rows.append((i, " ".join(random.choice(good if y else bad) for _ in range(40))))
        marks.append((i, int(y)))
    every, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.score(every, *quality.fit(every, known)).where(quality.held_out()).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in got]) > 0.97


def _judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda f: len(f[0]))
    spam = re.search(r"(^|[^a-z])(" + "|".join(urls.BLOCKED_WORDS) + r")([^a-z]|$)", host)
    return host, path, None, "block" if spam else "allow"


def test_urls(spark):
    random.seed(9)
    hosts = ["com", "a.com", "example.com", "M.Example.COM", "xexample.com", "example.net", "b.net", "org", "x.org", "free-bets.example.io", "bets", "sex", "essex.io"]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x", "/de/8#f", "/de/", "/es/1", "?q=/en/", "#/en/", "/en"]
    made = [f"http://{h}{p}" for h in hosts for p in paths]
    odd = [None, "", "no scheme", "://", "a://b://c/en/", "http:///en/", "://com/en/\nx", "http://" + "l." * 300 + "com/en/"]
    rows = list(enumerate([*made, *odd, *made[:3]])) + [(None, "http://a.com/en/"), (0, "http://a.net/de/")]
    pages = spark.createDataFrame([(i, u, "x", "k") for i, u in rows], "page_id long, url string, html string, keys string")
    got = sorted(map(tuple, urls.judge_urls(pages).collect()), key=str)
    assert got == sorted([(i, *_judge(u)) for i, u in rows], key=str)
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_urls_bear_the_verdicts_of_the_contract(spark):
    """Each rule's own word, not that of the table in the code; subdomains too, and the longer rule inside the shorter."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"),
        "http://www.example.com/en/7": ("example.com/en/7", "allow"),
        "http://a.net/de/": ("net/de/", "allow"),
        "http://casino.net/de/": ("net/de/", "allow"),
        "http://x.example.net/de/8": ("example.net/de/8", "block"),
        "http://a.org/es/": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    assert got == dict(enumerate(want.values()))
    duck = duckdb.connect()
    duck.execute("create table pages (page_id bigint, url varchar)")
    duck.executemany("insert into pages values (?, ?)", list(enumerate(want)))
    assert {i: (rule, verdict) for i, _, _, rule, verdict in duck.execute(urls.ORACLE["op9_urls"]).fetchall()} == got


def test_cascade_is_exact(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 62, (4000, 2))
    keys = spark.createDataFrame([(int(a), int(b), bool(i % 7 == 0)) for i, (a, b) in enumerate(h)], "h1 long, h2 long, listed boolean")
    levels = urls.build_cascade(keys.where("listed"), keys.where("not listed"))
    assert len(levels) > 1
    assert urls.in_cascade(levels, h[:, 0].astype(np.uint64), h[:, 1].astype(np.uint64)).tolist() == [i % 7 == 0 for i in range(4000)]
    assert urls.build_cascade(keys.limit(0), keys) == []


def test_exact(spark, docs):
    got = exact.exact_groups(docs, exact.DigestIndex(spark))
    rows = got.collect()
    assert len(rows) == docs.count()
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(set(texts)) == len({r["text_sha256"] for r in kept})
    assert all(r["group_size"] == sum(hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"] for t in texts) for r in rows)
    unique = exact.keep_unique(docs, exact.DigestIndex(spark))
    assert unique.columns == docs.columns and unique.count() == len(kept) and unique.subtract(docs).count() == 0
    assert exact.exact_groups(docs.limit(0), exact.DigestIndex(spark)).count() == 0


def test_exact_index_persists(spark, tmp_path):
    where = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    exact.exact_groups(first, exact.DigestIndex(spark, where, 4)).count()
    again = exact.DigestIndex(spark, where, 4)
    later = spark.createDataFrame([(3, "a"), (4, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact.exact_groups(later, again).collect()}
    assert got == {3: (1, False), 4: (4, True)} and again.rows().count() == 3
    plan = again.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
