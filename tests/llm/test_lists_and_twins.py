"""Rule lists as tables, and the quality model against plain loops."""

import random

import numpy as np

from folio.llm import quality, urls

SF = "/root/testdata/sf0.001"


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut].lower(), rest[cut:]
    path = rest[: min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))]
    labels = host.split(".")
    fits = [h + path[:n] for i in range(len(labels)) for h in [".".join(labels[i:])] for n in range(len(path) + 1) if h + path[:n] in rules]
    best = max(fits, key=len, default=None)
    return best, rules.get(best, "allow")


def test_rules_as_a_table(spark):
    """Thousands of rules, most of which fit nothing; nulls, repeats, both verdicts on one key."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    random.seed(3)
    hosts = sorted({r["url"].split("://")[1].split("/")[0].lower() for r in pages.where("url like '%://%'").collect()})
    rows = [(random.choice([h, h.split(".", 1)[-1]]), random.choice(["", "/", "/en/", "/fr/8"]), random.choice(["allow", "block"])) for h in hosts]
    rows += [(f"host{i}.example.org", f"/{i}", "block") for i in range(5000)]
    known = {}
    for h, p, v in rows:
        known[h + p] = max(v, known.get(h + p, ""))
    odd = [(None, "/", "block"), ("x.org", "/", None), *rows[:20]]
    table = spark.createDataFrame([*rows, *odd], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, table, ()).collect()}
    assert got == {r["page_id"]: plain_verdict(r["url"], known) for r in pages.collect()}
    assert len({v for _, v in got.values()}) == 2


def test_empty_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    for rules in ((), spark.createDataFrame([], "host string, path string, verdict string")):
        got = {(r["page_id"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules, ()).collect()}
        assert got == {(1, None, "allow"), (2, None, "allow")}


def test_quality_model_against_plain_loops(spark):
    random.seed(4)
    words = [f"{random.choice('abc')}{i}" for i in range(60)] + ["Ab", "X!", "..", "9é"]
    texts = [" ".join(random.choices(words, k=random.randint(0, 60))) for _ in range(80)] + [None, "", "one", "a b a b a b a b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index = quality.index_vectors().astype(np.float64)
    sums = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        own = quality.buckets(t or "")[0]
        for i in range(len(own)):
            for j in range(max(0, i - quality.AROUND), min(len(own), i + quality.AROUND + 1)):
                if i != j:
                    sums[own[i]] += index[own[j]]
    want = np.array([(s / np.linalg.norm(s) if np.linalg.norm(s) > 0 else s) + v / quality.NONZERO for s, v in zip(sums, index, strict=True)])
    vectors = quality.train_vectors(docs.select("text").repartition(3))
    assert np.allclose(vectors, want, atol=1e-5)

    net = quality.fit_network(np.random.default_rng(1).normal(size=(40, 3 * quality.DIM)), np.arange(40) % 2.0)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, vectors, net).collect()}
    for i, t in enumerate(texts):
        own, shape, _ = quality.buckets(t or "")
        seen, triples = 0, set()
        for k in range(len(own) - 2):
            seen += tuple(own[k : k + 3]) in triples
            triples.add(tuple(own[k : k + 3]))
        n = max(len(own), 1)
        x = np.concatenate([sum((want[b] for b in own), np.zeros(quality.DIM)), sum((want[b] for b in shape), np.zeros(quality.DIM)), seen * want[0] + (len(own) - seen) * want[1]]) / n
        hidden = [np.tanh(sum((x[a] - net.mean[a]) / net.scale[a] * net.w1[a, h] for a in range(len(x))) + net.b1[h]) for h in range(quality.HIDDEN)]
        logit = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        assert abs(got[i] - 1 / (1 + np.exp(-logit))) < 1e-4
