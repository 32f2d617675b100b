"""URL filters by a Bloom filter cascade.

Listed keys are told from all other keys that occur by a chain of Bloom filters: the first
holds the listed keys, the second those of the other keys that the first lets through, the
third the listed keys that the second lets through, and so on until none is left. As the
chain is built over every key of the corpus, its answers for them are exact, and a URL is
judged by looking at a few bits, without a join.

A key is a host or a parent domain of it, followed by a prefix of the path as long as some
listed rule's; or a word of the host, marked as one. Only parameters list keys, so a list is as
long as the parameters are. The first filter is made so sharp that it lets through about as
many other keys as the list has: the filters' size then follows the list and the logarithm
of the corpus. Keys are hashed by Spark and counted as distinct before a level is built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import cut, small_batches, table

#: Host, path and verdict of the rules.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: A host without a rule is blocked if one of these is a word of one of its labels.
BLOCKED_WORDS = ("adult", "bet", "bets", "casino", "escort", "gambling", "pills", "poker", "porn", "sex", "viagra", "xxx")

#: Levels at most. Each lets a quarter of the level before through, so only two keys with equal hashes get here.
LEVELS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and for URLs without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def probe_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Each of the host's ``labels`` shortest parent domains with each listed length of the path's start."""
    parts = F.split(host, r"\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    heads = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    whole = F.array_union(ends, F.array(host))
    return F.flatten(F.transform(whole, lambda e: F.array_compact(F.array(*[F.concat(e, h) for h in heads]))))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class Level(NamedTuple):
    """A Bloom filter. It is sent to the tasks as a plain tuple."""

    bits: int
    hashes: int
    salt: int
    words: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), dtype=bool)
        for at in _bit_places(h1, h2, self.bits, self.hashes, self.salt):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _bit_places(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int, salt: int) -> Iterator[np.ndarray]:
    """The bits of each key; other ones at each level, as ``salt`` is the level's number."""
    x = h1 + np.uint64(salt + 1) * h2
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    for i in range(hashes):
        y = (x + np.uint64(i) * (h2 | np.uint64(1))) * np.uint64(0xC4CEB9FE1A85EC53)
        yield (y ^ (y >> np.uint64(31))) % np.uint64(bits)


def in_cascade(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the corpus are listed: so if the first level without them is an even one."""
    listed = np.zeros(len(h1), dtype=bool)
    left = np.arange(len(h1))
    for depth, level in enumerate(levels):
        inside = level.has(h1[left], h2[left])
        listed[left[~inside]] = bool(depth % 2)
        left = left[inside]
    listed[left] = bool(len(levels) % 2)
    return listed


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of ``n`` keys (h1, h2); Spark ors the bits, the driver gets the finished words."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    hashes = min(32, max(1, round(bits / n * math.log(2))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, dtype=np.uint64)
        for b in batches:
            h1, h2 = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            for at in _bit_places(h1, h2, bits, hashes, salt):
                np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["place", "word"])

    parts = keys.select("h1", "h2").mapInArrow(run, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word"))
    words = np.zeros(bits // 64, dtype=np.uint64)
    # At most a word for each bit that a listed key sets: the list's size, not the corpus's.
    found = parts.toArrow()
    words[found.column("place").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return Level(bits, hashes, salt, words)


def _through(keys: DataFrame, level: Level) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(tuple(level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            yield b.filter(pa.array(Level(*sent.value).has(h1, h2)))

    return keys.select("h1", "h2").mapInArrow(run, "h1 long, h2 long")


def build_cascade(listed: DataFrame, others: DataFrame, n: int | None = None, rest: int | None = None) -> list[Level]:
    """Levels that tell ``listed`` from ``others`` (h1, h2 of distinct keys, apart from each other).

    ``n`` and ``rest`` are their counts where known. Two keys count as one only if both 64-bit hashes
    agree. The list may be empty.
    """
    levels: list[Level] = []
    inside, outside = listed.select("h1", "h2"), others.select("h1", "h2")
    n, rest = inside.count() if n is None else n, outside.count() if rest is None else rest
    while n:
        if len(levels) == LEVELS:
            raise ValueError("the cascade does not end: a listed key and another one have the same two hashes")
        # The first level lets through about as many others as it has keys; then a quarter, as is usual.
        rate = 0.25 if levels else min(0.25, n / max(rest, 1))
        levels.append(_level(inside, n, rate, len(levels)))
        inside, outside = cut(_through(outside, levels[-1])), inside
        n = inside.count()
    return levels


def _rule_keys(rules: DataFrame) -> DataFrame:
    """``(key, verdict, length, labels)``: each listed key once, with its path's length and its host's labels."""
    host, path = F.lower("host"), F.coalesce("path", F.lit(""))
    named = rules.where("host is not null and verdict is not null").select(F.concat(host, path).alias("key"), "verdict", F.length(path).alias("length"), F.size(F.split("host", "[.]")).alias("labels"))
    return named.groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("length").alias("length"), F.max("labels").alias("labels"))


def judge_urls(pages: DataFrame, rules=RULES, blocked_words=BLOCKED_WORDS) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    The longest fitting rule's verdict holds; without one, a host with one of ``blocked_words`` as a
    word of its labels is blocked and any other allowed. Null URLs and URLs without ``://`` have an
    empty host and path, fit no rule and are allowed. Very long URLs are looked at whole: only the
    hosts' last labels and the starts of paths can be listed. Repeated rows each give a row, an
    empty table gives none. Columns other than page_id and url, whatever their names, are ignored.

    ``rules`` is a sequence of (host, path, verdict) or, for long lists, a table with these columns, whose
    keys meet the universe in a join. Either may be empty. Hosts are held in lower case, null
    paths count as empty, rules without host or verdict are left out, and of two verdicts on one key block holds.
    """
    spark = pages.sparkSession
    small_batches(spark)
    listed = _rule_keys(rules) if isinstance(rules, DataFrame) else None
    if listed is None:
        lengths = sorted({0, *(len(p) for _, p, _ in rules)})
        labels = max((h.count(".") + 1 for h, _, _ in rules), default=1)
    else:
        # Two facts of the list: how long its paths are, each length once, and how many labels its hosts have at most.
        shape = listed.agg(F.collect_set("length").alias("lengths"), F.max("labels").alias("labels")).first()
        lengths, labels = sorted({0, *shape["lengths"]}), shape["labels"] or 1
    host, path = url_parts(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    # No host or path prefix has a question mark, so words cannot be mistaken for them.
    words = F.transform(F.filter(F.split("host", "[^a-z]+"), lambda w: w != ""), lambda w: F.concat(F.lit("?"), w))
    keyed = parts.withColumn("keys", F.array_union(probe_keys(F.col("host"), F.col("path"), labels, lengths), words))

    # The complete universe of keys: each once, with what lists it.
    found = keyed.select(F.explode("keys").alias("key")).distinct()
    if listed is None:
        kinds = F.lit(None).cast("string")
        for verdict in ("allow", "block"):
            kinds = F.when(F.col("key").isin([h + p for h, p, v in rules if v == verdict]), F.lit(verdict)).otherwise(kinds)
    else:
        found, kinds = found.join(listed.select("key", "verdict"), "key", "left"), F.col("verdict")
    kinds = F.when(F.col("key").isin([f"?{w}" for w in blocked_words]), F.lit("word")).otherwise(kinds)
    named = found.withColumn("kind", kinds)
    every = cut(named.select("kind", _hashes(F.col("key")).alias("h")).select("kind", "h.*"))
    sizes = {r["kind"]: r["count"] for r in every.groupBy("kind").count().collect()}
    total = sum(sizes.values())
    lists = {}
    for k in ("allow", "block", "word"):
        own = F.col("kind").eqNullSafe(F.lit(k))
        lists[k] = build_cascade(every.where(own), every.where(~own), sizes.get(k, 0), total - sizes.get(k, 0))
    sent = spark.sparkContext.broadcast({k: [tuple(x) for x in levels] for k, levels in lists.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(3)
            flat = keys.flatten().to_pylist()
            h = b.column(4).flatten()
            h1, h2 = (np.asarray(h.field(i)).view(np.uint64) for i in (0, 1))
            hits = {k: in_cascade([Level(*x) for x in levels], h1, h2) for k, levels in sent.value.items()}
            sizes = np.diff(keys.offsets.to_numpy())
            rule, verdict, at = [], [], 0
            for n in sizes.tolist():
                best, says = None, "allow"
                for i in range(at, at + n):
                    if (hits["allow"][i] or hits["block"][i]) and (best is None or len(flat[i]) > len(best)):
                        best, says = flat[i], "allow" if hits["allow"][i] else "block"
                if best is None and hits["word"][at : at + n].any():
                    says = "block"
                rule.append(best)
                verdict.append(says)
                at += n
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    hashed = keyed.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "keys", F.transform("keys", _hashes).alias("hashes"))
    return hashed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_ALLOWED = ", ".join(f"'{h}{p}'" for h, p, v in RULES if v == "allow")
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)

ORACLE = {
    "op9_urls": f"""
        WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT page_id, regexp_extract(r, '^([^/?#]*)', 1) AS raw, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        hosts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
        ruled AS (SELECT *, CASE {_FITS} END AS rule FROM hosts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ({_ALLOWED}) THEN 'allow'
                    WHEN rule IS NOT NULL THEN 'block'
                    WHEN regexp_matches(host, '(^|[^a-z])({"|".join(BLOCKED_WORDS)})([^a-z]|$)') THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM ruled
    """
}
