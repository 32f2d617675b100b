"""Personal data by weak supervision.

Four exact patterns (email, ip, card, phone) give the base spans, which always stay. Beside
them wider patterns propose candidates: written-out emails, cards in other groupings, phone
numbers without a plus, addresses of the wrong shape. Labelers vote on each of these candidates, for,
against or not at all: a pattern of its own kind (it abstains on what only fails a base pattern),
its check sum and structure, gazetteers of endings, issuers and country codes, cue words around
it, and how it stands in the text. Base spans are certain, so they have no vote and no part in what follows.
Expectation-maximisation over the counts of vote patterns, of which there is a fixed number,
estimates how reliable each labeler is and how likely each pattern is personal data. The final
span classifier sees no votes, but the span: its shape with the lengths of its groups, first and
number of digits, check sum, ending, and the words and characters beside it. It is a logistic model
over hashed features, trained on the probabilities of at most SAMPLED candidates, and decides on
every candidate that is not a base span. Documents are read once.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import cut, small_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Hash buckets of the span classifier's features, and candidates that it is trained on.
FEATURES = 4096
SAMPLED = 20_000
LABELERS = ("pattern", "structure", "gazetteer", "context", "standing")

# Possessive quantifiers: each scan is linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z]{2,24}(?![A-Za-z])", re.I)
_GROUPED = re.compile(r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_DOMESTIC = re.compile(r"(?<![0-9+(.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")

#: The wider patterns that speak for a candidate of their kind.
OWN = {0: _SPELT, 2: _GROUPED, 3: _DOMESTIC}

#: Endings, country codes and cue words of the gazetteer and context labelers.
ENDINGS = frozenset("com org net edu gov info io de fr es uk it nl eu ch at be pl pt br ca us au jp cn in ru".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "90", "91", "351", "352", "353", "358", "420")
CUES = {
    "email": frozenset("email mail contact write address courriel correo kontakt".split()),
    "ip": frozenset("ip host server address login client ipv4".split()),
    "card": frozenset("card visa mastercard amex credit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell ring telefon telefono".split()),
}
ISSUERS = ("34", "37", "4", "5", "6", "2", "30", "36", "38")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: from each @ back over the local part and on over the domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done))
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def _ip_ok(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in s.split(".")))


def _ending(s: str) -> str:
    return re.split(r"[^A-Za-z0-9-]+", s.rstrip("."))[-1].lower()


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """``(kind, start, end, base)`` of base spans and of the wider patterns that overlap none."""
    base, wide = [], []
    if "@" in text:
        base += [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        (base if _ip_ok(m[0]) else wide).append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            base.append((2, m.start(), m.end()))
        elif 13 <= len(d) <= 19:
            wide.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_digits(m[0]))
            (base if 8 <= n <= 15 else wide).append((3, m.start(), m.end()))
    wide += [(0, m.start(), m.end()) for m in _SPELT.finditer(text)] if "at" in text and "dot" in text.lower() else []
    wide += [(2, m.start(), m.end()) for m in _GROUPED.finditer(text)]
    wide += [(3, m.start(), m.end()) for m in _DOMESTIC.finditer(text)]
    starts, ends = [], []  # what base spans cover, as intervals apart from each other
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out, done = [(k, a, b, True) for k, a, b in base], 0
    for k, a, b in sorted(set(wide), key=lambda w: (w[1], -w[2], w[0])):
        i = bisect_left(starts, b)
        if a >= done and not (i and ends[i - 1] > a):
            out.append((k, a, b, False))
            done = b
    return sorted(out)


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[str, int]:
    """A vote of each labeler as one of ``+-0``, and the length's class."""
    s = text[start:end]
    digits = _digits(s)
    if kind == 0:
        # Said in plain words it may be prose ("look at this dot matrix"), so only signs speak for it.
        structure = "+" if base or re.search(r"[\[({]", s) else "0"
        gazetteer = "+" if _ending(s) in ENDINGS else "-"
    elif kind == 1:
        structure = "+" if _ip_ok(s) else "-"
        gazetteer = "-" if s.startswith(("0.", "127.", "255.")) or not structure == "+" else "+"
    elif kind == 2:
        structure = "+" if luhn(digits) else "-"
        gazetteer = "+" if digits.startswith(ISSUERS) and len(set(digits)) > 2 else "-"
    else:
        structure = "+" if 8 <= len(digits) <= 15 and not re.search(r"\d{9,}", s[1:]) else "-"
        gazetteer = "+" if s[0] == "+" and digits.startswith(COUNTRY_CODES) or s[0] == "(" else "0"
    around = set(re.findall(r"\w+", text[max(0, start - 40) : start].lower()))
    context = "+" if around & CUES[KINDS[kind]] else "-" if any(around & CUES[k] for k in KINDS if k != KINDS[kind]) else "0"
    before, after = text[start - 1 : start], text[end : end + 1]
    standing = "-" if before.isalnum() or after.isalnum() else "+"
    pattern = "+" if base or kind in OWN and OWN[kind].fullmatch(s) else "0"
    return pattern + structure + gazetteer + context + standing, min(len(s) // 8, 3)


def fit(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Pattern -> probability of personal data, from the number of candidates of each pattern.

    A pattern is ``kind|votes|length``. Expectation-maximisation over kinds' rates and each
    labeler's votes given the truth, with priors that labelers are mostly right. Cards with a failing
    check sum and addresses out of range are none by definition: known cases, which anchor the rest.
    """
    if not counts:
        return {}
    names = sorted(counts)
    n = np.array([counts[p] for p in names], dtype=float)
    kind = np.array([int(p.split("|")[0]) for p in names])
    vote = np.array([["-0+".index(c) for c in p.split("|")[1]] for p in names])
    known = ((kind == 1) | (kind == 2)) & (vote[:, 1] == 0)
    # The prior's weight is a share of the data, so that it means the same at any size.
    weight = 0.3 * n.sum()
    right = np.array([0.65, 0.9, 0.7, 0.6, 0.6])
    prior = np.stack([np.stack([r, np.full(5, 0.1), 1 - r], 1) if y == 0 else np.stack([1 - r, np.full(5, 0.1), r], 1) for y in (0, 1) for r in [right]])
    prior /= prior.sum(2, keepdims=True)
    theta, rate = prior.copy(), np.full(len(KINDS), 0.5)
    at = np.arange(len(LABELERS))
    for _ in range(rounds):
        logs = np.stack([np.log(theta[y][at, vote]).sum(1) for y in (0, 1)]) + np.log(np.stack([1 - rate[kind], rate[kind]]))
        p = np.where(known, 0.0, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))))
        for y, q in ((0, 1 - p), (1, p)):
            seen = np.stack([[(n * q * (vote[:, i] == v)).sum() for v in range(3)] for i in at])
            theta[y] = (seen + weight * prior[y]) / (seen.sum(1, keepdims=True) + weight)
        for k in range(len(KINDS)):
            own = kind == k
            rate[k] = ((n * p)[own].sum() + 1) / (n[own].sum() + 2)
    return dict(zip(names, p.tolist(), strict=True))


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashed features of a candidate: shape and group lengths, digits, check sum and ending, the words and characters on both sides."""
    s = text[start:end]
    digits = _digits(s)
    shape = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), re.sub(r"[^\W\d_]+", "a", s))
    before, after = re.findall(r"\w+", text[max(0, start - 40) : start].lower())[-2:], re.findall(r"\w+", text[end : end + 40].lower())[:1]
    said = [f"k{kind}", f"s{kind}{shape}", f"g{kind}{len(re.findall('[0-9]+', s))}", f"n{kind}{min(len(s) // 4, 12)}"]
    said += [f"e{_ending(s)}"] if kind == 0 else [f"f{kind}{digits[:2]}", f"m{kind}{min(len(digits), 24)}", f"l{kind}{luhn(digits)}"]
    said += [f"b{kind}{w}" for w in before] + [f"a{kind}{w}" for w in after]
    said += [f"c{kind}{_class(text[start - 1 : start])}", f"d{kind}{_class(text[end : end + 1])}"]
    return sorted({xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), 5) % FEATURES for x in said})


def _class(c: str) -> str:
    return "w" if c.isspace() else "a" if c.isalpha() else "0" if c.isdigit() else c


def train(rows: list[tuple[list[int], float]], rounds: int = 200) -> np.ndarray:
    """Weights of the logistic span classifier from candidates' features and probabilities; all rows at once, by Adam."""
    w = np.zeros(FEATURES)
    if not rows:
        return w
    n = np.array([len(f) for f, _ in rows])
    at, of, p = np.concatenate([f for f, _ in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), n), np.array([q for _, q in rows])
    m, v = np.zeros(FEATURES), np.zeros(FEATURES)
    for step in range(1, rounds + 1):
        q = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], len(rows)), -30, 30)))
        g = np.bincount(at, (q - p)[of], FEATURES) / len(rows) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


SCHEMA = "doc_id long, spans array<struct<kind:int,start:int,end:int,base:boolean,pattern:string,features:array<int>>>"


def find_candidates(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string()), ("features", pa.list_(pa.int32()))]))

    def one(text: str) -> list[dict]:
        out = []
        for k, a, b, base in candidates(text):
            v, size = votes(text, k, a, b, base)
            out.append({"kind": k, "start": a, "end": b, "base": base, "pattern": f"{k}|{v}|{size}", "features": [] if base else features(text, k, a, b)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t or "") for t in batch.column(1).to_pylist()], kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, spans)``: base spans and the candidates with a probability over ``threshold``, by kind and start.

    Null texts count as empty and have no spans, as have texts without candidates. Very long texts
    are read whole. Of wider candidates that overlap, the first and then the longest counts; base spans
    always stay. Repeated rows each give a row, null doc_ids stay null, an empty table gives no
    rows. Columns other than doc_id and text, whatever their names, are ignored.
    """
    found = cut(find_candidates(docs))
    each = found.select("doc_id", F.explode(F.filter("spans", lambda s: ~s["base"])).alias("s"))
    # Patterns: 4 kinds, 3 votes of 5 labelers and 4 lengths, so 3,888 rows at the very most.
    counts = {r["p"]: r["n"] for r in each.groupBy(F.col("s.pattern").alias("p")).agg(F.count("*").alias("n")).collect()}
    likely = fit(counts)
    # The SAMPLED candidates with the smallest hashes; those that tie in all of this are equal. The share spares the sort the rest.
    share = min(1_000_000, 2_000_000 * SAMPLED // max(sum(counts.values()), 1) + 1)
    hashed = each.select(F.pmod(F.xxhash64("doc_id", "s.start", "s.end"), F.lit(1_000_000)).alias("h"), "s.features", "s.pattern").where(F.col("h") < share)
    drawn = hashed.orderBy("h", "pattern", "features").limit(SAMPLED).collect()
    rows = sorted((r["features"], likely[r["pattern"]]) for r in drawn)
    weights = F.from_json(F.lit(json.dumps(train(rows).tolist())), "array<double>")
    score = lambda s: F.aggregate(s["features"], F.lit(0.0), lambda acc, f: acc + F.get(weights, f))
    edge = math.log(threshold / (1 - threshold))
    return found.select("doc_id", F.filter("spans", lambda s: s["base"] | (score(s) > edge)).alias("spans"))


def redact(text: str, spans: list) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(((s["kind"], s["start"], s["end"]) for s in spans), key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
            at = b
    return "".join([*out, text[at:]])


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    names = F.lit(list(KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
