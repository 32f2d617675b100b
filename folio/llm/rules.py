"""Quality rules: learned decision lists over text statistics. Native.

Sequential covering: a rule is a conjunction of thresholds on text statistics. It grows by
the condition with the best gain on labelled rows, is pruned on other labelled rows, and,
if precise enough there, joins the list; the rows that it covers are set aside and the next
rule is grown. Each step is one small count by statistic, threshold and label. The list
becomes a chain of Spark conditions, so judging a document needs no shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import WORD, cut, let, table, text_or_empty, wrapped

REPEAT_WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

#: Labelled rows that rules are learned from at most (a hash sample of them beyond that).
LABELLED_ROWS = 20_000
THRESHOLDS = 40
RULES, CONDITIONS = 8, 3
#: Share of rejects among the pruning rows that a rule covers, and how many it has to cover.
PRECISION, COVERS = 0.9, 5

STATISTICS = ("n_words", "mean_word", "symbol_rate", "repeat_rate", "dup_line_rate", "distinct_rate", "capital_rate", "mark_rate")


def _repeated_words(hashes: Column) -> Column:
    """Words under windows whose hash occurs twice, given the hash of the window at each word."""

    def neighbour(s: Column, k: Column) -> Column:
        own = F.get(s, k)["h"]
        return F.coalesce((k > 0) & (F.get(s, k - 1)["h"] == own), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == own, F.lit(False))

    def covered(p: Column) -> Column:
        step = lambda acc, k: acc + F.least(F.lit(REPEAT_WINDOW), F.get(p, k + 1) - F.get(p, k)).cast("long")
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 2), F.lit(REPEAT_WINDOW).cast("long"), step)

    def places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda e, k: neighbour(s, k)), lambda e: e["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, places), covered)


def _window_hashes(words: Column) -> Column:
    own = F.transform(words, lambda w: F.xxhash64(w))
    at = F.sequence(F.lit(0), F.size(words) - REPEAT_WINDOW)
    return let(own, lambda a: F.transform(at, lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(REPEAT_WINDOW)])))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the statistics.

    All come with a leading underscore. Null texts count as empty.
    """
    text = text_or_empty()
    nonblank = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    first = docs.withColumns({"_text": text, "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "_lines": nonblank})
    n = F.size("_words").cast("long")
    repeats = let(
        _window_hashes(F.col("_words")),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_repeated_words(h)),
    )
    per_word = F.greatest(F.col("_n_words"), F.lit(1)).cast("double")
    counts = {
        "_n_words": n,
        "_word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_repeat_words": F.when(F.size("_words") >= REPEAT_WINDOW, repeats).otherwise(F.lit(0).cast("long")),
        "_n_lines": F.size("_lines"),
        "_n_distinct": F.size(F.array_distinct("_words")),
        "_n_capitals": F.regexp_count("_text", F.lit(r"\p{Lu}")),
        "_n_marks": F.regexp_count("_text", F.lit("[!?]")),
    }
    statistics = {
        "_s_n_words": F.col("_n_words").cast("double"),
        "_s_mean_word": F.col("_word_chars") / per_word,
        "_s_symbol_rate": F.col("_n_symbols") / per_word,
        "_s_repeat_rate": F.col("_n_repeat_words") / per_word,
        "_s_dup_line_rate": F.col("_n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        # Of the logarithms, as long texts repeat words without harm.
        "_s_distinct_rate": F.log1p("_n_distinct") / F.log1p(per_word),
        "_s_capital_rate": F.col("_n_capitals") / F.greatest(F.col("_word_chars"), F.lit(1)),
        "_s_mark_rate": F.col("_n_marks") / per_word,
    }
    return first.withColumns(counts).drop("_text", "_words", "_lines").withColumns(statistics)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # statistic > threshold, else <= threshold
    threshold: float
    place: int

    def column(self) -> Column:
        x = F.col(f"_s_{self.statistic}")
        return x > self.threshold if self.above else x <= self.threshold

    def binned(self) -> Column:
        x = F.col(f"b_{self.statistic}")
        return x > self.place if self.above else x <= self.place

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _best(counts: dict, edges: dict[str, list[float]]) -> tuple[float, Condition] | None:
    """The condition with the most gain: rejects covered times the rise of the log precision."""
    import math

    best = None
    total = [sum(v[y] for v in counts.get(STATISTICS[0], {}).values()) for y in (0, 1)]
    if not total[1]:
        return None
    base = math.log(total[1] / sum(total))
    for s in STATISTICS:
        below = [0, 0]
        for place, edge in enumerate(edges[s]):
            at = counts.get(s, {}).get(place, [0, 0])
            below = [below[0] + at[0], below[1] + at[1]]
            for above, (good, bad) in ((False, below), (True, [total[0] - below[0], total[1] - below[1]])):
                if bad >= COVERS:
                    gain = bad * (math.log(bad / (bad + good)) - base)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Condition(s, above, edge, place))
    return best


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """The ordered rules that reject, from ``labels`` (doc_id, quality 0 or 1).

    Null labels and labels of unknown documents are left out; of several for one doc_id the
    lowest counts. Without rejected or without kept rows there are no rules.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") <= 0).cast("int").alias("bad"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000))
    sample = known.where(draw < min(1_000_000, 1_000_000 * rows // max(n, 1)))
    # The sample is bounded by a parameter, so it may be broadcast; the texts stay where they are, and
    # only the statistics of the sample are moved together.
    stats = [f"_s_{s}" for s in STATISTICS]
    base = cut(measured(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).select("doc_id", "bad", *stats).repartition(4, "doc_id"))
    cuts = base.agg(*[F.percentile_approx(s, [i / THRESHOLDS for i in range(THRESHOLDS + 1)], 10_000).alias(s) for s in stats]).first()
    if cuts is None or cuts[0] is None:
        return []
    # Thresholds stand midway between neighbouring quantiles, so that a rule keeps a distance to either side.
    seen = {s: sorted(set(cuts[f"_s_{s}"])) for s in STATISTICS}
    edges = {s: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for s, v in seen.items()}
    place = lambda s: sum([(F.col(f"_s_{s}") > e).cast("int") for e in edges[s]], F.lit(0))
    pruning = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3)) == 0
    binned = cut(base.select("bad", pruning.alias("pruning"), *[place(s).alias(f"b_{s}") for s in STATISTICS]))
    columns = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"b_{s}").alias("b")) for s in STATISTICS])).alias("x")

    def count(where: Column) -> dict:
        out: dict = {}
        for r in binned.where(where).select("bad", columns).groupBy("x.s", "x.b", "bad").count().collect():
            out.setdefault(r["s"], {}).setdefault(r["b"], [0, 0])[r["bad"]] += r["count"]
        return out

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < RULES:
        grown: list[Condition] = []
        while len(grown) < CONDITIONS:
            here = count(left & ~F.col("pruning") & _all([c.binned() for c in grown]))
            found = _best(here, edges)
            if not found:
                break
            grown.append(found[1])
        if not grown:
            break
        prefixes = [grown[: i + 1] for i in range(len(grown))]
        sums = [F.sum(F.when(_all([c.binned() for c in p]) & (F.col("bad") == y), 1).otherwise(0)) for p in prefixes for y in (0, 1)]
        tried = binned.where(left & F.col("pruning")).agg(*[x.alias(f"c{i}") for i, x in enumerate(sums)]).first()
        scored = [((tried[2 * i + 1] or 0), (tried[2 * i] or 0), p) for i, p in enumerate(prefixes)]
        worth = [((bad - good) / (bad + good), -len(p), bad / (bad + good), p) for bad, good, p in scored if bad >= COVERS]
        if not worth:
            break
        _, _, precision, pruned = max(worth, key=lambda w: w[:2])
        if precision < PRECISION:
            break
        rules.append(tuple(pruned))
        left = left & ~_all([c.binned() for c in pruned])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered condition: false at the first rule that holds, else true."""
    chain = None
    for rule in rules:
        holds = _all([c.column() for c in rule])
        chain = F.when(holds, F.lit(False)) if chain is None else chain.when(holds, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("_n_words") < 20) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * 30)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``_base_failed`` and ``_kept``; every row has both, blank texts fail the base.

    Null texts count as empty. Very long texts are measured whole. Every row is judged by itself, so repeated
    rows each have the same verdict and an empty table gives no rows; a statistic that equals a threshold
    counts as not above it. Columns of ``docs`` that have the name of a count or statistic are replaced.
    """
    rules = learn(docs, labels)
    return measured(docs).withColumn("_base_failed", base_failed()).withColumn("_kept", ~F.col("_base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept; columns unchanged, also those with the name of a count. Otherwise as ``judge``."""
    return judge(wrapped(docs, "doc_id", "text"), labels).where("_kept").select("_row.*")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"_{c}").alias(c) for c in counts])
