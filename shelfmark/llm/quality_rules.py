"""Quality rules as a learned decision list (operator 6).

Text statistics are DataFrame expressions over the whole text. A decision
list is learned from labelled statistics by sequential covering: a rule is
grown greedily (FOIL gain over threshold tests) on two thirds of the
labelled rows that the base keeps, pruned from its end on the other third,
kept if it is precise there, and the rows it covers are removed before the
next rule; one that is not kept removes nothing, and no later rule begins
with its first test or one much like it.
The list becomes one ordered ``when(...).when(...)`` expression, so judging
a corpus is a projection of the scan: no shuffle and no Python.

Defined results: a null text counts as empty (0 in every count, base
failed); rows with equal ids are judged one by one; an empty table gives an
empty result; without labels of both kinds the list has no rule and only
the base decides. Only the id and text columns are read, so other columns
may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, let, spread, words

#: Most labelled rows that the list is fitted on (taken by hash of the id).
FIT_ROWS = 10_000
#: Longest conjunction, most rules, thresholds tried per statistic.
MAX_TESTS, MAX_RULES, CUTS = 3, 12, 24
#: Rules that may be set aside; each bans its first test from coming first.
MAX_BANNED = 60
#: A rule stays if so much of what it covers among the pruning rows is bad.
PRECISION = 0.97
#: With wrong labels among them: or if even the lower confidence bound (normal
#: quantile ``Z``) closes this part of the gap from the base rate to 1.
GAIN, Z = 0.8, 1.96
#: Least bad rows that a rule covers among the growing rows.
SUPPORT = 8

BASE_MIN_WORDS, BASE_MAX_REPEAT_PCT = 50, 50

RATIOS = ["mean_word", "symbol_share", "upper_share", "letter_share", "repeat_share",
          "dup_line_share", "exclaim_share", "distinct_share", "words_per_line"]


def _repeated_words(ws: Column) -> Column:
    """Words inside any 3-word window that is found twice or more.

    The windows are sorted with their positions; neighbours that are equal
    mark repeated ones, whose positions, sorted, give the words covered:
    a window adds three words, less those that the one before it covers.
    """
    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"),
            i.alias("i")))

    def repeated(s):
        def same(x, j):
            return F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        return F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))

    def covered(at):
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(
            p.alias("last"),
            (a["n"] + F.least(F.lit(3), p - a["last"])).cast("bigint").alias("n")),
            lambda a: a["n"])

    found = let(F.sort_array(windows(ws)), repeated)
    return F.when(F.size(ws) < 4, F.lit(0).cast("bigint")).otherwise(
        covered(F.array_sort(F.transform(found, lambda x: x["i"]))))


def _left(text: Column, pattern: str) -> Column:
    """Characters that ``pattern`` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of every whole text."""
    t = F.col("t")
    d = docs.select(F.col(id_col).alias("doc_id"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", words(t).alias("ws"),
                 F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("ls"))
    d = d.select(
        "doc_id",
        F.size("ws").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(t, GAP, "")).cast("bigint").alias("word_chars"),
        _left(t, r"[#*$%&|<>]+").cast("bigint").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(F.col("ws")).alias("n_repeat_words"),
        F.size("ls").alias("n_lines"),
        _left(t, r"\p{Lu}+").alias("n_upper"),
        _left(t, r"\p{L}+").alias("n_letters"),
        _left(t, r"!+").alias("n_exclaim"),
        F.size(F.array_distinct("ws")).alias("n_distinct"))
    part = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        part("word_chars", "n_words").alias("mean_word"),
        part("n_symbols", "word_chars").alias("symbol_share"),
        part("n_upper", "word_chars").alias("upper_share"),
        part("n_letters", "word_chars").alias("letter_share"),
        part("n_repeat_words", "n_words").alias("repeat_share"),
        part("n_dup_lines", "n_lines").alias("dup_line_share"),
        part("n_exclaim", "word_chars").alias("exclaim_share"),
        part("n_distinct", "n_words").alias("distinct_share"),
        part("n_words", "n_lines").alias("words_per_line"))


# --- learning -------------------------------------------------------------

@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.name] > self.cut if self.above else row[self.name] <= self.cut

    def column(self) -> Column:
        c = F.col(self.name)
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


def _counts(rows: list, tests: list[Test]) -> tuple[int, int]:
    hit = [bad for row, bad in rows if all(t.holds(row) for t in tests)]
    return sum(hit), len(hit) - sum(hit)


def _grow(rows: list, names: list[str], banned: list[tuple[str, bool, int]] = ()) -> list[Test]:
    """Adds the test of best FOIL gain until only bad rows are covered; the
    first is none of the ``banned`` (a statistic, a side, and the number of
    rows covered, give or take a quarter)."""
    tests: list[Test] = []
    while len(tests) < MAX_TESTS:
        p0 = sum(bad for _, bad in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
        for name in names:
            pairs = sorted((row[name], bad) for row, bad in rows)
            step = max(1, len(pairs) // CUTS)
            p = n = 0
            for i, (v, bad) in enumerate(pairs[:-1]):
                p, n = p + bad, n + (not bad)
                nxt = pairs[i + 1][0]
                if nxt == v or (i % step and bad == pairs[i + 1][1]):
                    continue
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a >= SUPPORT:
                        gain = a * (math.log2(a / (a + b)) - base)
                        if gain > best[0] + 1e-9 and (tests or not any(
                                (name, above) == x[:2] and 4 * abs(a + b - x[2]) <= x[2] for x in banned)):
                            best = (gain, Test(name, above, (v + nxt) / 2))
        if best[1] is None:
            break
        tests.append(best[1])
        rows = [(r, bad) for r, bad in rows if best[1].holds(r)]
    return tests


def _prune(rows: list, tests: list[Test]) -> list[Test]:
    """The leading tests with the best (bad - good) / covered."""
    def worth(k):
        p, n = _counts(rows, tests[:k])
        return ((p - n) / (p + n) if p + n else -1.0, -k)
    return tests[:max(range(1, len(tests) + 1), key=worth)] if tests else tests


def _precise(p: int, n: int, base: float) -> bool:
    """Whether a rule that covers ``p`` bad and ``n`` good pruning rows stays;
    ``base`` is the share of bad rows."""
    if not p:
        return False
    share, total = p / (p + n), p + n
    # Wilson's lower bound
    low = (share + Z * Z / (2 * total) - Z * math.sqrt(share * (1 - share) / total + Z * Z / (4 * total * total))) / (1 + Z * Z / total)
    return share >= PRECISION or low >= base + GAIN * (1 - base)


def learn(rows: list[tuple[dict, bool]], names: list[str] = RATIOS) -> list[list[Test]]:
    """Ordered rules (conjunctions) for bad rows; ``rows``: (statistics, bad)."""
    grow = [x for i, x in enumerate(rows) if i % 3 != 2]
    prune = [x for i, x in enumerate(rows) if i % 3 == 2]
    base = sum(bad for _, bad in prune) / max(1, len(prune))
    rules: list[list[Test]] = []
    banned: list[tuple[str, bool, int]] = []
    while len(rules) < MAX_RULES and len(banned) < MAX_BANNED and sum(bad for _, bad in grow) >= SUPPORT:
        tests = _prune(prune, _grow(grow, names, banned))
        if not tests:
            break
        if _precise(*_counts(prune, tests), base):
            left = lambda part: [x for x in part if not all(t.holds(x[0]) for t in tests)]
            rules.append(tests)
            grow, prune = left(grow), left(prune)
        else:  # its rows stay for the rules after it
            first = tests[0]
            banned.append((first.name, first.above, sum(_counts(grow, [first]))))
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = FIT_ROWS) -> list[list[Test]]:
    """Rules from at most ``max_rows`` labelled documents (0: bad, 1: good)
    that the base keeps, chosen by hash of the id: what it rejects needs no
    rule and would only hide the others. Null labels and ids are left out; of several
    labels of one id the least counts."""
    chosen = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y"))
              .where("doc_id is not null and y is not null")
              .groupBy("doc_id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # at most max_rows (id, label) pairs: a fixed bound
    picked = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).join(
        F.broadcast(chosen), "doc_id")
    got = (statistics(picked).join(F.broadcast(chosen), "doc_id")
           .orderBy(F.xxhash64("doc_id"), "doc_id", *RATIOS).limit(max_rows).collect())
    return learn([(r.asDict(), r["y"] == 0) for r in got if not (
        r["n_words"] < BASE_MIN_WORDS or 100 * r["n_repeat_words"] > BASE_MAX_REPEAT_PCT * r["n_words"])])


def verdict(rules: list[list[Test]]) -> Column:
    """The list as an ordered conditional: the first rule that fires, else null."""
    out = F.lit(None).cast("string")
    for i in range(len(rules) - 1, -1, -1):
        every = rules[i][0].column()
        for t in rules[i][1:]:
            every = every & t.column()
        name = " and ".join(map(str, rules[i]))
        out = F.when(every, F.lit(name)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < BASE_MIN_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PCT * F.col("n_words"))


def judge(docs: DataFrame, rules: list[list[Test]], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the rule that rejected it."""
    s = statistics(docs, id_col, text_col).withColumns(
        {"base_failed": base_failed(), "rule": verdict(rules)})
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base and the learned list keep; all columns."""
    rules = fit(docs, labels)
    # judged in the row itself: the document rides along under its own struct
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"),
                       F.col("text"))
    # a row number in the condition keeps it above the statistics: pushed
    # below them it would hold a copy of each statistic for each use of it
    kept = (judge(rows, rules).withColumn("row", F.monotonically_increasing_id())
            .where("kept and row >= 0"))
    return kept.select(*[F.col("doc_id").getField(c).alias(c) for c in docs.columns])
