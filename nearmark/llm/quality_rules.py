"""Quality rules: a decision list learned from labelled statistics, applied as one Spark CASE expression.

Sequential covering: a rule grows by the threshold with the best information gain over the labelled rows that
no earlier rule covers, is pruned back on rows kept aside, and joins the list while its precision there holds.
Growing looks at counts per feature and quantile bin only, so each step is one small aggregate whatever the
number of labelled rows.  All of it is DataFrame code.

Defined results: null, empty and blank texts have no words and fail the base rule; a null doc_id has no label;
rows repeating a doc_id are scored each; without labels the list is empty and the base rule decides alone;
further columns of the input are carried through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, let, words

#: Fixed values of the base rule.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
WINDOW = 3
MAX_REPEAT_PERCENT = 50

FEATURES = ["symbol_share", "repeat_share", "dup_line_share", "mean_word", "log_words"]
BINS = 32
#: Up to so many repeated windows are looked up one by one; texts with more sort their windows instead.
FEW = 24


def repeated_words(w: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more."""

    def union_length(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def by_lookup(hashes: Column, twice: Column) -> Column:
        at = F.transform(hashes, lambda x, i: F.when(F.array_contains(twice, x), i))
        return let(F.filter(at, lambda i: i.isNotNull()), union_length)

    def by_sort(hashes: Column) -> Column:
        def starts(s: Column) -> Column:
            same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            at = F.transform(s, lambda x, k: F.when(same(x, k), x["i"]))
            return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(placed, starts), union_length)

    def of_windows(hashes: Column) -> Column:
        def choose(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: x == F.get(s, k + 1))
            return let(twice, lambda t: F.when(F.size(t) == 0, 0).when(F.size(t) <= FEW, by_lookup(hashes, t)).otherwise(by_sort(hashes)))

        return let(F.sort_array(hashes), choose)

    def windows(h: Column) -> Column:
        full = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return let(F.slice(full, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), of_windows)

    return let(F.transform(w, lambda x: F.xxhash64(x)), windows).cast("long")


def text_statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines over the whole text."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            joined = F.concat_ws("", w)
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(joined).cast("long").alias("word_chars"),
                (F.length(joined) - F.length(F.regexp_replace(joined, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(lines).cast("long").alias("n_lines"),
            )

        return let(F.filter(F.split(whole, "\n", -1), lambda x: F.regexp_like(x, F.lit("[^ \\t\\n\\x0B\\f\\r]"))), of_lines)

    return let(words(text), of_words)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def feature_columns() -> dict[str, Column]:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "mean_word": F.col("word_chars") / n,
        "log_words": F.log(1.0 + F.col("n_words")),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules for 'bad'; what no rule covers is good."""

    rules: list[list[Condition]] = field(default_factory=list)

    def covers(self, rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & c.column()
        return out

    def verdict(self) -> Column:
        """CASE WHEN rule THEN false ... ELSE true: true where the document stays."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(self.covers(rule), F.lit(False)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "; ".join(" and ".join(map(str, r)) for r in self.rules) or "empty"


@dataclass
class Learner:
    """Sequential covering over a table of features, bad (0/1) and part ('grow' or 'prune')."""

    max_rules: int = 4
    max_conditions: int = 3
    min_covered: int = 5
    min_precision: float = 0.95

    def fit(self, rows: DataFrame) -> DecisionList:
        quantiles = rows.agg(
            *(F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 10_000).alias(f) for f in FEATURES),
            *(F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), [k / BINS for k in range(BINS)], 10_000).alias(f"bad_{f}") for f in FEATURES),
        ).first()
        cuts = {f: sorted({*(quantiles[f] or []), *(quantiles[f"bad_{f}"] or [])}) for f in FEATURES}
        found = DecisionList()
        left = rows
        while len(found.rules) < self.max_rules:
            rule = self._prune(left.where("part = 'prune'"), self._grow(left.where("part = 'grow'"), cuts))
            if not rule:
                break
            found.rules.append(rule)
            left = left.where(~found.covers(rule))
        return found

    def _grow(self, rows: DataFrame, cuts: dict[str, list[float]]) -> list[Condition]:
        rule: list[Condition] = []
        good, bad = self._counts(rows)
        while len(rule) < self.max_conditions and bad >= self.min_covered and good:
            best = self._best(self._histogram(rows, cuts), cuts, good, bad)
            if best is None:
                break
            condition, good, bad = best
            rule.append(condition)
            rows = rows.where(condition.column())
        return rule

    def _counts(self, rows: DataFrame) -> tuple[int, int]:
        r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
        return r["n"] - r["bad"], r["bad"]

    def _histogram(self, rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
        """Good and bad rows for each feature and bin; bin k holds the values above k thresholds."""
        each = [
            F.struct(F.lit(f).alias("feature"), sum((F.when(F.col(f) > t, 1).otherwise(0) for t in cuts[f]), F.lit(0)).alias("bin"))
            for f in FEATURES
        ]
        counted = rows.select("bad", F.inline(F.array(*each))).groupBy("feature", "bin")
        counted = counted.agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
        return {(r["feature"], r["bin"]): (r["n"] - r["bad"], r["bad"]) for r in counted.toLocalIterator()}

    def _best(self, hist, cuts, good: int, bad: int) -> tuple[Condition, int, int] | None:
        before, best = math.log2(bad / (bad + good)), None
        for f in FEATURES:
            g = b = 0  # rows at or below the threshold
            for k, t in enumerate(cuts[f]):
                g, b = g + hist.get((f, k), (0, 0))[0], b + hist.get((f, k), (0, 0))[1]
                for above, (x, y) in ((False, (g, b)), (True, (good - g, bad - b))):
                    if y < self.min_covered:
                        continue
                    gain = y * (math.log2(y / (x + y)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Condition(f, above, float(t)), x, y)
        return best and best[1:]

    def _prune(self, rows: DataFrame, rule: list[Condition]) -> list[Condition]:
        """The beginning of the rule with the best (bad - good) / covered; none below min_precision."""
        if not rule:
            return []
        covered, values = F.lit(True), []
        for k, c in enumerate(rule):
            covered = covered & c.column()
            values += [F.count_if(covered & (F.col("bad") == v)).alias(f"n{v}_{k}") for v in (0, 1)]
        r = rows.agg(*values).first()
        score = [(r[f"n1_{k}"] / max(1, r[f"n0_{k}"] + r[f"n1_{k}"]), k) for k in range(len(rule)) if r[f"n1_{k}"] >= 2]
        best = max(score, key=lambda s: (s[0], -s[1]), default=(0.0, 0))
        return rule[: best[1] + 1] if best[0] >= self.min_precision else []


def learn(space: Workspace, wide: DataFrame, labels: DataFrame, learner: Learner | None = None) -> DecisionList:
    """The list for rows of doc_id, base_failed and FEATURES.

    It is learned from labelled rows that pass the base rule, as it decides for those alone; rows whose
    crc32(doc_id) mod 5 is 0 are held out of learning.  They are written in files by size, as each step reads them."""
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    turn = F.crc32(F.col("doc_id").cast("string"))
    rows = wide.where(~F.col("base_failed")).join(marks, "doc_id").where(turn % 5 != 0).select(
        *FEATURES, (1 - F.col("quality")).alias("bad"), F.when(F.pmod(F.floor(turn / 5), F.lit(3)) == 0, "prune").otherwise("grow").alias("part")
    )
    return (learner or Learner()).fit(space.keep(rows.hint("rebalance"), "rows"))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, learner: Learner | None = None) -> tuple[DataFrame, DecisionList]:
    """A row for each row of docs without its text: doc_id, statistics, base_failed and kept; and the list."""
    space = Workspace(spark, "quality")
    stats = docs.select("doc_id", text_statistics(F.col("text")).alias("s"))
    stats = space.keep(stats.select("doc_id", "s.*").withColumn("base_failed", base_failed()), "stats")
    wide = stats.withColumns(feature_columns())
    found = learn(space, wide, labels, learner)
    return wide.withColumn("kept", ~F.col("base_failed") & found.verdict()).drop(*FEATURES), found


def filter_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, learner: Learner | None = None) -> DataFrame:
    """The rows of docs that the base rule and the learned list keep.

    Texts are written once with their statistics, so they are neither shuffled nor measured twice."""
    space = Workspace(spark, "quality")
    carried = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", text_statistics(F.col("text")).alias("_s"))
    carried = space.keep(carried.select("_doc", "doc_id", "_s.*").withColumn("base_failed", base_failed()), "carried")
    wide = carried.withColumns(feature_columns())
    found = learn(space, wide, labels, learner)
    return wide.where(~F.col("base_failed") & found.verdict()).select("_doc.*")
