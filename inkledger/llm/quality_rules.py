"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Base counts and the base rule are fixed. On top, each feature (symbols, repeated lines, repeated words, capitals, word length)
rejects a document that reaches a cutoff. Cutoffs come from labelled documents, by stratum (language): a cutoff is admitted
only if an exact binomial test shows that it rejects less than ``risk`` / (number of features) of the good documents. For
a cutoff that rejects k of n good ones, the p-value is P(Binomial(n, risk per feature) <= k). Within one stratum and
feature, cutoffs are tested from the loosest to the tightest and the walk stops at the first that fails, which needs no
correction; across strata and features the level ``delta`` is divided by their number (Bonferroni). So with probability
1 - delta no stratum loses more than ``risk`` of its good documents to the rules. Strata with too few labels get no rule.

Features are computed in one scan and written as a narrow table; labels, thresholds and verdicts work on that table.

Defined results: a null text has no words (and fails the base rule); a null lang is a stratum of its own; a null id has no
label; of repeated labels the best counts; rows that repeat an id are judged, and counted, each; other columns are ignored;
without labels only the base rule applies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkledger.llm.common import SPACES, Scratch, without_spaces, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Counts of a document by feature; a feature is 100 * numerator / denominator.
FEATURES = {"symbols": ("n_symbols", "n_words"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars"), "length": ("word_chars", "n_words")}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``use``; inside lambdas a column expression would be evaluated anew for
    every element."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - v, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeats(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, i: F.coalesce(F.get(pairs, i + 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(pairs, i - 1)["g"] == x["g"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def counted(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, repeats))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(grams, counted)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts, one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("lang").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("stratum"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    size = F.length("text")
    return rows.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.length(without_spaces(F.col("text"))).cast("long").alias("word_chars"),
        (size - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), (size - F.length(F.translate("text", CAPITALS, ""))).cast("long").alias("n_capitals"),
    )


def level(feature: str) -> Column:
    """The feature on a fixed scale of steps of about a twelfth of an octave; cutoffs are steps of this scale."""
    top, bottom = FEATURES[feature]
    return F.floor(8 * F.log2(1 + F.col(top) * 100.0 / F.greatest(F.col(bottom), F.lit(1)))).cast("int")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact up to rounding, for k below the mean n p; 1 otherwise. The largest term is summed
    in logarithms, the others relative to it, so large n does not underflow."""
    ratio = F.log(F.lit(p / (1 - p)))
    logs = F.when(k < 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i) + ratio))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        i = k - j  # from the term of i + 1 to that of i
        term = a["term"] * (i + 1) / (n - i) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    rest = F.when(k < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, add, lambda a: a["sum"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(logs + n * F.log(F.lit(1 - p))) * rest)


def cutoffs(counts: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """stratum, feature, cutoff, n_good, n_rejected: the tightest admitted cutoffs."""
    best = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    good = counts.join(best.filter("quality = 1"), "doc_id")
    steps = F.array(*(F.struct(F.lit(f).alias("feature"), level(f).alias("cutoff")) for f in FEATURES))
    grid = good.select("stratum", F.inline(steps)).groupBy("stratum", "feature", "cutoff").agg(F.count("*").alias("n"))
    # a cutoff rejects what lies at or above it; the step just above each occupied one is a cutoff as well
    grid = grid.select("stratum", "feature", F.inline(F.array(F.struct("cutoff", "n"), F.struct((F.col("cutoff") + 1).alias("cutoff"), F.lit(0).cast("long").alias("n"))))).groupBy("stratum", "feature", "cutoff").agg(F.sum("n").alias("n"))
    each, down = Window.partitionBy("stratum", "feature"), Window.partitionBy("stratum", "feature").orderBy(F.desc("cutoff"))
    grid = grid.withColumns({"n_good": F.sum("n").over(each), "n_rejected": F.sum("n").over(down)})
    families = grid.select("stratum", "feature").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("families"))
    tested = grid.join(F.broadcast(families)).withColumn("p_value", binomial_tail(F.col("n_good"), F.col("n_rejected"), risk / len(FEATURES)))  # one row
    return tested.filter(F.col("p_value") <= F.lit(delta) / F.col("families")).groupBy("stratum", "feature").agg(F.min("cutoff").alias("cutoff"), F.first("n_good").alias("n_good"), F.max("n_rejected").alias("n_rejected"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.write(base_counts(docs), "counts")
    rules = scratch.write(cutoffs(counts, labels, risk, delta), "cutoffs")
    by_stratum = rules.groupBy("stratum").agg(*(F.min(F.when(F.col("feature") == f, F.col("cutoff"))).alias(f"cut_{f}") for f in FEATURES))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.lit(False)
    for f in FEATURES:
        rejected = rejected | F.coalesce(level(f) >= F.col(f"cut_{f}"), F.lit(False))
    out = counts.join(by_stratum, "stratum", "left").withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
