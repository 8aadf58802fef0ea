"""Quality rules with risk-controlled thresholds (built-in functions only).

Base rules reject short and repetitive texts.  Every further rule is "reject if the feature is at
or beyond a cutoff".  For each stratum (language) and rule, the cutoffs of a fixed grid are tested
from the most lenient to the strictest on the labelled documents of good quality: the null
hypothesis "this cutoff rejects more than ``alpha`` of the good documents" is rejected if the exact
binomial tail P(Bin(n, alpha) <= k) is at most ``delta`` / (strata x rules).  Testing in a fixed
order needs no further correction inside a rule, Bonferroni covers strata and rules, so with
probability 1 - delta no rule rejects more than ``alpha`` of the good documents of any stratum.
A rule without a passing cutoff in a stratum is off there.

Defined results
---------------
* null text: no words, all counts 0, base_failed;
* null language: a stratum of its own; a language without labelled good documents has no learned
  rules; null labels and labels of unknown documents do not count; a document with several labels
  is good only if all of them say so;
* empty tables: no rules, empty result;
* extra columns pass through; feature names that clash replace nothing (``features`` returns only
  the listed columns, ``reject`` keeps the columns of its input).

The promise holds per rule; all five rules together reject at most 5 x ``alpha`` of a stratum's good
documents (union bound).  The driver gathers one row for each stratum that has enough labelled good
documents for a cutoff to pass at all (``least_labels``), with the counts at each grid point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import WHITE, let, stash, text_of

SYMBOLS = "#*$%&|<>"

#: Rule: (feature, grid from lenient to strict); at or above the cutoff is rejected, for "low" rules at or below.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_high": ("symbol_ratio", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.04, 0.03, 0.02)),
    "dup_lines_high": ("dup_line_ratio", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "repeats_high": ("repeat_ratio", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "word_length_high": ("word_length", (20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0)),
    "word_length_low": ("word_length", (1.5, 2.0, 2.25, 2.5, 2.75, 3.0, 3.25)),
}
ALPHA, DELTA = 0.005, 0.05


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _repeated(words: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more: windows are hashed and sorted with their places."""

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0), lambda s, x: s + x)

    def twins(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        return let(F.sort_array(F.transform(heads, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))), twins)

    return windows(words)


def features(docs: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row."""
    text = text_of(text_col)

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"))

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    with_word = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(WHITE)) != "")
    out = docs.select(
        *keep,
        let(words, counts).alias("_w"),
        let(with_word, lines).alias("_l"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return out.select(*keep, "_w.n_words", "word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _measures() -> dict[str, Column]:
    return {
        "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "word_length": _ratio("word_chars", "n_words"),
    }


def _beyond(rule: str, cutoff: float) -> Column:
    value = _measures()[RULES[rule][0]]
    return value <= cutoff if rule.endswith("_low") else value >= cutoff


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed term by term."""
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(1.0, math.fsum(term(i) for i in range(min(k, n) + 1)))


def least_labels(level: float, alpha: float) -> int:
    """With fewer good documents no cutoff can pass, even one that rejects none of them."""
    return math.floor(math.log(level) / math.log1p(-alpha))


def fit(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str | None, str], float]:
    """(stratum, rule) -> cutoff.  ``measured``: the rows of ``features`` with id and stratum."""
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("_good")).where("_good = 1")
    held = measured.join(good, F.col(id_col) == F.col("_id"), "left_semi")
    points = [(r, c) for r, (_, grid) in RULES.items() for c in grid]
    counted = stash(held.groupBy(F.col(stratum_col).alias("_s")).agg(F.count("*").alias("_n"), *[F.count_if(_beyond(r, c)).alias(f"_{i}") for i, (r, c) in enumerate(points)]), "quality-strata")
    level, found = delta / max(1, counted.count() * len(RULES)), {}
    rows = counted.where(F.col("_n") >= least_labels(level, alpha)).collect()  # only strata with enough good documents come to the driver
    for row in rows:
        passing = dict.fromkeys(RULES, True)
        for i, (rule, cutoff) in enumerate(points):
            passing[rule] = passing[rule] and binomial_tail(row[f"_{i}"], row["_n"], alpha) <= level
            if passing[rule]:
                found[row["_s"], rule] = cutoff
    return found


def learned_failed(cutoffs: dict[tuple[str | None, str], float], stratum_col: str = "lang") -> Column:
    """Whether a row of ``features`` fails a learned rule of its stratum."""
    out = F.lit(False)
    for (stratum, rule), cutoff in sorted(cutoffs.items(), key=lambda x: (x[0][0] or "", x[0][1])):
        out = out | (F.col(stratum_col).eqNullSafe(F.lit(stratum)) & _beyond(rule, cutoff))
    return out


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum_col: str = "lang", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per row: id, stratum, the counts, base_failed and kept."""
    measured = stash(features(docs, [id_col, stratum_col], text_col), "quality")
    cutoffs = fit(measured, labels, id_col=id_col, stratum_col=stratum_col, alpha=alpha, delta=delta)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~learned_failed(cutoffs, stratum_col))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum_col: str = "lang", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.  Rows are written once with their counts, so no text is measured twice."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_key"), F.col(stratum_col).alias("_s"), F.col(text_col).alias("_text"))
    measured = stash(features(rows, ["row", "_key", "_s"], "_text"), "quality-rows")
    cutoffs = fit(measured.drop("row"), labels.withColumnRenamed(id_col, "_key"), id_col="_key", stratum_col="_s", alpha=alpha, delta=delta)
    return measured.where(~base_failed() & ~learned_failed(cutoffs, "_s")).select("row.*")
