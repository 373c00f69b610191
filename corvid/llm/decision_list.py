"""Quality rules: a learned decision list over native text statistics.

Statistics of each whole text are DataFrame expressions. From labelled rows, sequential covering learns an ordered list
of rules, each a conjunction of thresholds: a rule grows by the condition of most information gain on two thirds of the
rows, is pruned from its end on the other third, is kept if it is precise there, and takes the rows it covers with it.
The list becomes one ordered conditional expression (CASE WHEN ... THEN false ... ELSE true), so judging a table is one
narrow pass without shuffle or Python.

It is learned from at most ``MAX_LABELLED`` labelled rows, those of the smallest id hash; only their numbers, never
texts, reach the driver.

Defined results: a null or empty text has no words and every statistic 0; a null label, a label other than 0 and 1, ids
that have both, and labels without a row are not learned from; with no usable labels the list is empty and keeps everything; repeated rows are
judged alike; an empty table gives no rows; columns of the input are kept under ``judged`` and a clash with a working
name is impossible, since statistics live in one struct whose name is chosen to be free.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import common

MAX_LABELLED = 12_000
MAX_CONDITIONS = 3
MAX_RULES = 12
MIN_COVER = 5
MIN_PRECISION = 0.9
#: Thresholds tried for a statistic: its quantiles.
CUTS = 40

#: The base rule's limits and the symbols that it counts.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"

#: What rules may look at.
FEATURES = ("symbol_rate", "upper_rate", "bang_rate", "dup_line_rate", "repeat_rate", "word_chars_mean", "digit_rate", "words_per_line", "n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def sql(self, stats: Column) -> Column:
        x = stats[self.feature]
        return x >= F.lit(self.value) if self.at_least else x < F.lit(self.value)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def with_statistics(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with one struct column of statistics, and that column's name. Narrow projections only."""
    name = _free(df, "_stats")
    at = {k: _free(df, f"_{k}") for k in ("text", "words", "h", "s", "r", "p")}
    c = {k: F.col(v) for k, v in at.items()}
    out = df.withColumn(at["text"], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumn(at["words"], common.words_of(c["text"]))
    n = F.size(c["words"])
    # One hash for each window of three words; equal windows are found by sorting hashes.
    window = F.transform(F.slice(c["words"], 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(c["words"], i + 1), F.get(c["words"], i + 2)))
    out = out.withColumn(at["h"], window)
    out = out.withColumn(at["s"], F.sort_array(c["h"]))
    out = out.withColumn(at["r"], F.array_distinct(F.filter(c["s"], lambda x, i: (i > 0) & (x == F.get(c["s"], i - 1)))))
    few = F.array_compact(F.transform(c["h"], lambda x, i: F.when(F.array_contains(c["r"], x), i)))
    pairs = F.sort_array(F.transform(c["h"], lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    by_sort = F.element_at(
        F.transform(
            F.array(pairs),
            lambda z: F.sort_array(F.transform(F.filter(z, lambda e, i: (F.coalesce(F.get(z, i - 1)["x"] == e["x"], F.lit(False))) | (F.coalesce(F.get(z, i + 1)["x"] == e["x"], F.lit(False)))), lambda e: e["i"])),
        ),
        1,
    )
    places = F.when(F.size(c["r"]) == 0, F.array().cast("array<int>")).when(F.size(c["r"]) <= 32, few).otherwise(by_sort)
    out = out.withColumn(at["p"], places)
    covered = F.aggregate(
        c["p"],
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(c["text"], "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = out.withColumn(
        name,
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(c["words"], "")).cast("long").alias("word_chars"),
            (F.length(c["text"]) - F.length(F.regexp_replace(c["text"], f"{SYMBOLS}+", ""))).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            covered.cast("long").alias("n_repeat_words"),
            (F.length(c["text"]) - F.length(F.regexp_replace(c["text"], "\\p{Lu}+", ""))).alias("n_upper"),
            (F.length(c["text"]) - F.length(F.regexp_replace(c["text"], "!+", ""))).alias("n_bang"),
            (F.length(c["text"]) - F.length(F.regexp_replace(c["text"], "[0-9]+", ""))).alias("n_digit"),
        ),
    ).drop(*at.values())
    s = F.col(name)
    base = ["n_words", "word_chars", "n_symbols", "n_repeat_words"]
    rate = lambda x, y: x / F.greatest(y, F.lit(1)).cast("double")
    counted = counted.withColumn(
        name,
        F.struct(
            *(s[k].alias(k) for k in base),
            F.size(s["lines"]).alias("n_lines"),
            (F.size(s["lines"]) - F.size(F.array_distinct(s["lines"]))).cast("long").alias("n_dup_lines"),
            *(s[k].alias(k) for k in ("n_upper", "n_bang", "n_digit")),
        ),
    )
    final = F.struct(
        *(s[k].alias(k) for k in [*base, "n_dup_lines"]),
        rate(s["n_symbols"], s["word_chars"]).alias("symbol_rate"),
        rate(s["n_upper"], s["word_chars"]).alias("upper_rate"),
        rate(s["n_bang"], s["n_words"]).alias("bang_rate"),
        rate(s["n_digit"], s["word_chars"]).alias("digit_rate"),
        rate(s["n_dup_lines"], s["n_lines"]).alias("dup_line_rate"),
        rate(s["n_repeat_words"], s["n_words"]).alias("repeat_rate"),
        rate(s["word_chars"], s["n_words"]).alias("word_chars_mean"),
        rate(s["n_words"], s["n_lines"]).alias("words_per_line"),
    )
    # A generator of one row is a fence: without it a filter on the verdict would be pushed through every projection
    # above, each use of a statistic written out in full, and the plan would grow without measure.
    return counted.withColumn(name, final).select(*(F.col(f"`{x}`") for x in df.columns), F.explode(F.array(F.col(name))).alias(name)), name


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        v = x[:, FEATURES.index(c.feature)]
        out &= v >= c.value if c.at_least else v < c.value
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Conditions of most information gain, one after the other, until only bad rows are covered."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        now = _covers(rule, x)
        y, rows = bad[now], x[now]
        p0, n0 = int(y.sum()), int((~y).sum())
        if not p0 or not n0:
            break
        best, found = 1e-9, None
        for f, name in enumerate(FEATURES):
            steps = np.linspace(0, 1, CUTS + 1)[1:-1]
            for v in np.unique(np.concatenate((np.quantile(rows[:, f], steps, method="lower"), np.quantile(rows[y, f], steps, method="lower")))):
                over = rows[:, f] >= v
                p1, n1 = int((y & over).sum()), int((~y & over).sum())
                for at_least, p, n in ((True, p1, n1), (False, p0 - p1, n0 - n1)):
                    if p >= MIN_COVER and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best:
                        best, found = gain, Condition(name, at_least, float(v))
        if found is None:
            break
        rule.append(found)
    return rule


def _worth(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> tuple[float, int]:
    got = bad[_covers(rule, x)]
    return (float(got.mean()) if len(got) else 0.0), int(got.sum())


def learn(x: np.ndarray, bad: np.ndarray, prunes: np.ndarray) -> list[list[Condition]]:
    """Ordered rules that reject. x: a column for each of FEATURES; prunes: rows that prune and don't grow."""
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES and len(x):
        rule = _grow(x[~prunes], bad[~prunes])
        if not rule:
            break
        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=lambda r: (_worth(r, x[prunes], bad[prunes])[0], -len(r)))
        precision, found = _worth(rule, x[prunes], bad[prunes])
        if precision < MIN_PRECISION or found < 2:
            break
        rules.append(rule)
        rest = ~_covers(rule, x)
        x, bad, prunes = x[rest], bad[rest], prunes[rest]
    return rules


def verdict(rules: list[list[Condition]], stats: Column) -> Column:
    """True for texts that no rule rejects: the rules in order as one conditional expression."""
    out = None
    for rule in rules:
        test = rule[0].sql(stats)
        for c in rule[1:]:
            test = test & c.sql(stats)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[list[Condition]]:
    sample = common.smallest(common.labelled(labels, id_col, label_col), F.xxhash64("id"), MAX_LABELLED)  # a bounded number of rows: it may be broadcast
    rows, name = with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id"))
    s = F.col(name)
    # Texts that the base rule rejects need no learned rule.
    found = rows.where(~base_failed(s)).select((F.col("y") == 0).alias("bad"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 2).alias("prunes"), *(s[f].cast("double").alias(f) for f in FEATURES))
    rows = sorted(tuple(r) for r in found.collect())
    x = np.array([r[2:] for r in rows], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r[0] for r in rows], bool), np.array([r[1] for r in rows], bool))


def judged(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> tuple[DataFrame, str, Column]:
    """``docs`` with its statistics, their column, and whether the row is kept."""
    rows, name = with_statistics(docs, text_col)
    s = F.col(name)
    return rows, name, ~base_failed(s) & verdict(rules, s)


def keep_good(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the base rule or a learned rule rejects; all columns stay as they are."""
    rows, name, kept = judged(docs, rules, text_col)
    return rows.where(kept).drop(name)
