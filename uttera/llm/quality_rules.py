"""Quality rules: a decision list learned from labelled statistics, applied as one CASE expression.

Every statistic and every rule is a DataFrame expression; no Python runs on the executors. The list is
learned on the driver from the statistics (numbers only) of at most `sample` labelled documents.

Defined cases: a null text counts as empty: all statistics 0, base_failed true, kept false. Rows are
independent, so repeated rows and repeated ids give repeated results. An empty table gives an empty
result. Without any labelled document of both classes the list is empty and base_failed decides alone.
Other columns, whatever their names, pass through or are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import WORD_SPACE, free_name, words_of

#: Characters that count as symbols. Fixed by the contract.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Repeated windows that are looked up one by one in a text.
FEW = 12
#: Labelled documents that a list is learned from, at most.
SAMPLE = 5_000

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def text_stats(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with a struct column `into` that holds STATS of the column `text`.

    Steps are separate projections, so that the word array and the sorted windows are made once a row.
    """
    w, g, s, a, d, n, ls = (free_name(df, f"_qr_{x}") for x in ("words", "grams", "sorted", "pairs", "repeated", "counts", "lines"))
    body, words, keep = F.coalesce(F.col(text), F.lit("")), F.col(w), [F.col(f"`{c}`") for c in df.columns]
    grams = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    count = lambda chars: (F.char_length(body) - F.char_length(F.regexp_replace(body, chars + "+", ""))).cast("long")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")
    df = df.select(*keep, words_of(F.col(text)).alias(w), lines.alias(ls))
    # wide arrays are copied by each projection, so they are dropped as soon as they have been counted
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(F.col(ls)))).cast("long").alias("n_dup_lines"),
        F.size(ls).cast("long").alias("n_lines"),
        count("[A-Z]").alias("n_upper"),
    )
    empty = F.array().cast("array<bigint>")
    df = df.select(*keep, counts.alias(n), F.when(F.size(w) < 4, empty).otherwise(F.slice(grams, F.lit(1), F.size(w) - 2)).alias(g))
    # equal windows are neighbours in the sorted hashes. A few repeated hashes are looked up in each window; where
    # there are many, windows are sorted with their positions, so that no text costs the square of its length
    ordered, at = F.col(s), F.col(a)
    df = df.select(*keep, n, g, F.sort_array(F.col(g)).alias(s))
    df = df.select(*keep, n, g, F.array_distinct(F.filter(ordered, lambda h, i: h == F.get(ordered, i + 1))).alias(s))
    pairs = F.sort_array(F.transform(F.col(g), lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.select(*keep, n, g, s, F.when(F.size(s) > FEW, pairs).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")).alias(a))
    looked_up = F.filter(F.transform(F.col(g), lambda h, i: F.when(F.array_contains(F.col(s), h), i)), lambda p: p.isNotNull())
    neighbours = F.filter(at, lambda x, i: (F.get(at, i - 1)["h"] == x["h"]) | (F.get(at, i + 1)["h"] == x["h"]))
    where = (
        F.when(F.size(s) == 0, F.array().cast("array<int>"))
        .when(F.size(s) <= FEW, looked_up)
        .otherwise(F.sort_array(F.transform(neighbours, lambda x: x["p"])))
    )
    df = df.select(*keep, n, where.alias(d))
    covered = F.aggregate(
        F.transform(F.col(d), lambda p, i: F.least(F.lit(3), F.coalesce(p - F.get(F.col(d), i - 1), F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    # explode() of one struct: a filter on a statistic can't be moved below it and copied into each of its uses
    stats = [covered.cast("long").alias(k) if k == "n_repeat_words" else F.col(n)[k].alias(k) for k in STATS]
    return df.select(*keep, F.explode(F.array(F.struct(*stats))).alias(into))


#: Ratios that the rules test, each a function of STATS; the same code serves Columns and numpy arrays.
FEATURES = {
    "n_words": lambda s: s["n_words"] * 1.0,
    "mean_word_chars": lambda s: s["word_chars"] / s["one_word"],
    "symbols_per_word": lambda s: s["n_symbols"] / s["one_word"],
    "dup_line_share": lambda s: s["n_dup_lines"] / s["one_line"],
    "repeat_word_share": lambda s: s["n_repeat_words"] / s["one_word"],
    "words_per_line": lambda s: s["n_words"] / s["one_line"],
    "upper_per_char": lambda s: s["n_upper"] / s["one_char"],
}


def _at_least_one(stats: dict, largest) -> dict:
    return stats | {
        "one_word": largest(stats["n_words"]),
        "one_line": largest(stats["n_lines"]),
        "one_char": largest(stats["word_chars"]),
    }


def feature_columns(stats: str) -> dict[str, Column]:
    of = {k: F.col(stats)[k].cast("double") for k in STATS}
    of = _at_least_one(of, lambda x: F.greatest(x, F.lit(1.0)))
    return {k: f(of) for k, f in FEATURES.items()}


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at_least, threshold); documents that meet it are rejected."""

    tests: tuple[tuple[str, bool, float], ...]
    hits: int = 0
    wrong: int = 0

    def met(self, features: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, at_least, value in self.tests:
            out = out & (features[name] >= value if at_least else features[name] < value)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<'} {v:.6g}" for n, up, v in self.tests)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def verdict(self, stats: str) -> Column:
        """Number of the first rule that a row meets, from 1; 0 where it meets none."""
        features = feature_columns(stats)
        out: Column | None = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule.met(features), F.lit(k)) if out is None else out.when(rule.met(features), F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, max_tests: int = 4, max_rules: int = 12, seed: int = 7) -> DecisionList:
    """Sequential covering. x: rows by features; bad: the class that rules describe.

    Each rule grows on two thirds of what is left by the information gain of one threshold at a time, is
    pruned from its end on the other third, and stays if its precision there (Laplace) is high enough.
    """
    order = np.random.default_rng(seed).permutation(len(bad))
    part = np.zeros(len(bad), bool)
    part[order[: 2 * len(bad) // 3]] = True
    left, rules = np.ones(len(bad), bool), []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 129))) if len(x) else np.array([]) for j in range(x.shape[1])]
    while len(rules) < max_rules:
        grow, prune = left & part, left & ~part
        if (bad & grow).sum() < 3 or not (bad & prune).any():
            break
        tests, inside = [], grow.copy()
        while len(tests) < max_tests and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            base, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
            xs, good = x[inside], bad[inside]
            for j, at in enumerate(cuts):
                slot = np.searchsorted(at, xs[:, j], side="right")  # x >= at[k] when slot > k
                p_all = np.bincount(slot, weights=good, minlength=len(at) + 1)
                n_all = np.bincount(slot, weights=~good, minlength=len(at) + 1)
                for up in (True, False):
                    p = p_all[::-1].cumsum()[::-1][1:] if up else p_all.cumsum()[:-1]
                    n = n_all[::-1].cumsum()[::-1][1:] if up else n_all.cumsum()[:-1]
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-12) / np.maximum(p + n, 1e-12)) - base), 0)
                    if len(gain) and gain.max() > best[0] + 1e-9:
                        k = int(gain.argmax())
                        best = (float(gain[k]), (j, up, float(at[k])))
            if best[1] is None:
                break
            tests.append(best[1])
            inside &= _meets(x, [best[1]])
        if not tests:
            break
        worth = lambda ts: (lambda m: ((m & bad).sum() - (m & ~bad).sum()) / max(1, m.sum()))(prune & _meets(x, ts))
        tests = max((tests[:k] for k in range(len(tests), 0, -1)), key=worth)
        hit = prune & _meets(x, tests)
        if ((hit & bad).sum() + 1) / (hit.sum() + 2) < precision:
            break
        whole = left & _meets(x, tests)
        rules.append(Rule(tuple((names[j], up, v) for j, up, v in tests), int(whole.sum()), int((whole & ~bad).sum())))
        left &= ~whole
    return DecisionList(tuple(rules))


def _meets(x: np.ndarray, tests: list) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, up, v in tests:
        out &= (x[:, j] >= v) if up else (x[:, j] < v)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Learn a list from the statistics of at most `sample` labelled documents, chosen by a hash of the id."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `sample` rows of two numbers
    rows = text_stats(rows, "text", "_s").where(~base_failed("_s"))
    # repeated ids could exceed the bound: the smallest hashes of (id, text) decide which stay
    rows = rows.select("quality", *[F.col("_s")[k].alias(k) for k in STATS], F.xxhash64("doc_id", "text").alias("_o"))
    found = rows.orderBy("_o").limit(2 * sample).collect()
    stats = {k: np.array([r[k] for r in found], float) for k in STATS}
    of = _at_least_one(stats, lambda v: np.maximum(v, 1.0))
    x = np.stack([f(of) for f in FEATURES.values()], 1) if found else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*x.T[::-1], [r["quality"] for r in found]]) if found else np.array([], int)
    bad = np.array([r["quality"] == 0 for r in found], bool)
    return learn(x[order], bad[order], list(FEATURES))


def apply(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """docs with a struct column: statistics, base_failed, rule (number of the rule met, 0: none), kept.

    The column is `quality_rules`, or that name behind underscores where docs has such a column.
    """
    name = free_name(docs, "quality_rules")
    df = text_stats(docs, text, name)
    failed, rule = base_failed(name), rules.verdict(name)
    inner = [F.col(name)[k].alias(k) for k in STATS]
    kept = F.when(failed, False).otherwise(rule == 0)
    return df.withColumn(name, F.struct(*inner, failed.alias("base_failed"), rule.alias("rule"), kept.alias("kept")))
