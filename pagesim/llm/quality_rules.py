"""Learned decision lists over statistics of texts (operator 5).

The statistics and the list are column expressions; nothing but Spark functions touches a document.
The list is learned by sequential covering: conjunctions of thresholds that describe labelled bad
documents are grown on two thirds of a bounded labelled sample by information gain, pruned on the
last third, and taken one after another until a rule no longer pays. The sample's statistics, not its
texts, are what the driver sees.

A null text counts as an empty one: all statistics 0, ``base_failed``. Without labels the list is
empty and keeps whatever passes the base."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesim.llm.text import SPACES, crc_fold, labelled, narrow

SYMBOLS = "#*$%&|<>"  # fixed values of the symbol count
WINDOW = 5
SAMPLE_ROWS, MAX_RULES, MAX_CONDITIONS, CUTS, LEAST_PRECISION = 20_000, 12, 4, 64, 0.8
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "caps_share", "exclaim_share")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more. Windows are compared by 64-bit hash."""
    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                              lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(
            _let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0))
                 .otherwise(_let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), _covered))))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _covered(ordered: Column) -> Column:
    """Length of the union of the windows whose hash has a neighbour of equal hash."""
    again = F.transform(ordered, lambda e, k: F.when(
        (F.get(ordered, k - 1)["h"] == e["h"]) | (F.get(ordered, k + 1)["h"] == e["h"]), e["p"]))
    places = F.sort_array(F.filter(again, lambda p: p.isNotNull()))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                       lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"),
                                             (p + WINDOW).alias("end")), lambda a: a["n"])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id with the statistics of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    counted = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    lined = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    length = F.length(text)
    return docs.select(
        "doc_id", counted.alias("_w"), lined.alias("_l"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (length - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (length - F.length(_without(text, "!"))).cast("long").alias("n_exclaims"),
        F.regexp_count(text, F.lit("[A-Z]{3,}")).cast("long").alias("n_caps"),
    ).select(
        "doc_id", F.col("_w.n_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("_l.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("_l.n_lines").cast("long").alias("n_lines"), "n_exclaims", "n_caps")


def features() -> dict[str, Column]:
    """What the learned conditions compare, from the statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "mean_word": F.col("word_chars") / n,
            "symbol_share": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n, "caps_share": F.col("n_caps") / n,
            "exclaim_share": F.col("n_exclaims") / n}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold): above means greater than, else at most."""

    conditions: tuple[tuple[str, bool, float], ...]

    def __str__(self) -> str:
        return " AND ".join(f"{f} {'>' if above else '<='} {t!r}" for f, above, t in self.conditions)

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, above, t in self.conditions:
            out = out & ((values[f] > t) if above else (values[f] <= t))
        return out

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.conditions:
            v = x[:, FEATURES.index(f)]
            out &= (v > t) if above else (v <= t)
        return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list:
    """Add the condition of the greatest information gain until no good document is covered."""
    conditions, here = [], np.ones(len(x), bool)
    while len(conditions) < MAX_CONDITIONS and (here & ~bad).any():
        p0, n0 = int((here & bad).sum()), int((here & ~bad).sum())
        best = (0.0, None)
        for k, name in enumerate(FEATURES):
            v = x[:, k]
            own = np.unique(v[here])
            cuts = (own[:-1] + own[1:]) / 2
            if len(cuts) > CUTS:
                cuts = cuts[np.linspace(0, len(cuts) - 1, CUTS).astype(int)]
            for above in (True, False):
                for t in cuts:
                    inside = here & ((v > t) if above else (v <= t))
                    p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
                    if p:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, above, float(t)))
        if best[1] is None:
            break
        conditions.append(best[1])
        here = Rule(tuple(conditions)).holds(x)
    return conditions


def _prune(conditions: list, x: np.ndarray, bad: np.ndarray) -> tuple[list, float]:
    """The leading conditions with the best (p - n) / (p + n) on the rows kept for pruning; its precision."""
    best = (-2.0, [], 0.0)
    for size in range(len(conditions), 0, -1):
        inside = Rule(tuple(conditions[:size])).holds(x)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= best[0]:
            best = (worth, conditions[:size], p / (p + n) if p + n else 0.0)
    return best[1], best[2]


def learn_rules(x: np.ndarray, bad: np.ndarray, least_precision: float = LEAST_PRECISION) -> list[Rule]:
    """Rules for bad documents by sequential covering; rows in a fixed order make it repeatable."""
    prune = np.arange(len(x)) % 3 == 2
    rules, left = [], np.ones(len(x), bool)
    while len(rules) < MAX_RULES and (left & bad & ~prune).any():
        grown = _grow(x[left & ~prune], bad[left & ~prune])
        if not grown:
            break
        conditions, precision = _prune(grown, x[left & prune], bad[left & prune])
        if not conditions or precision < least_precision:
            break
        rules.append(Rule(tuple(conditions)))
        left &= ~rules[-1].holds(x)
    return rules


def train_rules(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``limit`` labelled rows whose crc32(doc_id) mod 5 is not 0."""
    sample = labelled(docs, labels, "quality", crc_fold(F.col("doc_id"), 5) != 0, limit)
    known = sample.select("doc_id", "label").distinct()
    stats = text_statistics(narrow(sample)).dropDuplicates(["doc_id"]).join(known, "doc_id")
    rows = stats.select("label", *(c.alias(n) for n, c in features().items())).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not rows:
        return []
    x = np.array([[r[f] for f in FEATURES] for r in rows], float)
    return learn_rules(x, np.array([r.label == 0 for r in rows]))


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Whether the list keeps a document, and the number of the rule that rejects it (null: none)."""
    values, kept, by = features(), None, None
    for k, rule in enumerate(rules, 1):
        holds = rule.column(values)
        kept = F.when(holds, False) if kept is None else kept.when(holds, False)
        by = F.when(holds, k) if by is None else by.when(holds, k)
    return (kept.otherwise(True), by) if rules else (F.lit(True), F.lit(None).cast("int"))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics, base verdict and the list's verdict of every document."""
    kept, by = verdict(rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (text_statistics(narrow(docs)).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & kept).withColumn("rule", by))
