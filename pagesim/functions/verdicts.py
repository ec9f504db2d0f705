"""Verdict expressions: modes, minimal pages, bands, explanations, the hybrid decision."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    DECISION_LEGIT, DECISION_LEGIT_MINIMAL, DECISION_PHISH, DECISION_PHISH_MINIMAL,
    ERROR_NO_PROTOTYPES, MINIMAL_DOM_PENALTY, MINIMAL_DOM_THRESHOLD, ML_GATE, MODE_DOM,
    MODE_RESOURCES, REASON, REASON_PENALTY, SMALL_DOM_THRESHOLD, UNKNOWN,
)


def detection_mode(dom_length: Column, threshold: int = SMALL_DOM_THRESHOLD) -> Column:
    """Small pages are judged by their resources, others by their structure."""
    return F.when(dom_length < threshold, MODE_RESOURCES).otherwise(MODE_DOM)


def signature_input(mode: Column, resources: Column, dom: Column) -> Column:
    """The bytes to classify."""
    return F.when(mode == MODE_RESOURCES, resources).otherwise(dom)


def is_minimal(classified: Column, threshold: int = MINIMAL_DOM_THRESHOLD) -> Column:
    """P8, on the classified bytes."""
    return F.octet_length(classified) < threshold


def round4(score: Column) -> Column:
    """P23."""
    return F.round(score, 4)


def label_to_int(label: Column) -> Column:
    """P19."""
    return F.when(label == "phish", 1).otherwise(0)


def int_to_label(value: Column) -> Column:
    """P19."""
    return F.when(value == 1, "phish").otherwise("legit")


def verdict_family(verdict: Column) -> Column:
    """P20: ``phish`` and ``phish-*`` are one family."""
    return (
        F.when((verdict == "phish") | verdict.startswith("phish-"), "phish")
        .when(verdict.isin("suspicious", "legit"), verdict)
        .otherwise(UNKNOWN)
    )


def confidence_band(difference: Column) -> Column:
    """By the separation of the two class minima."""
    return F.when(difference > 0.1, "high").when(difference > 0.05, "medium").otherwise("low")


def ml_confidence_band(phish_p: Column, legit_p: Column) -> Column:
    """By the larger class probability."""
    best = F.greatest(phish_p, legit_p)
    return F.when(best > 0.8, "high").when(best > 0.6, "medium").otherwise("low")


def _fill(template: str, **values: Column) -> Column:
    """``template`` with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[part] if i % 2 else F.lit(part) for i, part in enumerate(parts) if part])


def classify_scores(df: DataFrame, classified: str = "dom", has_prototypes: bool = True,
                    minimal_threshold: int = MINIMAL_DOM_THRESHOLD,
                    penalty: float = MINIMAL_DOM_PENALTY) -> DataFrame:
    """C1 after A1: verdict, confidence and explanation from the four class scores.

    A minimal page pays ``penalty`` on its legit scores. A tie is legit."""
    scores = ["phish_min", "phish_avg", "legit_min", "legit_avg"]
    if not has_prototypes:
        return df.withColumns({
            "verdict": F.lit(UNKNOWN), **{s: F.lit(1.0) for s in scores},
            "dom_size": F.octet_length(classified).cast("bigint"),
            "minimal_dom_adjustment_applied": F.lit(False),
            "confidence": F.lit(None).cast("string"), "final_decision": F.lit(None).cast("string"),
            "reason": F.lit(None).cast("string"), "score_error": F.lit(ERROR_NO_PROTOTYPES),
        })
    phish, legit = F.col("phish_min"), F.col("legit_min")
    minimal = F.col("minimal_dom_adjustment_applied")
    adjusted = F.when(minimal, legit + penalty).otherwise(legit)
    is_phish = phish < adjusted
    verdict = F.when(is_phish, "phish").otherwise("legit")
    shown = {name: F.format_string("%.4f", score) for name, score in {
        "phish": phish, "legit": legit, "adjusted": adjusted,
        "phish_avg": F.col("phish_avg"), "legit_avg": F.col("legit_avg")}.items()}
    decision = (
        F.when(is_phish & minimal, _fill(DECISION_PHISH_MINIMAL, **shown))
        .when(is_phish, _fill(DECISION_PHISH, **shown))
        .when(minimal, _fill(DECISION_LEGIT_MINIMAL, **shown))
        .otherwise(_fill(DECISION_LEGIT, **shown)))
    reason = _fill(
        REASON, verdict=F.col("verdict"), decision=F.col("final_decision"),
        penalty=F.when(minimal, REASON_PENALTY.format(amount=penalty)).otherwise(""), **shown)
    return (
        df.withColumn("dom_size", F.octet_length(classified).cast("bigint"))
        .withColumn("minimal_dom_adjustment_applied", is_minimal(F.col(classified), minimal_threshold))
        .withColumns({"verdict": verdict, "final_decision": decision,
                      "confidence": confidence_band(F.abs(phish - adjusted))})
        .withColumn("reason", reason)
        .withColumns({s: round4(F.col(s)) for s in scores})
        .withColumn("score_error", F.lit(None).cast("string"))
    )


def hybrid_decision(ncd_verdict: Column, ml_label: Column, phish_p: Column,
                    gate: float = ML_GATE, on: str = "phish") -> tuple[Column, Column]:
    """(final verdict, decision source).

    The model decides only where its phish probability reaches ``gate``; ``on="max"`` gates on
    the larger class probability instead. Without a prediction the distance verdict stands and
    there is no final verdict."""
    p = phish_p if on == "phish" else F.greatest(phish_p, 1.0 - phish_p)
    by_model = p >= gate
    final = F.when(by_model, ml_label).when(phish_p.isNotNull(), ncd_verdict)
    source = F.when(by_model, "ml").otherwise("ncd")
    return final, source


def legacy_unverified_verdict(verified: Column) -> tuple[Column, Column]:
    """C14: a feed row that nobody verified makes the page suspicious, with medium confidence."""
    unverified = ~verified
    return (F.when(unverified, "suspicious"), F.when(unverified, "medium"))
