"""Per-candidate scores against prototype classes and sets, and nearest-sample answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ERROR_NOT_FETCHED, LEGIT_SET, NEAREST_THRESHOLD, PHISH_SETS
from ..session import materialize
from .distances import MAX_BROADCAST_ROWS, PrototypeSet, distances_to, grid_scores, payload_digest, set_scores
from .nearest import nearest


def scores_by_set(cands: DataFrame, protos: DataFrame | PrototypeSet, names: dict[str, str],
                  key: str = "page_id", payload: str = "dom", distance: str = "ncd",
                  set_col: str = "label", order_col: str = "prototype_index",
                  proto_payload: str = "dom", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Add ``<prefix>_min`` and ``<prefix>_avg`` for every set in ``names`` (set -> prefix).

    Beyond the bound, distinct payloads are measured in the grid and joined back by their digest,
    so rows need no key of their own and equal payloads are measured once."""
    bounded = protos if isinstance(protos, PrototypeSet) else PrototypeSet.load(
        protos, set_col, order_col, proto_payload, max_rows)
    if bounded is not None:
        if not bounded.rows:
            empty = {f"{p}_{s}": F.lit(1.0) for p in names.values() for s in ("min", "avg")}
            return cands.withColumns(empty)
        measured = cands.withColumn("_d", distances_to(F.col(payload), bounded, distance, proto_payload))
        columns = {}
        for name, prefix in names.items():
            columns[f"{prefix}_min"], columns[f"{prefix}_avg"] = set_scores(
                F.col("_d"), bounded, name)
        return measured.withColumns(columns).drop("_d")

    # written: sized, measured and joined are three reads
    cands = materialize(cands.withColumn("_digest", payload_digest(cands, payload)), "candidates")
    distinct = cands.where(F.col(payload).isNotNull()).select("_digest", payload).dropDuplicates(["_digest"])
    found = grid_scores(distinct, protos, "_digest", payload, distance, set_col, order_col,
                        other_payload=proto_payload)
    wide = found.groupBy("_digest").agg(*[
        agg for name, prefix in names.items() for agg in (
            F.min(F.when(F.col(set_col) == name, F.col("min_distance"))).alias(f"{prefix}_min"),
            F.min(F.when(F.col(set_col) == name, F.col("total") / F.col("n"))).alias(f"{prefix}_avg"),
        )])
    joined = cands.join(wide, "_digest", "left").drop("_digest")
    there = F.col(payload).isNotNull()
    return joined.withColumns({
        c: F.when(there, F.coalesce(c, F.lit(1.0))) for c in wide.columns if c != "_digest"})


def class_scores(cands, protos, **options) -> DataFrame:
    """A1: distances to the phish and the legit class; an absent class scores 1.0."""
    return scores_by_set(cands, protos, {"phish": "phish", "legit": "legit"}, **options)


def cluster_scores(cands, protos, set_col: str = "proto_set", **options) -> DataFrame:
    """Distances to the clustered sets and their combination.

    The overall average is the plain mean of the three set averages, absent sets included."""
    names = {s: f"ncd_{s}" for s in [*PHISH_SETS, LEGIT_SET]}
    out = scores_by_set(cands, protos, names, set_col=set_col, **options)
    mins = [F.col(f"ncd_{s}_min") for s in PHISH_SETS]
    avgs = [F.col(f"ncd_{s}_avg") for s in PHISH_SETS]
    return out.withColumns({
        "ncd_phish_best": F.least(*mins),
        "ncd_phish_avg": (avgs[0] + avgs[1] + avgs[2]) / 3.0,
    })


def nearest_sample(cands: DataFrame, samples: DataFrame, threshold: float = NEAREST_THRESHOLD,
                   key: str = "page_id", payload: str = "dom", distance: str = "ncd",
                   order_col: str = "idx", **search) -> DataFrame:
    """Label and url of the nearest sample strictly below distance 1.0.

    Ties go to the first sample. Beyond ``threshold``, and when nothing is below 1.0, the
    answer is ``phish``. A candidate without a dom answers ``error``. ``search`` goes to ``nearest``."""
    cands = materialize(cands, "candidates")  # sized, measured and joined: three reads
    has_dom = F.octet_length(payload) > 0
    found = nearest(cands.where(has_dom), samples, key, payload, distance, order_col, ("label", "url"), **search)
    near = found.filter(F.col("min_distance") < 1.0).select(
        key, F.col("min_distance").alias("_d"), F.col("label").alias("_label"),
        F.col("url").alias("_url"))
    d = F.coalesce("_d", F.lit(1.0))
    return (
        cands.join(near, key, "left")
        .withColumn("ncd", F.when(has_dom, F.round(d, 4)))
        .withColumn("classification",
                    F.when(~F.coalesce(has_dom, F.lit(False)), "error")
                    .when(d > threshold, "phish").otherwise(F.coalesce("_label", F.lit("unknown"))))
        .withColumn("closest_sample", F.when(has_dom & F.col("_d").isNotNull(),
                                             F.coalesce("_url", F.lit("unknown"))))
        .withColumn("error", F.when(~F.coalesce(has_dom, F.lit(False)), ERROR_NOT_FETCHED))
        .drop("_d", "_label", "_url")
    )
