"""Threshold tuning over two prototype sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distances import MAX_BROADCAST_ROWS, PrototypeSet, distances_to, grid_pair_stats, grid_pairs


def cross_set_distances(a: DataFrame, b: DataFrame, key: str = "idx", payload: str = "dom",
                        distance: str = "ncd", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Every ordered pair of two prototype sets, ``a`` before ``b``.

    ``a`` stays where it is while ``b`` is within the broadcast bound, else both go through the grid."""
    marked = b.withColumn("_set", F.lit("b"))
    right = PrototypeSet.load(marked, "_set", key, payload, max_rows)
    if right is None:
        other = marked.withColumnRenamed(key, "j")
        return grid_pairs(a.withColumnRenamed(key, "i"), other, "i", payload, distance, "_set", "j").drop("_set")
    scored = a.select(F.col(key).alias("i"), distances_to(F.col(payload), right, distance, payload).alias("d"))
    ids = F.array(*[F.lit(r[key]).cast(b.schema[key].dataType) for r in right.rows])
    pairs = scored.select("i", F.explode(F.arrays_zip(ids.alias("j"), F.col("d").alias("distance"))).alias("x"))
    return pairs.select("i", "x.j", "x.distance")


def distance_stats(distances: DataFrame) -> DataFrame:
    """A9."""
    return distances.agg(
        F.count("distance").alias("comparisons"), F.min("distance").alias("min_distance"),
        F.max("distance").alias("max_distance"), F.avg("distance").alias("avg_distance"))


def _pair_stats(a: DataFrame, b: DataFrame, name: str, skip_equal: bool, key: str = "idx", payload: str = "dom",
                distance: str = "ncd", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A9 over all pairs of two sets in one row, columns ``<name>_``: no pair becomes a row.

    Beyond the bound a cell of the grid gives its own sums. ``skip_equal`` leaves out distances of exactly 0."""
    marked = b.withColumn("_set", F.lit("b"))
    right = PrototypeSet.load(marked, "_set", key, payload, max_rows)
    if right is None:
        other = marked.withColumnRenamed(key, "j")
        parts = grid_pair_stats(a.withColumnRenamed(key, "i"), other, "i", payload, distance, "_set", "j", skip_equal)
    else:
        d = F.filter(F.col("d"), lambda x: x != 0) if skip_equal else F.col("d")
        scored = a.select(distances_to(F.col(payload), right, distance, payload).alias("d")).select(d.alias("d"))
        parts = scored.select(F.size("d").alias("n"), F.aggregate("d", F.lit(0.0), lambda x, y: x + y).alias("total"),
                              F.array_min("d").alias("lo"), F.array_max("d").alias("hi"))
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    return parts.agg(n.alias(f"{name}_comparisons"), F.min("lo").alias(f"{name}_min"), F.max("hi").alias(f"{name}_max"),
                     (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias(f"{name}_avg"))


def tune_threshold(legit: DataFrame, phish: DataFrame, **options) -> DataFrame:
    """A10: within-legit distances (all ordered pairs but exact zeros) against legit-to-phish.

    One row: both distributions, the bounds between them, their midpoint and whether they
    separate. An empty set is an error."""
    stats = _pair_stats(legit, legit, "ll", True, **options).crossJoin(_pair_stats(legit, phish, "lp", False, **options))
    ready = F.col("lp_comparisons") > 0
    return stats.select(
        "*", F.col("ll_max").alias("lower_bound"), F.col("lp_min").alias("upper_bound"),
        ((F.col("ll_max") + F.col("lp_min")) / 2).alias("suggested_threshold"),
        (F.col("ll_max") < F.col("lp_min")).alias("separated"),
        F.when(~ready, F.raise_error(F.lit("both prototype sets must have rows"))).alias("_check"),
    ).drop("_check")
