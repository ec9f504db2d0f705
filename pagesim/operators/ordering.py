"""Dense positions and ranks without putting a class into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above, the row below


def ordered_index(df: DataFrame, order: list, by: list[str] = [], name: str = "idx") -> DataFrame:
    """0-based position by ``order`` within each ``by`` group.

    A window over a class would sort half the data in one task. Here rows are range-partitioned
    and sorted once, written, and each row's position in its partition is shifted by the rows
    of its group in the partitions before; those counts are one row per partition and group."""
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    # rows equal in the order may still be told apart, so that they need not share a partition
    keys.append(F.xxhash64(*df.columns))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counts = placed.groupBy("_part", *by).agg(F.count("*").alias("_rows"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    # one row per partition and group; a missing group value is a group of its own
    shifts = shifts.withColumnsRenamed({"_part": "_shift_part", **{c: f"_by_{c}" for c in by}})
    same = F.col("_part") == F.col("_shift_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return placed.join(shifts, same).select(
        *(c for c in df.columns if c != name), (F.col("_at") - F.col("_from") + F.col("_shift")).alias(name))


def stratified_split(df: DataFrame, fraction: float = 0.2, seed: int = 42, id_col: str = "doc_id",
                     label: str = "label") -> DataFrame:
    """Add ``is_test``; every class gives the rounded ``fraction`` of its rows, the ones
    whose hashed id comes first, so the split is the same on every run and every engine."""
    if not fraction:
        return df.withColumn("is_test", F.lit(True))
    shuffled = df.withColumn("_hash", F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed)))))
    ranked = ordered_index(shuffled, ["_hash", id_col], [label], "_rank").drop("_hash")
    quota = df.groupBy(label).agg(F.round(F.count("*") * fraction).cast("bigint").alias("_quota"))
    quota = quota.withColumnRenamed(label, "_of")
    return ranked.join(quota, F.col(label).eqNullSafe(F.col("_of"))).select(
        *(c for c in df.columns if c != "is_test"), (F.col("_rank") < F.col("_quota")).alias("is_test"))
