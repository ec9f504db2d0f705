"""Positions and running values within groups of any size, without a window over a whole group.

Rows are dealt to tasks by ranges of (group, order), so that a group that holds a third of all rows lies in
many tasks. What the tasks before hold of a group is one row for each task and group: the only thing that is
added up in order. Everything else is numbered within its own task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesim.session import materialize

#: How running values are combined: aggregate, neutral value, and what joins an offset with a part.
_COMBINE = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def dealt_in_order(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """The rows of ``df``, written in the order of (group, order), with ``_task`` and ``_at``.

    ``_at`` rises with the order; equal rows are kept apart by the place at which they were read, so the rows of
    ``df`` should come from a written table. A missing group is a group of its own and comes first."""
    keys = [F.col(group).asc_nulls_first(), *order, F.col("_read").asc()]
    rows = df.withColumn("_read", F.monotonically_increasing_id())
    return materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
                       .withColumn("_at", F.monotonically_increasing_id())
                       .withColumn("_task", F.shiftright("_at", 33)), name)


def positions(dealt: DataFrame, group: str, place: str = "_place", known: DataFrame | None = None) -> DataFrame:
    """The place of each row within its group, from 0, and ``_size``, the rows of the group.

    No row is sorted again: within a task a group's rows follow one another. ``known`` has more columns for
    each group (one row each); they reach the rows over (task, group), so that no group's rows meet in one task."""
    spans = dealt.groupBy("_task", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                               "_size": F.sum("_n").over(Window.partitionBy(group))})
    more = [] if known is None else [c for c in known.columns if c != group]
    if known is not None:
        spans = spans.join(known.withColumnRenamed(group, "_known"), F.col(group).eqNullSafe(F.col("_known")), "left")
    spans = spans.select(F.col("_task").alias("_span_task"), F.col(group).alias("_span_group"), "_first", "_before", "_size", *more)
    return (dealt.join(spans, (F.col("_task") == F.col("_span_task")) & F.col(group).eqNullSafe(F.col("_span_group")))
            .withColumn(place, F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_span_task", "_span_group", "_first", "_before"))


def running(dealt: DataFrame, group: str, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Running values within each group, the row itself included: {name: ("sum" or "xor", column)}.

    Windows stand over the rows of one group in one task only."""
    spans = dealt.groupBy("_task", group).agg(*[_COMBINE[how][0](column).alias(f"_{name}") for name, (how, column) in values.items()])
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("_task").alias("_span_task"), F.col(group).alias("_span_group"),
                         *[F.coalesce(_COMBINE[how][0](f"_{name}").over(before), F.lit(0)).alias(f"_{name}")
                           for name, (how, _) in values.items()])
    within = Window.partitionBy("_task", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({f"_own_{name}": _COMBINE[how][0](column).over(within) for name, (how, column) in values.items()})
    joined = rows.join(spans, (F.col("_task") == F.col("_span_task")) & F.col(group).eqNullSafe(F.col("_span_group")))
    return (joined.withColumns({name: _COMBINE[how][1](F.col(f"_{name}"), F.col(f"_own_{name}")) for name, (how, _) in values.items()})
            .drop("_span_task", "_span_group", *[f"_{name}" for name in values], *[f"_own_{name}" for name in values]))
