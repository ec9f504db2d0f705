"""Minimax contiguous partition into shards (operator 6).

Groups of equal text are atomic and ordered by a hash of the text. The smallest capacity for which a
greedy left-to-right filling needs no more than the wanted shards is found by binary search, and the
order is cut where that filling cuts. The driver never sees groups: it holds sums over intervals of the
hash order. Where the search cannot decide from these, only the intervals in which a cut may fall are
split further, each by one aggregation, until intervals are single groups or the answer is sure; so
what reaches the driver is bounded by intervals, not by rows.

A null text counts as an empty one; all empty texts are one group. Equal texts of any number stay
together. An empty table gives no row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesim.llm.text import narrow
from pagesim.session import materialize

SHARDS = 8
FIRST_INTERVALS, SPLIT = 4096, 256
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def group_key() -> Column:
    """The place of a text in the order: equal texts have equal keys."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


class Intervals:
    """Consecutive intervals of the key order: (first key, last key, size, whether one group)."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.parts = self._split([(LOW, HIGH)], FIRST_INTERVALS)

    def _split(self, ranges: list[tuple[int, int]], pieces: int) -> list[tuple[int, int, int, bool]]:
        """Sums of the groups in ``pieces`` equal pieces of each range: one aggregation."""
        width = [max(1, -(-(high - low + 1) // pieces)) for low, high in ranges]
        inside, piece = None, None
        for k, ((low, high), w) in enumerate(zip(ranges, width)):
            here = F.col("key").between(low, high)
            inside = here if inside is None else inside | here
            # the distance from the range's start may exceed a long: decimals hold it
            at = F.floor((F.col("key").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(w).cast("decimal(20,0)"))
            at = F.least(at.cast("long"), F.lit(pieces - 1)) + k * pieces  # the quotient may round up
            piece = F.when(here, at) if piece is None else piece.when(here, at)
        rows = (self.groups.where(inside).groupBy(piece.alias("piece"))
                .agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect())
        return sorted((r.low, r.high, r.size, r.low == r.high) for r in rows)

    def refine(self, wanted: list[int]) -> None:
        fresh = self._split([self.parts[k][:2] for k in wanted], SPLIT)
        left = set(wanted)
        self.parts = sorted([p for k, p in enumerate(self.parts) if k not in left] + fresh)


def greedy(sizes: list[int], fixed: list[bool], shards: int, capacity: int, whole: bool) -> tuple[bool, list[int], set[int]]:
    """Fill shards from left to right. ``whole``: cut only between intervals; else also within those that
    are not single groups, as if their groups were as small as can be. Returns whether it fits, the
    intervals that begin a new shard, and the open intervals in which a cut fell."""
    used, room, starts, touched = 1, capacity, [], set()
    for k, size in enumerate(sizes):
        if size <= room:
            room -= size
            continue
        if whole or fixed[k]:
            if size > capacity:
                return False, starts, touched | ({k} if not fixed[k] else set())
            used, room = used + 1, capacity - size
            starts.append(k)
        else:
            touched.add(k)
            size -= room
            more = -(-size // capacity)
            used, room = used + more, more * capacity - size
    if whole:
        touched = {k for k in starts if not fixed[k]}
    return used <= shards, starts, touched


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the first keys of all shards but the first.

    ``groups``: one row (key, size) for each group, kept where reading it again is cheap."""
    view = Intervals(groups)
    if not view.parts:
        return 0, []
    while True:
        sizes, fixed = [p[2] for p in view.parts], [p[3] for p in view.parts]
        total = sum(sizes)

        def smallest(whole: bool) -> int:
            low, high = max(1, -(-total // shards)), total
            while low < high:
                middle = (low + high) // 2
                if greedy(sizes, fixed, shards, middle, whole)[0]:
                    high = middle
                else:
                    low = middle + 1
            return low

        lower, upper = smallest(False), smallest(True)
        if lower == upper:
            _, starts, touched = greedy(sizes, fixed, shards, upper, True)
            if not touched:
                return upper, [view.parts[k][0] for k in starts]
        else:
            touched = set()
            for capacity in {lower, upper, (lower + upper) // 2}:
                for whole in (False, True):
                    touched |= {k for k in greedy(sizes, fixed, shards, capacity, whole)[2] if not fixed[k]}
        if not touched:
            touched = {k for k, f in enumerate(fixed) if not f}
        view.refine(sorted(touched))


def shard_of(key: Column, cuts: list[int]) -> Column:
    """The number of cuts at or before the key: the shard."""
    return reduce(lambda a, c: a + (key >= F.lit(c)).cast("int"), cuts, F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document with its shard and a gapless slot there, by key and doc_id.

    The text is read twice where it lies and never moved: only its hash, size and checksum are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = narrow(docs).select(
        "doc_id", group_key().alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = materialize(rows, "shard-rows")
    groups = materialize(placed.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    capacity, cuts = minimax_cuts(groups, shards)
    # positions: ranges of the order are numbered by the rows before them
    order = [F.col("key"), F.col("doc_id").asc_nulls_first()]
    moved = placed.withColumn("shard", shard_of(F.col("key"), cuts))
    ranked = materialize(moved.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("at", F.monotonically_increasing_id())
                         .withColumn("part", F.shiftright("at", 33)), "shard-order")
    return _with_slots(ranked, capacity)


def _with_slots(ranked: DataFrame, capacity: int) -> DataFrame:
    """Slots from places within partitions and the sums over the partitions before, one row per
    partition and shard."""
    counts = ranked.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "shard", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (ranked.join(base, ["part", "shard"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("at") - F.col("first") + F.col("base")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity")))
