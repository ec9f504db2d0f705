"""Exact nearest samples, and the row farthest from all others on average, without all pairs.

Three ways to a nearest sample. Tag sets are searched by inverted lists over their rarest tags:
two sets that share a given part of their tags share one of their few rarest, so only the lists
of these are opened, for a high similarity first and a lower one for what is left. Points are
searched by cells around pivots: the triangle inequality bounds what a cell can hold. Compression
distance obeys no such law; it goes through the grid. Each way gives the grid's answer."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernel import L2Closest, kernel
from ..session import materialize
from .distances import MAX_BROADCAST_BYTES, PrototypeSet, _cell_partitions, _self_grid, distances_to, grid_scores, mean_distance

#: Similarities in percent that inverted lists are searched for, one after another.
SIMILARITIES = (90, 70, 50)
MAX_PIVOTS = 32
CELL_BLOCK, CELL_BYTES = 1 << 15, 32 << 20
#: Queries that are measured together, at most.
TOGETHER = 256
#: Rows whose mean is taken first, and in one pass at most.
FIRST_MEASURED, MOST_MEASURED = 64, 4096
#: One of so many rows left after a pass: all pairs cost less than more passes.
MANY_LEFT = 8
#: Points of up to so many values have their third moments taken.
MOMENTS_WIDTH, MOMENT_ROWS = 128, 512


def nearest(cands: DataFrame, samples: DataFrame, key: str = "page_id", payload: str = "dom",
            distance: str = "ncd", order_col: str = "idx", carry: tuple[str, ...] = (),
            exclude_self: bool = False, report: list | None = None, method: str = "auto", **grid) -> DataFrame:
    """(key, min_distance, order_col, *carry): the nearest sample of every candidate, ties to the lowest order.

    ``key`` must be unique among the candidates, ``order_col`` among the samples. With ``exclude_self`` the sample whose order equals a
    candidate's ``key`` is left out: the nearest *other* row of one set. ``method`` is ``auto`` or ``grid``.
    ``report`` gets a dict for each step: queries, pairs opened, all pairs."""
    extra = tuple(c for c in carry if c != order_col)
    if method == "auto" and distance == "tag_jaccard":
        return _nearest_by_tags(cands, samples, key, payload, order_col, extra, exclude_self, report)
    if method == "auto" and distance == "l2":
        return _nearest_by_pivots(cands, samples, key, payload, order_col, extra, exclude_self, report)
    one_set = samples.withColumn("_set", F.lit(1))
    return grid_scores(cands, one_set, key, payload, distance, "_set", order_col, carry=extra,
                       exclude=order_col if exclude_self else None, **grid).select(key, "min_distance", order_col, *extra)


# --- tag sets -------------------------------------------------------------------------------

def _tag_set(payload: str) -> Column:
    """Distinct tags in order; equal sets have equal arrays."""
    return F.array_sort(F.array_distinct(F.split(F.col(payload).cast("string"), " ")))


def _rarest_first(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """(set, ordered, n): tags by falling rarity among the samples."""
    tags = sets.select("set", F.explode("set").alias("tag")).join(counts, "tag", "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("tag_count", F.lit(0)).alias("c"), "tag"))), lambda t: t["tag"])
    return tags.groupBy("set").agg(ordered.alias("ordered"), F.count("*").cast("int").alias("n"))


def _nearest_by_tags(cands, samples, key, payload, order_col, extra, exclude_self, report):
    """Rows with equal tag sets are searched for once, and answered from the first of the samples that share a set."""
    row = F.struct(F.col(order_col).alias("o"), *[F.col(c).alias(f"x_{c}") for c in extra])
    cands = materialize(cands.select(F.col(key).alias("_key"), _tag_set(payload).alias("set")).where("set IS NOT NULL"), "nearest-candidates")
    there = samples.where(F.col(payload).isNotNull()).select(_tag_set(payload).alias("set"), row.alias("row"))
    firsts = there.groupBy("set").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    firsts = materialize(firsts, "nearest-sets")
    counts = firsts.select(F.explode("set").alias("tag")).groupBy("tag").agg(F.count("*").alias("tag_count"))
    counts = materialize(counts, "nearest-tags")
    wanted = cands.select("set").distinct()
    if exclude_self:  # a set that several rows share is answered by these
        wanted = wanted.join(firsts.where("rows > 1").select("set"), "set", "left_anti")
    queries = materialize(_rarest_first(wanted, counts), "nearest-queries")
    index = materialize(_rarest_first(firsts, counts).join(firsts.select("set", "first"), "set"), "nearest-index")
    n_sets, left, answers = index.count(), queries, []
    for percent in SIMILARITIES:
        opened = _search(left, index, percent, exclude_self)
        best = materialize(opened.groupBy("set").agg(
            F.min(F.struct("d", "first", "enough")).alias("best"), F.count("*").alias("pairs")), "nearest-found")
        answers.append(best.where("best.enough").select("set", "best.d", "best.first"))
        if report is not None:
            report.append({"step": f"similarity {percent}", "queries": left.count(),
                           "pairs": best.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0], "all_pairs": left.count() * n_sets})
        left = materialize(left.join(answers[-1].select("set"), "set", "left_anti"), "nearest-left")
    text = F.array_join("set", " ").cast("binary").alias("text")
    rest = left.select(F.array_join("set", " ").alias("name"), "set", text)
    carried = [f"x_{c}" for c in extra]
    others = index.select(F.lit(1).alias("one"), "first.*", F.array_join("set", " ").alias("name"), text)
    found = grid_scores(rest, others.drop("name") if not exclude_self else others.withColumnRenamed("name", "own"), "name", "text",
                        "tag_jaccard", "one", "o", carry=(*carried, "own") if exclude_self else tuple(carried),
                        exclude="own" if exclude_self else None)
    found = found.where("min_distance IS NOT NULL").select("name", "min_distance", F.struct("o", *carried).alias("first"))
    answers.append(rest.join(found, "name").select("set", F.col("min_distance").alias("d"), "first"))
    if report is not None:
        report.append({"step": "grid", "queries": left.count(), "pairs": left.count() * n_sets, "all_pairs": left.count() * n_sets})
    found = answers[0]
    for one in answers[1:]:
        found = found.unionByName(one)
    out = cands.join(found, "set").select("_key", "d", "first")
    if exclude_self:
        lowest = firsts.where("rows > 1").select("set", F.col("first").alias("lowest"))
        second = there.join(lowest, "set").where("row != lowest").groupBy("set").agg(F.min("lowest").alias("lowest"), F.min("row").alias("second"))
        shared = cands.join(second, "set").select(
            "_key", F.lit(0.0).alias("d"), F.when(F.col("lowest.o") == F.col("_key"), F.col("second")).otherwise(F.col("lowest")).alias("first"))
        out = out.unionByName(shared)
    return out.select(F.col("_key").alias(key), F.col("d").alias("min_distance"), F.col("first.o").alias(order_col),
                      *[F.col(f"first.x_{c}").alias(c) for c in extra])


def _search(queries: DataFrame, index: DataFrame, percent: int, exclude_self: bool) -> DataFrame:
    """Pairs (set, d, first, enough) that may share ``percent`` of their tags, among them all that do.

    A set of n tags that shares enough has one of its rarest n - ceil(percent * n) + 1 in common with the other
    such set's. A pair is opened once, at the first tag the two rarest parts share, and only if the tags that
    follow can still be enough."""
    def rarest(side: DataFrame, *more: str) -> DataFrame:
        length = F.col("n") - F.expr(f"(n * {percent} + 99) div 100").cast("int") + 1
        return side.select("set", "ordered", "n", *more, F.posexplode(F.slice("ordered", F.lit(1), length)).alias("at", "tag"))

    q = rarest(queries).select("tag", *[F.col(c).alias(f"q_{c}") for c in ("set", "ordered", "n", "at")])
    s = rarest(index, "first")
    follow = F.least(F.col("q_n") - F.col("q_at"), F.col("n") - F.col("at"))
    close = ((F.col("n") * 100 >= F.col("q_n") * percent) & (F.col("q_n") * 100 >= F.col("n") * percent)
             & (follow * (100 + percent) >= (F.col("q_n") + F.col("n")) * percent))
    if exclude_self:
        close = close & (F.col("q_set") != F.col("set"))
    earlier = F.arrays_overlap(F.slice("q_ordered", F.lit(1), F.col("q_at")), F.slice("ordered", F.lit(1), F.col("at")))
    pairs = q.join(s, "tag").where(close).where(~earlier)
    shared = F.size(F.array_intersect("q_ordered", "ordered"))
    union = F.col("q_n") + F.col("n") - F.col("shared")
    return pairs.withColumn("shared", shared).select(
        F.col("q_set").alias("set"), (1.0 - F.col("shared") / union).alias("d"), "first",
        (F.col("shared") * 100 >= union * percent).alias("enough"))


# --- points ---------------------------------------------------------------------------------

def _nearest_by_pivots(cands, samples, key, payload, order_col, extra, exclude_self, report):
    """Samples lie in the cell of their nearest pivot, in blocks of bounded size. A candidate searches its own
    cell; the distance found then rules out every cell whose ball it does not reach, and in the others the samples
    whose distance to the pivot differs too much from its own."""
    samples = materialize(samples.where(F.col(payload).isNotNull()).select(
        F.col(order_col).alias("o"), F.col(payload).alias("p"), *[F.col(c).alias(f"x_{c}") for c in extra]), "nearest-samples")
    cands = cands.where(F.col(payload).isNotNull()).select(F.col(key).alias("k"), F.col(payload).alias("p"))
    n = samples.count()
    pivots = samples.orderBy(F.xxhash64("o"), "o").limit(min(MAX_PIVOTS, math.isqrt(n) + 1)).withColumn("all", F.lit(1))
    found = PrototypeSet.load(pivots, "all", "o", "p")
    if found is None or not found.rows:
        if n:
            raise ValueError("one point is larger than a pivot set may be")
        return cands.select(F.col("k").alias(key), F.lit(None).cast("double").alias("min_distance"), F.lit(None).cast(
            samples.schema["o"].dataType).alias(order_col), *[F.lit(None).cast(samples.schema[f"x_{c}"].dataType).alias(c) for c in extra]).limit(0)

    def placed(df):
        df = df.withColumn("ds", distances_to(F.col("p"), found, "l2", "p"))
        return df.withColumns({"own": F.array_min("ds"), "cell": (F.array_position("ds", F.array_min("ds")) - 1).cast("int")})

    index = materialize(placed(samples).drop("ds"), "nearest-cells")
    cells = {r["cell"]: r for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("far")).collect()}
    most = max(1, min(CELL_BLOCK, CELL_BYTES // (8 * max(1, *(len(r["p"]) for r in found.rows)))))
    blocks = [math.ceil(cells[c]["n"] / most) if c in cells else 0 for c in range(len(found.rows))]
    spark = samples.sparkSession
    counts = F.array(*[F.lit(b) for b in blocks])
    index = index.withColumn("block", F.pmod(F.xxhash64("o"), counts[F.col("cell")]).cast("int"))
    queries = materialize(placed(cands), "nearest-queries")
    index_schema = {f.name: f.dataType for f in index.schema}
    kinds = [T.StructField("k", cands.schema["k"].dataType), T.StructField("d", T.DoubleType()),
             T.StructField("o", index_schema["o"]), *[T.StructField(f"x_{c}", index_schema[f"x_{c}"]) for c in extra],
             T.StructField("pairs", T.LongType())]
    names = [f.name for f in kinds]
    l2 = kernel("l2")

    def search(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        """Every query's best in one block, unless it lies beyond ``reach``. Of equal points only the first by order
        can be nearest, or the second for the query that is the first itself."""
        if lhs.empty or rhs.empty:
            return pd.DataFrame([], columns=names)
        rhs = rhs.sort_values("o", kind="stable")
        same = pd.Series([l2.prepare(p).tobytes() for p in rhs["p"]], index=rhs.index)
        if exclude_self:
            there = ~pd.DataFrame({"same": same, "o": rhs["o"]}).duplicated()
            rhs, same = rhs[there], same[there]
        at = same.groupby(same, sort=False).cumcount().to_numpy()
        rhs = rhs[at < (2 if exclude_self else 1)].reset_index(drop=True)
        rhs = rhs.rename_axis("rank").reset_index().sort_values("own", kind="stable")
        lhs = lhs.sort_values("at", kind="stable")
        own, order, rank = rhs["own"].to_numpy(), rhs["o"].to_numpy(), rhs["rank"].to_numpy()
        closest, asks, keys = L2Closest(np.stack([l2.prepare(p) for p in rhs["p"]])), np.stack([l2.prepare(p) for p in lhs["p"]]), lhs["k"].to_numpy()
        reach = lhs["reach"].to_numpy()
        low = np.searchsorted(own, lhs["at"].to_numpy() - reach * (1 + 1e-9) - 1e-12)
        high = np.searchsorted(own, lhs["at"].to_numpy() + reach * (1 + 1e-9) + 1e-12, "right")
        if report is not None:  # what lies beyond reach is opened and counted as well
            reach = np.full(len(reach), np.inf)
        places, found = {}, []
        for j, o in enumerate(order.tolist() if exclude_self else ()):
            places.setdefault(o, []).append(j)
        for start in range(0, len(lhs), TOGETHER):  # queries in the order of their ranges, so that these mostly overlap
            some = slice(start, start + TOGETHER)
            a, b = low[some].min(), high[some].max()
            if a >= b:
                continue
            out = [(i, j - a) for i, k in enumerate(keys[some].tolist() if exclude_self else ()) for j in places.get(k, ()) if a <= j < b]
            i, j, d = closest.near(asks[some], reach[some], a, b, tuple(np.array(out, np.int64).reshape(-1, 2).T))
            best = np.lexsort((rank[j], d, i))
            best = best[np.diff(i[best], prepend=-1) > 0]
            found.append((start + i[best], j[best], d[best], np.full(len(best), b - a)))
        if not found:
            return pd.DataFrame([], columns=names)
        i, j, d, pairs = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"k": keys[i], "d": d, "o": order[j], **{f"x_{c}": rhs[f"x_{c}"].to_numpy()[j] for c in extra}, "pairs": pairs})[names]

    def searched(asked: DataFrame) -> DataFrame:
        """``asked`` has cell, at (distance to its pivot) and reach. Each block of a cell meets the cell's queries in parts of bounded size."""
        number = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        parts = [math.ceil(number.get(c, 0) / (2 * most)) for c in range(len(blocks))]
        shares = F.array(*[F.lit(p) for p in parts])
        tasks = _cell_partitions(spark, sum(b * p for b, p in zip(blocks, parts)))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("k"), shares[F.col("cell")]).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), counts[F.col("cell")] - 1))).repartition(tasks, "cell", "block", "part")
        there = index.where(shares[F.col("cell")] > 0).withColumn("part", F.explode(F.sequence(F.lit(0), shares[F.col("cell")] - 1)))
        there = there.repartition(tasks, "cell", "block", "part")
        return materialize(asked.groupBy("cell", "block", "part").cogroup(there.groupBy("cell", "block", "part")).applyInPandas(
            search, T.StructType(kinds)), "nearest-found")

    inside = [i for i, b in enumerate(blocks) if b]
    first = searched(queries.select("k", "p", "cell", F.col("own").alias("at"), F.lit(float("inf")).alias("reach"))
                     .where(counts[F.col("cell")] > 0))
    near = F.min(F.struct("d", "o", *[f"x_{c}" for c in extra])).alias("near")
    reach = first.groupBy("k").agg(F.min("d").alias("reach"))
    others = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(float(cells[i]["far"])).alias("far")) for i in inside])
    asked = queries.join(reach, "k", "left").select(
        "k", "p", "ds", F.col("cell").alias("home"), F.coalesce("reach", F.lit(float("inf"))).alias("reach"), F.explode(others).alias("c"))
    asked = asked.select("k", "p", "home", "reach", "c.cell", "c.far", F.col("ds")[F.col("c.cell")].alias("at"))
    asked = asked.where((F.col("cell") != F.col("home")) & (F.col("at") - F.col("far") <= F.col("reach") * (1 + 1e-9) + 1e-12))
    second = searched(asked.drop("home", "far"))
    both = first.unionByName(second)
    if report is not None:
        total = queries.count() * n
        for step, part in (("own cell", first), ("other cells", second)):
            report.append({"step": step, "queries": queries.count(), "pairs": part.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0], "all_pairs": total})
    return both.groupBy("k").agg(near).select(F.col("k").alias(key), F.col("near.d").alias("min_distance"), F.col("near.o").alias(order_col),
                                              *[F.col(f"near.x_{c}").alias(c) for c in extra])


# --- the row farthest from all others on average --------------------------------------------

def farthest_on_average(samples: DataFrame, key: str = "idx", payload: str = "dom", distance: str = "ncd",
                        report: list | None = None):
    """The key of the row with the largest mean distance, ties to the lower key; None without rows.

    Points: the moments of all rows bound every row's mean (``_mean_bound``); rows are measured by falling bound until
    the best mean is above all bounds left, or by all pairs where too many are left. Tag sets: equal sets are measured once, with
    their number as weight. Compression distance has no bound and takes all pairs.
    ``report`` gets a dict: rows, measured (rows whose mean was taken)."""
    if distance == "l2":
        return _farthest_point(samples, key, payload, report)
    if distance == "tag_jaccard":
        sets = samples.where(F.col(payload).isNotNull()).groupBy(_tag_set(payload).alias("set")).agg(F.min(key).alias("key"), F.count("*").alias("w"))
        sets = materialize(sets.select("key", F.array_join("set", " ").cast("binary").alias("payload"), "w"), "distinct-sets")
        partial = _self_grid(sets, "key", "payload", distance, None, None, "rows", "w")
        means = partial.groupBy("key").agg(F.sum("total").alias("total"))
        if report is not None:
            report.append({"rows": samples.count(), "measured": sets.count()})
        row = means.agg(F.min_by("key", F.struct(-F.round("total", 9), F.col("key")))).first()
        return row[0] if row[0] is not None or not sets.count() else sets.agg(F.min("key")).first()[0]
    means = mean_distance(samples, key, payload, distance)
    if report is not None:
        n = samples.count()
        report.append({"rows": n, "measured": n})
    return means.agg(F.min_by(key, F.struct(-F.round("mean_distance", 12), F.col(key)))).first()[0]


def _mean_distances(rows: DataFrame, points: list, n: int) -> list[float]:
    """The mean distance of each of a few points from all rows: each task sums its own rows' distances."""
    l2 = kernel("l2")
    targets = [l2.prepare(p) for p in points]

    def partial(frames):
        totals = np.zeros(len(targets))
        for frame in frames:
            for _, d in l2.strips([l2.prepare(p) for p in frame["p"]], targets):
                totals += d.sum(axis=0)
        yield pd.DataFrame({"i": np.arange(len(targets)), "total": totals})

    sums = {r["i"]: r["total"] for r in rows.select("p").mapInPandas(partial, "i long, total double")
            .groupBy("i").agg(F.sum("total").alias("total")).collect()}  # one row per point
    return [sums[i] / n for i in range(len(targets))]


def _sums(rows: DataFrame, sums, number: int) -> list[np.ndarray]:
    """``sums(frames)`` gives ``number`` arrays in each task; their totals, added apart."""
    def partial(frames):
        yield pd.DataFrame({"k": range(number), "sums": [np.ascontiguousarray(x, float).tobytes() for x in sums(frames)]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "sums": [sum(np.frombuffer(x) for x in pdf["sums"]).tobytes()]})

    schema = "k long, sums binary"
    found = rows.select("p").mapInPandas(partial, schema).groupBy("k").applyInPandas(added, schema).collect()  # one row for each array
    return [np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["k"])]


def _mean_bound(rows: DataFrame, width: int, n: int):
    """A bound on the mean distance of a point from all points, as a function of a column of points.

    The squared distance of x from y is q + u, with q the mean square and u = w.z for z = (1, |y|^2 - 1, y) and a w that
    x gives. The root is at most its series up to the first or the third power of u, as its second and fourth derivatives
    are negative everywhere, so the mean square, and for points that are not wide the means of u^2 and u^3, give bounds."""
    def plain(frames):
        total, squares = np.zeros(width), 0.0
        for frame in frames:
            p = np.stack(frame["p"])
            total, squares = total + p.sum(axis=0), squares + (p * p).sum()
        return total, [squares]

    total, squares = _sums(rows, plain, 2)
    middle = total / n  # this and the scale need not be exact, only the same in all that follows
    scale = math.sqrt(max(0.0, squares[0] / n - middle @ middle))
    scale = scale if 0.0 < scale < math.inf else 1.0
    first, second = np.triu_indices(width + 2) if width <= MOMENTS_WIDTH else (np.zeros(0, int),) * 2

    def centred(points):
        for start in range(0, len(points), MOMENT_ROWS):
            yield (np.stack(points.iloc[start:start + MOMENT_ROWS]) - middle) / scale

    def moments(frames):
        sums, by_pair, cubes = np.zeros(width + 2), np.zeros((len(first), width + 2)), 0.0
        for frame in frames:
            for y in centred(frame["p"]):
                z = np.column_stack([np.ones(len(y)), (y * y).sum(axis=1) - 1.0, y])
                sums, cubes = sums + z.sum(axis=0), cubes + ((z * z).sum(axis=1) ** 1.5).sum()
                by_pair += (z[:, first] * z[:, second]).T @ z
        return sums, [cubes], *by_pair.T

    sums, cubes, *by_pair = (x / n for x in _sums(rows, moments, width + 4))
    by_pair, twice = np.column_stack(by_pair), np.where(first == second, 1.0, 2.0)

    @F.pandas_udf(T.DoubleType())
    def bound(points: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for x in centred(points):
            along = 2.0 * (x @ sums[2:])
            q = (x * x).sum(axis=1) + 1.0 + sums[1] - along
            root = np.sqrt(np.maximum(q, 0.0))
            out.append(root)
            if len(first):
                w = np.column_stack([along - sums[1], np.ones(len(x)), -2.0 * x])
                with np.errstate(all="ignore"):  # equal points: no number, and no closer bound
                    by_column = (w[:, first] * w[:, second] * twice) @ by_pair
                    u2, u3 = by_column[:, 0], (by_column * w).sum(axis=1)
                    lost = 1e-12 * (w * w).sum(axis=1) ** 1.5 * cubes[0]
                    out[-1] = np.fmin(root, root * (1.0 - u2 / (8.0 * q * q) + (u3 + lost) / (16.0 * q * q * q)))
        return pd.Series(np.concatenate(out) * scale)

    return bound


def _farthest_point(samples: DataFrame, key: str, payload: str, report: list | None):
    rows = samples.where(F.col(payload).isNotNull()).select(F.col(key).alias("key"), F.col(payload).cast("array<double>").alias("p"))
    size = rows.agg(F.max(F.size("p")).alias("width"), F.count("*").alias("n")).first()
    if not size["n"]:
        return None
    width, n = size["width"], size["n"]
    bound = _mean_bound(rows, width, n)(F.col("p"))
    # a little above, so that rounding never rules a row out
    rows = materialize(rows.withColumn("bound", bound * (1 + 1e-9)), "bounded-points")
    falling = (F.col("bound").desc(), F.col("key"))
    most = max(1, MAX_BROADCAST_BYTES // (8 * max(1, width)))
    batch = rows.orderBy(*falling).limit(min(FIRST_MEASURED, most)).collect()
    best, measured = _farther(rows, batch, n, None), len(batch)
    # equal points are measured once, for the lowest of their keys
    left = materialize(rows.where(F.col("bound") >= best[0]).groupBy("p").agg(F.min("key").alias("key"), F.max("bound").alias("bound")), "points-left")
    passes = 0
    while number := left.count():
        if passes and number * MANY_LEFT > n and number > MOST_MEASURED:
            best, measured = _farthest_of_all(rows, n), n
            break
        batch = left.orderBy(*falling).limit(min(MOST_MEASURED, most)).collect()
        best, measured, passes = _farther(rows, batch, n, best), measured + len(batch), passes + 1
        last = batch[-1]
        left = left.where((F.col("bound") < last["bound"]) | ((F.col("bound") == last["bound"]) & (F.col("key") > last["key"])))
        left = left.where(F.col("bound") >= best[0])
    if report is not None:
        report.append({"rows": n, "measured": min(measured, n)})
    return best[1]


def _farther(rows: DataFrame, batch: list, n: int, best: tuple | None) -> tuple:
    """(mean, key) of the row that is farthest on average among ``batch`` and ``best``."""
    for r, mean in zip(batch, _mean_distances(rows, [r["p"] for r in batch], n)):
        if best is None or round(mean, 12) > round(best[0], 12) or (round(mean, 12) == round(best[0], 12) and r["key"] < best[1]):
            best = (mean, r["key"])
    return best


def _farthest_of_all(rows: DataFrame, n: int) -> tuple:
    """The same by all pairs of distinct points, where bounds rule out too few."""
    points = materialize(rows.groupBy("p").agg(F.min("key").alias("key"), F.count("*").alias("w")).withColumn("id", F.monotonically_increasing_id()), "distinct-points")
    totals = _self_grid(points, "id", "p", "l2", None, None, "rows", "w").groupBy(F.col("key").alias("id")).agg(F.sum("total").alias("total"))
    mean = F.col("total") / n
    row = totals.join(points.select("id", "key"), "id").agg(F.min_by(F.struct(mean.alias("mean"), "key"), F.struct(-F.round(mean, 12), "key")).alias("best")).first()
    return row["best"]["mean"], row["best"]["key"]
