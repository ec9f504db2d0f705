"""Prototype selection and clustering by farthest-point-first.

Each row keeps the distance to the nearest centre it was measured against. That distance only
falls as centres are added, so an old one is an upper bound: selection measures a row again only
while its bound reaches the best fresh value, and finds the same rows as n*k distances would.
Clustering needs the variance over all rows after every centre, so it measures all of them; never
the n*n matrix. Rows stay in their partitions; a round moves one candidate per class. Round state
is cached with its (narrow) lineage, so a lost executor recomputes its own partitions, and every
few rounds it is checkpointed to the shared folder."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import (
    DEFAULT_K, MAX_CLUSTERS, MIN_VARIANCE_GAIN, MINIMAL_DOM_THRESHOLD, UNKNOWN,
)
from ..functions.kernel import kernel, memo_key, payload_size
from ..session import bounded_rows, materialize, shared_folder
from .distances import MAX_BROADCAST_ROWS, group_distance_stats, payload_bytes
from .nearest import farthest_on_average

CHECKPOINT_EVERY = 8
_SELECTED = float("-inf")


def filter_minimal(samples: DataFrame, threshold: int = MINIMAL_DOM_THRESHOLD,
                   payload: str = "dom") -> DataFrame:
    """Samples of at least ``threshold`` bytes."""
    return samples.filter(F.octet_length(payload) >= threshold)


def _start(samples: DataFrame, group: Column, key: str, payload: str, distance: str) -> DataFrame:
    """Round state; the payload's own compressed size is computed once, not once per round."""
    return samples.select(
        group.cast("string").alias("g"), F.col(key).alias("key"), F.col(payload).alias("payload"),
        payload_size(F.col(payload), distance).alias("size"), F.lit(float("inf")).alias("d_min"))


def _nearer(state: DataFrame, centres: dict, distance: str, self_distance: float) -> DataFrame:
    """``d_min`` after adding one centre per group; ``centres`` is group -> (id, payload).

    Argument order follows sample order, as in a matrix filled from its upper triangle."""
    k = kernel(distance)
    ready = {g: (i, None if p is None else k.prepare(p)) for g, (i, p) in centres.items()}

    @F.pandas_udf(T.DoubleType())
    def measure(g: pd.Series, key: pd.Series, payload: pd.Series, size: pd.Series, d_min: pd.Series) -> pd.Series:
        out, there = d_min.to_numpy(float).copy(), payload.notna().to_numpy()
        for group, (centre_id, centre) in ready.items():
            rows = np.flatnonzero((g == group).to_numpy() & there & (out != _SELECTED))
            if len(rows):
                sizes = None if size.isna().all() else size.iloc[rows].tolist()
                found = _from_centre(k, key.iloc[rows].tolist(), payload.iloc[rows].tolist(), centre_id, centre, sizes)
                out[rows] = np.fmin(out[rows], found)
            out[((g == group) & (key == centre_id)).to_numpy()] = self_distance
        return pd.Series(out)

    return state.withColumn("d_min", measure("g", "key", "payload", "size", "d_min"))


def _from_centre(k, keys: list, payloads: list, centre_id, centre, sizes: list | None = None) -> np.ndarray:
    """Distances of rows from one centre, the lower key first; NaN from one without payload. Repeated payloads are
    measured once."""
    if centre is None:
        return np.full(len(keys), np.nan)
    if k.symmetric:
        return k.matrix([k.prepare(p) for p in payloads], [centre])[:, 0]
    out, seen = np.empty(len(keys)), {}
    for at, (row_id, data) in enumerate(zip(keys, payloads)):
        before = row_id < centre_id
        known = memo_key(data), before
        if known not in seen:
            mine = k.prepare(data, None if sizes is None or np.isnan(sizes[at]) else sizes[at])
            seen[known] = k.pair(mine, centre) if before else k.pair(centre, mine)
        out[at] = seen[known]
    return out


def _cached(state: DataFrame, round_no: int, every: int) -> DataFrame:
    if round_no % every == 0:
        shared_folder(state.sparkSession)
        return state.checkpoint()
    return state.persist(StorageLevel.MEMORY_AND_DISK)


def _payloads(state: DataFrame, chosen: dict) -> dict:
    """Payloads of the chosen rows: one row per group reaches the driver."""
    wanted = list(chosen.values())
    rows = state.filter(F.col("key").isin(wanted)).select("g", "key", "payload").collect()
    return {r["g"]: (r["key"], r["payload"]) for r in rows if chosen.get(r["g"]) == r["key"]}


#: Rows measured at once where a block of pairs costs one matrix product.
_LAZY_BLOCK = 256
#: Bounds above this quantile are tried first; the best of them decides what else is measured.
_TRIED_FIRST = 0.99


def _lazily(state: DataFrame, centres: dict, floors: dict, distance: str) -> DataFrame:
    """``d_min``, ``seen`` and ``pairs`` after measuring rows whose bound reaches their group's floor.

    ``centres`` is group -> [(id, payload)] in the order of selection, ``floors`` group -> bound. Within a
    batch rows are taken by falling bound and the floor rises to the best row that has seen all centres, so a
    row is left stale only below a fresh one. Payloads of rows below the floor do not leave the JVM."""
    k = kernel(distance)
    ready = {g: [(i, k.prepare(p)) for i, p in rows] for g, rows in centres.items()}
    step = _LAZY_BLOCK if k.symmetric else 1
    marks = reduce(lambda otherwise, g: F.when(F.col("g") == g, floors[g]).otherwise(otherwise), floors, F.lit(float("inf")))
    tried = (F.col("d_min") >= marks) & (F.col("d_min") > _SELECTED)

    @F.pandas_udf("d_min double, seen int, pairs long")
    def measure(g: pd.Series, key: pd.Series, payload: pd.Series, size: pd.Series, d_min: pd.Series, seen: pd.Series) -> pd.DataFrame:
        bound, done, pairs = d_min.to_numpy(float).copy(), seen.to_numpy(int).copy(), np.zeros(len(g), np.int64)
        there, keys, sizes, payloads = payload.notna().to_numpy(), key.tolist(), size.tolist(), payload.tolist()
        for group, rows in pd.Series(np.arange(len(g))[there]).groupby(g.to_numpy()[there]):
            rows, floor, all_centres = rows.to_numpy(), floors[group], ready[group]
            rows = rows[np.argsort(-bound[rows], kind="stable")]
            for start in range(0, len(rows), step):
                block = rows[start:start + step]
                block = block[bound[block] >= floor]
                if not len(block):
                    break
                mine = {r: k.prepare(payloads[r], None if sizes[r] is None or np.isnan(sizes[r]) else sizes[r]) for r in block}
                for c in range(done[block].min(), len(all_centres)):
                    centre_id, centre = all_centres[c]
                    now = [r for r in block if done[r] == c and bound[r] >= floor and bound[r] > _SELECTED]
                    if not now:
                        continue
                    if k.symmetric:
                        found = k.matrix([mine[r] for r in now], [centre])[:, 0]
                    else:
                        found = [np.nan if keys[r] == centre_id else k.pair(mine[r], centre) if keys[r] < centre_id
                                 else k.pair(centre, mine[r]) for r in now]
                    for r, d in zip(now, found):
                        done[r] = c + 1
                        if keys[r] == centre_id:
                            bound[r] = _SELECTED
                        else:
                            bound[r], pairs[r] = min(bound[r], d), pairs[r] + 1
                fresh = block[done[block] == len(all_centres)]
                if len(fresh):
                    floor = max(floor, bound[fresh].max())
        return pd.DataFrame({"d_min": bound, "seen": done, "pairs": pairs})

    found = state.withColumn("_m", measure("g", "key", F.when(tried, F.col("payload")), "size", "d_min", "seen"))
    return found.withColumns({c: F.col(f"_m.{c}") for c in ("d_min", "seen", "pairs")}).drop("_m")


def fpf_select(samples: DataFrame, k: int = DEFAULT_K, by: str | None = None, key: str = "idx",
               payload: str = "dom", distance: str = "ncd", first="random", seed: int = 42,
               checkpoint_every: int = CHECKPOINT_EVERY, report: list | None = None) -> DataFrame:
    """``k`` rows of every ``by`` class, added columns ``prototype_index`` (1-based
    selection order) and ``cover_distance`` (distance to the nearest earlier centre).

    ``first`` is ``random`` (uniform by hashed key), ``lowest``, a key, or with ``by`` a mapping
    from class to key; every class of more than ``k`` rows must hold its key. Ties go to the lower
    key. A class of at most ``k`` rows is returned whole, in order.

    Rows are measured lazily. A round first tries the rows with the highest bounds, then all whose bound
    still reaches the best fresh distance; most rows stay as they are. ``report`` gets one dict for each
    round: rows, pairs measured, and the pairs that measuring every row would take."""
    spark = samples.sparkSession
    group = F.col(by) if by else F.lit("all")
    state = _start(samples, group, key, payload, distance)
    base = state = state.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["g"]: r["n"] for r in state.groupBy("g").agg(F.count("*").alias("n")).collect()}
    whole = [g for g, n in sizes.items() if n <= k]
    active = [g for g in sizes if g not in whole]
    if active and k <= 0:
        raise ValueError(f"cannot select {k} rows")

    picked = []  # (group, key, index, cover distance): k per class
    if whole:
        in_whole = reduce(lambda a, b: a | b, [F.col("g").eqNullSafe(F.lit(g)) for g in whole])
        kept = state.filter(in_whole).groupBy("g").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # k keys at most
        picked += [(r["g"], value, i + 1, None) for r in kept.collect() for i, value in enumerate(r["keys"])]

    if active:
        state = state.filter(F.col("g").isin(active)).withColumns({"seen": F.lit(0), "pairs": F.lit(0).cast("long")})
        chosen = _first_centres(state, first, seed)
        picked += [(g, value, 1, None) for g, value in chosen.items()]
        centres, floors = {g: [] for g in active}, dict.fromkeys(active, float("-inf"))
        held, rows = [], sum(sizes[g] for g in active)
        for i in range(2, k + 1):
            for g, centre in _payloads(state, chosen).items():
                centres[g].append(centre)
            pairs, open_groups = 0, active
            while open_groups:
                state = _cached(_lazily(state, {g: centres[g] for g in open_groups}, {g: floors[g] for g in open_groups}, distance),
                                i, checkpoint_every)
                held.append(state)
                fresh = F.col("seen") == i - 1
                found = state.groupBy("g").agg(
                    F.min_by(F.struct("key", "d_min"), F.when(fresh, F.struct(-F.col("d_min"), F.col("key")))).alias("far"),
                    F.max(F.when(~fresh, F.col("d_min"))).alias("stale"), F.sum("pairs").alias("pairs"),
                    F.percentile_approx("d_min", _TRIED_FIRST).alias("high")).collect()
                pairs += sum(r["pairs"] for r in found if r["g"] in open_groups)
                done = {r["g"]: r for r in found if r["far"] is not None and r["far"]["d_min"] > _SELECTED
                        and (r["stale"] is None or r["stale"] < r["far"]["d_min"])}
                open_groups = [r["g"] for r in found if r["g"] in open_groups and r["g"] not in done]
                for r in found:
                    if r["g"] in open_groups:
                        floors[r["g"]] = r["far"]["d_min"] if r["far"] is not None else float("-inf")
            chosen = {}
            for g, r in done.items():
                chosen[g] = r["far"]["key"]
                floors[g] = r["high"]
                picked.append((g, r["far"]["key"], i, r["far"]["d_min"]))
            for frame in held[:-1]:
                frame.unpersist()  # only the start and the newest round stay cached
            held = held[-1:]
            if report is not None:
                report.append({"round": i, "rows": rows, "pairs": pairs, "full_pairs": rows})
        state.unpersist()
    base.unpersist()

    key_type = samples.schema[key].dataType
    picks = spark.createDataFrame(picked, T.StructType([
        T.StructField("_g", T.StringType()), T.StructField(key, key_type),
        T.StructField("prototype_index", T.IntegerType()),
        T.StructField("cover_distance", T.DoubleType())]))
    # picks holds k rows per class by construction
    joined = samples.withColumn("_g", group.cast("string")).join(F.broadcast(picks), ["_g", key])
    # written, so that users of the few chosen rows do not scan the samples again
    return materialize(joined.drop("_g").repartition(max(1, len(picked) // 1000)), "prototypes")


def _first_centres(state: DataFrame, first, seed: int) -> dict:
    if first == "random":
        rank = F.struct(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("key").cast("string"))), F.col("key"))
        rows = state.groupBy("g").agg(F.min_by("key", rank).alias("key"))
    elif first == "lowest":
        rows = state.groupBy("g").agg(F.min("key").alias("key"))
    elif isinstance(first, dict):
        wanted = [(F.col("g") == F.lit(g)) & (F.col("key") == F.lit(key)) for g, key in first.items()]
        rows = state.filter(reduce(lambda a, b: a | b, wanted, F.lit(False))).select("g", "key").distinct()
    else:
        rows = state.filter(F.col("key") == F.lit(first)).select("g", "key").distinct()
    chosen = {r["g"]: r["key"] for r in rows.collect()}
    without = sorted(str(r["g"]) for r in state.select("g").distinct().collect() if r["g"] not in chosen)
    if without:
        raise ValueError(f"first centre {first!r} is not among the samples of {without}")
    return chosen


def name_prototypes(selected: DataFrame, label: str = "label", payload: str = "dom") -> DataFrame:
    """K2: ``<label>_prototype_<02d>``, size and url of selected rows."""
    url = F.coalesce("url", F.lit(UNKNOWN)) if "url" in selected.columns else F.lit(UNKNOWN)
    return selected.withColumns({
        "name": F.format_string("%s_prototype_%02d", F.col(label), F.col("prototype_index")),
        "size": F.octet_length(payload).cast("bigint"), "url": url,
    })


def build_prototypes(samples: DataFrame, k: int = DEFAULT_K, filter_minimal_doms: bool = True,
                     minimal_threshold: int = MINIMAL_DOM_THRESHOLD, **options) -> DataFrame:
    """M2: P9, then M1 per class with ``k`` capped at the class size, then K2 names."""
    kept = filter_minimal(samples, minimal_threshold) if filter_minimal_doms else samples
    return name_prototypes(fpf_select(kept, k, by="label", **options))


def prototype_build_summary(samples: DataFrame, prototypes: DataFrame, key: str = "idx") -> DataFrame:
    """Per class the number of samples, ``k``, and names and indices in selection order."""
    counts = samples.groupBy("label").agg(F.count("*").alias("samples"))
    chosen = prototypes.groupBy("label").agg(
        F.count("*").alias("k"),
        F.sort_array(F.collect_list(F.struct("prototype_index", "name", key))).alias("rows"))
    return counts.join(chosen, "label").select(
        "label", "k", "samples", F.col("rows.name").alias("prototypes"),
        F.col(f"rows.{key}").alias("indices"))


# --- clustering ----------------------------------------------------------------------------

def fpf_cluster(samples: DataFrame, max_clusters: int = MAX_CLUSTERS,
                min_variance_gain: float = MIN_VARIANCE_GAIN, key: str = "idx",
                payload: str = "dom", distance: str = "ncd",
                checkpoint_every: int = CHECKPOINT_EVERY) -> DataFrame:
    """M3: centres as rows (cluster, <key>, cover_distance, variance_before, variance_after).

    Starts at the row with the largest mean distance and adds the farthest row while that
    lowers the variance of the distance to the nearest centre (A12) by ``min_variance_gain``."""
    spark = samples.sparkSession
    start = farthest_on_average(samples, key, payload, distance)
    if start is None:
        raise ValueError("clustering needs at least 2 samples")
    state = _start(samples, F.lit("all"), key, payload, distance)
    base = state.persist(StorageLevel.MEMORY_AND_DISK)
    centres, held = [(1, start, None, None, None)], [base]

    def add(frame, centre, round_no):
        out = _cached(_nearer(frame, _payloads(frame, {"all": centre}), distance, 0.0),
                      round_no, checkpoint_every)
        held.append(out)
        return out

    def far_and_variance(frame):
        row = frame.agg(
            F.min_by(F.struct("key", "d_min"), F.struct(-F.col("d_min"), F.col("key"))).alias("far"),
            F.var_pop("d_min").alias("variance")).first()
        return row["far"]["key"], row["far"]["d_min"], row["variance"]

    state = add(base, start, 1)
    candidate, cover, before = far_and_variance(state)
    for cluster in range(2, max_clusters + 1):
        state = add(state, candidate, cluster)
        following, next_cover, after = far_and_variance(state)
        held.pop(-2).unpersist()  # the newest round is filled
        if before - after < min_variance_gain:
            break
        centres.append((cluster, candidate, cover, before, after))
        candidate, cover, before = following, next_cover, after
    for frame in held:
        frame.unpersist()
    return spark.createDataFrame(centres, T.StructType([
        T.StructField("cluster", T.IntegerType()),
        T.StructField(key, samples.schema[key].dataType),
        T.StructField("cover_distance", T.DoubleType()),
        T.StructField("variance_before", T.DoubleType()),
        T.StructField("variance_after", T.DoubleType())]))


def cover_variance(samples: DataFrame, centre_ids: list, key: str = "idx", payload: str = "dom",
                   distance: str = "ncd") -> DataFrame:
    """Variance of the distance to the nearest centre as centres are added one by one."""
    spark = samples.sparkSession
    state = _start(samples, F.lit("all"), key, payload, distance)
    out = []
    for i, centre in enumerate(centre_ids):
        state = _nearer(state, _payloads(state, {"all": centre}), distance, 0.0)
        out.append(state.agg(F.lit(i + 1).alias("centres"), F.var_pop("d_min").alias("variance")))
    result = out[0]
    for frame in out[1:]:
        result = result.unionByName(frame)
    return result


def assign_clusters(samples: DataFrame, centres: DataFrame, key: str = "idx", payload: str = "dom",
                    distance: str = "ncd") -> DataFrame:
    """Nearest centre, ties to the earlier one; adds ``cluster``, ``center_distance``.

    Centres are a handful of rows: they travel with the tasks after their number and bytes were checked."""
    k = kernel(distance)
    few = centres.select("cluster", key)
    rows = bounded_rows(few, MAX_BROADCAST_ROWS)
    if rows is None:
        raise ValueError(f"more than {MAX_BROADCAST_ROWS} centres")
    ids = {r[key]: r["cluster"] for r in rows}
    wanted = samples.join(F.broadcast(few), key, "left_semi").select(key, payload)
    data = bounded_rows(wanted, MAX_BROADCAST_ROWS, payload_bytes(wanted, payload))
    if data is None:
        raise ValueError("the centres' payloads are too large to travel with the tasks")
    ready = sorted(((ids[r[key]], r[key], None if r[payload] is None else k.prepare(r[payload])) for r in data), key=lambda c: c[0])

    @F.pandas_udf("cluster int, center_distance double")
    def nearest(key_values: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        if not len(key_values) or not ready:
            return pd.DataFrame({"cluster": [None] * len(key_values), "center_distance": [None] * len(key_values)})
        keys, there = key_values.tolist(), np.flatnonzero(payloads.notna().to_numpy())
        known = [payloads.iloc[r] for r in there]
        cluster, best = np.full(len(keys), ready[0][0]), np.full(len(keys), np.nan)
        for at, (number, centre_id, centre) in enumerate(ready):
            d = np.full(len(keys), np.nan)
            if len(there):
                d[there] = _from_centre(k, [keys[r] for r in there], known, centre_id, centre)
            d[(key_values == centre_id).to_numpy()] = 0.0
            nearer = d < best if at else np.ones(len(keys), bool)
            cluster[nearer], best[nearer] = number, d[nearer]
        return pd.DataFrame({"cluster": cluster, "center_distance": best})

    found = samples.withColumn("_near", nearest(key, payload))
    return found.withColumns({"cluster": F.col("_near.cluster"),
                              "center_distance": F.col("_near.center_distance")}).drop("_near")


def cluster_report(assigned: DataFrame, centres: DataFrame, key: str = "idx", payload: str = "dom",
                   distance: str = "ncd") -> DataFrame:
    """Per cluster its centre, size and intra-cluster min, max and mean distance.

    A cluster may hold most of the rows; its pairs are measured block by block."""
    sizes = assigned.groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg("center_distance").alias("avg_center_distance"))
    inner = group_distance_stats(assigned, "cluster", key, payload, distance)
    return (centres.select("cluster", F.col(key).alias("center")).join(sizes, "cluster")
            .join(inner, "cluster", "left"))


def cluster_samples(samples: DataFrame, max_clusters: int = MAX_CLUSTERS,
                    min_variance_gain: float = MIN_VARIANCE_GAIN, **options) -> tuple:
    """M5: (assigned samples, centres, report). The samples are read many times, so they are
    written once first."""
    samples = materialize(samples, "samples")
    centres = fpf_cluster(samples, max_clusters, min_variance_gain, **options)
    assigned = assign_clusters(samples, centres, **options)
    return assigned, centres, cluster_report(assigned, centres, **options)
