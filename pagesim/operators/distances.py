"""Distances between candidates and prototypes, and within one sample set.

Two ways, both exact. A prototype set proven small travels with the tasks and every candidate
is scored where it lies: no shuffle and no pair rows. A larger set goes through a grid: both
sides are hashed into blocks, one cell holds one block of each, and a cell gives one partial
result per candidate instead of its pairs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernel import kernel, memo_key
from ..session import bounded_rows, materialize
from .ordering import ordered_index

MAX_BROADCAST_ROWS = 2000
MAX_BROADCAST_BYTES = 32 << 20
BLOCK_ROWS = 256
SMALLEST_BLOCK = 32
#: Where a block of pairs costs one matrix product, blocks are so many times larger: they move less often.
WIDER = 128
BLOCK_BYTES = 16 << 20
CELLS_PER_TASK = 4


def payload_bytes(df: DataFrame, payload: str) -> Column:
    """Bytes of one payload, whatever its type."""
    kind = df.schema[payload].dataType
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(payload), F.lit(0)) * 8
    return F.octet_length(payload) if isinstance(kind, (T.BinaryType, T.StringType)) else F.lit(8)


@dataclass(frozen=True)
class PrototypeSet:
    """Prototypes whose size was checked, sorted by (set, order)."""

    rows: tuple[dict[str, Any], ...]
    set_col: str
    order_col: str

    @classmethod
    def load(cls, protos: DataFrame, set_col: str = "label", order_col: str = "prototype_index",
             payload: str = "dom", max_rows: int = MAX_BROADCAST_ROWS,
             max_bytes: int = MAX_BROADCAST_BYTES) -> PrototypeSet | None:
        """None when the table is beyond the bound; the caller then takes the grid."""
        needed = list(dict.fromkeys([set_col, order_col, payload]))
        rows = bounded_rows(protos.filter(F.col(payload).isNotNull()).select(*needed), max_rows,
                            payload_bytes(protos, payload), max_bytes)
        if rows is None:
            return None
        ordered = sorted((r.asDict() for r in rows), key=lambda r: (r[set_col], r[order_col]))
        return cls(tuple(ordered), set_col, order_col)

    def positions(self, name: str) -> tuple[int, int]:
        """(first position, count) of one set inside a distance array."""
        at = [i for i, r in enumerate(self.rows) if r[self.set_col] == name]
        return (at[0], len(at)) if at else (0, 0)


def distances_to(payload: Column, protos: PrototypeSet, distance: str = "ncd",
                 proto_payload: str = "dom") -> Column:
    """Array of distances, candidate first, aligned with ``protos.rows``."""
    k = kernel(distance)
    targets = [k.prepare(r[proto_payload]) for r in protos.rows]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def measure(values: pd.Series) -> pd.Series:
        ids = {}
        which = [None if v is None else ids.setdefault(memo_key(v), (len(ids), v))[0] for v in values]
        found = k.matrix([k.prepare(v) for _, v in ids.values()], targets).tolist()
        return pd.Series([None if i is None else found[i] for i in which], dtype=object)

    return measure(payload)


def set_scores(distances: Column, protos: PrototypeSet, name: str) -> tuple[Column, Column]:
    """Minimum and mean of one set's part of a distance array; an absent set gives 1.0."""
    first, count = protos.positions(name)
    if not count:
        return F.lit(1.0), F.lit(1.0)
    part = F.slice(distances, first + 1, count)
    total = F.aggregate(part, F.lit(0.0), lambda a, d: a + d)
    return F.array_min(part), total / F.lit(float(count))


def prototype_distances(cands: DataFrame, protos: DataFrame, key: str = "page_id",
                        payload: str = "dom", distance: str = "ncd", set_col: str = "label",
                        order_col: str = "prototype_index", proto_payload: str = "dom",
                        max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """J4/J6 in long form, one row per candidate and prototype: a set beyond the bound goes
    through the grid, whose cells then give their pairs."""
    bounded = PrototypeSet.load(protos, set_col, order_col, proto_payload, max_rows)
    if bounded is None:
        return grid_pairs(cands, protos, key, payload, distance, set_col, order_col, proto_payload)
    schema = protos.select(set_col, order_col).schema
    names = F.array(*[
        F.struct(F.lit(r[set_col]).cast(schema[set_col].dataType).alias(set_col),
                 F.lit(r[order_col]).cast(schema[order_col].dataType).alias(order_col))
        for r in bounded.rows
    ])
    scored = cands.select(key, distances_to(F.col(payload), bounded, distance, proto_payload).alias("d"))
    pairs = scored.select(key, F.explode(F.arrays_zip(names.alias("p"), F.col("d").alias("d"))).alias("x"))
    return pairs.select(key, f"x.p.{set_col}", f"x.p.{order_col}", F.col("x.d").alias("distance"))


# --- the grid -----------------------------------------------------------------------------

def _size_columns(df: DataFrame, payload: str) -> list[Column]:
    return [F.count("*").alias("rows"), F.coalesce(F.sum(payload_bytes(df, payload)), F.lit(0)).alias("bytes")]


def _blocks(rows: int, size: int, cells_wanted: int, block_rows: int | None, cheap: bool = False) -> int:
    """Blocks of one side: small enough in rows and bytes, and enough of them that the cells
    keep every core busy even when the data is tiny but each pair is costly."""
    least = math.ceil(rows / (block_rows or BLOCK_ROWS * (WIDER if cheap else 1)))
    if block_rows is None:
        smallest = SMALLEST_BLOCK * (WIDER // 8 if cheap else 1)
        least = max(least, min(math.ceil(math.sqrt(cells_wanted)), math.ceil(rows / smallest)))
    return max(1, least, math.ceil(size / BLOCK_BYTES))


def _cell_partitions(spark, cells: int) -> int:
    """Tasks for the cells: so many that a task has ``CELLS_PER_TASK`` of them at most, however many
    there are. Given explicitly: by bytes, adaptive execution would merge cells that are small to
    ship but long to compute."""
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    return max(1, min(2 * cells, max(least, math.ceil(cells / CELLS_PER_TASK))))


def payload_digest(df: DataFrame, payload: str) -> Column:
    """A digest that equal payloads share."""
    plain = F.col(payload) if isinstance(df.schema[payload].dataType, (T.BinaryType, T.StringType)) else F.to_json(F.struct(payload))
    return F.sha2(plain.cast("binary"), 256)


def grid_scores(cands: DataFrame, others: DataFrame, key: str, payload: str = "dom",
                distance: str = "ncd", set_col: str = "label", order_col: str = "idx",
                carry: tuple[str, ...] = (), block_rows: int | None = None,
                other_payload: str | None = None, exclude: str | None = None) -> DataFrame:
    """Per candidate and set: count, sum, minimum and the nearest row (ties to lowest order).

    ``key`` must be unique. Rows whose ``exclude`` column (the order or a carried one) equals the candidate's key are
    never its nearest; a candidate without any other row then has no minimum. ``other_payload`` names the others' payload if it differs.
    Each distinct payload is measured once against each distinct one of a set, which counts as often as it has rows
    and answers with its first row. Payloads are spread over blocks by hash, so no cell depends on how the
    data is distributed; each cell combines before anything is shuffled again."""
    k = kernel(distance)
    extra = [c for c in carry if c not in (set_col, order_col)]
    fields = [order_col, *extra]
    left = cands.filter(F.col(payload).isNotNull()).select(key, payload_digest(cands, payload).alias("_id"), F.col(payload).alias("payload"))
    distinct = materialize(left.groupBy("_id").agg(F.first("payload").alias("payload")), "grid-candidates")
    firsts = _first_rows(others, other_payload or payload, set_col, order_col, fields, exclude)
    lefts, rights, tasks = _place(distinct, firsts, "_id", "payload", set_col, "_id",
                                  [f.name for f in firsts.schema.fields if f.name not in (set_col, "_id", "payload")], block_rows, "payload", k.symmetric)
    answer = [f for f in firsts.schema.fields if f.name[:2] in ("f_", "s_") or f.name == "two"]
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField(set_col, others.schema[set_col].dataType),
                           T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()),
                           T.StructField("d", T.DoubleType()), *answer])
    names, near_names = [f.name for f in schema.fields], [f.name for f in answer]

    def cell(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if lhs.empty or rhs.empty:
            return pd.DataFrame([], columns=names)
        rhs = rhs.sort_values([set_col, f"f_{order_col}"], kind="stable").reset_index(drop=True)
        parts = [(name, np.array(at)) for name, at in rhs.groupby(set_col, sort=False).indices.items()]
        near, weight = rhs[near_names].to_numpy(dtype=object), rhs["rows"].to_numpy()
        mine, ids = [k.prepare(p) for p in lhs["payload"]], lhs["_id"].to_numpy()
        frames = []
        for start, d in k.strips(mine, [k.prepare(p) for p in rhs["payload"]]):
            for name, at in parts:
                part = d[:, at].copy()
                n, total = int(weight[at].sum()), part @ weight[at]
                for again in range(1 if exclude is None else min(2, len(at))):
                    best = part.argmin(axis=1)  # the first of equals
                    frame = pd.DataFrame({"_id": ids[start:start + len(d)], set_col: name, "n": 0 if again else n, "total": 0.0 if again else total,
                                          "d": part[np.arange(len(d)), best]})
                    for column, values in zip(near_names, near[at[best]].T):
                        frame[column] = values
                    frames.append(frame[names])
                    part[np.arange(len(d)), best] = np.inf
        return pd.concat(frames) if len(frames) > 1 else frames[0]

    lefts, rights = lefts.repartition(tasks, "lb", "rb"), rights.repartition(tasks, "lb", "rb")
    partial = lefts.groupBy("lb", "rb").cogroup(rights.groupBy("lb", "rb")).applyInPandas(cell, schema)
    there = F.when(F.col("d") < float("inf"), F.struct("d", *near_names))
    # two of each cell at most
    near = F.array(F.min(there)) if exclude is None else F.slice(F.sort_array(F.collect_list(there)), 1, 2)
    found = partial.groupBy("_id", set_col).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), near.alias("near"))
    joined = left.select(F.col(key).alias("_key"), "_id").join(found, "_id")

    def row(x, side):
        return F.struct(x["d"].alias("d"), *[x[f"{side}_{c}"].alias(c) for c in fields])

    if exclude is None:
        choice = F.transform("near", lambda x: row(x, "f"))
    else:
        def allowed(x, side):
            return ~F.coalesce(x[f"{side}_{exclude}"] == F.col("_key"), F.lit(False))

        choice = F.concat(F.transform(F.filter("near", lambda x: allowed(x, "f")), lambda x: row(x, "f")),
                          F.transform(F.filter("near", lambda x: x["two"] & allowed(x, "s")), lambda x: row(x, "s")))
    return joined.withColumn("_near", F.array_min(choice)).groupBy(F.col("_key").alias(key), set_col).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("_near").alias("near"),
    ).select(key, set_col, "n", "total", F.col("near.d").alias("min_distance"),
             *[F.col(f"near.{c}").alias(c) for c in fields])


def _first_rows(others: DataFrame, payload: str, set_col: str, order_col: str, fields: list[str], exclude: str | None) -> DataFrame:
    """Distinct payloads of each set: how many rows each has, and its first row as ``f_`` columns. With ``exclude`` also
    the first row that differs from that one there, as ``s_`` columns (the first again if ``two`` is false)."""
    there = others.filter(F.col(payload).isNotNull()).select(
        set_col, payload_digest(others, payload).alias("_id"), F.col(payload).alias("payload"), F.struct(*fields).alias("row"))
    out = there.groupBy(set_col, "_id").agg(F.first("payload").alias("payload"), F.count("*").alias("rows"), F.min("row").alias("f"))
    columns = [F.col(f"f.{c}").alias(f"f_{c}") for c in fields]
    if exclude is not None:
        out = materialize(out, "grid-firsts")
        several = out.where("rows > 1").select(F.col(set_col).alias("_first_set"), F.col("_id").alias("_first_id"), "f")
        other = ~F.coalesce(F.col(f"row.{exclude}") == F.col(f"f.{exclude}"), F.lit(False))
        second = there.join(several, F.col(set_col).eqNullSafe(F.col("_first_set")) & (F.col("_id") == F.col("_first_id"))).where(other)
        second = second.groupBy("_first_set", "_first_id").agg(F.min("row").alias("s"))
        out = out.join(second, F.col(set_col).eqNullSafe(F.col("_first_set")) & (F.col("_id") == F.col("_first_id")), "left")
        columns += [F.coalesce(f"s.{c}", f"f.{c}").alias(f"s_{c}") for c in fields] + [F.col("s").isNotNull().alias("two")]
    return materialize(out.select(set_col, "_id", "payload", "rows", *columns), "grid-payloads")


def _place(cands, others, key, payload, set_col, order_col, extra, block_rows, other_payload, cheap=False):
    """Both sides in blocks by hash, each row with the cells it takes part in."""
    spark = cands.sparkSession
    wanted = 8 * spark.sparkContext.defaultParallelism
    left_blocks = _blocks(*cands.agg(*_size_columns(cands, payload)).first(), wanted, block_rows, cheap)
    right_blocks = _blocks(*others.agg(*_size_columns(others, other_payload)).first(), wanted, block_rows, cheap)

    def block(column, count):
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = (cands.filter(F.col(payload).isNotNull()).select(key, F.col(payload).alias("payload"))
            .withColumn("lb", block(F.col(key), left_blocks)).withColumn("rb", every(right_blocks)))
    right = (others.filter(F.col(other_payload).isNotNull())
             .select(set_col, order_col, *extra, F.col(other_payload).alias("payload"))
             .withColumn("rb", block(F.struct(set_col, order_col), right_blocks))
             .withColumn("lb", every(left_blocks)))
    return left, right, _cell_partitions(spark, left_blocks * right_blocks)


def grid_pairs(cands: DataFrame, others: DataFrame, key: str, payload: str = "dom", distance: str = "ncd",
               set_col: str = "label", order_col: str = "idx", other_payload: str | None = None,
               block_rows: int | None = None) -> DataFrame:
    """Every candidate with every other row: (key, set, order, distance), made in the grid's cells."""
    k = kernel(distance)
    left, right, tasks = _place(cands, others, key, payload, set_col, order_col, [], block_rows, other_payload or payload)
    schema = T.StructType([T.StructField(key, cands.schema[key].dataType), T.StructField(set_col, others.schema[set_col].dataType),
                           T.StructField(order_col, others.schema[order_col].dataType), T.StructField("distance", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def cell(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        d = k.matrix([k.prepare(p) for p in lhs["payload"]], [k.prepare(p) for p in rhs["payload"]])
        i, j = (x.ravel() for x in np.indices(d.shape))
        return pd.DataFrame({key: lhs[key].to_numpy()[i], set_col: rhs[set_col].to_numpy()[j],
                             order_col: rhs[order_col].to_numpy()[j], "distance": d.ravel()})[names]

    left, right = left.repartition(tasks, "lb", "rb"), right.repartition(tasks, "lb", "rb")
    return left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInPandas(cell, schema)


def grid_pair_stats(cands: DataFrame, others: DataFrame, key: str, payload: str, distance: str, set_col: str,
                    order_col: str, skip_equal: bool = False) -> DataFrame:
    """(n, total, lo, hi) of the pairs of each cell; ``skip_equal`` leaves out distances of exactly 0."""
    k = kernel(distance)
    left, right, tasks = _place(cands, others, key, payload, set_col, order_col, [], None, payload)

    def cell(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        d = k.matrix([k.prepare(p) for p in lhs["payload"]], [k.prepare(p) for p in rhs["payload"]]).ravel()
        d = d[d != 0] if skip_equal else d
        rows = [(len(d), d.sum(), d.min(), d.max())] if len(d) else []
        return pd.DataFrame(rows, columns=["n", "total", "lo", "hi"])

    left, right = left.repartition(tasks, "lb", "rb"), right.repartition(tasks, "lb", "rb")
    return left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInPandas(cell, "n long, total double, lo double, hi double")


def _self_grid(samples: DataFrame, key: str, payload: str, distance: str, group: str | None,
               block_rows: int | None, emit: str, weight: str | None = None) -> DataFrame:
    """Every unordered pair once, in cells of two blocks of one group.

    A group gets as many blocks as its own size needs, so a group holding most of the data is
    spread over as many cells as it takes. Matrix rule: lower key first, a row with itself 0.
    ``weight`` names how many equal rows a row stands for, in the totals of ``emit="rows"``."""
    k = kernel(distance)
    if not k.symmetric and emit != "pairs" and weight is None:
        return _self_grid_of_payloads(samples, key, payload, distance, group, block_rows, emit)
    group_type = samples.schema[group].dataType if group else T.IntegerType()
    rows = samples.select(
        (F.col(group) if group else F.lit(0)).alias("g"), F.col(key).alias("key"),
        F.col(payload).alias("payload"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"),
    )
    spark = samples.sparkSession
    wanted = 16 * spark.sparkContext.defaultParallelism
    sizes = rows.groupBy("g").agg(*_size_columns(rows, "payload")).collect()  # one row per group
    cheap = k.symmetric and emit != "pairs"
    counts = [(r["g"], _blocks(r["rows"], r["bytes"], wanted, block_rows, cheap)) for r in sizes]
    blocks = spark.createDataFrame(counts, T.StructType([
        T.StructField("g", group_type), T.StructField("blocks", T.IntegerType())]))
    tasks = _cell_partitions(spark, sum(n * (n + 1) // 2 for _, n in counts))
    placed = (
        rows.join(blocks, "g")
        .withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo_b", F.least("b", "other")).withColumn("hi_b", F.greatest("b", "other"))
        .drop("other", "blocks").repartition(tasks, "g", "lo_b", "hi_b")
    )
    key_type = samples.schema[key].dataType
    head = [T.StructField("g", group_type), T.StructField("key", key_type)]
    if emit == "pairs":
        schema = T.StructType([
            T.StructField("g", group_type), T.StructField("i", key_type),
            T.StructField("j", key_type), T.StructField("distance", T.DoubleType())])
    else:
        schema = T.StructType(head + [
            T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()),
            T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        g, split = pdf["g"].iloc[0], pdf["lo_b"].iloc[0] != pdf["hi_b"].iloc[0]
        if cheap:
            return strips(pdf, g, split)
        pdf = pdf.sort_values("key", kind="stable")
        keys = pdf["key"].to_numpy(dtype=object)
        d = k.triangle(list(pdf["payload"]), pdf["b"].to_numpy() if split else None)
        there = ~np.isnan(d)
        if emit == "pairs":
            i, j = np.nonzero(there)
            return pd.DataFrame({"g": [g] * len(i), "i": keys[i], "j": keys[j], "distance": d[there]})
        if not there.any():
            return pd.DataFrame([], columns=names)
        if emit == "stats":
            return pd.DataFrame([(g, None, int(there.sum()), d[there].sum(), d[there].min(), d[there].max())],
                                columns=names)
        w = pdf["w"].to_numpy()
        full = np.where(there, d, 0.0)
        total, n = full @ w + w @ full, there @ w + w @ there
        return pd.DataFrame({"g": [g] * len(keys), "key": keys, "n": n, "total": total,
                             "lo": np.nan, "hi": np.nan})

    def strips(pdf: pd.DataFrame, g, split: bool) -> pd.DataFrame:
        """The same where the order of a pair does not matter: a few rows of one block at a time against the other."""
        here = (pdf["b"] == pdf["lo_b"]).to_numpy()
        lhs, rhs = (pdf[here], pdf[~here]) if split else (pdf, pdf)
        left, right = lhs["w"].to_numpy(), rhs["w"].to_numpy()
        rows, columns, pairs, lo, hi = np.zeros(len(lhs)), np.zeros(len(rhs)), 0, math.inf, -math.inf
        mine = [k.prepare(p) for p in lhs["payload"]]
        for start, d in k.strips(mine, [k.prepare(p) for p in rhs["payload"]] if split else mine):
            if not split:  # every pair twice, and each row with itself
                own = np.arange(len(d))
                d[own, start + own] = 0.0
            if emit == "rows":
                rows[start:start + len(d)] = d @ right
                columns += left[start:start + len(d)] @ d if split else 0.0
                continue
            pairs += d.size - (0 if split else len(d))
            rows[start] += d.sum()
            if not split:
                d[own, start + own] = np.inf
            lo = min(lo, d.min())
            if not split:
                d[own, start + own] = -np.inf
            hi = max(hi, d.max())
        if emit == "stats":
            half = 1 if split else 2
            return pd.DataFrame([(g, None, pairs // half, rows.sum() / half, lo, hi)] if pairs else [], columns=names)
        if split and (lhs.empty or rhs.empty) or len(pdf) < 2:
            return pd.DataFrame([], columns=names)
        frames = [(lhs, rows, right.sum())] + ([(rhs, columns, left.sum())] if split else [])
        return pd.concat([pd.DataFrame({"g": g, "key": side["key"].to_numpy(dtype=object), "n": n - (0 if split else side["w"].to_numpy()),
                                        "total": total, "lo": np.nan, "hi": np.nan}) for side, total, n in frames])

    out = placed.groupBy("g", "lo_b", "hi_b").applyInPandas(cell, schema)
    return out.withColumnRenamed("g", group) if group else out.drop("g")


#: Positions of one payload that travel as one row.
POSITIONS = 1 << 20


def _self_grid_of_payloads(samples: DataFrame, key: str, payload: str, distance: str, group: str | None,
                           block_rows: int | None, emit: str) -> DataFrame:
    """Rows or stats of ``_self_grid`` for a distance that depends on the order of a pair.

    Cells hold distinct payloads with the sorted positions (by key) of their rows, and measure two payloads once in each
    order that occurs; how often it does follows from the positions. Positions of a payload with very many rows travel
    in several rows. Rows equal in the key are taken in the order of their payloads."""
    k = kernel(distance)
    group_type = samples.schema[group].dataType if group else T.IntegerType()
    key_type = samples.schema[key].dataType
    rows = samples.select((F.col(group) if group else F.lit(0)).alias("g"), F.col(key).alias("key"),
                          payload_digest(samples, payload).alias("id"), F.col(payload).alias("payload"))
    whole = isinstance(key_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if whole:
        rows = rows.withColumn("pos", F.col("key").cast("long"))
    else:
        rows = materialize(ordered_index(rows.withColumn("pos", F.lit(0).cast("long")), ["key"], name="pos"), "grid-positions")
    spark = samples.sparkSession
    last = (1 << 63) - 1  # a row without a key comes last
    chunks = F.greatest(F.lit(1), F.ceil(F.count("*") / POSITIONS)).cast("int").alias("chunks")
    number = rows.groupBy("g", "id").agg(chunks).where("chunks > 1")
    same = rows["g"].eqNullSafe(F.col("_g")) & (rows["id"] == F.col("_id"))
    rows = rows.join(number.select(F.col("g").alias("_g"), F.col("id").alias("_id"), "chunks"), same, "left")
    held = materialize(rows.groupBy("g", "id", F.pmod(F.xxhash64("pos"), F.coalesce("chunks", F.lit(1))).alias("chunk")).agg(
        F.first("payload").alias("payload"), F.sort_array(F.collect_list(F.coalesce("pos", F.lit(last)))).alias("at")), "grid-payloads")
    sizes = held.groupBy("g").agg(*_size_columns(held, "payload")).collect()  # one row per group
    wanted = 16 * spark.sparkContext.defaultParallelism
    counts = [(r["g"], _blocks(r["rows"], r["bytes"], wanted, block_rows)) for r in sizes]
    blocks = spark.createDataFrame(counts, T.StructType([T.StructField("_g", group_type), T.StructField("blocks", T.IntegerType())]))
    tasks = _cell_partitions(spark, sum(n * (n + 1) // 2 for _, n in counts))
    placed = (held.join(F.broadcast(blocks), F.col("g") == F.col("_g"))
              .withColumn("b", F.pmod(F.xxhash64("id", "chunk"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("lo_b", F.least("b", "other")).withColumn("hi_b", F.greatest("b", "other"))
              .select("g", "id", "chunk", "payload", "at", "b", "lo_b", "hi_b").repartition(tasks, "g", "lo_b", "hi_b"))
    schema = T.StructType([T.StructField("g", group_type), T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("total", T.DoubleType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "chunk"], kind="stable")
        g, split = pdf["g"].iloc[0], pdf["lo_b"].iloc[0] != pdf["hi_b"].iloc[0]
        ids, at, b = pdf["id"].tolist(), [np.asarray(x, np.int64) for x in pdf["at"]], pdf["b"].tolist()
        ready, measured = [k.prepare(p) for p in pdf["payload"]], {}

        def far(i, j):
            if (ids[i], ids[j]) not in measured:
                measured[ids[i], ids[j]] = k.pair(ready[i], ready[j])
            return measured[ids[i], ids[j]]

        n, totals = [0] * len(ids), [np.zeros(len(x)) for x in at]
        count, total, lo, hi = 0, 0.0, math.inf, -math.inf
        for i in range(len(ids)):
            for j in range(i, len(ids)):
                if split and b[i] == b[j]:
                    continue
                if i == j:
                    first, second, behind = len(at[i]) * (len(at[i]) - 1) // 2, 0, None
                else:  # how many of j's rows are before each of i's
                    before = np.searchsorted(at[j], at[i], "left")
                    second = int(before.sum())
                    first = len(at[i]) * len(at[j]) - second
                if not first and not second:
                    continue
                there, back = far(i, j) if first else 0.0, far(j, i) if second else 0.0
                for number, d in ((first, there), (second, back)):
                    if number:
                        count, total, lo, hi = count + number, total + number * d, min(lo, d), max(hi, d)
                if emit == "stats":
                    continue
                if i == j:
                    totals[i] += (len(at[i]) - 1) * there
                    n[i] += len(at[i]) - 1
                    continue
                behind = np.searchsorted(at[i], at[j], "right")  # of i's rows before each of j's
                totals[i] += before * back + (len(at[j]) - before) * there
                totals[j] += behind * there + (len(at[i]) - behind) * back
                n[i] += len(at[j])
                n[j] += len(at[i])
        if emit == "stats":
            return pd.DataFrame([(g, None, count, total, lo, hi)] if count else [], columns=names)
        frames = [pd.DataFrame({"g": g, "pos": p, "n": m, "total": t, "lo": np.nan, "hi": np.nan}) for p, m, t in zip(at, n, totals) if m]
        return pd.concat(frames) if frames else pd.DataFrame([], columns=names)

    out = placed.groupBy("g", "lo_b", "hi_b").applyInPandas(cell, schema)
    if emit == "rows" and whole:
        out = out.withColumn("key", F.when(F.col("pos") != last, F.col("pos")).cast(key_type))
    elif emit == "rows":
        out = out.join(rows.select("pos", "key"), "pos")
    out = out.drop("pos")
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def pairwise_distances(samples: DataFrame, key: str = "idx", payload: str = "dom",
                       distance: str = "ncd", group: str | None = None,
                       block_rows: int | None = None) -> DataFrame:
    """The distance matrix as rows (i, j, distance) with i < j.

    The answer itself has n*(n-1)/2 rows, so this is for prototype-sized sets; the aggregates
    below never form those rows."""
    return _self_grid(samples, key, payload, distance, group, block_rows, "pairs")


def mean_distance(samples: DataFrame, key: str = "idx", payload: str = "dom",
                  distance: str = "ncd", block_rows: int | None = None) -> DataFrame:
    """Row mean of the distance matrix, its zero diagonal included."""
    partial = _self_grid(samples, key, payload, distance, None, block_rows, "rows")
    sums = partial.groupBy("key").agg(F.sum("total").alias("total"), F.sum("n").alias("others"))
    return sums.select(
        F.col("key").alias(key), (F.col("total") / (F.col("others") + 1)).alias("mean_distance"))


def group_distance_stats(samples: DataFrame, group: str, key: str = "idx", payload: str = "dom",
                         distance: str = "ncd", block_rows: int | None = None) -> DataFrame:
    """A9 within groups: count, min, max and mean over the pairs i < j of every group."""
    partial = _self_grid(samples, key, payload, distance, group, block_rows, "stats")
    return partial.groupBy(group).agg(
        F.sum("n").alias("pairs"), F.min("lo").alias("min_distance"),
        F.max("hi").alias("max_distance"), (F.sum("total") / F.sum("n")).alias("avg_distance"))
