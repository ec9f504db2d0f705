"""Distance kernels.

``ncd`` is the product's distance; ``tag_jaccard`` and ``l2`` are the same plans with a
distance SQL can check. A kernel prepares each payload once and then measures pairs, so a set
of n candidates against m prototypes costs n + m + n*m compressions."""

from __future__ import annotations

import lzma
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# XZ container at preset 6, whose own dictionary is 8 MiB.
PRESET = 6
PRESET_DICTIONARY = 8 << 20
SMALLEST_DICTIONARY = 4096


def compressed_size(data: bytes) -> int:
    """Bytes of ``data`` under XZ preset 6.

    The dictionary is cut to the input: nothing further back can be referenced, so the size is
    the same, and a short input no longer pays for setting up 8 MiB."""
    dictionary = max(SMALLEST_DICTIONARY, 1 << max(len(data) - 1, 0).bit_length())
    chain = [{"id": lzma.FILTER_LZMA2, "preset": PRESET,
              "dict_size": min(dictionary, PRESET_DICTIONARY)}]
    return len(lzma.compress(data, format=lzma.FORMAT_XZ, filters=chain))


def _ncd_pair(first, second):
    joined = compressed_size(first[0] + second[0])
    low, high = sorted((first[1], second[1]))
    return (joined - low) / high


def _jaccard_prepare(data):
    return frozenset(bytes(data).decode("utf-8", "replace").split(" "))


def _jaccard_pair(first, second):
    shared = len(first & second)
    return 1.0 - shared / (len(first) + len(second) - shared)


def _l2_prepare(vector):
    return np.asarray(vector, dtype=np.float64)


def _l2_pair(first, second):
    gap = first - second
    return float(np.sqrt(np.dot(gap, gap)))


def _jaccard_ready(lhs, rhs):
    """Distances of a range of ``lhs`` from all of ``rhs``: shared tags are products of 0/1 matrices, a few thousand
    tags at a time; sums of ones are exact."""
    tags = {t: i for i, t in enumerate(set().union(*rhs))}
    places = [[np.array([tags[t] for t in s if t in tags], dtype=np.int64) for s in side] for side in (lhs, rhs)]
    sizes = [np.array([len(s) for s in side], dtype=np.float64) for side in (lhs, rhs)]

    def bits(side, start):
        out = np.zeros((len(side), min(_TAGS_AT_ONCE, len(tags) - start)), np.float32)
        for row, at in enumerate(side):
            out[row, at[(at >= start) & (at < start + out.shape[1])] - start] = 1
        return out

    whole = bits(places[1], 0) if len(tags) <= _TAGS_AT_ONCE else None

    def measure(first, last):
        shared = np.zeros((len(places[0][first:last]), len(rhs)))
        for start in range(0, len(tags), _TAGS_AT_ONCE):
            shared += bits(places[0][first:last], start) @ (bits(places[1], start) if whole is None else whole).T
        return 1.0 - shared / (sizes[0][first:last, None] + sizes[1][None, :] - shared)

    return measure


def _l2_ready(lhs, rhs):
    """By products of centred points; pairs so close that the difference of squares loses digits are taken from
    their gaps, so that equal points are exactly 0 apart."""
    a, b = np.stack(lhs), np.stack(rhs)
    middle = b.mean(axis=0)
    near, far = a - middle, b - middle
    squares_a, squares_b = (near * near).sum(axis=1), (far * far).sum(axis=1)
    # the squares go through the product as two more columns, so that a strip is passed over once less for each
    left = np.column_stack([near * -2.0, squares_a, np.ones(len(a))])
    right = np.column_stack([far, np.ones(len(b)), squares_b]).T
    largest = squares_b.max()

    def measure(first, last):
        squares = left[first:last] @ right
        mine = squares_a[first:last]
        rows = np.flatnonzero(~(squares.min(axis=1) >= (mine + largest) * 1e-4))
        if len(rows):
            at, j = np.nonzero(squares[rows] < (mine[rows, None] + squares_b[None, :]) * 1e-4)
            i = rows[at]
            for start in range(0, len(i), _GAPS_AT_ONCE):
                some = slice(start, start + _GAPS_AT_ONCE)
                squares[i[some], j[some]] = l2_gaps(a[first:last][i[some]], b[j[some]]) ** 2
        return np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)

    return measure


def l2_gaps(lhs: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Distances of rows, each from the row beside it (or from one point)."""
    gap = lhs - rhs
    return np.sqrt((gap * gap).sum(axis=1))


class L2Closest:
    """Finds the closest of many points: products in single precision rule out what cannot be closest for more than
    their rounding, and what is left is measured by its gap. Points that hold values of very different sizes take
    double precision."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self._middle = points.mean(axis=0)
        far = points - self._middle
        self._squares = (far * far).sum(axis=1)
        largest = math.sqrt(self._squares.max())
        self._scale = largest if 0.0 < largest < math.inf else 1.0
        self._ready = {}

    def _side(self, kind):
        """The points' side of the product, once for each precision."""
        if kind not in self._ready:
            far = (self.points - self._middle) / self._scale
            self._ready[kind] = np.column_stack([far, self._squares / self._scale ** 2]).astype(kind)
        return self._ready[kind]

    def near(self, asks: np.ndarray, reach: np.ndarray, first: int, last: int, left_out: tuple):
        """(ask, point, distance) of the points ``first`` to ``last`` that are closest to an ask or that its rounding
        cannot tell from these, unless they lie beyond its reach. ``left_out`` holds pairs (asks, points) not to be found."""
        near = (asks - self._middle) / self._scale
        squares = (near * near).sum(axis=1)
        kind = np.float64 if not squares.max() < 1e24 else np.float32
        there = self._side(kind)[first:last]
        products = np.column_stack([near * -2.0, np.ones(len(near))]).astype(kind) @ there.T
        products[left_out] = np.inf
        best = products.min(axis=1).astype(np.float64)
        # twice what rounding the values, the products and their sums may amount to, and what the distance itself loses
        rounding = (2 * near.shape[1] + 32) * float(np.finfo(kind).eps) * (2.0 * np.sqrt(squares) + 1.0) + 4e-9 * squares
        limit = np.minimum(best, (reach / self._scale) ** 2 - squares) + rounding
        rows = np.flatnonzero((best <= limit) & (best < np.inf))
        at, j = np.nonzero(products[rows] <= np.nextafter(limit[rows].astype(kind), kind(np.inf))[:, None])
        i = rows[at]
        there = np.isfinite(products[i, j])
        i, j = i[there], j[there] + first
        d = np.empty(len(i))
        for start in range(0, len(i), _GAPS_AT_ONCE):
            some = slice(start, start + _GAPS_AT_ONCE)
            d[some] = l2_gaps(asks[i[some]], self.points[j[some]])
        return i, j, d


_TAGS_AT_ONCE, _GAPS_AT_ONCE = 4096, 1 << 15
#: Distances that are held at once.
_AT_ONCE = 1 << 19
_MATRICES = {"tag_jaccard": _jaccard_ready, "l2": _l2_ready}


class Kernel:
    """One distance: ``pair(first, second)`` over prepared payloads, in that order."""

    def __init__(self, name, measure, prepare, pair):
        self.name, self.measure, self._prepare, self.pair = name, measure, prepare, pair
        #: Whether the order of a pair does not matter, and a block of pairs costs one matrix product.
        self.symmetric = name in _MATRICES

    def matrix(self, lhs: list, rhs: list) -> np.ndarray:
        """Distances of prepared payloads, every one of ``lhs`` before every one of ``rhs``."""
        if self.symmetric:
            return _MATRICES[self.name](lhs, rhs)(0, len(lhs)) if len(lhs) and len(rhs) else np.zeros((len(lhs), len(rhs)))
        return np.array([[self.pair(a, b) for b in rhs] for a in lhs], dtype=np.float64).reshape(len(lhs), len(rhs))

    def strips(self, lhs: list, rhs: list):
        """(first row, matrix) of consecutive rows of ``lhs``, few enough that a matrix stays small."""
        if not len(lhs) or not len(rhs):
            return
        step = max(1, _AT_ONCE // len(rhs))
        measure = _MATRICES[self.name](lhs, rhs) if self.symmetric else lambda a, b: self.matrix(lhs[a:b], rhs)
        for at in range(0, len(lhs), step):
            yield at, measure(at, at + step)

    def prepare(self, payload, size=None):
        """What ``pair`` takes; ``size`` is the payload's ``measure`` if it is already known."""
        if self.measure is None:
            return self._prepare(payload)
        data = self._prepare(payload)
        return data, self.measure(data) if size is None else int(size)

    def triangle(self, payloads, apart=None) -> np.ndarray:
        """Distances i < j of one block as a matrix, NaN elsewhere.

        With ``apart`` only pairs whose entries there differ are measured. Repeated payloads
        are measured once."""
        n = len(payloads)
        out = np.full((n, n), np.nan)
        apart = None if apart is None else np.asarray(apart)
        ids = {}
        which = [ids.setdefault(memo_key(p), len(ids)) for p in payloads]
        first = {key: payload for key, payload in zip(map(memo_key, payloads), payloads)}
        distinct = [self.prepare(first[key]) for key in ids]
        if self.symmetric:
            out = self.matrix(distinct, distinct)[np.ix_(which, which)]
            out[np.tril_indices(n)] = np.nan
            if apart is not None:
                out[apart[:, None] == apart[None, :]] = np.nan
            return out
        seen = {}
        for i in range(n):
            for j in range(i + 1, n):
                if apart is not None and apart[i] == apart[j]:
                    continue
                pair = which[i], which[j]
                if pair not in seen:
                    seen[pair] = self.pair(distinct[pair[0]], distinct[pair[1]])
                out[i, j] = seen[pair]
        return out


_KERNELS = {
    "ncd": Kernel("ncd", compressed_size, bytes, _ncd_pair),
    "tag_jaccard": Kernel("tag_jaccard", None, _jaccard_prepare, _jaccard_pair),
    "l2": Kernel("l2", None, _l2_prepare, _l2_pair),
}


def kernel(distance: str) -> Kernel:
    """The kernel called ``distance``."""
    if distance not in _KERNELS:
        raise ValueError(f"unknown distance {distance!r}; use one of {sorted(_KERNELS)}")
    return _KERNELS[distance]


def payload_size(payload: Column, distance: str) -> Column:
    """The part of preparing that is worth keeping as a column: C(x) for ncd."""
    return csize(payload) if distance == "ncd" else F.lit(None).cast("bigint")


def memo_key(payload):
    """A hashable stand-in for a payload, to measure repeated payloads of a batch once."""
    return payload.tobytes() if isinstance(payload, np.ndarray) else bytes(payload)


@F.pandas_udf(T.LongType())
def csize(data: pd.Series) -> pd.Series:
    """Compressed size; NULL stays NULL. Repeated data of a batch is compressed once."""
    sizes = {x: compressed_size(x) for x in {bytes(x) for x in data if x is not None}}
    return data.map(lambda x: None if x is None else sizes[bytes(x)]).astype("Int64")


def ncd_from_sizes(cx: Column, cy: Column, cxy: Column) -> Column:
    """Normalized compression distance from the three sizes."""
    return (cxy - F.least(cx, cy)) / F.greatest(cx, cy)


def ncd(x: Column, y: Column) -> Column:
    """N2 over two binary columns, ``x`` before ``y``."""
    return ncd_from_sizes(csize(x), csize(y), csize(F.concat(x, y)))


def tag_jaccard(x: Column, y: Column) -> Column:
    """Jaccard distance of two tag arrays, JVM only."""
    shared = F.size(F.array_intersect(x, y))
    return 1.0 - shared / F.size(F.array_union(x, y))


def register_kernels(spark: SparkSession) -> None:
    """``csize(x)`` and ``ncd(x, y)`` for SQL."""
    spark.udf.register("csize", csize)
    measured = kernel("ncd")

    @F.pandas_udf(T.DoubleType())
    def ncd_udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([
            None if a is None or b is None else measured.pair(measured.prepare(a), measured.prepare(b))
            for a, b in zip(x, y)
        ], dtype="float64")

    spark.udf.register("ncd", ncd_udf)
