"""Exact Jaccard join of documents on word shingles by a token-group matrix (operator 7).

A document's set holds the hashes of its distinct five-word shingles (ASCII letters in lower case); with
fewer words its whole word sequence is the one shingle; without words or text the set is empty and
links with nothing. Documents link when 100 * intersection >= 75 * union.

1. Equal sets are one class from here on; their number does not matter.
2. Of any two linked sets, the first 2d + 2 shingles in any common order, with d = n - ceil(3n/4), share more
   than the d of either. These leads are dealt by shingle, once, and each class gets back those that another
   class has too, with the number of classes. A class that gets no more than d is linked with nothing and
   goes; of the others, the rarest c - d of the c shingles met are the heads, of which linked sets share one.
   A sample of documents supplies shingles that come last in the order of the leads, which affects effort,
   not results.
3. Classes with the same least, or the same greatest, shingle hash are compared with a few leaders among them.
   This costs no more than the sets, finds most links of large clusters, and only those that are exact; what
   hangs together by them is one group of the matrix.
4. The heads are dealt by shingle; where classes of different groups meet, those of the group that is smaller
   there ask the other: (class, group) candidates. Within a group all are linked already.
5. A parity bitmap of each set, 32 times smaller than the set, bounds the overlap of two sets from above; classes
   that its least form rules out do not meet, and candidates of small groups that fail the bound with every
   member go.
6. Each remaining group's token union is held in one place, in chunks of bounded size with the members
   of each token. A query is opened against the members only if its overlap with the union
   reaches 3/4 of its own size, which bounds every member's similarity; members are then counted exactly.
7. Links become components by alternating star contractions.

Repeated rows, rows with equal or null doc_id and empty texts each keep their row. The component id is
the least doc_id of the component (null if none has one; an empty set's is its own)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesim.llm.hashing import ByteSums, mix
from pagesim.llm.text import SPACES, narrow, slices
from pagesim.llm.tokens import release_encoders
from pagesim.session import arrow_batches, materialize

WORDS, PERCENT = 5, 75
#: Leaders among classes with a common least or greatest shingle, and how many classes are compared with the same ones.
COMMON_GROUPS, COMMON_CLASSES = 4, 2048
#: Documents drawn for the common shingles, and how many of them must hold one.
SAMPLE_DOCUMENTS, SAMPLE_LEAST = 4096, 3
#: Most shingles that are moved to the end of the order, the commonest first.
MAX_MOVED = 2_000_000
#: Rows of a table that is small enough to be sent to all executors, checked by a count.
SMALL_ROWS = 1_000_000
#: Shingles in a chunk of a group and in a chunk of its queries.
CHUNK = 1 << 16
#: Bytes of text that are cut into shingles at once (hashing takes some 50 times that), and of an Arrow batch.
SLICE_BYTES, ARROW_BYTES = 1 << 18, 1 << 20
#: Bytes of heads that a task sorts at once; sorting takes about ten times that.
HEADS_AT_ONCE = 4 << 20
#: Size comparisons at once where classes meet, and most rows of a batch of small rows.
COMPARED_AT_ONCE, MET_ROWS = 1 << 18, 10_000
#: Shingles that a task sorts at once where they meet, about; sorting takes some 80 bytes for each.
MET_AT_ONCE = 1 << 21
#: Bytes of a bitmap that go with a class to where it meets others: the least that a bitmap has.
PRINT_BYTES = 64
#: Groups of so many members are bounded member by member before whole sets move.
SMALL_GROUP = 4
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [np.unique(run) for run in shingle_runs(texts)]


def shingle_runs(texts: list[str | None]) -> list[np.ndarray]:
    """The shingle hashes of each text in their order."""
    words = [(t or "").encode().translate(_FOLD).split() for t in texts]
    data = np.frombuffer(b" ".join([w for doc in words for w in doc]) + b" ", np.uint8)
    sums = ByteSums(data)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out, at = [], 0
    for doc in words:
        n = len(doc)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        size = min(n, WORDS)
        out.append(sums.hashes(starts[at:at + n - size + 1], ends[at + size - 1:at + n]))
        at += n
    return out


def set_key(own: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    parts = [len(own)] + [int(mix(own ^ np.uint64(c)).sum(dtype=np.uint64)) for c in (0x5BD1E995, 0x27D4EB2F)]
    return (parts[1] ^ (parts[0] << 1) & (2**64 - 1)).to_bytes(8, "big") + parts[2].to_bytes(8, "big")


def head_of(own: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """The leading shingles of which any linked set has one: those moved come last, else by hash."""
    return _ordered(own, moved)[:spare(len(own)) + 1]


def lead_of(own: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """The leading shingles, in the same order, of which any linked set has more than the ``spare`` of either."""
    return _ordered(own, moved)[:2 * spare(len(own)) + 2]


def spare(n):
    """How many of its n shingles a set may lack in one that it is linked with, at most."""
    return n - (PERCENT * n + 99) // 100


def _ordered(own: np.ndarray, moved: np.ndarray) -> np.ndarray:
    if len(moved):
        late = moved[np.minimum(np.searchsorted(moved, own), len(moved) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own


def parity_bitmap(own: np.ndarray) -> np.ndarray:
    """Bits 0 to b - 1 as bytes: bit k is the parity of the shingles whose hash is k modulo b, where b is
    the power of two from 2n on. Halves of a bitmap combine by xor into the bitmap of half the size."""
    bits = 1 << max(9, int(2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def may_link(a: np.ndarray, n: int, b: np.ndarray, m: int) -> bool:
    """Whether sets of n and m shingles with these bitmaps can reach the similarity: each differing
    bit stands for a shingle that only one of them has."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        half = len(a) // 2
        a = a[:half] ^ a[half:]
    differ = int(np.bitwise_count(a ^ b).sum())
    return (100 + PERCENT) * (n + m - differ) >= 2 * PERCENT * (n + m)


def _signed(x: np.uint64) -> int:
    return int(np.int64(np.uint64(x).view(np.int64)))


def document_sets(docs: DataFrame, moved: np.ndarray) -> DataFrame:
    """doc_id, th (text hash), n, key, first and last (least and greatest shingle), lead and bitmap of every document row."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("key", pa.binary()),
                        ("first", pa.int64()), ("last", pa.int64()), ("lead", pa.binary()), ("bitmap", pa.binary())])

    def shingle(batches):
        release_encoders()
        for batch in slices(batches, limit=SLICE_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist())
            cols = [batch.column("doc_id"), batch.column("th"), [len(s) for s in sets],
                    [set_key(s) if len(s) else None for s in sets], [_signed(s[0]) if len(s) else None for s in sets],
                    [_signed(s[-1]) if len(s) else None for s in sets], [lead_of(s, moved).tobytes() if len(s) else None for s in sets],
                    [parity_bitmap(s).tobytes() if len(s) else None for s in sets]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return (narrow(docs).withColumn("th", F.xxhash64("text"))
            .mapInArrow(shingle, "doc_id long, th long, n int, key binary, first long, last long, lead binary, bitmap binary"))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that several of a bounded sample of documents hold, sorted; at most ``MAX_MOVED``."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    sample = narrow(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"))

    def shingles(batches):
        for batch in slices(batches, limit=SLICE_BYTES):
            own = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["h"])

    rows = (sample.mapInArrow(shingles, "h long").groupBy("h").count().where(F.col("count") >= SAMPLE_LEAST)
            .orderBy(F.col("count").desc(), "h").limit(MAX_MOVED).select("h").collect())
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def _places(spark: SparkSession, parts: int) -> np.ndarray:
    """Numbers that Spark's hash deals to partition 0, 1, ...: one block of rows for each task."""
    rows = (spark.range(parts * 24).select(F.col("id").cast("int").alias("id"))
            .groupBy(F.expr(f"pmod(hash(id), {parts})").alias("part")).agg(F.min("id").alias("id")).collect())
    out = np.arange(parts, dtype=np.int32)
    for r in rows:
        out[r.part] = r.id
    return out


def _blocks(places: np.ndarray, part: np.ndarray, keys, sizes, firsts, owner: np.ndarray, *tokens: np.ndarray) -> pa.RecordBatch:
    """Tokens (more arrays may go beside them) and their owners' key, size and group, as one packed row for each part."""
    order = np.argsort(part.astype(np.min_scalar_type(len(places))), kind="stable")
    owner, tokens = owner[order], [t[order] for t in tokens]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(places)))])
    rows = []
    for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        a, b = cuts[p], cuts[p + 1]
        begin = np.flatnonzero(np.concatenate([[True], owner[a + 1:b] != owner[a:b - 1]]))
        own, count = owner[a:b][begin], np.diff(np.append(begin, b - a))
        rows.append((int(places[p]), keys[own].tobytes(), sizes[own].tobytes(), firsts[own].tobytes(),
                     count.astype("<u4").tobytes(), *(t[a:b].tobytes() for t in tokens)))
    names = ["place", "keys", "sizes", "firsts", "counts", "tokens", "held"][:5 + len(tokens)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))], names=names)


def _unpacked(batches, *kinds, key="V16") -> list[np.ndarray]:
    """The arrays of all packed rows of a partition, or none."""
    names = ("keys", "sizes", "firsts", "counts", "tokens", "held")
    cells = [[] for _ in range(5 + len(kinds))]
    for batch in batches:
        for out, name, kind in zip(cells, names, (key, np.int32, np.int64, "<u4", np.uint64, *kinds)):
            out.extend(np.frombuffer(cell.as_buffer(), kind) for cell in batch.column(name))
    return [np.concatenate(cells.pop(0)) for _ in range(len(cells))] if cells[0] else []


def _by_key(key: np.ndarray) -> np.ndarray:
    """The order of keys of 16 bytes."""
    return np.lexsort(key.view(">u8").astype(np.uint64).reshape(-1, 2).T[::-1])


def _deal(classes: DataFrame, places: np.ndarray) -> DataFrame:
    """The heads (key, n, first, head) dealt by shingle, as packed blocks: one for each task pair."""
    def deal(batches):
        waiting, held = [], 0
        for batch in slices(batches, "head", HEADS_AT_ONCE):
            heads = batch.column("head").to_pylist()
            keys = batch.column("key").to_pylist()
            waiting.append((np.frombuffer(b"".join(keys), f"V{len(keys[0])}"),
                            np.array(batch.column("n"), np.int32), np.array(batch.column("first"), np.int64),
                            np.array([len(h) // 8 for h in heads], np.int64), np.frombuffer(b"".join(heads), np.uint64)))
            held += waiting[-1][-1].nbytes
            if held > HEADS_AT_ONCE:
                yield blocks(waiting)
                waiting, held = [], 0
        if waiting:
            yield blocks(waiting)

    def blocks(waiting):
        keys, sizes, firsts, lengths, tokens = (np.concatenate(x) for x in zip(*waiting))
        part = (mix(tokens) % np.uint64(len(places))).astype(np.int64)
        return _blocks(places, part, keys, sizes, firsts, np.repeat(np.arange(len(keys), dtype=np.int32), lengths), tokens)

    return (classes.select("key", "n", "first", "head")
            .mapInArrow(deal, "place int, keys binary, sizes binary, firsts binary, counts binary, tokens binary")
            .repartition(len(places), "place"))


def able_classes(sets: DataFrame) -> DataFrame:
    """key and head of each class that may be linked: of the shingles of its lead that other leads hold too, the
    rarest. Two linked classes share one of their heads. Copies of a set count as one class."""
    spark = sets.sparkSession
    total = sets.agg(F.sum(F.octet_length("lead"))).first()[0] or 0
    places = _places(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * MET_AT_ONCE))))
    leads = sets.where("n > 0").select("key", "n", F.lit(0).cast("long").alias("first"), F.col("lead").alias("head"))

    def count(batches):
        if not (cells := _unpacked(batches)):
            return
        key, size, first, counts, token = cells
        order = _by_key(key)
        new = np.ones(len(key), bool)
        new[order[1:]] = key[order[1:]] != key[order[:-1]]
        token, owner = token[np.repeat(new, counts)], np.repeat(np.arange(len(key), dtype=np.int32), counts * new)
        distinct, at, held = np.unique(token, return_inverse=True, return_counts=True)
        held = np.minimum(held, 65535).astype("<u2")[at]
        met = held > 1
        token, owner, held = token[met], owner[met], held[met]
        part = (mix(key.view("<u8").reshape(-1, 2)[:, 0]) % np.uint64(len(places))).astype(np.int64)
        ends = np.searchsorted(owner, np.arange(len(key) + 1))
        begin = 0
        while begin < len(key):  # some classes at a time, so that no batch is large
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + HEADS_AT_ONCE // 8, side="right")) - 1)
            end = min(end, len(key))
            a, b = ends[begin], ends[end]
            if b > a:
                yield _blocks(places, part[owner[a:b]], key, size, first, owner[a:b], token[a:b], held[a:b])
            begin = end

    def gather(batches):
        if not (cells := _unpacked(batches, "<u2")):
            return
        key, size, _, counts, token, held = cells
        order = _by_key(key)
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        number = np.empty(len(key), np.int32)
        number[order] = np.cumsum(new) - 1
        key, size = key[order[new]], size[order[new]].astype(np.int64)
        owner = np.repeat(number, counts)
        order = np.lexsort((token, held, owner))
        token, ends = token[order], np.cumsum(np.bincount(owner, minlength=len(key)))
        length = np.diff(ends, prepend=0) - spare(size)
        able = np.flatnonzero(length > 0)
        for k in range(0, len(able), 1000):
            some = able[k:k + 1000]
            starts = np.concatenate([[0], ends])[some].tolist()
            heads = [token[a:a + n].tobytes() for a, n in zip(starts, length[some].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(key[some].tolist(), pa.binary()), pa.array(heads, pa.binary())], names=["key", "head"])

    return (_deal(leads, places).mapInArrow(count, "place int, keys binary, sizes binary, firsts binary, counts binary, tokens binary, held binary")
            .repartition(len(places), "place").mapInArrow(gather, "key binary, head binary"))


def candidates(classes: DataFrame) -> DataFrame:
    """(key, first): each class and the groups it must be compared with, where their heads meet. Groups are numbered
    by ``first``; of two that meet, the classes of the one that is smaller there ask the other. Bitmaps, folded to
    ``PRINT_BYTES``, go with the keys: two classes that they rule out do not meet."""
    spark = classes.sparkSession
    total = classes.agg(F.sum(F.octet_length("head"))).first()[0] or 0
    places = _places(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * MET_AT_ONCE))))

    def fold(batches):
        for batch in slices(batches, "head", HEADS_AT_ONCE):
            prints = [np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, PRINT_BYTES)).tobytes() for b in batch.column("bitmap").to_pylist()]
            keys = pa.array([k + p for k, p in zip(batch.column("key").to_pylist(), prints)], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, *(batch.column(c) for c in ("n", "first", "head"))], names=["key", "n", "first", "head"])

    def meet(batches):
        if not (cells := _unpacked(batches, key=f"V{16 + PRINT_BYTES}")):
            return
        key, size, first, count, token = cells
        cells = key.view(np.uint8).reshape(-1, 16 + PRINT_BYTES)
        key, prints = np.ascontiguousarray(cells[:, :16]).view("V16")[:, 0], np.ascontiguousarray(cells[:, 16:]).view(np.uint64)
        # classes are numbered by the size of their groups: of two, the one with the greater number asks
        order = _by_key(key)
        place, new = np.empty(len(key), np.int64), np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        place[order] = np.cumsum(new) - 1
        key, size, first, prints = key[order[new]], size[order[new]].astype(np.int64), first[order[new]], prints[order[new]]
        groups, group, members = np.unique(first, return_inverse=True, return_counts=True)
        order = np.lexsort((group, -members[group]))
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        owner = np.repeat(number[place], count)
        key, size, group, prints = key[order], size[order], group[order], prints[order]

        def fit(a, b):  # see may_link
            both = size[a] + size[b]
            differ = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1).astype(np.int64)
            return (100 + PERCENT) * (both - differ) >= 2 * PERCENT * both

        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(begin, len(token)))
        apart = np.minimum.reduceat(group[owner], begin) < np.maximum.reduceat(group[owner], begin)
        codes, held = [], 0
        for met in _candidates(begin[apart], length[apart], owner, size, group, fit):
            codes.append(met[0] * len(groups) + met[1])
            held += len(codes[-1])
            if held > 1 << 20:
                codes = [np.unique(np.concatenate(codes))]
                held = len(codes[0]) // 2
        codes = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
        for at in range(0, len(codes), MET_ROWS):
            asks, told = np.divmod(codes[at:at + MET_ROWS], len(groups))
            yield pa.RecordBatch.from_arrays([pa.array(key[asks].tolist(), pa.binary()), pa.array(groups[told], pa.int64())], names=["key", "first"])

    printed = classes.select("key", "n", "first", "head", "bitmap").mapInArrow(fold, "key binary, n int, first long, head binary")
    return _deal(printed, places).mapInArrow(meet, "key binary, first long").distinct()


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted, non-empty array."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _candidates(begin, length, owner, size, group, fit=None):
    """Yields (classes, groups): each class and each group that has a class of fitting size and lesser number
    in the same shingle, often repeated. A shingle's classes stand in ``owner`` from ``begin``, ascending.
    With ``fit``, which says of two arrays of classes which may be linked, only such and in groups not their own."""
    for n in np.unique(length).tolist():
        at = begin[length == n]
        if n <= 16:  # shingles met by equally many are compared at once, one pair of places after another
            for k in range(0, len(at), COMPARED_AT_ONCE // n):
                own = owner[at[k:k + COMPARED_AT_ONCE // n, None] + np.arange(n)].T
                sizes, groups = size[own], group[own]
                for i in range(1, n):
                    for j in range(i):
                        fits = (100 * sizes[j] >= PERCENT * sizes[i]) & (100 * sizes[i] >= PERCENT * sizes[j])
                        if fit:
                            fits &= groups[i] != groups[j]
                            fits[fits] = fit(own[i][fits], own[j][fits])
                        yield own[i][fits].astype(np.int64), groups[j][fits]
            continue
        step = max(1, COMPARED_AT_ONCE // n)
        for own in (owner[a:a + n] for a in at.tolist()):
            by = np.argsort(group[own], kind="stable")
            told, groups = size[own][by], group[own][by]
            starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            # classes of the first one's group, which come first, have no other group before them
            for k in range(int((group[own] == group[own[0]]).argmin()) if fit else 0, n, step):
                asks, place = size[own[k:k + step], None], np.arange(k, min(n, k + step))[:, None]
                fits = (100 * told >= PERCENT * asks) & (100 * asks >= PERCENT * told) & (by < place)
                if fit:
                    fits &= group[own[k:k + step], None] != groups
                    rows, columns = np.nonzero(fits)
                    fits[rows, columns] = fit(own[k + rows], own[by[columns]])
                rows, columns = np.nonzero(np.logical_or.reduceat(fits, starts, axis=1))
                yield own[k + rows].astype(np.int64), groups[starts][columns]


def _near(docs: DataFrame, wanted: DataFrame, keep: str | None = None) -> DataFrame:
    """The rows of ``docs`` at the places (doc_id, th) of ``wanted``, with its column ``keep`` if named.

    ``wanted`` is sent to all executors if a count finds it small, else both sides are dealt."""
    few = wanted.count() <= SMALL_ROWS
    there = wanted.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), *([keep] if keep else [])).alias("_there")
    at = docs["doc_id"].cast("long").eqNullSafe(F.col("_there._id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_there._th"))
    return docs.join(F.broadcast(there) if few else there, at, "inner" if keep else "left_semi")


def _bounded(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` without those whose bitmaps rule out every member of a small group."""
    slim = sets.select("key", "n", "first", "bitmap")
    members = materialize(slim.join(pairs.select("first").distinct(), "first", "left_semi"), "bitmap-members")
    number = members.groupBy("first").count()
    sized = materialize(pairs.join(number, "first"), "bitmap-pairs")
    asks = (sized.where(F.col("count") <= SMALL_GROUP).select("key", "first")
            .join(slim.select("key", F.col("n").alias("m"), F.col("bitmap").alias("mine")), "key"))
    told = members.join(number.where(F.col("count") <= SMALL_GROUP), "first").select("first", "n", "bitmap")
    both = asks.join(told, "first").where((100 * F.col("n") >= PERCENT * F.col("m")) & (100 * F.col("m") >= PERCENT * F.col("n")))

    def bound(batches):
        for batch in slices(batches, "mine", SLICE_BYTES):
            fits = [may_link(np.frombuffer(a, np.uint8), n, np.frombuffer(b, np.uint8), m) for a, n, b, m in zip(
                *(batch.column(c).to_pylist() for c in ("mine", "m", "bitmap", "n")))]
            kept = batch.filter(pa.array(fits, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("key"), kept.column("first")], names=["key", "first"])

    left = both.select("key", "first", "mine", "m", "bitmap", "n").mapInArrow(bound, "key binary, first long").distinct()
    return left.unionAll(sized.where(F.col("count") > SMALL_GROUP).select("key", "first"))


def _placed(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The whole sets (own) of ``rows`` (first, part, round, side, key, at), side by side: a class is told where it is
    wanted, and its set is made from its text again and goes there."""
    told = materialize(rows.groupBy("key").agg(
        F.first("at").alias("at"), F.collect_list(F.struct("first", "part", "round", "side")).alias("to")), "group-places")
    there = told.select("at.doc_id", "at.th", "to")
    schema = pa.schema([("first", pa.int64()), ("part", pa.int32()), ("round", pa.int32()), ("side", pa.int32()),
                        ("key", pa.binary()), ("own", pa.binary())])

    def shingle(batches):
        release_encoders()
        for batch in slices(batches, limit=SLICE_BYTES):
            rows, held = [], 0
            for own, to in zip(shingle_sets(batch.column("text").to_pylist()), batch.column("to")):
                key, blob = set_key(own), own.tobytes()
                for t in to.as_py():
                    rows.append((t["first"], t["part"], t["round"], t["side"], key, blob))
                    held += len(blob)
                    if held > ARROW_BYTES or len(rows) == MET_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (_near(docs, there, keep="to").select("text", "to")
            .mapInArrow(shingle, "first long, part int, round int, side int, key binary, own binary")
            .repartition(parts, "first", "part", "round").sortWithinPartitions("first", "part", "round", "side"))


def leaders(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): keys of linked classes, found by comparing the classes of each least and each greatest shingle with
    leaders: the class of the least key, and the next few of the same part that are linked with none before."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("round"), F.col(c).alias("value")) for k, c in enumerate(("least", "greatest")))))
    rows = classes.select("key", "at", kinds.alias("kind")).select("key", "at", F.col("kind.round").alias("round"), F.col("kind.value").alias("first"))
    groups = (rows.groupBy("first", "round").agg(F.min("key").alias("leader"), F.count("*").alias("number")).where("number > 1")
              .withColumn("parts", F.ceil(F.col("number") / COMMON_CLASSES).cast("int")))
    rows = materialize(rows.join(groups, ["first", "round"]), "leader-groups")
    leads = rows.where("key = leader").select("first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "round", F.lit(0).alias("side"), "key", "at")
    others = rows.where("key <> leader").select("first", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "round", F.lit(1).alias("side"), "key", "at")
    edges = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(batches):
        name, held = None, []
        for batch in slices(batches, "own", ARROW_BYTES):
            out = []
            for first, part, round_, _, key, own in zip(*(c.to_pylist() for c in batch.columns)):
                if name != (first, part, round_):
                    name, held = (first, part, round_), []
                own = np.frombuffer(own, np.uint64)
                for leader, other in held:
                    if 100 * min(len(own), len(other)) >= PERCENT * max(len(own), len(other)):
                        common = int(_among(own, other).sum())
                        if 100 * common >= PERCENT * (len(own) + len(other) - common):
                            out.append((max(key, leader), min(key, leader)))
                            break
                else:
                    if len(held) < COMMON_GROUPS:
                        held.append((key, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], schema=edges)

    return _placed(docs, leads.unionAll(others)).mapInArrow(compare, "a binary, b binary")


def links(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): keys of linked classes, enough of them to connect all candidates that are linked."""
    slim = sets.select("key", "n", "first", "at")
    members = materialize(slim.join(pairs.select("first").distinct(), "first", "left_semi"), "group-members")
    asked = materialize(pairs.join(slim.select("key", "n", "at"), "key"), "group-queries")
    size = lambda t: F.ceil(F.sum("n") / CHUNK).cast("int")
    chunks = members.groupBy("first").agg(size("n").alias("parts")).join(asked.groupBy("first").agg(size("n").alias("rounds")), "first")
    chunk = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(chunks, "first").select(
        "first", chunk("key", "parts").alias("part"), every("rounds").alias("round"), F.lit(0).alias("side"), "key", "at")
    right = asked.join(chunks, "first").select(
        "first", every("parts").alias("part"), chunk("key", "rounds").alias("round"), F.lit(1).alias("side"), "key", "at")
    edges = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(batches):
        state = _Group()
        for batch in slices(batches, "own", ARROW_BYTES):
            for first, part, round_, side, key, own in zip(*(c.to_pylist() for c in batch.columns)):
                if state.name != (first, part, round_):
                    if out := state.edges():
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], schema=edges)
                    state = _Group((first, part, round_))
                state.take(side, key, np.frombuffer(own, np.uint64))
        if out := state.edges():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], schema=edges)

    return _placed(docs, left.unionAll(right)).mapInArrow(compare, "a binary, b binary")


class _Group:
    """One chunk of a group: its token union with the members of each token, and what links with it."""

    def __init__(self, name=None):
        self.name, self.keys, self.sets, self.union, self.parent = name, [], [], None, {}

    def _root(self, key: bytes) -> bytes:
        while self.parent.setdefault(key, key) != key:
            self.parent[key] = self.parent[self.parent[key]]
            key = self.parent[key]
        return key

    def take(self, side: int, key: bytes, own: np.ndarray) -> None:
        if side == 0:
            self.keys.append(key)
            self.sets.append(own)
            return
        if self.union is None:
            self._build()
        at = np.searchsorted(self.union, own)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == own]
        if 100 * len(at) < PERCENT * len(own):  # the bound: no member can be similar enough
            return
        start, count = self.start[at], self.start[at + 1] - self.start[at]
        shift = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        common = np.bincount(self.member[np.arange(int(count.sum())) + shift], minlength=len(self.keys))
        for k in np.flatnonzero(100 * common >= PERCENT * (len(own) + self.size - common)).tolist():
            if self.keys[k] != key:
                a, b = self._root(key), self._root(self.keys[k])
                if a != b:
                    self.parent[max(a, b)] = min(a, b)

    def _build(self) -> None:
        tokens = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        self.size = np.array([len(s) for s in self.sets], np.int64)
        member = np.repeat(np.arange(len(self.sets)), self.size)
        order = np.argsort(tokens, kind="stable")
        self.union, start = np.unique(tokens[order], return_index=True)
        self.start, self.member, self.sets = np.append(start, len(tokens)), member[order], []
        if not len(self.union):
            self.union, self.start, self.member = np.zeros(1, np.uint64), np.zeros(2, np.int64), np.zeros(0, np.int64)

    def edges(self) -> list[tuple[bytes, bytes]]:
        return [(k, r) for k in list(self.parent) if (r := self._root(k)) != k]


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not the least of its component, with the least one.

    Large-star and small-star contractions by minimum and join: no node's neighbours are gathered."""
    pairs = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .unionAll(least.select("a", F.col("m").alias("b"))))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = materialize(small, "small-star")
        twice = pairs.groupBy("a").count().where("count > 1").take(1)
        if not twice and not pairs.join(pairs.select(F.col("a").alias("b")), "b", "left_semi").take(1):
            return pairs


def join_similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document row, with ``th``, the hash of its text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_batches(docs.sparkSession, ARROW_BYTES):
        moved = common_shingles(docs)
        sets = materialize(document_sets(docs, moved), "document-sets")
        able = materialize(able_classes(sets), "able-classes")
        known = sets.where("n > 0").join(able, "key").groupBy("key").agg(
            *(F.first(c).alias(c) for c in ("n", "head", "bitmap")), F.first("first").alias("least"), F.first("last").alias("greatest"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("at"))
        known = materialize(known, "able-known")
        found = components(leaders(docs, known))
        roots = found.select(F.col("a").alias("key"), F.col("b").alias("root"))
        classes = materialize(known.join(roots, "key", "left").select(
            "key", "n", "head", "bitmap", "at", F.xxhash64(F.coalesce("root", "key")).alias("first")), "grouped-classes")
        pairs = materialize(candidates(classes), "group-candidates")
        pairs = materialize(_bounded(classes, pairs), "group-bounded")
        found = components(found.unionAll(links(docs, classes, pairs)))
    named = sets.select("doc_id", "th", "n", "key").join(found.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left")
    named = named.withColumn("part", F.coalesce("root", "key"))
    least = named.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("least"))
    return named.join(least, "part", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "th", "part")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id (then text hash); rows without
    a word all stay. Rows that agree in doc_id and text are one document and leave one row."""
    wordless = F.btrim(F.coalesce(docs["text"], F.lit("")), F.lit(SPACES)) == ""
    spoken = docs.where(~wordless)
    named = materialize(join_similar(docs).where("part is not null"), "component-names")
    first = named.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("at"))
    rows = named.groupBy("part", "doc_id", "th").count()
    kept = materialize(rows.join(first, "part").where(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th") == F.col("at"))
                       .select("doc_id", "th", "count"), "component-first")
    once = _near(spoken, kept.where("count = 1"))
    again = kept.where("count > 1")
    if again.take(1):
        once = once.unionAll(_near(spoken, again).dropDuplicates(["doc_id", "text"]))
    return once.unionAll(docs.where(wordless))
