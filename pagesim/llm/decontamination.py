"""Benchmark decontamination by pigeonhole edit matching (operator 9).

An item is found in a document when some part of the document is within the item's error budget in
edit distance, a share of its length. An item is split into budget-plus-one pieces; with at most
budget errors one piece is untouched, so every match has an exact piece hit. Piece hits of a block
of items are found by one Aho-Corasick pass over each text, and the text around each hit is verified by
Myers' bit-parallel distance with one big integer for a column.

Both sides are compared in a normal form: ASCII letters in lower case, each run of white space one space,
none at the ends. Reported places are places in that form. Items without text match nothing; items with
equal normal form are verified once and reported with the smallest id (``item_id``, nulls last) and
their number. Null and empty documents match nothing. The benchmark is handled in blocks of bounded
size, each a pass over the documents, so the automaton's memory does not grow with it."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesim.llm.text import narrow, slices
from pagesim.llm.tokens import release_encoders

#: Errors allowed, as a share of the item's length; the pieces are then about 1 / ERROR_SHARE long.
ERROR_SHARE = 0.08
#: Characters of items in one automaton.
BLOCK_CHARACTERS = 4_000_000
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, item_id long, copies long, distance int, place int, length int"


def normal(text: str | None) -> str:
    return b" ".join((text or "").encode().translate(_FOLD).split()).decode()


def budget(length: int, share: float = ERROR_SHARE) -> int:
    return min(int(length * share), length - 1)


def piece_bounds(length: int, errors: int) -> list[tuple[int, int]]:
    """``errors + 1`` pieces of nearly equal length."""
    n = errors + 1
    return [(length * k // n, length * (k + 1) // n) for k in range(n)]


def best_match(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Least distance of ``pattern`` to any part of ``text`` and the end of the first such part, if at
    most ``limit``: Myers' recurrence, a column of the distance matrix as two bit vectors."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = minus | (~(diagonal | plus) & full), plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (~(diagonal | up) & full), up & diagonal
        if score <= limit and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """The items of one block: their pieces in an automaton."""

    def __init__(self, items: list[tuple[int, int, str]], share: float):
        self.items, self.budgets = items, [budget(len(t), share) for *_, t in items]
        places: dict[str, list] = {}
        for k, (_, _, text) in enumerate(items):
            for a, b in piece_bounds(len(text), self.budgets[k]):
                places.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, copies, distance, place, length) of the best match of each item that is found.

        ``place`` is the earliest place that the item's start can have in the window of the match."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                start, slack = end + 1 - size - offset, self.budgets[k]
                low, high = max(0, start - slack), min(len(text), start + len(self.items[k][2]) + slack)
                known = windows.setdefault(k, [])
                near = next((w for w in reversed(known) if w[0] <= high and low <= w[1]), None) if known else None
                if near and high - near[0] <= 4 * (len(self.items[k][2]) + 2 * slack):
                    near[0], near[1] = min(near[0], low), max(near[1], high)
                else:
                    known.append([low, high])
        found = []
        for k, spans in sorted(windows.items()):
            item, copies, pattern = self.items[k]
            best = None
            for low, high in spans:
                exact = text.find(pattern, low, high)
                if exact >= 0:
                    best = (0, exact)
                    break
                hit = best_match(pattern, text[low:high], self.budgets[k])
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], max(low, low + hit[1] - len(pattern)))
            if best:
                found.append((item, copies, *best, len(pattern)))
        return found


def item_blocks(benchmark: DataFrame) -> list[list[tuple[int, int, str]]]:
    """The distinct items in blocks of bounded size. The set of items is the stated query set."""
    known: dict[str, list] = {}
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        if text := normal(r.text):
            known.setdefault(text, []).append(r.item_id)
    blocks, size = [], 0
    for text, ids in sorted(known.items(), key=lambda x: (min((i for i in x[1] if i is not None), default=1 << 62), x[0])):
        if not blocks or size + len(text) > BLOCK_CHARACTERS:
            blocks.append([])
            size = 0
        blocks[-1].append((min((i for i in ids if i is not None), default=None), len(ids), text))
        size += len(text)
    return blocks


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE) -> DataFrame:
    """One row for each document row and item found in it, with the best distance."""
    types = [pa.int64()] * 3 + [pa.int32()] * 3
    names = ["doc_id", "item_id", "copies", "distance", "place", "length"]

    def passes(block):
        def find(batches):
            matcher = Matcher(block, share)
            for batch in slices(batches):
                rows = [(doc, *m) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                        if text for m in matcher.matches(normal(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        return find

    out = None
    for block in item_blocks(benchmark):
        found = narrow(docs).mapInArrow(passes(block), SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE) -> DataFrame:
    """``docs`` without the rows in which an item is found, decided where the rows lie."""
    blocks = item_blocks(benchmark)
    schema = docs.schema

    def keep(batches):
        release_encoders()
        for batch in slices(batches):
            clean = [True] * batch.num_rows
            for block in blocks:
                matcher = _matcher(block, share)
                for k, text in enumerate(batch.column("text").to_pylist()):
                    if clean[k] and text and matcher.matches(normal(text)):
                        clean[k] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, schema) if blocks else docs


_matchers: dict[int, tuple[list, float, Matcher]] = {}


def _matcher(block: list, share: float) -> Matcher:
    """One matcher at a time in a worker's memory, kept while the same block is asked for."""
    known = _matchers.get(0)
    if known is None or known[0] is not block or known[1] != share:
        _matchers[0] = (block, share, Matcher(block, share))
    return _matchers[0][2]
