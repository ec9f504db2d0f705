"""Harmonic packing of documents into token sequences (operator 4).

A length belongs to class i when i of it, but not i + 1, fit into a sequence; each bin of class i takes
exactly i pieces. Documents may be cut: whole sequences are cut off first, and what remains is cut
to the next smaller class limit as long as it would fill less than ``FILL`` of its class share, so
every bin is nearly full by construction. Each worker fills the bins of its own rows, knows no other
worker, and at its end lays the pieces of its unfilled bins one behind the other, cut at the capacity;
the last part is cut into powers of two, which need no padding.

A null text is an empty one and gives the end id alone. Rows with equal or null doc_id are packed
like all others. Nothing is shuffled, and only counts and open bins stay in memory."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

import numpy as np

from pagesim.llm.text import narrow, slices
from pagesim.llm.tokens import crc_of_ids, encoder

CAPACITY, FILL, MAX_CLASS = 2048, 0.97, 256
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, class int")


def class_of(length: int, capacity: int) -> int:
    """How many pieces of this length one sequence takes, at most ``MAX_CLASS``."""
    return min(capacity // length, MAX_CLASS)


def cut_lengths(tokens: int, capacity: int, fill: float = FILL) -> list[int]:
    """Piece lengths of a document of so many tokens."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        i = class_of(rest, capacity)
        if i == MAX_CLASS or rest * i >= fill * capacity:
            out.append(rest)
            break
        piece = capacity // (i + 1)  # the largest length of the next class
        out.append(piece)
        rest -= piece
    return out


class _Packer:
    def __init__(self, part: int, capacity: int):
        self.capacity, self.next, self.open = capacity, part << 32, {}

    def _emit(self, pieces: list, kind: int) -> list:
        at, rows = 0, []
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), crc_of_ids(ids), total, self.next, at, kind))
            at += len(ids)
        self.next += 1
        return rows

    def add(self, doc, ids: np.ndarray) -> list:
        rows, start = [], 0
        for n in cut_lengths(len(ids), self.capacity):
            i = class_of(n, self.capacity)
            waiting = self.open.setdefault(i, [])
            waiting.append((doc, start, ids[start:start + n], len(ids)))
            start += n
            if len(waiting) == i:
                rows += self._emit(self.open.pop(i), i)
        return rows

    def finish(self) -> list:
        """The unfilled bins, as one run of ids cut at the capacity and then at powers of two."""
        left = [piece for i in sorted(self.open) for piece in self.open[i]]
        todo = sum(len(p[2]) for p in left)
        rows = []
        left.reverse()
        while todo:
            room = self.capacity if todo >= self.capacity else 1 << (todo.bit_length() - 1)
            todo -= room
            taken = []
            while room:
                doc, start, ids, total = left.pop()
                if len(ids) > room:
                    left.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                taken.append((doc, start, ids, total))
                room -= len(ids)
            rows += self._emit(taken, 0)
        return rows


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the sequence and offset they lie at; ``class`` 0 marks a worker's rest."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class"]
    types = [pa.int64()] * 7 + [pa.int32()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    def pack(batches):
        encode, packer = encoder(tokenizer), _Packer(TaskContext.get().partitionId(), capacity)
        for batch in slices(batches):
            rows = []
            ids = encode.encode(batch.column("text").to_pylist(), end_id)
            for doc, own in zip(batch.column("doc_id").to_pylist(), ids):
                rows += packer.add(doc, own)
            if rows:
                yield batch_of(rows)
        if rows := packer.finish():
            yield batch_of(rows)

    return narrow(docs).mapInArrow(pack, SCHEMA)
