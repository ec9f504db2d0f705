"""What a worker holds at once: hashing, shingles met by many classes, Arrow batches."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pagesim.llm import ngram_join
from pagesim.llm.hashing import ByteSums
from pagesim.session import arrow_batches


def peak_of(function):
    tracemalloc.start()
    try:
        out = function()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_hashing_holds_little_more_than_its_sums():
    data = np.random.default_rng(1).integers(0, 256, 1 << 21).astype(np.uint8)
    sums, peak = peak_of(lambda: ByteSums(data))
    assert peak < 10 * len(data)  # the sums take 8
    word = data[:9].copy()
    for at in (5, (1 << 16) - 4, 1 << 16, (1 << 20) + 3):  # within a block, across two, at a start
        data[at:at + 9] = word
    at = np.array([5, (1 << 16) - 4, 1 << 16, (1 << 20) + 3, 70])
    found = ByteSums(data).hashes(at[[0, 3]], at[[0, 3]] + 9)
    assert found[0] == found[1] == ByteSums(word).hashes(np.array([0]), np.array([9]))[0]
    assert found[0] != ByteSums(data).hashes(at[4:], at[4:] + 9)[0]


def plain_candidates(shingles, size, group):
    return {(c, group[d]) for own in shingles for c in own for d in own
            if d < c and 100 * size[d] >= 75 * size[c] and 100 * size[c] >= 75 * size[d]}


def test_candidates_of_few_and_of_many_classes():
    draw = np.random.default_rng(2)
    size, group = draw.integers(50, 90, 300), draw.integers(0, 40, 300)
    shingles = [np.sort(draw.choice(300, n, replace=False)).astype(np.int32) for n in (2, 2, 3, 10, 10, 16, 17, 120)]
    length = np.array([len(s) for s in shingles])
    begin = np.cumsum(length) - length
    got = {pair for met in ngram_join._candidates(begin, length, np.concatenate(shingles), size, group)
           for pair in zip(*(x.tolist() for x in met))}
    assert got == plain_candidates([s.tolist() for s in shingles], size.tolist(), group.tolist())


def test_a_shingle_of_many_classes_is_compared_in_bounded_memory():
    n = 6000
    size, group = np.full(n, 100), np.arange(n) % 7

    def last():
        for met in ngram_join._candidates(np.array([0]), np.array([n]), np.arange(n, dtype=np.int32), size, group):
            pass
        return met

    met, peak = peak_of(last)
    assert met[0][-1] == n - 1 and peak < 24 << 20


def test_batches_to_workers_are_bounded_in_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with arrow_batches(spark, 1 << 18):
        sizes = [r.n for r in spark.range(3000, numPartitions=1).selectExpr("repeat('x', 4096) as text").mapInArrow(size, "n long").collect()]
    assert sum(sizes) > 3000 * 4096 and max(sizes) < 1 << 19
    with pytest.raises(ValueError), arrow_batches(spark, 1 << 18):
        raise ValueError
    assert spark.conf.get(key) == before


def test_the_join_sends_its_workers_small_batches(documents, monkeypatch):
    seen, inner = [], ngram_join.document_sets

    def document_sets(docs, moved):
        seen.append(docs.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
        return inner(docs, moved)

    monkeypatch.setattr(ngram_join, "document_sets", document_sets)
    ngram_join.join_similar(documents([(1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert set(seen) == {str(ngram_join.ARROW_BYTES)} and ngram_join.SLICE_BYTES <= ngram_join.ARROW_BYTES <= 1 << 20
