import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesim.functions import kernel as N

from . import brute


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_size_equals_plain_compression(data):
    assert N.compressed_size(data) == brute.csize(data)


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 70_000, 1_000_000])
def test_size_on_random_and_repetitive(size):
    rng = random.Random(size)
    for data in (rng.randbytes(size), b"div span p " * (size // 11), bytes(rng.choices(b"ab", k=size))):
        assert N.compressed_size(data) == brute.csize(data)


def test_ncd_columns_and_sql(spark):
    items = brute.tag_texts(6)
    df = spark.createDataFrame([(a, b) for a in items for b in items], "x binary, y binary")
    N.register_kernels(spark)
    df.createOrReplaceTempView("pairs")
    rows = spark.sql("SELECT x, y, csize(x) AS cx, ncd(x, y) AS d FROM pairs").collect()
    assert all(r.cx == brute.csize(bytes(r.x)) and r.d == brute.ncd(bytes(r.x), bytes(r.y)) for r in rows)
    native = df.select("x", "y", N.ncd(F.col("x"), F.col("y")).alias("d")).collect()
    assert all(abs(r.d - brute.ncd(bytes(r.x), bytes(r.y))) < 1e-12 for r in native)


def test_null_and_empty(spark):
    row = spark.sql("SELECT cast(NULL AS binary) AS n, cast('' AS binary) AS e").select(
        N.csize(F.col("n")).alias("n"), N.csize(F.col("e")).alias("e")).first()
    assert row.n is None and row.e == 32


def test_other_kernels(spark):
    k = N.kernel("tag_jaccard")
    assert k.pair(k.prepare(b"a b b"), k.prepare(b"b c")) == 1 - 1 / 3
    v = N.kernel("l2")
    assert v.pair(v.prepare([0, 0]), v.prepare([3, 4])) == 5.0
    with pytest.raises(ValueError):
        N.kernel("cosine")
    df = spark.createDataFrame([(["a", "b"], ["b", "c"])], "x array<string>, y array<string>")
    assert df.select(N.tag_jaccard(F.col("x"), F.col("y"))).first()[0] == pytest.approx(2 / 3)
