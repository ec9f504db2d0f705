"""Operators 5 and 6, against plain loops."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pagesim.llm import quality_rules as rules
from pagesim.llm import sharding
from pagesim.llm.queries import QUERIES
from tests.llm.conftest import AWKWARD, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_statistics_of_a_table(spark, sf):
    texts = texts_of(spark, sf)
    rows = QUERIES["op5_quality_rules"](spark, sf).collect()
    assert {r.doc_id: columns(r) for r in rows} == {d: plain_statistics(t) for d, t in texts.items()}
    assert all(not r.kept for r in rows if r.base_failed)


def test_statistics_of_awkward_rows(awkward, documents, labels):
    learned = rules.train_rules(awkward, labels())
    assert learned == []
    rows = rules.apply_rules(awkward, learned).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, columns(r)) for r in rows), key=key) == sorted(((d, plain_statistics(t)) for d, t, *_ in AWKWARD), key=key)
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert rules.apply_rules(documents([]), []).collect() == []


def test_rules_find_a_planted_conjunction_and_spark_agrees(spark):
    draw = np.random.default_rng(2)
    x = draw.random((3000, len(rules.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 4] > 0.5) | (x[:, 1] <= 0.1)
    learned = rules.learn_rules(x, bad)
    said = np.zeros(len(x), bool)
    for rule in learned:
        said |= rule.holds(x)
    assert (said == bad).mean() > 0.98 and 2 <= len(learned) <= 6
    df = spark.createDataFrame([[float(v) for v in row] for row in x[:200]], list(rules.FEATURES))
    values = {f: F.col(f) for f in rules.FEATURES}
    got = [any(r) for r in df.select(*(rule.column(values) for rule in learned)).collect()]
    assert got == said[:200].tolist()


def test_held_out_documents_are_judged_well(spark):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_quality_rules"](spark, sf).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good = [r.kept for r in rows if known.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if known.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.1


def plain_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def check_shards(docs, rows, shards=8):
    keyed = docs.select("text", sharding.group_key().alias("group")).collect()
    sizes = defaultdict(int)
    for r in keyed:
        sizes[r.group] += len((r.text or "").encode()) + 1
    want = plain_capacity([s for _, s in sorted(sizes.items())], shards)
    used, slots = Counter(), defaultdict(list)
    for r in rows:
        used[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(used.values()) == want == rows[0].capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in slots)


def test_shards_of_a_table(spark, sf):
    texts = texts_of(spark, sf)
    rows = QUERIES["op6_sharding"](spark, sf).collect()
    check_shards(spark.read.parquet(f"{sf}/documents.parquet"), rows)
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {
        d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_shards_with_a_hot_group_and_awkward_rows(awkward, documents):
    check_shards(awkward, sharding.shard_documents(awkward).collect())
    hot = documents([(k, "the same text") for k in range(300)] + [(k, f"text {k}") for k in range(300, 600)])
    check_shards(hot, sharding.shard_documents(hot).collect())
    one = documents([(1, "x")])
    assert sharding.shard_documents(one).collect()[0].shard == 0
    assert sharding.shard_documents(documents([])).collect() == []


def test_search_refines_coarse_intervals(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_INTERVALS", 3)
    monkeypatch.setattr(sharding, "SPLIT", 2)
    draw = np.random.default_rng(3)
    keys = sorted(int(k) for k in draw.integers(-(1 << 62), 1 << 62, 200))
    sizes = [int(s) for s in draw.integers(1, 100, 200)]
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(list(zip(keys, sizes)), "key long, size long"), 7)
    assert capacity == plain_capacity(sizes, 7) and len(cuts) <= 6
