"""The trie of conversation prefixes: which beginnings conversations share, and what sharing them saves.

A node is a distinct beginning: the first d turns (role and text) of at least one conversation. Method:
*whole-sequence collapse*. Identical conversations become one weighted sequence with the list of those that end
there. A sequence that is a proper prefix of another is found by an anti-join against the inner nodes, the rest
are the leaves. Only the distinct sequences are unfolded into prefixes, and nodes are aggregates of these.

A prefix is known by its depth and two 64-bit sums (exclusive or) over the hashes of its turns at their places; a
node's parent is therefore known without a join. What lies below a node is added up along sequences: each node is
charged to the sequence of its least member, and a running sum from the end of a sequence to its beginning gives
what it holds below each of its prefixes. No text moves after its turn was hashed.

Neither a very long conversation, nor many equal ones, nor a beginning that most share meets in one task: rows are
dealt by ranges (``ordered``), nodes are aggregates with map-side combine, children of one parent are a join that
adaptive execution splits. Only the hash of a list of ends is made in order, from a stream of integers.

Defined results: a missing role or text counts as empty; a missing turn comes first; turns with the same number are
ordered by the SHA-256 of role and text; repeated rows are turns of their own. Rows without conv_id belong to no
conversation. An empty table has no nodes. Other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesim.llm.merkle import CRC_STEPS_SQL, _crc32_sql
from pagesim.llm.ordered import dealt_in_order, positions, running
from pagesim.session import materialize

#: How conversations are rebuilt: up to MOST_SHARED - 1 turns come from the first conversation of each SPAN.
SPAN, MOST_SHARED = 100, 6
NODE = ("depth", "k1", "k2")


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars) of each turn; the text goes no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(framed.cast("binary"), 256)).alias("digest"), F.length(text).cast("long").alias("chars"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, digest, chars) of the rebuilt conversations, and all conv_ids.

    The first h turns come from the first conversation of the hundred, h = crc32(conv_id as text) % 6; the own
    turns after the first h follow."""
    dealt = dealt_in_order(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest").asc()], "trie-turns")
    sizes = dealt.groupBy("conv_id").agg(F.count("*").alias("turns"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    convs = sizes.select("conv_id", shared.alias("shared"), (F.col("conv_id") - F.col("conv_id") % SPAN).alias("base"))
    bases = sizes.where(F.col("conv_id") % SPAN == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = convs.join(bases, "base", "left").select(
        "conv_id", "base", "shared", F.least("shared", F.coalesce("base_turns", F.lit(0))).alias("taken"))
    convs = materialize(convs, "trie-conversations")
    placed = positions(dealt, "conv_id", "place", convs.select("conv_id", "shared", "taken"))
    own = placed.where(F.col("place") >= F.col("shared")).select(
        "conv_id", (F.col("place") - F.col("shared") + F.col("taken") + 1).alias("depth"), "digest", "chars")
    first = placed.where((F.col("conv_id") % SPAN == 0) & (F.col("place") < MOST_SHARED - 1)).select(
        F.col("conv_id").alias("base"), "place", "digest", "chars")
    lent = convs.join(first, "base").where(F.col("place") < F.col("shared")).select(
        "conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars")
    return own.unionByName(lent), convs.select("conv_id")


def _end_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined conv_ids of each sequence; rows come sorted by sequence and conv_id.

    A list may run over many batches; only its hash so far is kept."""
    key, state, out = None, None, []

    def flushed():
        yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends"), (*k, e))) for k, e in out],
                                         pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends", pa.string())]))
        out.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in NODE])
        ids = batch.column("conv_id").to_pylist()
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
        for start, end in zip(cuts, cuts[1:]):
            own = tuple(keys[:, start].tolist())
            joined = ",".join(map(str, ids[start:end])).encode()
            if own == key:
                state.update(b"," + joined)
            else:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(joined)
        if len(out) > 10_000:
            yield from flushed()
    if key is not None:
        out.append((key, state.hexdigest()))
    yield from flushed()


def sequences_of(dealt: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sequences (depth, k1, k2, rep, weight), and the hash of the list of ends of each."""
    whole = dealt.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))
    members = materialize(convs.join(whole, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in NODE]), "trie-members")
    sequences = members.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"))
    ends = members.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(
        _end_lists, "depth long, k1 long, k2 long, ends string")
    return materialize(sequences, "trie-sequences"), ends


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv_id, depth from 1 without gaps, digest, chars) and all ``convs``.

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    node and all below: members but one, times the characters of its last text), ends_sha256."""
    coded = turns.select("conv_id", "depth", "chars", F.xxhash64("digest", "depth").alias("x1"),
                         F.xxhash64(F.lit(7), "depth", "digest").alias("x2"))
    dealt = dealt_in_order(coded, "conv_id", [F.col("depth").asc()], "trie-rebuilt")
    sequences, ends = sequences_of(dealt, convs)
    # The prefixes of distinct sequences, and the root as the prefix of length 0 of each.
    reps = sequences.select(F.col("rep").alias("conv_id"), F.col("depth").alias("length"), "weight")
    prefixes = running(dealt, "conv_id", {"k1": ("xor", "x1"), "k2": ("xor", "x2")}).join(reps, "conv_id").select(
        F.col("conv_id").alias("rep"), *NODE, "x1", "x2", "chars", "length", "weight")
    zero = F.lit(0).cast("long")
    roots = sequences.select("rep", *[zero.alias(c) for c in (*NODE, "x1", "x2", "chars")], F.col("depth").alias("length"), "weight")
    prefixes = materialize(prefixes.unionByName(roots), "trie-prefixes")
    nodes = materialize(prefixes.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("rep").alias("rep"), F.max("chars").alias("chars"),
        F.max(F.col("depth") < F.col("length")).alias("inner")), "trie-nodes")
    leaves = sequences.join(nodes.where("inner").select(*NODE), list(NODE), "left_anti")
    # What a sequence holds below each of its prefixes: charged nodes and leaves, added up from its end.
    charged = nodes.select("rep", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), zero.alias("leaf"))
    charged = charged.unionByName(leaves.select("rep", "depth", zero.alias("own"), F.lit(1).cast("long").alias("leaf")))
    rows = prefixes.drop("length", "chars").withColumns({"own": zero, "leaf": zero, "kind": F.lit(1)}).unionByName(
        charged.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    rows = dealt_in_order(materialize(rows, "trie-charged"), "rep", [F.col("depth").desc(), F.col("kind").asc()], "trie-below")
    below = running(rows, "rep", {"saved": ("sum", "own"), "leaves": ("sum", "leaf")}).where("kind = 1")
    nodes = materialize(below.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.max("x1").alias("x1"), F.max("x2").alias("x2"),
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")), "trie-totals")
    parent = {"depth": F.col("depth") - 1, "k1": F.col("k1").bitwiseXOR(F.col("x1")), "k2": F.col("k2").bitwiseXOR(F.col("x2"))}
    kids = nodes.where("depth > 0").groupBy(*[parent[c].alias(c) for c in NODE]).agg(F.count("*").alias("n_children"))
    full = nodes.join(kids, list(NODE), "left").join(ends, list(NODE), "left")
    full = full.withColumns({f"p_{c}": parent[c] for c in NODE})
    up = nodes.select(*[F.col(c).alias(f"p_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    return full.join(up, [f"p_{c}" for c in NODE], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns, convs = rebuilt_turns(materialize(hashed_turns(conversations), "trie-hashed"))
    return trie(materialize(turns, "trie-lent"), convs)


def trie_sql() -> str:
    """The same in SQL: every node row of every conversation, and for each node a row for each one above it."""
    shared = f"{_crc32_sql('c::VARCHAR')} % {MOST_SHARED}"
    return f"""WITH {CRC_STEPS_SQL},
turns AS (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS chars,
  sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM turns),
convs AS (SELECT c, n, {shared} AS h, c - c % {SPAN} AS base FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc_steps),
taken AS (SELECT v.c, v.h, v.base, least(v.h, coalesce(b.n, 0)) AS t FROM convs v LEFT JOIN convs b ON b.c = v.base),
rebuilt AS (
  SELECT v.c, p.place + 1 AS d, p.digest, p.chars FROM taken v JOIN placed p ON p.c = v.base WHERE p.place < v.h
  UNION ALL
  SELECT v.c, p.place - v.h + v.t + 1, p.digest, p.chars FROM taken v JOIN placed p ON p.c = v.c WHERE p.place >= v.h),
prefix AS (
  SELECT c, d, chars, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
node AS (SELECT d, k, min(c) AS m, count(*) AS n, any_value(chars) AS chars FROM prefix GROUP BY d, k),
linked AS (SELECT n.*, p.k AS pk FROM node n LEFT JOIN prefix p ON p.c = n.m AND p.d = n.d - 1),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM linked WHERE d > 0 GROUP BY 1, 2),
charged AS (SELECT n.*, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf FROM node n LEFT JOIN kids USING (d, k)),
below AS (SELECT a.d, a.k, sum((n.n - 1) * n.chars)::BIGINT AS saved, sum(n.leaf)::BIGINT AS leaves
  FROM charged n JOIN prefix a ON a.c = n.m AND a.d <= n.d GROUP BY a.d, a.k),
ends AS (SELECT p.d, p.k, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS ends
  FROM prefix p JOIN (SELECT c, max(d) AS d FROM prefix GROUP BY c) l ON l.c = p.c AND l.d = p.d GROUP BY p.d, p.k)
SELECT n.m AS conv_id, n.d::BIGINT AS depth, up.m AS parent_conv_id, n.n AS n_convs, coalesce(kids.n, 0) AS n_children,
  below.leaves AS n_leaves, below.saved AS saved_tokens, coalesce(ends.ends, sha256('')) AS ends_sha256
FROM linked n JOIN below USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN ends USING (d, k)
LEFT JOIN node up ON up.d = n.d - 1 AND up.k = n.pk"""
