import zlib
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from pagesim.llm.prefix_trie import prefix_trie, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def h(text):
    return sha256(text.encode()).hexdigest()


def digest(turn):
    return h(f"{len(turn[0].encode())}:{turn[0]}{turn[1]}")


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        k = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:k] + turns[k:]
    return out


def brute(convs):
    """Nodes as nested tuples of turns."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    return sorted(((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids.get(node, 0), leaves[node],
                    saved[node], h(",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))))
                   for node, who in members.items()), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_prefixes_of_prefixes_and_copies(spark):
    """Sequences that begin others, equal ones, one turn of all, and equal turns at different depths."""
    a, b, c = ("user", "Hi"), ("assistant", "été \U0001f600"), ("user", "")
    convs = {5: [a], 9: [a, b], 7: [a, b], 3: [a, b, c], 2: [a, c, b], 11: [b], 12: [], 13: [a, a, a], 14: [a, a], 1: [b, c]}
    rows = [(k, d + 1, t[0], t[1]) for k, v in convs.items() for d, t in enumerate(v)]
    turns = spark.createDataFrame(rows, "conv_id long, depth long, role string, text string").select(
        "conv_id", "depth", F.unhex(F.sha2(F.concat_ws(":", "role", "text").cast("binary"), 256)).alias("digest"), F.length("text").cast("long").alias("chars"))
    ids = spark.createDataFrame([(k,) for k in convs], "conv_id long")
    assert got(trie(turns, ids)) == brute(convs)


def test_rebuilt_conversations(spark):
    """Shared beginnings, absent and short first conversations, a long one, ties, nulls, repeated rows, clashing columns."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c if c % 3 else 'all'}") for c in
            [*range(0, 40), *range(100, 130), *range(205, 230), -3, -100, -101, 5000] for t in range(1 + c % 8 if c != 105 else 300)]
    rows += [(7, 1, "user", "same number"), (7, 1, "user", "same number"), (7, 1, None, "x"), (7, None, "user", None),
             (8, None, None, None), (None, 1, "user", "nobody's"), (205, 3, "", ""), (300, 0, "user", "only one")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("depth", "digest", "rep", "k1", "x1", "place", "_at", "base", "chars", "kind", "shared")})
    assert got(prefix_trie(df)) == brute(rebuilt(rows))


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", f"{t}") for c in range(1, 600) for t in range(7)] + [(c, 0, "user", f"{c}") for c in range(1000, 1300)]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rebuilt(rows))


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
