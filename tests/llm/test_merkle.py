import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from pagesim.llm.merkle import manifest, merkle_manifest
from pagesim.llm.ordered import dealt_in_order, positions, running


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, low=False):
    doc_id, text, lang, source, n_chars = row
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if low and text is not None else text
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Paths of (siblings before, siblings after) by place, and the root."""
    paths = [[] for _ in nodes]
    above = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        new, new_above = [], []
        for i in range(0, len(nodes), 8):
            run = nodes[i:i + 8]
            for j in range(len(run)):
                for k in above[i + j]:
                    paths[k].append((run[:j], run[j + 1:]))
            new.append(h("".join(run)))
            new_above.append([k for a in above[i:i + 8] for k in a])
        nodes, above = new, new_above
    return paths, nodes[0]


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    upper, root = climb([trees[g][1] for g in names])
    out = []
    for g, top in zip(names, upper):
        for row, path in zip(groups[g], trees[g][0]):
            path = path + top
            folded = leaf(row, low=zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 3 == 0)
            for before, after in path:
                folded = h("".join(before) + folded + "".join(after))
            out.append((row[0], leaf(row), trees[g][1], root, h("".join(x for b, a in path for x in b + a)), folded, folded == root))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_small_trees_of_all_shapes(documents):
    for n in (1, 2, 8, 9, 64, 65, 71):
        rows = [(k, f"Text {k}", "en", "s", k) for k in range(n)]
        assert got(merkle_manifest(documents(rows))) == brute(rows)


def test_awkward_rows(awkward):
    rows = [tuple(r) for r in awkward.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert got(merkle_manifest(awkward)) == brute(rows)


def test_many_groups_and_repeated_rows(documents):
    """More groups than children of a node, one of them large, and one row many times over."""
    rows = [(k % 90, "Same TEXT" if k % 3 else f"T{k}", f"l{k % 75}" if k % 2 else "é", None, None) for k in range(700)]
    rows += [(5, "Again", "en", "s", 5)] * 150
    assert got(merkle_manifest(documents(rows, 5))) == brute(rows)


def test_empty_table(documents):
    assert merkle_manifest(documents([])).count() == 0


def test_untouched_rows_verify(documents):
    rows = [(k, f"Text {k}", "en", "s", k) for k in range(20)]
    out = manifest(documents(rows)).collect()
    assert all(r.verified for r in out) and {len(r.path) for r in out} == {2}


@pytest.mark.parametrize("parts", [1, 4])
def test_positions_and_running_values(spark, parts):
    """A group over many tasks is numbered and added up like one list."""
    rows = [(None if k % 7 == 0 else "hot" if k % 3 else f"g{k % 5}", (k * 37) % 101, k) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(parts)
    dealt = dealt_in_order(df, "g", [df.o.asc(), df.v.asc()], "test-order")
    placed = positions(dealt, "g", "place")
    out = {r.v: r for r in running(placed.select(*df.columns, "place", "_size", "_task", "_at"), "g",
                                   {"total": ("sum", "v"), "mixed": ("xor", "v")}).collect()}
    lists = defaultdict(list)
    for g, o, v in sorted(rows, key=lambda r: r[1:]):
        lists[g].append(v)
    for members in lists.values():
        total = mixed = 0
        for place, v in enumerate(members):
            total, mixed = total + v, mixed ^ v
            assert (out[v].place, out[v]._size, out[v].total, out[v].mixed) == (place, len(members), total, mixed)
