"""A Merkle manifest of a data set: one tree for each group, one tree over the groups' roots.

Every row becomes a leaf: the SHA-256 of its fields, each framed by its length so that no two rows are written
alike. Leaves of a group are numbered in the order of their id; eight of them in a row are children of one
parent. A *slot pivot* makes a level: one aggregate per parent spreads the children over eight columns, slot by
slot. The columns one after another are hashed to the parent; all but the own column are a child's siblings.
On the way down each parent hands the siblings above it to its children, by unfolding the same eight columns, so
the leaves themselves are never joined: only parents are, an eighth of them.

Digests are kept as 32 bytes and hashed as lowercase hex text.

Defined results: a null field counts as ``-``; rows without an id come first in their group; rows without a group
form one that comes before all others. Rows with the same id are ordered by their leaves; equal rows are all
leaves. An empty table gives no rows, and columns other than the hashed ones are ignored."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesim.llm.ordered import dealt_in_order, positions
from pagesim.llm.text import crc_fold
from pagesim.session import materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(*fields: Column) -> Column:
    """What a leaf hashes: each field as its UTF-8 byte count, a colon and its value; ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _digest(data: Column) -> Column:
    return F.unhex(F.sha2(data.cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, group, leaf, shown): the leaf of each row, and the leaf of the row as it is shown to a verifier.

    ``tampered`` says which rows are shown with A-Z in their text turned to lower case."""
    rows = docs.select(*[F.col(c).alias(c) for c in FIELDS])
    fold = F.lit(False) if tampered is None else tampered
    low = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    leaf = _digest(framed(*[F.col(c) for c in FIELDS]))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("group"),
        leaf.alias("leaf"),
        F.when(fold, _digest(framed(*[F.col(c) if c != "text" else low for c in FIELDS]))).alias("shown"))


def pivot(nodes: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """One row per parent (group, place): children in the columns c0 to c7, null where there is none.

    ``nodes`` has group, place, digest and size, the number of nodes of its level. A group with one node left
    has reached its root: it is handed up as it is. Each child is a struct with its digest and ``payload``."""
    child = ", ".join(("digest", *payload))
    slots = [F.expr(f"max(CASE WHEN place % {FANOUT} = {k} THEN struct({child}) END) AS c{k}") for k in range(FANOUT)]
    return (nodes.groupBy("group", F.expr(f"place div {FANOUT}").alias("place"))
            .agg(*slots, F.max("size").alias("size")))


def parents(level: DataFrame) -> DataFrame:
    """The nodes that a pivoted level hands up."""
    joined = F.expr("concat_ws('', " + ", ".join(f"lower(hex(c{k}.digest))" for k in range(FANOUT)) + ")")
    return level.select("group", "place", F.when(F.col("size") > 1, _digest(joined)).otherwise(F.col("c0.digest")).alias("digest"),
                        F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"))


def children(level: DataFrame, above: DataFrame) -> DataFrame:
    """The children of a pivoted level with all siblings on their way up: ``path`` is a list of (before, after).

    ``above`` has the paths of the parents by (group, place); its other columns are handed down as they are."""
    hexed = "array_join(transform(slice(kids, {}, {}), c -> hex(c.digest)), '')"
    unfolded = F.expr(f"""filter(transform(sequence(0, {FANOUT - 1}), k -> struct(k AS slot, kids[k] AS child,
        unhex({hexed.format(1, 'k')}) AS before, unhex({hexed.format('k + 2', FANOUT)}) AS after)), s -> s.child IS NOT NULL)""")
    carried = [c for c in above.columns if c not in ("group", "place", "path", "digest")]
    step = F.array(F.struct("s.before", "s.after"))
    kids = F.expr("array(" + ", ".join(f"c{k}" for k in range(FANOUT)) + ")")
    return (level.select("group", "place", "size", kids.alias("kids")).join(above, ["group", "place"])
            .select("group", "place", "size", "path", *carried, F.explode(unfolded).alias("s"))
            .select("group", (F.col("place") * FANOUT + F.col("s.slot")).alias("place"), "s.child.*", *carried,
                    F.when(F.col("size") > 1, F.concat(step, "path")).otherwise(F.col("path")).alias("path")))


def _levels(size: int) -> int:
    n = 0
    while size > 1:
        size, n = -(-size // FANOUT), n + 1
    return n


def _climb(nodes: DataFrame, size: int, name: str, payload: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """All pivoted levels from the nodes up, each written, and the roots; at least one level."""
    levels = []
    for k in range(max(1, _levels(size))):
        levels.append(materialize(pivot(nodes, payload if k == 0 else ()), f"{name}-level{k}"))
        nodes = parents(levels[-1])
    return levels, nodes


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; and the siblings.

    ``path`` lists, from the leaf's level to the root's, the digests before and after the own one. ``folded_root``
    is computed from the shown leaf (the tampered one where there is one) and the path alone; ``verified`` says
    whether it is the root."""
    rows = materialize(leaves(docs, tampered), "merkle-leaves")
    placed = positions(dealt_in_order(rows, "group", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "merkle-ordered"),
                       "group", "place")
    placed = placed.select("group", "place", F.col("leaf").alias("digest"), "doc_id", "shown", F.col("_size").alias("size"))
    largest = placed.agg(F.max("size")).first()[0]
    levels, subroots = _climb(placed, largest or 0, "merkle", ("doc_id", "shown"))
    # The second tree: its leaves are the groups' roots, in the order of the groups.
    subroots = materialize(subroots.select(F.col("group").alias("name"), F.lit("").alias("group"), "digest"), "merkle-subroots")
    top = positions(dealt_in_order(subroots, "group", [F.col("name").asc()], "merkle-groups"), "group", "place")
    top = top.select("group", "place", "digest", "name", F.col("_size").alias("size"))
    upper, root = _climb(top, subroots.count(), "merkle-top", ("name",))
    above = root.select("group", "place", F.col("digest").alias("root"), F.lit([]).cast("array<struct<before: binary, after: binary>>").alias("path"))
    for level in reversed(upper):
        above = children(level, above)
    above = materialize(above.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("place"),
                                     F.col("digest").alias("subroot"), "root", "path"), "merkle-paths")
    for level in reversed(levels):
        above = children(level, above)
    proof = F.aggregate("path", F.lit("").cast("binary"), lambda joined, s: F.concat(joined, s["before"], s["after"]))
    folded = F.aggregate("path", F.coalesce("shown", "digest"),
                         lambda digest, s: _digest(F.concat(_hex(s["before"]), _hex(digest), _hex(s["after"]))))
    return above.select(
        "doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        F.sha2(_hex(proof).cast("binary"), 256).alias("proof_sha256"), _hex(folded).alias("folded_root"),
        (folded == F.col("root")).alias("verified"), "path")


def tampered_third(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text is divisible by 3; a missing id counts as empty text."""
    return crc_fold(doc_id, 3) == 0


def merkle_manifest(docs: DataFrame) -> DataFrame:
    return manifest(docs, tampered_third(F.col("doc_id"))).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _crc32_sql(value: str) -> str:
    """Unsigned crc32 of a text of ASCII characters as SQL; ``crc_steps.t`` holds the 256 steps."""
    codes = f"list_transform(string_split({value}, ''), lambda x: ascii(x)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
            f"lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


CRC_STEPS_SQL = """crc_steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _framed_sql(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields)


def _tree_sql(n: str, levels: int) -> list[str]:
    """Levels over the table <n>0 (grp, place, size, digest): <n>p0, <n>1, <n>p1 and so on."""
    out = []
    for k in range(levels):
        out.append(f"""{n}p{k} AS (SELECT grp, place // 8 AS place, any_value(size) AS size, list(digest ORDER BY place) AS kids
  FROM {n}{k} GROUP BY grp, place // 8)""")
        out.append(f"""{n}{k + 1} AS (SELECT grp, place, (size + 7) // 8 AS size,
  CASE WHEN size > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS digest FROM {n}p{k})""")
    return out


def _walk_sql(walk: str, n: str, levels: int) -> list[str]:
    """From <walk>0 (doc, grp, place, folded, proof) up the tree <n>: one join for each level."""
    out = []
    for k in range(levels):
        own, rest = "w.place % 8", "list_concat(p.kids[1:w.place % 8], p.kids[w.place % 8 + 2:])"
        folded = f"list_concat(list_append(p.kids[1:{own}], w.folded), p.kids[{own} + 2:])"
        out.append(f"""{walk}{k + 1} AS (SELECT w.row, w.grp, w.place // 8 AS place,
  CASE WHEN p.size > 1 THEN sha256(array_to_string({folded}, '')) ELSE w.folded END AS folded,
  CASE WHEN p.size > 1 THEN w.proof || array_to_string({rest}, '') ELSE w.proof END AS proof
  FROM {walk}{k} w JOIN {n}p{k} p ON w.grp IS NOT DISTINCT FROM p.grp AND p.place = w.place // 8)""")
    return out


def manifest_sql(levels: int = 7, upper: int = 3) -> str:
    """The same in SQL, for tables of up to 8**levels rows a group and 8**upper groups."""
    ctes = [CRC_STEPS_SQL, f"""hashed AS (SELECT doc_id, lang AS grp, sha256({_framed_sql('text')}) AS leaf,
  CASE WHEN {_crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 3 = 0
    THEN sha256({_framed_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS shown
  FROM documents, crc_steps)""", """doc AS (SELECT *, row_number() OVER () AS row,
  row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY grp) AS size FROM hashed)""", "a0 AS (SELECT grp, place, size, leaf AS digest FROM doc)",
            *_tree_sql("a", levels), f"""subroots AS (SELECT grp AS lang, digest, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place,
  count(*) OVER () AS size FROM a{levels})""", "b0 AS (SELECT 0 AS grp, place, size, digest FROM subroots)", *_tree_sql("b", upper),
            "v0 AS (SELECT row, grp, place, coalesce(shown, leaf) AS folded, '' AS proof FROM doc)", *_walk_sql("v", "a", levels),
            f"""w0 AS (SELECT v.row, 0 AS grp, s.place, v.folded, v.proof FROM v{levels} v JOIN subroots s ON v.grp IS NOT DISTINCT FROM s.lang)""",
            *_walk_sql("w", "b", upper)]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT d.doc_id, d.leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root,
  w.folded = r.digest AS verified
FROM doc d JOIN w{upper} w ON d.row = w.row JOIN subroots s ON d.grp IS NOT DISTINCT FROM s.lang CROSS JOIN b{upper} r"""
