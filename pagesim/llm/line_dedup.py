"""Line deduplication by winnowing over line hashes (operator 2).

A text is its lines, split at ``\\n``; lines without a word are passed over and always stay. From every
line a window runs to the first line with which it has ``MIN_WORDS`` words, and a gram likewise with
``GRAM_WORDS``. The least gram hash among the grams within a window is its fingerprint, so equal runs
of at least ``MIN_WORDS`` words, wherever they lie, have a fingerprint at the same place: that is
the guarantee. No window is left out by it: every window is a row, with its fingerprint and the hash of
its lines. Positions with equal fingerprint and window are joined to the first of them, and the lines of
all later ones are deleted. Lines after the last window of such a run, too few for a window, go as far
as the window and these lines stood at any earlier place: the window is hashed with its next line, its
next two and so on, and each of these has a first place too.

Order: by doc_id (nulls last), then text hash, then line. The first place of a run stays, every line
that is deleted has an equal line before it in this order. Rows with the same doc_id and text are one
document here: they get the same answer. A null text stays null; a text all of whose lines go
becomes empty. Lines are compared by 64-bit hash, white space included. Extra columns are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesim.llm.text import SPACES
from pagesim.session import at_least_partitions, materialize

MIN_WORDS, GRAM_WORDS = 50, 25
DOC = ["doc_id", "text_hash"]


def document_lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: doc_id, text_hash, at (its place among these lines), h (hash),
    upto (words of the document before it), words (of the whole document)."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(
        F.xxhash64(line).alias("h"), F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w")))
    spoken = F.filter(lines, lambda x: x["w"] > 0)
    one = (docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), spoken.alias("lines"))
           .where(F.size("lines") > 0).groupBy(*DOC).agg(F.first("lines").alias("lines")))
    by_place = Window.partitionBy(*DOC).orderBy("at")
    rows = one.select(*DOC, F.posexplode("lines").alias("at", "line")).select(*DOC, "at", "line.h", "line.w")
    return (rows.withColumn("upto", F.sum("w").over(by_place) - F.col("w"))
            .withColumn("words", F.sum("w").over(Window.partitionBy(*DOC))))


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """One row for each window: its fingerprint (``gram``), its hash, its place, and what lies around it.

    ``at`` is the first line, ``n`` the number of lines; ``right`` holds the hashes of the
    lines after the window, nearest first. Every line has a word, so ``upto`` grows from line to
    line and the lines of a window are a range of it."""
    def reach(low: int, high: int):
        return Window.partitionBy(*DOC).orderBy("upto").rangeBetween(low, high)

    next_line = Window.partitionBy(*DOC).orderBy("upto")
    window, gram = reach(0, min_words - 1), reach(0, gram_words - 1)
    lines = document_lines(docs).withColumns({
        "gram_lines": F.collect_list("h").over(gram), "run": F.collect_list("h").over(window),
        "end": F.last("at").over(window)})
    lines = lines.withColumns({
        "gram_end": F.col("at") + F.size("gram_lines") - 1, "after": F.lead("run").over(next_line),
        "gram": F.when(F.col("words") - F.col("upto") >= gram_words, F.xxhash64("gram_lines"))})
    lines = lines.withColumns({"grams": F.collect_list(F.struct("gram", "gram_end")).over(window),
                               "right": F.last("after").over(window)})
    inside = F.filter("grams", lambda g: g["gram"].isNotNull() & (g["gram_end"] <= F.col("end")))
    return lines.where(F.col("words") - F.col("upto") >= min_words).select(
        *DOC, F.array_min(inside)["gram"].alias("gram"), F.xxhash64("run").alias("window"), "at", F.size("run").alias("n"),
        F.coalesce("right", F.array().cast("array<bigint>")).alias("right"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(doc_id, text_hash, gone): places, among the lines with a word, of the lines to delete."""
    prints = materialize(fingerprints(docs, min_words, gram_words), "line-fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "at")
    first = (prints.groupBy("gram", "window").agg(F.min(place).alias("first"), F.count("*").alias("places"))
             .where("places > 1").drop("places"))
    found = materialize(prints.join(first, ["gram", "window"]).withColumn("origin", place == F.col("first")), "line-matches")
    later = found.where("not origin")
    here = Window.partitionBy(*DOC).orderBy("at")
    last = materialize(later.withColumn("next", F.lead("at").over(here)).where("(next is null or next > at + 1) and size(right) > 0")
                       .drop("next"), "line-ends")  # what follows other windows lies in the next one and its tail
    tails = lambda rows: rows.select("gram", "window", *DOC, "at", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("right")), lambda k: F.struct(k.alias("k"), F.xxhash64(F.slice("right", 1, k)).alias("tail")))).alias("x")
        ).select("gram", "window", *DOC, "at", "n", "x.k", "x.tail")
    asked = last.select("gram", "window").distinct()
    tail = ["gram", "window", "k", "tail"]
    before = (tails(found.join(asked, ["gram", "window"], "left_semi").where("size(right) > 0")).groupBy(*tail)
              .agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places"))
    more = tails(last).join(before, tail).where(place != F.col("first"))
    end = F.col("at") + F.col("n") - 1
    lines = later.select(*DOC, F.explode(F.sequence(F.col("at"), end)).alias("line")).unionAll(
        more.select(*DOC, (end + F.col("k")).alias("line")))
    return lines.distinct().groupBy(*DOC).agg(F.collect_list("line").alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """The text without these lines, which are counted among the lines with a word."""
    def rebuilt(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        spoken = F.filter(numbers, lambda k: F.btrim(F.get(lines, k), F.lit(SPACES)) != "")
        left = F.transform(F.array(spoken), lambda s: F.array_except(numbers, F.transform(gone, lambda g: F.get(s, g))))[0]
        return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")

    return F.transform(F.array(F.split(text, "\n")), rebuilt)[0]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and ``lines_removed`` (0 where nothing was)."""
    plain = at_least_partitions(docs.select("doc_id", "text"))
    gone = repeated_lines(plain, min_words, gram_words).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("gone").alias("_gone"))
    both = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left")
    text = F.when(gone["_gone"].isNull(), docs["text"]).otherwise(_without(docs["text"], gone["_gone"]))
    return both.select(*(text.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns if c != "lines_removed"),
                       F.coalesce(F.size(gone["_gone"]), F.lit(0)).alias("lines_removed"))
