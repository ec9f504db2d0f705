import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Inputs that every operator must take: nulls, empty and blank texts, ties, repeated rows, a long text.
AWKWARD = [
    (7, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62),
    (7, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62),
    (7, "another text under the same id with words enough to be one", "en", None, None),
    (None, "a text without an id but with some words of its own to hash", None, "a", 10),
    (None, None, None, None, None),
    (3, None, "en", "b", 0),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (6, "été 日本語 \U0001f600 naïve x", "fr", "b", 20),
    (8, "long " * 30_000 + "\n" + "line\n" * 2_000, "en", "b", 160_000),
    (9, "word", "en", "b", 4),
]


@pytest.fixture(scope="session")
def documents(spark):
    """(rows) -> DataFrame with the columns of documents; rows are (doc_id, text) or whole."""
    def make(rows, parts=3):
        full = [r if len(r) == 5 else (*r, "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)
    return make


@pytest.fixture(scope="session")
def awkward(documents):
    """The awkward rows with extra columns whose names operators also use."""
    return documents(AWKWARD).withColumns({c: F.lit("x") for c in (
        "key", "label", "size", "shard", "h", "n", "th", "part", "score", "gone", "_gone", "_id", "_hash", "_read", "_at", "_task", "text_hash", "first", "group", "place", "digest", "shown")})


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows=()):
        return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
    return make


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def auc(score, label):
    order = sorted(range(len(score)), key=lambda k: score[k])
    rank = {k: i + 1 for i, k in enumerate(order)}
    good = [k for k in range(len(score)) if label[k]]
    return (sum(rank[k] for k in good) - len(good) * (len(good) + 1) / 2) / (len(good) * (len(score) - len(good)))
