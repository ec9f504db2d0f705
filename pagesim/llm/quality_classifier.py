"""Quality by attention-based multiple-instance learning (operator 1).

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded: shares of
kinds of bytes, hashed byte pairs, lengths and repetitions go through a learned layer. Gated attention
(a tanh and a sigmoid branch) gives each passage a weight within its document; the weighted mean
of the encodings is the document's, and a logistic output scores it. All weights are learned together
from document labels alone, on a bounded sample.

Passages are a document's own rows of numbers, so a long text costs memory only for these. Null,
empty and wordless texts are one passage without words. Without both labels all scores are 1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesim.llm.hashing import ByteSums
from pagesim.llm.text import crc_fold, labelled, narrow, slices
from pagesim.llm.tokens import release_encoders

PASSAGE_WORDS, PAIR_BINS = 64, 32
#: Bound of the labelled rows that the model is fitted on.
SAMPLE_ROWS = 8_000
THRESHOLD, FOLDS = 0.3, 5
HIDDEN, GATE, EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 24, 12, 40, 1500, 128, 0.01, 1e-4
#: Texts of about so many bytes are encoded at a time.
ENCODE_BYTES = 1 << 20

_KINDS = np.full(256, 7, np.uint8)  # 7: other ASCII punctuation and control
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2),
                      (b" \t\x0b\x0c\r", 3), (b"\n", 4), (b"#*$%&|<>", 5), (b"!?", 6)):
    _KINDS[list(_chars)] = _kind
_KINDS[128:] = 8
N_KINDS = 9
_PAIRS = (np.random.default_rng(7).integers(0, PAIR_BINS, 1 << 16)).astype(np.int64)
N_FEATURES = N_KINDS + PAIR_BINS + 7


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many passages each text has (at least one)."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    doc_end = np.cumsum([len(r) + 1 for r in raw])  # behind each text's closing space
    kind = _KINDS[data]
    space = (kind == 3) | (kind == 4)
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    doc_of = np.searchsorted(doc_end, starts, "right")
    words = np.bincount(doc_of, minlength=len(raw))
    first = np.cumsum(words) - words
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.cumsum(passages) - passages
    total = int(passages.sum())
    inside = np.arange(len(starts)) - first[doc_of]
    passage = base[doc_of] + inside // PASSAGE_WORDS
    # a byte belongs to the passage of the last word that begins at or before it in its document
    change = np.zeros(len(data), np.int64)
    change[np.concatenate([[0], doc_end[:-1]])[passages > 0]] = base
    lead = (inside % PASSAGE_WORDS == 0) & (inside > 0)
    change[starts[lead]] = passage[lead]
    of_byte = np.maximum.accumulate(change)
    out = np.zeros((total, N_FEATURES), np.float32)
    size = np.bincount(of_byte, minlength=total).astype(np.float32)
    out[:, :N_KINDS] = np.bincount(of_byte * N_KINDS + kind, minlength=total * N_KINDS).reshape(total, -1) / size[:, None]
    pairs = _PAIRS[(data[:-1].astype(np.int64) << 8) | data[1:]]
    bins = of_byte[:-1] * PAIR_BINS + pairs
    counts = np.bincount(bins, minlength=total * PAIR_BINS)
    np.subtract.at(counts, bins[doc_end[:-1] - 1], 1)  # pairs across the end of a text
    out[:, N_KINDS:N_KINDS + PAIR_BINS] = counts.reshape(total, -1) / size[:, None]
    n = np.maximum(1, np.bincount(passage, minlength=total)).astype(np.float32)
    share = lambda flags: np.bincount(passage, weights=flags, minlength=total) / n
    if len(starts):
        word = ByteSums(data).hashes(starts, ends)
        same = np.zeros(len(word), bool)
        same[1:] = (word[1:] == word[:-1]) & (doc_of[1:] == doc_of[:-1])
        keyed = np.lexsort((word, passage))
        again = np.zeros(len(word), bool)
        again[keyed[1:]] = (word[keyed[1:]] == word[keyed[:-1]]) & (passage[keyed[1:]] == passage[keyed[:-1]])
        back = 5  # a word that stood five words before: short loops
        loop = np.zeros(len(word), bool)
        loop[back:] = (word[back:] == word[:-back]) & (doc_of[back:] == doc_of[:-back])
        gram = word[:-4] * np.uint64(3) + word[1:-3] * np.uint64(5) + word[2:-2] * np.uint64(7) + word[3:-1] * np.uint64(11) + word[4:] * np.uint64(13)
        whole = doc_of[:-4] == doc_of[4:]
        by = np.lexsort((gram, doc_of[:len(gram)]))
        twice = np.zeros(len(word), bool)
        twice[by[1:]] = (gram[by[1:]] == gram[by[:-1]]) & (doc_of[by[1:]] == doc_of[by[:-1]]) & whole[by[1:]] & whole[by[:-1]]
        k = N_KINDS + PAIR_BINS
        for j, flags in enumerate((same, again, loop, twice)):
            out[:, k + j] = share(flags)
        out[:, k + 4] = share((ends - starts).astype(np.float32)) / 10
    out[:, -2] = np.log1p(np.repeat(words, passages)) / 8
    out[:, -1] = np.bincount(passage, minlength=total) / PASSAGE_WORDS
    return out, passages


class AttentionModel:
    """Encoder, gated attention and output; ``weights`` are plain arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, features: int, seed: int = 11) -> "AttentionModel":
        draw = np.random.default_rng(seed)
        shape = {"E": (features, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE, 1), "o": (HIDDEN, 1)}
        w = {k: (draw.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in shape.items()}
        return cls(w | {"e": np.zeros(HIDDEN, np.float32), "b": np.zeros(1, np.float32),
                        "mean": np.zeros(features, np.float32), "scale": np.ones(features, np.float32)})

    def forward(self, x: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.w, np.cumsum(passages) - passages
        x = np.clip((x - w["mean"]) / w["scale"], -8, 8)
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = ((t * g) @ w["a"])[:, 0]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, at), passages))
        weight = s / np.repeat(np.add.reduceat(s, at), passages)
        bag = np.add.reduceat(weight[:, None] * h, at, axis=0)
        p = 1 / (1 + np.exp(-np.clip(bag @ w["o"] + w["b"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "bag": bag, "p": p[:, 0], "at": at}

    def gradients(self, x, passages, y) -> dict[str, np.ndarray]:
        f, w = self.forward(x, passages), self.w
        d = ((f["p"] - y) / len(y)).astype(np.float32)[:, None]
        out = {"o": f["bag"].T @ d, "b": d.sum(0)}
        dbag = np.repeat(d @ w["o"].T, passages, axis=0)
        dh = f["weight"][:, None] * dbag
        dweight = (f["h"] * dbag).sum(1)
        mean = np.repeat(np.add.reduceat(f["weight"] * dweight, f["at"]), passages)
        ds = (f["weight"] * (dweight - mean))[:, None]
        out["a"] = (f["t"] * f["g"]).T @ ds
        dtg = ds @ w["a"].T
        dv, du = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (dh + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
        out["E"], out["e"] = f["x"].T @ dh, dh.sum(0)
        return out


def fit(bags: list[np.ndarray], y: np.ndarray) -> AttentionModel:
    """Adam on cross-entropy over whole bags, in a fixed random order."""
    model, draw = AttentionModel.fresh(bags[0].shape[1]), np.random.default_rng(5)
    every = np.concatenate(bags)
    model.w["mean"], model.w["scale"] = every.mean(0), every.std(0) + np.float32(1e-4)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step, epochs = 0, max(EPOCHS, -(-LEAST_STEPS * BATCH // len(bags)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = draw.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            step += 1
            grads = model.gradients(np.concatenate([bags[k] for k in own]), np.array([len(bags[k]) for k in own]), y[own])
            for k, g in grads.items():
                g = g + DECAY * model.w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] = model.w[k] - np.float32(rate) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> AttentionModel | None:
    """Fit on at most ``limit`` labelled rows whose crc32(doc_id) mod 5 is not 0; their passages'
    numbers, not their texts, reach the driver."""
    sample = labelled(docs, labels, "quality", crc_fold(F.col("doc_id"), FOLDS) != 0, limit)

    def encode(batches):
        release_encoders()
        for batch in slices(batches, limit=ENCODE_BYTES):
            x, passages = encode_passages(batch.column("text").to_pylist())
            parts = np.split(x, np.cumsum(passages)[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([p.astype("<f2").tobytes() for p in parts])],
                names=["doc_id", "label", "bag"])

    rows = (sample.select("doc_id", F.col("text").cast("string").alias("text"), "label")
            .mapInArrow(encode, "doc_id long, label int, bag binary").orderBy(F.xxhash64("doc_id"), "doc_id").collect())
    if len({r.label for r in rows}) < 2:
        return None
    bags = [np.frombuffer(r.bag, "<f2").reshape(-1, N_FEATURES).astype(np.float32) for r in rows]
    return fit(bags, np.array([r.label for r in rows], np.float32))


def scorer(model: AttentionModel | None):
    """A function from texts to scores."""
    def score(texts: list[str | None]) -> np.ndarray:
        return np.ones(len(texts)) if model is None else model.forward(*encode_passages(texts))["p"].astype(float)
    return score


def score_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    of_texts = scorer(train(docs, labels, limit))

    def score(batches):
        for batch in slices(batches, limit=ENCODE_BYTES):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(of_texts(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    return narrow(docs).mapInArrow(score, "doc_id long, score double").select(
        "doc_id", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that score below the threshold, decided where the rows lie."""
    of_texts, schema = scorer(train(docs, labels, limit)), docs.schema

    def keep(batches):
        release_encoders()
        for batch in slices(batches, limit=ENCODE_BYTES):
            yield batch.filter(pa.array(of_texts(batch.column("text").to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(keep, schema)
