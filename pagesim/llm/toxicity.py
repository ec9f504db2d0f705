"""Toxicity by compression distance to two zstandard dictionaries (operator 8).

Two dictionaries are made of labelled text. The ordinary one is trained by zstandard on windows of ordinary text.
The toxic one holds the same and, behind it, the byte sequences that windows of toxic documents have and others
do not; so both know ordinary text alike, and a window is shorter under the toxic one exactly where it holds toxic
text. A window is one word between spaces, without the punctuation around it; each of its bytes is spelled as two,
and a fixed tail that both dictionaries know follows, so that a match of a short word is worth more than what a
zstandard frame costs. A window's evidence is its compressed length with the ordinary dictionary less that with
the toxic one. How large a document's evidences are, and how many and what share pass each of a row of thresholds,
is calibrated to a probability on all sampled documents; a missed toxic one counts as two false alarms.

No list of words is kept: toxic sequences are pieces of ``PIECE`` bytes, wherever in a word they stand. A piece is
toxic if the different contexts (the words before and after) of the words that hold it fall into toxic documents
far more often than contexts do on the whole. Contexts are counted once, so copies of a document add nothing.
Pieces are taken greedily: the words that one explains no longer count for the others; each grows while nearly
all of its words go on alike. Where no piece stands out, the toxic dictionary is trained by zstandard on the
windows of toxic documents as they are.

Null, empty and wordless texts have no evidence. Where no document of one of the classes is known, all scores
are 0. Long texts are read whole, word by word."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesim.llm.text import crc_fold, labelled, narrow, slices

#: Bound of the labelled rows that are learned from, and of the windows that a dictionary is trained on (the commonest).
SAMPLE_ROWS, TRAINING_WINDOWS = 20_000, 20_000
#: Bytes of a piece, in how many toxic contexts it stands at least, and how many standard deviations above chance.
PIECE, LEAST_CONTEXTS, LEAST_DEVIATION = 6, 4, 6.0
DICTIONARY_BYTES, LEVEL = 16_384, 3
#: Thresholds of evidence that windows are counted above.
STEPS = (0, 1, 2, 3, 4, 5, 7, 9, 12)
THRESHOLD, HELD_OUT_FOLD = 0.3, 2
PUNCTUATION = b".,;:!?|&$%*#()[]\"'"
MAX_CACHED = 400_000
TAIL = bytes([*range(1, 9), *range(14, 30)])
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SECOND = bytes((b * 89 + 41) % 256 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def spelled(data: bytes) -> bytes:
    """Each byte as two."""
    out = bytearray(2 * len(data))
    out[::2], out[1::2] = data, data.translate(_SECOND)
    return bytes(out)


def window(word: bytes) -> bytes:
    """A word as the compressors see it."""
    return spelled(b" " + word.strip(PUNCTUATION) + b" ")


def train_dictionary(words: list[tuple[bytes, int]], size: int) -> bytes:
    """A dictionary from words with counts: zstandard's own training, or the plain words where they are too few for it."""
    samples = [window(w) for w, n in words for _ in range(max(1, min(n, 50)))]
    try:
        return zstandard.train_dictionary(size, samples * max(1, 4000 // max(1, len(samples))), level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(window(w) for w, _ in words)[-size:]


class Evidence:
    """Evidence of words under a pair of dictionaries, with a bounded cache."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(data: bytes):
        """Greedy with hash chains: every place of the dictionary is found, whatever lies beside it."""
        shape = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
            strategy=zstandard.STRATEGY_GREEDY, min_match=6, search_log=5, hash_log=15, chain_log=15)
        own = zstandard.ZstdCompressionDict(data + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=shape)

    def of(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > MAX_CACHED:
                self.known.clear()
            seen = window(word) + TAIL
            found = self.known[word] = len(self.ordinary.compress(seen)) - len(self.toxic.compress(seen))
        return found

    def features(self, text: str | None) -> tuple[float, ...]:
        words = words_of(text)
        values = sorted((v for v in map(self.of, words) if v > 0), reverse=True)
        counts = np.array([sum(v > k for v in values) for k in STEPS], float)
        return (*(values[:3] + [0, 0, 0])[:3], *np.log1p(counts), *np.log1p(1000 * counts / max(1, len(words))))


FEATURES = 3 + 2 * len(STEPS)
ROW = "doc_id long, label int, " + ", ".join(f"f{k} double" for k in range(FEATURES))


def pieces(word: bytes) -> set[bytes]:
    """The pieces of a word between spaces; a shorter one is a piece itself."""
    whole = b" " + word + b" "
    return {whole[k:k + PIECE] for k in range(max(1, len(whole) - PIECE + 1))}


def _in_contexts(sample: DataFrame) -> DataFrame:
    """(word, toxic, all): in how many different contexts each word stands, and in how many of toxic documents."""
    def contexts(batches):
        for batch in slices(batches, limit=1 << 20):  # each word becomes a row
            rows = set()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                w = words_of(text)
                for before, word, after in zip([b"", *w], w, [*w[1:], b""]):
                    rows.add((word.strip(PUNCTUATION), label, zlib.crc32(before + b" " + after)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int64()))], names=["word", "label", "context"])

    seen = sample.mapInArrow(contexts, "word binary, label int, context long").distinct()
    return seen.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count("*").alias("all"))


def toxic_pieces(counted: DataFrame, chance: float) -> list[bytes]:
    """Pieces whose words stand in toxic contexts far more often than by ``chance``."""
    def cut(batches):
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for word, toxic, every in zip(*(batch.column(c).to_pylist() for c in ("word", "toxic", "all"))):
                for piece in pieces(word):
                    sums = found.setdefault(piece, [0, 0])
                    sums[0] += toxic
                    sums[1] += every
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([s[0] for s in found.values()]),
                                                  pa.array([s[1] for s in found.values()])], names=["piece", "toxic", "all"])

    sums = counted.mapInArrow(cut, "piece binary, toxic long, all long").groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"))
    expected = F.col("all") * chance
    stands_out = ((F.col("toxic") >= LEAST_CONTEXTS) & ((F.col("toxic") - expected) / F.sqrt(expected) > LEAST_DEVIATION)
                  & (2 * F.col("toxic") > F.col("all")))
    return [bytes(r.piece) for r in sums.where(stands_out).select("piece").collect()]


def _holding(counted: DataFrame, found: list[bytes], held: bool) -> DataFrame:
    """The words that hold one of the pieces, or the others."""
    marks = frozenset(found)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([bool(marks & pieces(w)) == held for w in batch.column("word").to_pylist()], pa.bool_()))

    return counted.mapInArrow(keep, counted.schema)


def choose_sequences(words: list[tuple[bytes, int, int]], found: list[bytes], chance: float) -> list[tuple[bytes, int]]:
    """(sequence, toxic contexts) from words with their contexts (toxic, all), by falling deviation.

    A piece counts only in words that no piece before it explains; it grows by the byte that follows or precedes
    it in nine tenths of its toxic contexts."""
    marks, held, sums = frozenset(found), {p: [] for p in found}, {p: [0, 0] for p in found}
    for word in sorted(words):
        for piece in marks & pieces(word[0]):
            held[piece].append(word)
            sums[piece][0] += word[1]
            sums[piece][1] += word[2]
    explained: set[bytes] = set()

    def deviation(piece):
        toxic, every = sums[piece]
        return (toxic - every * chance) / (every * chance) ** 0.5 if every else 0.0

    out = []
    while sums:
        best = max(sums, key=lambda p: (deviation(p), p))
        toxic, every = sums[best]
        if deviation(best) <= LEAST_DEVIATION or toxic < LEAST_CONTEXTS or 2 * toxic <= every:
            break
        left = [(b" " + w + b" ", t) for w, t, _ in held[best] if w not in explained]
        for word, t, n in held[best]:
            if word not in explained:
                explained.add(word)
                for piece in pieces(word) & sums.keys():
                    sums[piece][0] -= t
                    sums[piece][1] -= n
        del sums[best]
        sequence = best
        while True:
            after, before, total = Counter(), Counter(), 0
            for whole, n in left:
                at = whole.find(sequence)
                if at >= 0:
                    total += n
                    after[whole[at + len(sequence):at + len(sequence) + 1]] += n
                    before[whole[max(0, at - 1):at]] += n
            (right, n), (first, m) = after.most_common(1)[0], before.most_common(1)[0]
            if right and 10 * n >= 9 * total:
                sequence += right
            elif first and 10 * m >= 9 * total:
                sequence = first + sequence
            else:
                break
        out.append((sequence, toxic))
    return out


def dictionaries(sample: DataFrame) -> tuple[bytes, bytes] | None:
    """The toxic and the ordinary dictionary; None without contexts of both classes."""
    counted = _in_contexts(sample).persist()
    try:
        total = counted.agg(F.sum("toxic"), F.sum("all")).first()
        if not total[0] or total[0] == total[1]:
            return None
        chance = total[0] / total[1]
        found = toxic_pieces(counted, chance)
        ordinary = _holding(counted, found, False).where(F.col("all") > F.col("toxic"))
        ordinary = ordinary.orderBy((F.col("all") - F.col("toxic")).desc(), "word").limit(TRAINING_WINDOWS).collect()
        plain = train_dictionary([(bytes(r.word), r["all"] - r.toxic) for r in ordinary][::-1], DICTIONARY_BYTES)
        if not found:
            windows = counted.where("toxic > 0").orderBy(F.col("toxic").desc(), "word").limit(TRAINING_WINDOWS).collect()
            return train_dictionary([(bytes(r.word), r.toxic) for r in windows][::-1], DICTIONARY_BYTES), plain
        words = [(bytes(r.word), r.toxic, r["all"]) for r in _holding(counted, found, True).collect()]
        chosen = choose_sequences(words, found, chance)
        return plain + b"".join(spelled(s) for s, _ in sorted(chosen, key=lambda x: (x[1], x[0]))), plain
    finally:
        counted.unpersist()


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, positive: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (intercept first), means and deviations of a penalized logistic regression.

    Rows of class 1 count ``positive`` times."""
    each = np.where(y > 0, positive, 1.0)
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    a, w = np.c_[np.ones(len(x)), (x - mean) / deviation], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = a.T @ (a * (each * p * (1 - p))[:, None]) + penalty * np.eye(len(w))
        w -= np.linalg.solve(hessian, a.T @ (each * (p - y)) + penalty * w)
    return w, mean, deviation


def _measured(docs: DataFrame, toxic: bytes, ordinary: bytes) -> DataFrame:
    def measure(batches):
        evidence = Evidence(toxic, ordinary)
        for batch in slices(batches):
            found = np.array([evidence.features(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), *(pa.array(c, pa.float64()) for c in found.T)],
                names=["doc_id", "label", *(f"f{k}" for k in range(FEATURES))])

    return docs.mapInArrow(measure, ROW)


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS):
    """Dictionaries and calibration from at most ``limit`` labelled rows whose crc32(doc_id) mod 4 is not 2.
    None where a class is missing."""
    sample = narrow_labelled(labelled(docs, labels, "toxic", crc_fold(F.col("doc_id"), 4) != HELD_OUT_FOLD, limit))
    pair = dictionaries(sample)
    if pair is None:
        return None
    rows = _measured(sample, *pair).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # numbers of at most ``limit`` rows
    x = np.array([[r[f"f{k}"] for k in range(FEATURES)] for r in rows])
    return *pair, fit_logistic(x, np.array([float(r.label) for r in rows]), positive=2.0)


def narrow_labelled(sample: DataFrame) -> DataFrame:
    return sample.select("doc_id", F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, limit)
    plain = narrow(docs)
    if model is None:
        scored = plain.select("doc_id", F.lit(0.0).alias("score"))
    else:
        toxic, ordinary, (w, mean, deviation) = model

        def score(batches):
            evidence = Evidence(toxic, ordinary)
            for batch in slices(batches):
                x = (np.array([evidence.features(t) for t in batch.column("text").to_pylist()]) - mean) / deviation
                p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

        scored = plain.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 4) == HELD_OUT_FOLD).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
