import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesim.llm.katz import _word_hashes, score_documents, score_texts
from pagesim.llm.packed import pack, unpack
from pagesim.llm.text import crc_fold
from tests.llm.conftest import AWKWARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
START, END, UNKNOWN = ("<start>",), ("<end>",), ("<unknown>",)


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), END]


class Plain:
    """Katz backoff over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [None, *(defaultdict(Counter) for _ in range(order))]
        for text in texts:
            t = tokens(text)
            for i, w in enumerate(t):
                for n in range(1, order + 1):
                    history = [START, *t[:i]]
                    if n == 1 or len(history) >= n - 1:
                        self.counts[n][tuple(history[len(history) - n + 1:]) if n > 1 else ()][w] += 1
        self.factors, self.weights = [None], {}
        for n in range(1, order + 1):
            r = Counter(c for words in self.counts[n].values() for c in words.values())
            left = 6 * r[6] / r[1] if r[1] else 1.0
            f = {}
            for k in range(1, 6):
                d = ((k + 1) * r[k + 1] / (k * r[k]) - left) / (1 - left) if r[k] and left < 1 else 0.0
                f[k] = d if 0 < d < 1 else (k - 0.5) / k
            self.factors.append(f)

    def p(self, word, history):
        if len(history) == 0:
            words = self.counts[1][()]
            word = word if word in words else UNKNOWN
        else:
            words = self.counts[len(history) + 1].get(history)
            if not words:
                return self.p(word, history[1:])
        factors = self.factors[len(history) + 1]
        total = sum(words.values()) + (not any(c <= 5 for c in words.values()))
        if word in words:
            return words[word] * factors.get(words[word], 1.0) / total
        left = 1 - sum(c * factors.get(c, 1.0) for c in words.values()) / total
        if not history:
            return left
        if history not in self.weights:
            self.weights[history] = left / (1 - sum(self.p(w, history[1:]) for w in words))
        return self.weights[history] * self.p(word, history[1:])

    def score(self, text):
        t, out = tokens(text), 0.0
        for i, w in enumerate(t):
            history = [START, *t[:i]]
            n = min(self.order, len(history) + 1)
            out += math.log10(self.p(w, tuple(history[len(history) - n + 1:]) if n > 1 else ()))
        return out


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def expected(rows, order):
    learnt = [r[1] for r in rows if fold(r[0]) != 1]
    model = Plain(learnt, order)
    c = Counter(w for t in learnt for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for doc_id, text, *_ in rows:
        t = tokens(text)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((doc_id, fold(doc_id) == 1, len(t), sum(c[w] > 0 for w in t), n, base, model.score(text)))
    return out


def compare(df, want):
    def key(r):
        return repr((r[0] is None, r[0], r[1:5], round(r[5], 6), round(r[6], 6)))
    got = sorted(map(tuple, df.collect()), key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def prose(n, seed=5):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    return [(k, " ".join(draw.choices(words, [1 / (j + 1) for j in range(60)], k=draw.randint(0, 60))) + (f" new{k}" if k % 3 else ""))
            for k in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_model(documents, order, small):
    """With chunks, parts and hot contexts of the usual size, and so small that every way is taken."""
    rows = [*prose(150), (1000, "the the the the"), (1001, "the cat"), (1001, "the cat")]
    sizes = {"chunk_tokens": 300, "part_keys": 500, "hot_context": 40} if small else {}
    scores, _ = score_texts(documents(rows), crc_fold(F.col("doc_id"), 5) != 1, order, **sizes)
    compare(scores, expected(rows, order))


def test_probabilities_sum_to_one():
    """Of the plain model, which the operator equals: after every context, over the known words, the end and an unknown."""
    model = Plain([t for _, t in prose(150)], 3)
    vocabulary = [*model.counts[1][()], UNKNOWN]
    for history in [(), *list(model.counts[2])[:40], *list(model.counts[3])[:200]]:
        assert sum(model.p(w, history) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_awkward_rows(awkward):
    compare(score_documents(awkward), expected(AWKWARD, 2))


def test_nothing_to_learn_from_and_no_rows(documents):
    alone = next(k for k in range(100) if fold(k) == 1)
    row = score_documents(documents([(alone, "some Text")])).collect()
    assert [tuple(r) for r in row] == [(alone, True, 3, 0, 0, 0.0, 0.0)]
    assert score_documents(documents([])).count() == 0


def test_held_out_text_is_likelier_than_without_context(spark, documents):
    draw = random.Random(2)
    follow = {f"a{k}": [f"a{(k * 7 + j) % 50}" for j in range(3)] for k in range(50)}
    rows = []
    for k in range(300):
        word, text = "a0", []
        for _ in range(40):
            word = draw.choice(follow[word])
            text.append(word)
        rows.append((k, " ".join(text)))
    out = score_documents(documents(rows)).where("held_out").collect()
    assert len(out) > 30 and all(r.score > r.base_score for r in out)


def test_tables_hold_all_counts(documents):
    rows = prose(80)
    _, model = score_texts(documents(rows), crc_fold(F.col("doc_id"), 5) != 1, 2, part_keys=300)
    c = Counter(w for k, t in rows if fold(k) != 1 for w in tokens(t))
    words = [unpack(r.data) for r in model.table(1).collect()]
    assert sorted(x for w in words for x in w[1].tolist()) == sorted(c.values())
    ids = [x for w in words for x in w[2].tolist()]
    assert len(set(ids)) == len(ids) == len(c)


def test_word_hashes_do_not_depend_on_windows():
    data = np.frombuffer(("ab  cde " * 50 + "x" * 40 + " y\n" + "z" * 9).encode(), np.uint8)
    whole = _word_hashes(data)
    for window in (1, 3, 16, 64):
        cut = _word_hashes(data, window)
        assert (cut[0] == whole[0]).all() and (cut[1] == whole[1]).all()


def test_packed_arrays():
    arrays = [np.arange(5, dtype=np.int64) - 2, np.zeros(0, np.uint32), np.array([1.5, np.inf]), np.array([7], np.uint8)]
    for a, b in zip(arrays, unpack(pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()
