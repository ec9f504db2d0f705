"""Operators 1 and 8 by held-out accuracy, and the pipeline against plain versions of its stages."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagesim.llm import quality_classifier as quality
from pagesim.llm import toxicity
from pagesim.llm.text import labelled
from pagesim.llm.decontamination import budget, normal
from pagesim.llm.queries import QUERIES
from pagesim.session import materialize
from tests.llm.conftest import AWKWARD, auc
from tests.llm.test_text_operators import plain_components, plain_dedup
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label, folds, fold):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    return [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known], len(rows)


def test_quality_of_held_out_documents(spark):
    pairs, n = held_out(spark, "op1_quality_classifier", "quality", 5, 0)
    assert n == 1000 and auc(*zip(*pairs)) > 0.97
    assert np.mean([s >= 0.3 for s, y in pairs if y]) > 0.97


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(1)
    model = quality.AttentionModel.fresh(6)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, passages, y = draw.normal(size=(7, 6)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, passages)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in model.gradients(x, passages, y).items():
        for at in np.ndindex(g.shape):
            if draw.random() < 0.2:
                old = model.w[name][at]
                model.w[name][at] = old + 1e-5
                up = loss()
                model.w[name][at] = old - 1e-5
                down = loss()
                model.w[name][at] = old
                assert g[at] == pytest.approx((up - down) / 2e-5, abs=2e-4)


def test_passages_of_one_text_do_not_depend_on_the_others():
    texts = ["a b c " * 70, None, "", "x", " \n ", "w " * 64 + "!", "Über alles\nund\tmehr " * 30]
    together, passages = quality.encode_passages(texts)
    at = 0
    for t, n in zip(texts, passages):
        alone, one = quality.encode_passages([t])
        assert one[0] == n
        np.testing.assert_allclose(alone, together[at:at + n], atol=1e-6)
        at += n


def test_classifiers_of_awkward_rows(awkward, documents, labels):
    known = labels([(7, 1, 0), (8, 0, 1), (9, 0, 1), (4, 1, 0), (6, 1, 0), (None, 1, 1), (3, None, None)])
    for score in (quality.score_quality, toxicity.score_toxicity):
        for given in (known, labels()):
            rows = score(awkward, given).collect()
            assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in AWKWARD)
            assert all(0 <= r.score <= 1 for r in rows)
        assert score(documents([]), known).collect() == []
    kept = quality.keep_good(awkward, labels())
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)


def test_toxicity_of_planted_words(spark, documents, labels):
    draw = np.random.default_rng(2)
    common = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    marks = ["grobbel", "snarfit", "Blorkus", "zub"]
    rows, known = [], []
    for k in range(900):
        words = [str(draw.choice(common)) for _ in range(60)]
        bad = k % 3 == 0
        if bad:
            for _ in range(3):
                words[draw.integers(60)] = str(draw.choice(marks)) + str(draw.choice(["", ",", "."]))
        rows.append((k, " ".join(words)))
        known.append((k, 1, int(bad)))
    out = toxicity.score_toxicity(documents(rows), labels(known)).collect()
    pairs = [(r.score, int(r.doc_id % 3 == 0)) for r in out if r.held_out]
    assert len(pairs) > 150 and auc(*zip(*pairs)) > 0.98
    assert np.mean([(s >= 0.3) == y for s, y in pairs]) > 0.95


def marked_rows(n, seed=3):
    """Ordinary words of syllables; toxic texts hold ever new words with one of two beginnings, or a word of their own."""
    draw = np.random.default_rng(seed)
    syllables = ["re", "eux", "tion", "ment", "la", "que", "oi", "vi", "and", "er", "lich", "ach"]
    rows, known = [], []
    for k in range(n):
        words = ["".join(draw.choice(syllables, draw.integers(1, 5))) for _ in range(draw.integers(40, 120))]
        bad = k % 4 == 0
        if bad:
            for _ in range(len(words) // 20 + 2):
                words[draw.integers(len(words))] = draw.choice(["snarf", "zubko"]) + "".join(draw.choice(syllables, 3))
        rows.append((k, " ".join(words) + ("." if k % 2 else "")))
        known.append((k, 1, int(bad)))
    return rows, known


def test_toxicity_of_beginnings_of_new_words(documents, labels):
    rows, known = marked_rows(1200)
    out = toxicity.score_toxicity(documents(rows), labels(known)).collect()
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in out if r.held_out]
    assert np.mean([p for p, y in held if y]) >= 0.95 and np.mean([p for p, y in held if not y]) <= 0.05


def plain_toxicity(rows, known):
    """The operator as loops over all documents."""
    label = {d: y for d, _, y in known}
    sample = [(t, label[d]) for d, t in rows if d in label and zlib.crc32(str(d).encode()) % 4 != 2]
    seen = set()
    for text, y in sample:
        w = toxicity.words_of(text)
        for before, word, after in zip([b"", *w], w, [*w[1:], b""]):
            seen.add((word.strip(toxicity.PUNCTUATION), y, zlib.crc32(before + b" " + after)))
    counted = defaultdict(lambda: [0, 0])
    for word, y, _ in seen:
        counted[word][0] += y
        counted[word][1] += 1
    chance = sum(v[0] for v in counted.values()) / sum(v[1] for v in counted.values())
    by_piece = defaultdict(lambda: [0, 0])
    for word, (t, n) in counted.items():
        whole = b" " + word + b" "
        for piece in {whole[k:k + 6] for k in range(max(1, len(whole) - 5))}:
            by_piece[piece][0] += t
            by_piece[piece][1] += n
    found = [p for p, (t, n) in by_piece.items() if t >= 4 and (t - n * chance) / (n * chance) ** 0.5 > 6 and 2 * t > n]
    holds = {w: any(p in b" " + w + b" " for p in found) for w in counted}
    plain = sorted(((n - t, w) for w, (t, n) in counted.items() if not holds[w] and n > t), key=lambda x: (-x[0], x[1]))[:20_000]
    ordinary = toxicity.train_dictionary([(w, n) for n, w in plain][::-1], 16_384)
    chosen = toxicity.choose_sequences([(w, t, n) for w, (t, n) in counted.items() if holds[w]], found, chance)
    toxic = ordinary + b"".join(toxicity.spelled(s) for s, _ in sorted(chosen, key=lambda x: (x[1], x[0])))
    evidence = toxicity.Evidence(toxic, ordinary)
    x, y = np.array([evidence.features(t) for t, _ in sample]), np.array([float(y) for _, y in sample])
    w, mean, deviation = toxicity.fit_logistic(x, y, positive=2.0)
    return {d: 1 / (1 + np.exp(-np.clip(w[0] + ((np.array(evidence.features(t)) - mean) / deviation) @ w[1:], -30, 30))) for d, t in rows}, chosen


def test_toxicity_equals_plain_version(documents, labels):
    rows, known = marked_rows(240, 8)
    rows += [(1000, None), (1001, ""), (1002, "snarfreeux " * 3000)]
    want, chosen = plain_toxicity(rows, known[:200])
    assert {s[:5] for s, _ in chosen} >= {b" snar", b" zubk"}
    for r in toxicity.score_toxicity(documents(rows), labels(known[:200])).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6


def test_toxicity_where_no_sequence_stands_out(documents, labels):
    """Both labels known, nothing toxic to be found: plain dictionaries, and scores that say little."""
    rows = [(k, f"w{k % 7} and w{k % 5} some words") for k in range(80)]
    out = toxicity.score_toxicity(documents(rows), labels([(k, 1, int(k % 9 == 0)) for k in range(80)])).collect()
    assert len(out) == 80 and all(0 < r.score < 1 for r in out)


def test_sample_is_bounded_in_rows_and_bytes(spark, documents, labels):
    rows = [(1, f"text {k}") for k in range(500)] + [(2, "x" * 200_000), (3, None), (4, "short")]
    sample = labelled(documents(rows), labels([(1, 1, 1), (2, 1, 0), (3, 1, 0), (4, 0, 0)]), "quality", F.lit(True), 10)
    assert sorted((r.doc_id, r.text, r.label) for r in sample.collect()) == [(1, "text 0", 1), (3, None, 1), (4, "short", 0)]


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.dtypes
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(materialize(stage(spark, results[-1], sf), name))
        assert name == "packing" or results[-1].dtypes == columns
    before, good, lines, single, clean = ({r.doc_id: r for r in df.collect()} for df in results[:5])
    scores = {r.doc_id: r.predicted for r in QUERIES["op1_quality_classifier"](spark, sf).collect()}
    assert set(good) == {d for d in before if scores[d]} and all(good[d] == before[d] for d in good)
    order = sorted(good)
    assert [(lines[d].text, lines[d].n_chars) for d in order] == [
        (t, len(t)) for t, _ in plain_dedup([good[d].text for d in order], 50)]
    assert set(single) == {c for _, _, c in plain_components([(d, lines[d].text) for d in order])}
    items = [normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d in single if any(p in normal(single[d].text) for p in items)}
    assert leaked and set(clean) <= set(single) - leaked and len(set(single) - leaked - set(clean)) <= 1
    assert budget(100) == 8
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for d, r in clean.items():
        want[d].append(whole.encode(r.text or "", add_special_tokens=False).ids + [1])
    check_packing(results[5].collect(), want)


def test_stages_of_awkward_rows(spark, awkward, documents, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for docs in (awkward, documents([])):
        for name, stage in corpus_pipeline.STAGES:
            result = materialize(stage(spark, docs, sf), name)
            if name != "packing":
                assert sorted(result.columns) == sorted(docs.columns)
            docs = result
        docs.collect()


def test_the_pipeline_is_registered(spark):
    assert QUERIES["pipeline"] is corpus_pipeline.run
    assert [n.split("_")[0] for n in QUERIES if n.startswith("op")] == [f"op{k}" for k in range(1, 14)]
