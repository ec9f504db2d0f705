"""Operators 2, 7, 9 and 10, against plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesim.llm import decontamination as leaks
from pagesim.llm import line_dedup, ngram_join
from pagesim.llm import secret_scan as secrets
from pagesim.llm.queries import QUERIES
from tests.llm.conftest import AWKWARD, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- line deduplication

def plain_dedup(texts, least):
    """Texts, in order, without runs of lines of so many words that stood before."""
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for t in texts]
    count = [[len(WORD.findall(x)) for x in own] for own in lines]
    first, out = {}, []
    for d, own in enumerate(lines):
        gone = set()
        for i in range(len(own)):
            j, words = i, 0
            while j < len(own) and words < least:
                words += count[d][j]
                j += 1
            if words < least:
                break
            d0, i0 = first.setdefault(tuple(own[i:j]), (d, i))
            if (d0, i0) == (d, i):
                continue
            a, a0, b, b0 = i, i0, j, i0 + j - i
            while a and a0 and own[a - 1] == lines[d0][a0 - 1] and sum(count[d][a - 1:i]) <= least:
                a, a0 = a - 1, a0 - 1
            while b < len(own) and b0 < len(lines[d0]) and own[b] == lines[d0][b0] and sum(count[d][j:b]) < least:
                b, b0 = b + 1, b0 + 1
            gone |= set(range(a, b))
        at, kept = -1, []
        for x in (texts[d] or "").split("\n"):
            at += bool(WORD.search(x))
            if not (WORD.search(x) and at in gone):
                kept.append(x)
        out.append((None if texts[d] is None else "\n".join(kept), len(gone)))
    return out


def test_lines_of_a_table(spark, sf):
    texts = texts_of(spark, sf)
    order = sorted(texts)
    want = dict(zip(order, plain_dedup([texts[d] for d in order], line_dedup.MIN_WORDS)))
    assert {r.doc_id: (r.text, r.lines_removed) for r in QUERIES["op2_line_dedup"](spark, sf).collect()} == want


def test_lines_of_random_documents(spark, documents):
    draw = random.Random(4)
    pool = ["a b", "c", "d e f", "g h i j", "k l m n o", "", " ", "p q r"]
    texts = ["\n".join(draw.choice(pool) for _ in range(draw.randint(0, 9))) for _ in range(60)]
    rows = line_dedup.dedup_lines(documents(list(enumerate(texts))), 6, 3).collect()
    assert {r.doc_id: (r.text, r.lines_removed) for r in rows} == dict(enumerate(plain_dedup(texts, 6)))


def brute_dedup(texts, least):
    """Like plain_dedup, but every window is compared with all earlier places of it, as far as both go."""
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for t in texts]
    places, out = defaultdict(list), []
    for d, own in enumerate(lines):
        gone = set()
        for i in range(len(own)):
            ends = (j for j in range(i + 1, len(own) + 1) if sum(len(WORD.findall(x)) for x in own[i:j]) >= least)
            if not (j := next(ends, 0)):
                break
            for d0, i0 in places[tuple(own[i:j])]:
                b, b0 = j, i0 + j - i
                while b < len(own) and b0 < len(lines[d0]) and own[b] == lines[d0][b0]:
                    b, b0 = b + 1, b0 + 1
                gone |= set(range(i, b))
            places[tuple(own[i:j])].append((d, i))
        at, kept = -1, []
        for x in (texts[d] or "").split("\n"):
            at += bool(WORD.search(x))
            if not (WORD.search(x) and at in gone):
                kept.append(x)
        out.append((None if texts[d] is None else "\n".join(kept), len(gone)))
    return out


def test_tails_behind_a_shared_header(documents):
    draw = random.Random(9)
    header, pool = " ".join(f"p{k}" for k in range(51)), ["a b", "c", "d e f"]
    texts = [f"{header}\nx", f"{header}\na b\nc d e", f"{header}\na b\nc d e"]
    texts += [header + "\n" + "\n".join(draw.choice(pool) for _ in range(draw.randint(0, 5))) for _ in range(40)]
    want = brute_dedup(texts, line_dedup.MIN_WORDS)
    assert want[2] == ("", 3) and want != plain_dedup(texts, line_dedup.MIN_WORDS)
    rows = line_dedup.dedup_lines(documents(list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.text, r.lines_removed) for r in rows} == dict(enumerate(want))


def test_random_lines_against_all_earlier_places(documents):
    draw = random.Random(10)
    pool = ["a b", "c", "d e f", "g h i j k l m", "", " "]
    texts = ["\n".join(draw.choice(pool) for _ in range(draw.randint(0, 9))) for _ in range(80)]
    rows = line_dedup.dedup_lines(documents(list(enumerate(texts))), 6, 3).collect()
    assert {r.doc_id: (r.text, r.lines_removed) for r in rows} == dict(enumerate(brute_dedup(texts, 6)))


def test_a_passage_of_fifty_words_stays_once(documents):
    passage = " ".join(f"w{k}" for k in range(51))
    docs = documents([(k, f"own {k}\n{passage}\nend {k}") for k in range(40)])
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert sum(passage in t for t in texts.values()) == 1 and passage in texts[0]
    assert all(f"own {k}" in t and f"end {k}" in t for k, t in texts.items())


def test_lines_of_awkward_rows(awkward, documents):
    out = line_dedup.dedup_lines(awkward)
    assert out.columns == [*awkward.columns, "lines_removed"]
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in AWKWARD)
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    long = next(r.text for r in rows if r.doc_id == 8)
    assert long.count("line") == 1 and long.startswith("long ")
    assert line_dedup.dedup_lines(documents([])).collect() == []


# -- shingle join

def plain_sets(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    """[(doc_id, n, component)] in the order of rows, by comparing every pair."""
    sets, parent = [plain_sets(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)].append(doc)
    return [(doc, len(sets[k]), min(least[root(k)], default=None) if sets[k] else doc) for k, (doc, _) in enumerate(rows)]


def same_join(docs, rows):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_similar(docs).collect()]
    assert sorted(got, key=key) == sorted(plain_components(rows), key=key)


def families(seed, number, common=()):
    """Texts with near and far copies, sharing common passages."""
    draw, out = random.Random(seed), []
    vocabulary = [f"t{k}" for k in range(3000)]
    for _ in range(number):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(1, 120))]
        for passage in common:
            if draw.random() < 0.7:
                at = draw.randint(0, len(base))
                base[at:at] = passage.split()
        out.append(" ".join(base))
        for _ in range(draw.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 20))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_join_of_families_with_common_passages(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_GROUPS", 3)
    monkeypatch.setattr(ngram_join, "COMMON_CLASSES", 5)
    monkeypatch.setattr(ngram_join, "SAMPLE_DOCUMENTS", 10)  # so that common shingles are found in rounds
    common = [" ".join(f"c{p}x{k}" for k in range(30)) for p in range(2)]
    rows = list(enumerate(families(1, 90, common)))
    same_join(documents(rows), rows)


def test_join_without_moving_and_with_small_chunks(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAX_MOVED", 0)
    monkeypatch.setattr(ngram_join, "CHUNK", 150)
    monkeypatch.setattr(ngram_join, "SMALL_ROWS", 0)  # nothing is sent to all
    base = " ".join(f"u{k}" for k in range(60))
    rows = list(enumerate([base + f" v{k} w{k}" for k in range(40)] + families(2, 20)))
    same_join(documents(rows), rows)


@pytest.mark.parametrize("room", [1, 7])
def test_join_with_room_for_some_common_shingles(spark, documents, monkeypatch, room):
    monkeypatch.setattr(ngram_join, "COMMON_GROUPS", 3)
    monkeypatch.setattr(ngram_join, "COMMON_CLASSES", 3)
    monkeypatch.setattr(ngram_join, "SAMPLE_DOCUMENTS", 1)  # so that all are found in a round
    monkeypatch.setattr(ngram_join, "MAX_MOVED", room)
    rows = list(enumerate(" ".join(f"f{f}x{k}" for k in range(80)) + f" own{c}" for f in range(12) for c in range(6)))
    same_join(documents(rows), rows)


def test_join_of_awkward_rows(awkward, documents):
    rows = [(d, t) for d, t, *_ in AWKWARD]
    same_join(awkward, rows)
    assert ngram_join.join_similar(documents([])).collect() == []


def test_one_of_each_component_stays(awkward, documents):
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({7: 2, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1})
    texts = families(3, 40)
    groups = {c for _, _, c in plain_components(list(enumerate(texts)))}
    assert {r.doc_id for r in ngram_join.keep_one(documents(list(enumerate(texts)))).collect()} == groups


def test_heads_of_linked_sets_meet():
    draw = np.random.default_rng(1)
    for _ in range(200):
        pool = draw.integers(0, 1 << 62, 60).astype(np.uint64)
        a = np.unique(pool[draw.random(60) < 0.9])
        b = np.unique(pool[draw.random(60) < 0.9])
        moved = np.unique(pool[draw.random(60) < 0.3])
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 75 * (len(a) + len(b) - inter):
            assert len(np.intersect1d(ngram_join.head_of(a, moved), ngram_join.head_of(b, moved)))


def test_bitmaps_never_rule_out_a_link():
    draw, ruled = np.random.default_rng(3), 0
    for _ in range(400):
        pool = draw.integers(0, 1 << 62, int(draw.integers(1, 700))).astype(np.uint64)
        a = np.unique(pool[draw.random(len(pool)) < draw.choice([0.5, 0.95, 1])])
        b = np.unique(pool[draw.random(len(pool)) < draw.choice([0.5, 0.95, 1])])
        if not len(a) or not len(b):
            continue
        inter = len(np.intersect1d(a, b))
        fits = ngram_join.may_link(ngram_join.parity_bitmap(a), len(a), ngram_join.parity_bitmap(b), len(b))
        assert fits or 100 * inter < 75 * (len(a) + len(b) - inter)
        ruled += not fits
    assert ruled > 50


# -- decontamination

def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=80), st.text("abc ", min_size=1, max_size=90))
def test_bit_parallel_distance(pattern, text):
    found = leaks.best_match(pattern, text, len(pattern))
    assert min(found[0] if found else len(pattern), len(pattern)) == min(plain_distance(pattern, text), len(pattern))


def edited(text, errors, draw):
    out = list(text)
    for _ in range(errors):
        at = draw.randrange(len(out))
        out[at:at + 1] = draw.choice([[], ["x"], [out[at], "y"]])
    return "".join(out)


def test_matcher_finds_what_is_within_the_budget():
    draw = random.Random(5)
    items = [(k, 1, " ".join(draw.choice(["the", "of", "alpha", "beta", "gamma", "delta"]) for _ in range(14))) for k in range(8)]
    matcher = leaks.Matcher(items, 0.08)
    for _ in range(60):
        k = draw.randrange(8)
        hidden = edited(items[k][2], draw.randint(0, 8), draw)
        text = leaks.normal("zz " * draw.randint(0, 9) + hidden + " qq" * draw.randint(0, 9))
        want = {(i, d) for i, _, p in items if (d := plain_distance(p, text)) <= leaks.budget(len(p), 0.08)}
        assert {(m[0], m[2]) for m in matcher.matches(text)} == want


def test_leaks_of_a_table(spark, sf):
    texts = {d: leaks.normal(t) for d, t in texts_of(spark, sf).items()}
    items = {r.item_id: leaks.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, p in items.items() if p in t}
    rows = QUERIES["op9_decontamination"](spark, sf).collect()
    assert exact <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        assert plain_distance(items[r.item_id], texts[r.doc_id][max(0, r.place - 60):r.place + r.length + 60]) == r.distance
        assert r.distance <= leaks.budget(r.length)


def test_leaks_of_awkward_rows(spark, awkward, documents, monkeypatch):
    bench = spark.createDataFrame([(1, "three FOUR five\tsix seven eight nine"), (2, None), (None, ""), (9, "three four five six seven eight nine"),
                                   (5, "zzzz yyyy xxxx wwww vvvv uuuu tttt")], "item_id long, text string")
    rows = leaks.find_leaks(awkward, bench).collect()
    assert [(r.doc_id, r.item_id, r.copies, r.distance) for r in rows] == [(7, 1, 2, 0)] * 2
    kept = leaks.drop_leaks(awkward, bench)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in AWKWARD) - Counter({7: 2})
    monkeypatch.setattr(leaks, "BLOCK_CHARACTERS", 10)  # each item a block of its own
    assert len(leaks.find_leaks(awkward, bench).collect()) == 2 and leaks.drop_leaks(awkward, bench).count() == len(AWKWARD) - 2
    assert leaks.find_leaks(documents([]), bench).collect() == []
    assert leaks.find_leaks(awkward, bench.limit(0)).collect() == []
    assert leaks.drop_leaks(awkward, bench.limit(0)).count() == len(AWKWARD)


# -- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "SECRET", "apiKey", "api_key", "token", '"', "'", " ", ":", "=", "é", "AKIA", "AKIAABCDEFGHIJKL",
                                 "0123456789abcdef", "deadbeef", "x", "Zz9+/_-.", "ſecret", "\n"]), max_size=25).map("".join))
def test_base_spans(text):
    base = sorted(secrets.base_spans(text), key=lambda s: (s[0], s[2], s[1]))
    assert secrets._joined(base) == plain_spans(text)


def test_secrets_of_a_table(spark, sf):
    texts = texts_of(spark, sf)
    for r in QUERIES["op10_secret_scan"](spark, sf).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_random_strings_are_told_from_names(spark, documents):
    draw = random.Random(6)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]
    names = ["_".join(draw.choice(["user", "account", "balance", "total", "invoice", "number", "shipping"]) for _ in range(4)) for _ in range(300)]
    docs = documents([(k, f'token = "{h}" and {n} here') for k, (h, n) in enumerate(zip(hexes, names))])
    table, threshold = secrets.train(docs)
    alone = "0f3a9c7d51b24e860f3a9c7d"  # too short for the hex pattern
    text = f"é see {names[0]} or {alone}."
    base, spans = secrets.all_spans(text, table, threshold)
    assert base == [] and [text[a:b] for a, b, _ in spans] == [alone]


@pytest.mark.parametrize("share", [0.01, 0.05, 0.3])
def test_unmarked_keys_among_the_names_are_found(spark, documents, share):
    draw = random.Random(8)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "user account balance total invoice number shipping order customer address payment status request".split()
    names = sorted({"_".join(draw.choice(words) for _ in range(4)) for _ in range(600)})
    keys = ["".join(draw.choice(letters) for _ in range(32)) for _ in range(int(len(names) * share / (1 - share)))]
    texts = [f'token = "{h}"' for h in hexes] + [f"see {x} here" for x in names + keys]
    found = {texts[r.doc_id][4:-5]: r.n_markov for r in secrets.scan_secrets(documents(list(enumerate(texts)))).collect() if r.doc_id >= 200}
    assert sum(found[k] for k in keys) >= 0.95 * len(keys)
    assert sum(found[n] for n in names) <= 0.01 * len(names)


def test_secrets_of_awkward_rows(awkward, documents):
    rows = secrets.scan_secrets(awkward).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in AWKWARD)
    assert all(r.spans == "" for r in rows if r.doc_id in (3, 4, 5, None))
    assert secrets.scan_secrets(documents([])).collect() == []


def test_leads_of_linked_sets_share_more_than_either_may_lack():
    for n in range(1, 400):
        for m in range(-(-75 * n // 100), n + 1):
            common = -(-75 * (n + m) // 175)  # the least that links them
            if common <= m:
                kept = [min(k, 2 * ngram_join.spare(k) + 2) - (k - common) for k in (n, m)]
                assert min(kept) > max(ngram_join.spare(n), ngram_join.spare(m)), (n, m)
    own = np.arange(4, dtype=np.uint64)
    assert ngram_join.lead_of(own, own[:1]).tolist() == [1, 2, 3, 0] and ngram_join.spare(4) == 1


def met_candidates(docs, monkeypatch):
    """How many classes may be linked, and the candidates that the join made of them."""
    seen, inner = {}, ngram_join.candidates

    def candidates(classes):
        seen["able"], seen["met"] = classes.count(), inner(classes)
        return seen["met"]

    monkeypatch.setattr(ngram_join, "candidates", candidates)
    ngram_join.join_similar(docs).collect()
    return seen["able"], seen["met"].count()


def test_passages_met_by_chance_make_no_candidates(documents, monkeypatch):
    """Each text quotes four others in six words each: the pairs that meet grow with the square of the texts."""
    draw = random.Random(5)
    quotes = [" ".join(f"q{p}x{k}" for k in range(6)) for p in range(12)]
    rows = [(d, " ".join(" ".join(f"d{d}x{k}x{i}" for i in range(12)) + " " + q for k, q in enumerate(draw.sample(quotes, 4))))
            for d in range(60)]
    assert met_candidates(documents(rows), monkeypatch) == (0, 0)


def test_candidates_of_a_large_cluster_of_near_copies_do_not_grow_with_its_square(documents, monkeypatch):
    base = [f"u{k}" for k in range(120)]

    def copy(c):
        draw, words = random.Random(c), list(base)
        words[draw.randrange(len(words))] = f"v{draw.randrange(20)}"
        return " ".join(words)

    rows = [(c, copy(c)) for c in range(150)]
    same_join(documents(rows), rows)
    able, met = met_candidates(documents(rows), monkeypatch)
    assert able > 140 and met < 2 * able
