"""Operators 3 and 4: exact round trips against the tokenizer on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagesim.llm import packing, token_files
from pagesim.llm.queries import QUERIES
from pagesim.llm.tokens import Encoder
from pagesim.session import scratch_path
from tests.llm.conftest import AWKWARD, texts_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)
crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(text, end):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t 　\x1cab'sZ9.,é日<|endoftext|>")), max_size=30), max_size=5))
def test_encoder_equals_the_tokenizer_on_whole_texts(texts):
    texts = texts + ["a <|endoftext|> b  c\n d", None]
    assert [x.tolist() for x in ENCODER.encode(texts, 0)] == [ids_of(t, 0) for t in texts]


def test_encoder_keeps_ids_when_its_caches_turn(monkeypatch):
    small = Encoder(PATH)
    small.chunks.size = small.words.size = 2
    for texts in (["the cat sat", "x  y"], ["the dog, sat.", "the cat"], ["the cat sat"]):
        assert [x.tolist() for x in small.encode(texts, 1)] == [ids_of(t, 1) for t in texts]


def test_perfect_hash_is_a_bijection_and_knows_strangers():
    keys = np.random.default_rng(1).integers(-(1 << 60), 1 << 60, 5000)
    table = token_files.PerfectHash.of(keys)
    assert sorted(table.slots(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))
    assert token_files.PerfectHash.of(np.array([], np.int64)).size == 0


def test_token_files_of_a_table(spark, sf):
    texts, want, start = texts_of(spark, sf), {}, 0
    for doc in sorted(texts):
        ids = ids_of(texts[doc], 0)
        want[doc] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_files"](spark, sf).collect()} == want


def test_token_store_finds_every_key_and_no_other(spark, awkward):
    folder = scratch_path(spark, "tokens")
    manifest = token_files.write_token_shards(awkward, folder, PATH, 0)
    store = token_files.TokenStore(folder, manifest.collect())
    opened, shard = [], token_files.Shard
    token_files.Shard = lambda *a: opened.append(a[1]) or shard(*a)
    try:
        for _ in range(5):
            for key in (3, 4, 7):
                store.get(key)
    finally:
        token_files.Shard = shard
    assert len(opened) == len(set(opened))  # a shard's index is read once
    want = defaultdict(list)
    for doc, text, *_ in AWKWARD:
        want[doc].append(ids_of(text, 0))
    for doc in (3, 4, 5, 6, 7, 8, 9):
        assert sorted(x.tolist() for x in store.get(doc)) == sorted(want[doc])
    assert store.get(1) == [] and store.get(10**12) == []
    rows = token_files.read_token_shards(manifest, folder).collect()
    assert len(rows) == len(AWKWARD) and sum(r.doc_id is None for r in rows) == 2
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_token_files_of_an_empty_table(spark, documents):
    assert token_files.token_files(spark, documents([]), PATH).collect() == []


def check_packing(rows, ids, capacity=packing.CAPACITY):
    """Every id in one piece, offsets gapless, full bins of their class; returns the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        left = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own)
        for one in ids[doc]:
            at = 0
            while at < len(one):
                piece = next(p for p in left if p[0] == at and p[3] == len(one) and p[2] == crc(one[at:at + p[1]]))
                left.remove(piece)
                at += piece[1]
        assert not left
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
        kinds = {r["class"] for r in own}
        assert len(kinds) == 1
        if (kind := kinds.pop()):
            assert len(own) == kind and all(packing.class_of(r.length, capacity) == kind for r in own)
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    return padding / total


def test_packing_of_a_table(spark, sf):
    texts = texts_of(spark, sf)
    rows = QUERIES["op4_packing"](spark, sf).collect()
    assert check_packing(rows, {d: [ids_of(t, 1)] for d, t in texts.items()}) < 0.01


def test_packing_of_awkward_rows(awkward, documents):
    want = defaultdict(list)
    for doc, text, *_ in AWKWARD:
        want[doc].append(ids_of(text, 1))
    check_packing(packing.pack_documents(awkward, PATH).collect(), want)
    assert packing.pack_documents(documents([]), PATH).collect() == []


@pytest.mark.parametrize("capacity", [16, 100, 2048])
def test_cut_lengths_keep_all_tokens_and_fill_their_class(capacity):
    for n in range(1, 3 * capacity):
        cut = packing.cut_lengths(n, capacity)
        assert sum(cut) == n
        for length in cut:
            i = packing.class_of(length, capacity)
            assert 1 <= length <= capacity // i
