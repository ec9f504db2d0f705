"""Token ids of texts, by a public tokenizer file, with bounded caches of what lies between spaces."""

from __future__ import annotations

import gc
import os
import re
import zlib

import numpy as np
import regex

#: Entries of one generation of a cache, and bytes of its keys.
MAX_CHUNKS, MAX_WORDS, MAX_CACHE_BYTES = 600_000, 450_000, 16 << 20
#: Text before this character has the same classes in every Unicode version the libraries know.
_SETTLED = "ɐ"
#: Marks a chunk that is taken as it is, without the space before it. No text holds half a surrogate pair.
_AS_IS = "\udc00"
_INNER_SPACE = re.compile(r"(?<=\S)(?= )")
#: The byte-level pre-tokenization that the tokenizer file names (a fixed value of its format).
_WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_encoders: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Cache:
    """Two generations of a dictionary; one that is full by number or by bytes becomes the old one, so memory is bounded."""

    def __init__(self, size: int):
        self.size, self.new, self.old, self.held = size, {}, {}, 0

    def turn(self) -> None:
        if len(self.new) > self.size or self.held > MAX_CACHE_BYTES:
            self.old, self.new, self.held = self.new, {}, 0

    def missing(self, keys: set[str]) -> list[str]:
        """Keys without a value; what only the old generation knows moves to the new one."""
        out = []
        for key in keys.difference(self.new):
            if key in self.old:
                self.new[key] = self.old[key]
            else:
                out.append(key)
        self.held += sum(map(len, out))
        return out


class Encoder:
    """Ids exactly as the tokenizer gives them for the whole text without special tokens added.

    A text is cut before each space that follows a character that is no white space:
    pre-tokenization never joins characters across such a place and looks no further than one
    character beyond white space. Chunks met before come from a cache; new ones are cut into words
    by the tokenizer's own pattern, and words met before come from another cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        settings = repr(self.whole.pre_tokenizer)
        self.cuttable = (settings.startswith("ByteLevel") and "add_prefix_space=False" in settings
                         and "use_regex=True" in settings and self.whole.normalizer is None)
        self.model = Tokenizer(self.whole.model)
        self.letters = _byte_letters()
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.chunks, self.words = _Cache(MAX_CHUNKS), _Cache(MAX_WORDS)

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _letters(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.letters[32])
        return word.encode().decode("latin-1").translate(self.letters)

    def _learn_words(self, words: set[str]) -> None:
        new, known = self.words.missing(words), self.words.new
        for at in range(0, len(new), 4096):
            some = new[at:at + 4096]
            code = self.model.encode([self._letters(w) for w in some], is_pretokenized=True, add_special_tokens=False)
            ids, size = np.array(code.ids, self.dtype).tobytes(), self.dtype.itemsize
            ends = size * np.cumsum(np.bincount(np.array(code.word_ids, np.int64), minlength=len(some)))
            start = 0
            for word, end in zip(some, ends.tolist()):
                known[word] = ids[start:end]
                start = end

    def _learn_chunks(self, chunks: set[str], settled: bool) -> None:
        """``settled``: no chunk holds a special token or a character beyond the settled ones."""
        one, two, more = [], [], {}
        learned = self.chunks.missing(chunks)
        known = self.chunks.new
        for chunk in learned:
            if chunk.isalpha():
                one.append(chunk)
            elif chunk[:-1].isalpha() and chunk[-1] in ".,":
                two.append(chunk)
            elif chunk[:1] == _AS_IS:
                more[chunk] = chunk[1:]
            elif not chunk or chunk[-1].isspace():
                known[chunk] = None  # the space behind it belongs to the same run
            else:
                more[chunk] = " " + chunk
        if not settled:
            more |= {chunk: " " + chunk for chunk in one + two}
            one, two = [], []
            for chunk, text in list(more.items()):
                if text and max(text) >= _SETTLED or any(s in text for s in self.special):
                    known[chunk] = self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
                    del more[chunk]
        cut = {chunk: _WORDS.findall(text) for chunk, text in more.items()}
        words = set().union(*cut.values())
        words.update([" " + c for c in one], [" " + c[:-1] for c in two], (".", ","))
        self._learn_words(words)
        ids = self.words.new
        for chunk in one:
            known[chunk] = ids[" " + chunk]
        for chunk in two:
            known[chunk] = ids[" " + chunk[:-1]] + ids[chunk[-1]]
        for chunk, words in cut.items():
            known[chunk] = b"".join([ids[w] for w in words])

    def _settled(self, text: str) -> bool:
        return (text.isascii() or max(text) < _SETTLED) and not any(s in text for s in self.special)

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        """The ids of each text (None: empty) with ``end_id`` behind them.

        Millions of strings arise and none of them in a cycle: the cycle collector waits meanwhile."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts, end_id)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        end = self._bytes([end_id])
        if not self.cuttable:
            codes = self.whole.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.frombuffer(self._bytes(c.ids) + end, self.dtype) for c in codes]
        cut, plain, other = [], set(), set()
        for text in texts:
            chunks = text.split(" ") if text else []
            if chunks:
                chunks[0] = _AS_IS + chunks[0]
                (plain if self._settled(text) else other).update(chunks)
            cut.append(chunks)
        self.chunks.turn()
        self.words.turn()
        self._learn_chunks(plain, True)
        self._learn_chunks(other, False)
        out, odd = [], []
        known = self.chunks.new.__getitem__
        for k, chunks in enumerate(cut):
            try:
                if len(chunks) > 1 and chunks[0][-1].isspace():
                    raise TypeError("the first chunk ends in white space")
                out.append(np.frombuffer(b"".join(map(known, chunks)) + end, self.dtype))
            except TypeError:  # a chunk without ids of its own
                odd.append(k)
                out.append(None)
        for k in odd:
            chunks = [_AS_IS + c for c in _INNER_SPACE.split(texts[k])]
            self._learn_chunks(set(chunks), False)
            out[k] = np.frombuffer(b"".join(map(self.chunks.new.__getitem__, chunks)) + end, self.dtype)
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; workers are used again, so its caches stay warm."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release_encoders() -> None:
    """Forget the worker's encoders: a worker that encoded tokens in one stage needs their caches in no other."""
    if _encoders:
        _encoders.clear()
        gc.collect()


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
