"""Language-model scores by Katz backoff, learnt from one part of the corpus and given to all of it.

Counts are discounted by Good and Turing's rule; what the discounts leave at a context goes to the words never seen
after it, in proportion to the next shorter context, with a weight that makes the probabilities after every context
sum to one exactly (over the known words, the end and one unknown word).

The corpus is encoded once, into chunks of a few million tokens, written in buckets by chunk. For each order a chunk
asks for its *distinct* n-grams: one row for each chunk and part of the key space holds them as packed arrays. Spark
deals these rows by part; a part adds up the counts, writes its piece of the count table, and answers each chunk in
the order in which it asked. The answers go back by chunk, where the corpus already lies in buckets, and the next
order is asked for: an n-gram is a pair of ids, the one of its context (an n-gram of the order below) and the one of
its last word. At last every token is evaluated from the answers, order by order.

Nothing is ever grouped by a word or an n-gram of the data alone: a frequent one costs a part one row for each
*chunk* that holds it. An n-gram's part is drawn by its context, so that a context's discounts can be added up where
its n-grams lie; contexts with over ``hot_context`` occurrences (few: at most all tokens divided by it) are drawn by
n-gram, and their sums are added up by Spark and sent to all.

Defined results: a null text is empty (only the end token); a null doc_id counts as empty text in the split and
learns; repeated rows count and are scored each; other columns are ignored. With no text to learn from, every
probability is one and every score 0. Where Good and Turing's rule gives no discount between 0 and 1 (a count that no
n-gram has, small corpora), a count r becomes r - 1/2. A context none of whose counts is discounted keeps 1 of
count + 1 for unseen words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesim.llm.hashing import ByteSums, mix
from pagesim.llm.packed import pack, pack_repeated, unpack
from pagesim.llm.text import BATCH_BYTES, crc_fold, slices
from pagesim.session import at_least_partitions, scratch_path

#: Counts up to DISCOUNTED are discounted (Katz's own choice).
DISCOUNTED = 5
CHUNK_TOKENS, PART_KEYS, LEAST_HOT, MOST_BUCKETS = 1_500_000, 1_500_000, 1_000_000, 50_000
END_WORD = np.uint64(0x656E64656E64656E)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

CHUNK_SCHEMA = "chunk long, n_tokens long, n_train long, n_docs_train long, n_words long, docs binary, words binary, ids binary"
ASK_SCHEMA = "part int, chunk long, data binary"
TOLD_SCHEMA = "kind string, part int, chunk long, data binary, context long, sums array<double>"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _word_hashes(data: np.ndarray, window: int = BATCH_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in lower-cased bytes, a window at a time; a window ends between words."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + window)
        while end < len(data) and not _SPACE[data[end]]:
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            end = at + int(gaps[-1]) if len(gaps) and gaps[-1] else min(len(data), end + window)
        part = data[at:end]
        space = np.concatenate([[True], _SPACE[part], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        hashes.append(ByteSums(part).hashes(edges[::2], edges[1::2]))
        starts.append(edges[::2] + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _encoded(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Chunks of whole documents: per document its id, fold and number of tokens; per token a chunk's own word number.

    A chunk's words are numbered by falling count, so that most numbers are small."""
    docs, tokens, held = [], [], 0
    base = TaskContext.get().partitionId() << 32
    made = 0

    def chunk():
        nonlocal made
        stream = np.concatenate(tokens)
        words, at, counts = np.unique(stream, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        ids = np.array([d[0] or 0 for d in docs], np.int64)
        missing, train = (np.array([f(d) for d in docs], np.uint8) for f in (lambda d: d[0] is None, lambda d: d[1]))
        lengths = np.array([d[2] for d in docs], np.int64)
        made += 1
        return pa.RecordBatch.from_pylist([{
            "chunk": base + made, "n_tokens": len(stream), "n_train": int(lengths[train > 0].sum()), "n_docs_train": int(train.sum()),
            "n_words": len(words), "docs": pack(ids, missing, train, lengths), "words": words[order].tobytes(),
            "ids": pack(rank[at])}], pa.schema([("chunk", pa.int64()), ("n_tokens", pa.int64()), ("n_train", pa.int64()),
                                                ("n_docs_train", pa.int64()), ("n_words", pa.int64()), ("docs", pa.binary()),
                                                ("words", pa.binary()), ("ids", pa.binary())]))

    for batch in slices(batches):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        sizes = np.array([len(t) + 1 for t in texts])
        data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        hashes, starts = _word_hashes(data)
        ends = np.cumsum(sizes)
        upto = np.searchsorted(starts, ends)
        n_words = np.diff(upto, prepend=0)
        tokens.append(np.insert(hashes, upto, END_WORD))
        docs += zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), (n_words + 1).tolist())
        held += len(tokens[-1])
        if held >= limit:
            yield chunk()
            docs, tokens, held = [], [], 0
    if docs:
        yield chunk()


@dataclass(frozen=True)
class Discounts:
    """Of one order: what a count up to DISCOUNTED is multiplied with."""

    factors: tuple[float, ...]

    @classmethod
    def good_turing(cls, numbers: list[int]) -> Discounts:
        """``numbers``: how many n-grams occur 1, 2, ... DISCOUNTED + 1 times."""
        out = []
        n = [0, *numbers]
        left = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
        for r in range(1, DISCOUNTED + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - left) / (1 - left) if n[r] and left < 1 else 0.0
            out.append(d if 0 < d < 1 else (r - 0.5) / r)
        return cls(tuple(out))

    def of(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        table = np.array([0.0, *self.factors, 1.0])
        return counts * table[np.minimum(counts, DISCOUNTED + 1)]


@dataclass(frozen=True)
class Order:
    """What all chunks need to know of one order once it is counted."""

    discounts: Discounts
    tokens: int
    kinds: int
    #: Ids of this order's n-grams are below this.
    ids: int
    #: Sums of hot contexts; for words, discounted tokens and their denominator under -1.
    hot: dict[int, tuple[float, ...]] = field(default_factory=dict)


def _discounted(sums: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and backoff weights of contexts. Rows of ``sums``: contexts' numbers of n-grams with the counts 1 to
    DISCOUNTED, the greater counts added up, and the shorter contexts' probabilities of the words seen."""
    counts = np.arange(1, DISCOUNTED + 1)
    full = sums[:, :DISCOUNTED] @ counts + sums[:, DISCOUNTED]
    kept = sums[:, :DISCOUNTED] @ (counts * np.array(discounts.factors)) + sums[:, DISCOUNTED]
    total = np.where(sums[:, :DISCOUNTED].any(axis=1), full, full + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = (1 - kept / total) / np.maximum(1 - sums[:, DISCOUNTED + 1], np.finfo(float).tiny)
    return total, weight


class Chunk:
    """The tokens of a chunk and what is known of them, order by order."""

    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.doc_ids, self.missing, self.train, self.lengths = unpack(row["docs"])
        self.words = np.frombuffer(row["words"], np.uint64)
        (self.ids,) = unpack(row["ids"])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.weight = np.repeat(self.train, self.lengths).astype(np.float64)

    def ask_words(self, parts: int) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(self.words)
        words, counts = self.words[order], np.bincount(self.ids, self.weight, len(self.words)).astype(np.uint32)[order]
        for part, start, end in _cut(words, parts):
            yield part, pack(np.diff(words[start:end], prepend=np.uint64(0)), counts[start:end])

    def hear_words(self, told: list[bytes], order: Order, trained: int) -> None:
        """Counts and ids of the words; from them the probabilities without context."""
        answers = [unpack(t) for t in told]
        counts, ids = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        by_hash = np.argsort(self.words)
        counts[by_hash], ids[by_hash] = (np.concatenate([a[k] for a in answers]).astype(np.int64) for k in (0, 1))
        self.counts = counts[self.ids]
        kept, total, unknown = unigrams(order)
        self.unigram_counts = counts
        self.p = np.where(counts > 0, order.discounts.of(counts) / total, unknown)[self.ids]
        self.start_id, self.unknown_id = order.ids, order.ids + 1
        self.word_ids = np.where(counts > 0, ids, self.unknown_id)[self.ids]
        # The context of the next order: the word before, or the start.
        known = np.where(self.counts > 0, self.word_ids, -1)
        self.context, self.context_count = _shifted(known), _shifted(self.counts)
        self.context[self.first] = self.start_id if trained else -1
        self.context_count[self.first] = trained

    def entries(self, hot_context: int) -> None:
        """The distinct (context, word) pairs of known contexts, in the order in which parts are asked for them."""
        self.at = np.flatnonzero(self.context >= 0)
        context, word = self.context[self.at], self.word_ids[self.at]
        wide = int(self.unknown_id) + 1
        if len(context) and int(context.max()) < (1 << 62) // wide:
            pairs, inverse = np.unique(context * wide + word, return_inverse=True)
            self.e_context, self.e_word = pairs // wide, pairs % wide
        else:
            contexts, local = np.unique(context, return_inverse=True)
            pairs, inverse = np.unique(local * wide + word, return_inverse=True)
            self.e_context, self.e_word = contexts[pairs // wide] if len(pairs) else context, pairs % wide
        n = len(pairs)
        self.e_count = np.bincount(inverse, self.weight[self.at], n).astype(np.int64)
        self.e_p, of = np.zeros(n), np.zeros(n, np.int64)
        self.e_p[inverse] = self.p[self.at]
        of[inverse] = self.context_count[self.at]
        self.e_hot = of > hot_context
        place = mix(self.e_context.astype(np.uint64) + np.uint64(1))
        spread = mix(place ^ mix(self.e_word.astype(np.uint64) + np.uint64(1)))
        place = np.where(self.e_hot, spread, place)
        order = np.argsort(place, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.e_context, self.e_word, self.e_count, self.e_p, self.e_hot, self.e_place = (
            x[order] for x in (self.e_context, self.e_word, self.e_count, self.e_p, self.e_hot, place))
        self.token_entry = rank[inverse]

    def _runs(self, start: int, end: int) -> np.ndarray:
        """Starts of runs of one context within a part's entries."""
        c = self.e_context[start:end]
        return np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)

    def ask(self, parts: int, n: int) -> Iterator[tuple[int, bytes]]:
        """The shorter contexts' probabilities go along: of a word alone (n = 2) as its count, which is shorter."""
        if n == 2:
            low = np.zeros(len(self.e_word), np.uint32)
            low[self.token_entry] = np.minimum(self.counts[self.at], np.iinfo(np.uint32).max)
        for part, start, end in _cut(self.e_place, parts):
            runs = self._runs(start, end)
            distinct, index = (np.zeros(0), low[start:end]) if n == 2 else pack_repeated(self.e_p[start:end])
            yield part, pack(self.e_context[start:end][runs], np.diff(runs, append=end - start).astype(np.uint32),
                             self.e_hot[start:end][runs].astype(np.uint8), self.e_word[start:end],
                             self.e_count[start:end].astype(np.uint32), distinct, index)

    def hear(self, told: list[bytes], order: Order, parts: int) -> None:
        """Counts of the pairs and sums of their contexts; from them the probabilities with one more word of context."""
        n = len(self.e_word)
        counts, ids = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        total, weight = np.zeros(n), np.zeros(n)
        hot = np.array(sorted(order.hot), np.int64)
        hot_sums = np.array([order.hot[k] for k in hot.tolist()]).reshape(len(hot), DISCOUNTED + 2)
        answers = iter(told)
        for _, start, end in _cut(self.e_place, parts):
            counts[start:end], ids[start:end], *columns = unpack(next(answers))
            runs = self._runs(start, end)
            is_hot, sums = self.e_hot[start:end][runs], np.zeros((len(runs), DISCOUNTED + 2))
            sums[~is_hot] = np.stack(columns, axis=1)
            sums[is_hot] = hot_sums[np.searchsorted(hot, self.e_context[start:end][runs][is_hot])]
            lengths = np.diff(runs, append=end - start)
            total[start:end], weight[start:end] = (np.repeat(x, lengths) for x in _discounted(sums, order.discounts))
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(counts > 0, order.discounts.of(counts) / total, weight * self.e_p)
        self.p = self.p.copy()
        self.p[self.at] = p[self.token_entry]
        # The context of the next order: the pair that ends before, if it is known.
        token_id, token_count = np.full(len(self.p), -1, np.int64), np.zeros(len(self.p), np.int64)
        token_count[self.at] = counts[self.token_entry]
        token_id[self.at] = np.where(token_count[self.at] > 0, ids[self.token_entry], -1)
        self.context, self.context_count = _shifted(token_id), _shifted(token_count)
        self.context[self.first] = -1

    def scores(self, words: Order) -> pa.Table:
        base = np.log10((self.unigram_counts + 0.5) / (words.tokens + 0.5 * (words.kinds + 1)))[self.ids]
        columns = [pa.array(self.doc_ids, mask=self.missing > 0), pa.array(self.train == 0), pa.array(self.lengths),
                   pa.array(np.add.reduceat((self.counts > 0).astype(np.int64), self.first)),
                   pa.array(np.full(len(self.lengths), words.tokens, np.int64)),
                   pa.array(np.add.reduceat(base, self.first)), pa.array(np.add.reduceat(np.log10(self.p), self.first))]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def unigrams(order: Order) -> tuple[float, float, float]:
    """Discounted tokens, denominator and the probability of an unknown word."""
    kept, total = order.hot[-1][:2]
    return kept, total, 1 - kept / total if total else 1.0


def _shifted(values: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[1:], out[:1] = values[:-1], 0
    return out


def _cut(place: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of rising 64-bit places over equal ranges; parts without entries are left out."""
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    edges = [0, *np.searchsorted(place, bounds).tolist(), len(place)]
    return [(k, s, e) for k, (s, e) in enumerate(zip(edges, edges[1:])) if s < e]


def _told(rows: list[dict]) -> pa.Table:
    kinds = [("kind", pa.string()), ("part", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary()),
             ("context", pa.int64()), ("sums", pa.list_(pa.float64()))]
    return pa.Table.from_pylist([{n: r.get(n) for n, _ in kinds} for r in rows], pa.schema(kinds))


def _numbers(total: np.ndarray) -> list[float]:
    """Summary of a part: how many n-grams occur 1 to DISCOUNTED + 1 times, their number, their occurrences."""
    seen = total[total > 0]
    return [*np.bincount(np.minimum(seen, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1:DISCOUNTED + 2].tolist(), len(seen), int(seen.sum())]


def _ids(total: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Ids of the n-grams that were seen: the commoner, the smaller; no two parts give the same."""
    seen = np.flatnonzero(total > 0)
    ids = np.full(len(total), -1, np.int64)
    ids[seen[np.argsort(-total[seen], kind="stable")]] = np.arange(len(seen), dtype=np.int64) * parts + part
    return ids


def count_words(parts: int):
    """Adds up the words of one part, answers the chunks in their order, and writes the part's piece of the table."""
    def count(key, table):
        part = key[0].as_py()
        asked = [(c, *unpack(d)) for c, d in zip(table.column("chunk").to_pylist(), table.column("data").to_pylist())]
        words, at = np.unique(np.concatenate([np.cumsum(a[1], dtype=np.uint64) for a in asked]), return_inverse=True)
        total = np.bincount(at, np.concatenate([a[2] for a in asked]).astype(float), len(words)).astype(np.int64)
        ids, rows, start = _ids(total, part, parts), [], 0
        for chunk, keys, _ in asked:
            mine = at[start:start + len(keys)]
            rows.append({"kind": "answer", "part": part, "chunk": chunk, "data": pack(total[mine], ids[mine])})
            start += len(keys)
        seen = total > 0
        rows.append({"kind": "table", "part": part, "data": pack(np.diff(words[seen], prepend=np.uint64(0)), total[seen], ids[seen])})
        rows.append({"kind": "summary", "part": part, "sums": _numbers(total)})
        return _told(rows)
    return count


def _lower(asked: tuple, words: Order) -> np.ndarray:
    """The probabilities that came with a block, or those of the counts that came."""
    if len(asked[6]):
        return asked[6][asked[7]]
    _, total, unknown = unigrams(words)
    counts = asked[7].astype(np.int64)
    return np.where(counts > 0, words.discounts.of(counts) / total, unknown)


def count_pairs(parts: int, last: bool, words: Order):
    """The same for pairs of a context and a word; contexts' sums go with the answers, those of hot contexts apart."""
    def count(key, table):
        part = key[0].as_py()
        asked = [(c, *unpack(d)) for c, d in zip(table.column("chunk").to_pylist(), table.column("data").to_pylist())]
        context = np.concatenate([np.repeat(a[1], a[2]) for a in asked])
        hot = np.concatenate([np.repeat(a[3], a[2]) for a in asked])
        word = np.concatenate([a[4] for a in asked])
        order = np.lexsort((word, context))
        c, w = context[order], word[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        pair_context, pair_word = c[new], w[new]
        total = np.bincount(at, np.concatenate([a[5] for a in asked]).astype(float), len(pair_word)).astype(np.int64)
        lower, pair_hot = np.empty(len(pair_word)), np.zeros(len(pair_word), bool)
        lower[at] = np.concatenate([_lower(a, words) for a in asked])
        pair_hot[at] = hot > 0
        # Sums of each context over the pairs that were seen.
        heads = np.flatnonzero(np.concatenate([[True], pair_context[1:] != pair_context[:-1]]))
        of = np.cumsum(np.concatenate([[0], (pair_context[1:] != pair_context[:-1]).astype(np.int64)]))
        seen = total > 0
        columns = [np.bincount(of, (total == r).astype(float), len(heads)) for r in range(1, DISCOUNTED + 1)]
        columns.append(np.bincount(of, np.where(total > DISCOUNTED, total, 0).astype(float), len(heads)))
        columns.append(np.bincount(of, np.where(seen, lower, 0.0), len(heads)))
        ids = np.full(len(total), -1, np.int64) if last else _ids(total, part, parts)
        rows, start = [], 0
        for chunk, runs, lengths, run_hot, keys, *_ in asked:
            mine = at[start:start + len(keys)]
            run = of[mine[np.cumsum(lengths, dtype=np.int64) - lengths]][run_hot == 0]
            rows.append({"kind": "answer", "part": part, "chunk": chunk, "data": pack(
                total[mine], ids[mine], *[x[run].astype(np.int64) for x in columns[:-1]], columns[-1][run])})
            start += len(keys)
        for k in np.flatnonzero(pair_hot[heads]):
            rows.append({"kind": "hot", "part": part, "context": int(pair_context[heads[k]]), "sums": [float(x[k]) for x in columns]})
        rows.append({"kind": "table", "part": part, "data": pack(pair_context[seen], pair_word[seen], total[seen], ids[seen])})
        rows.append({"kind": "summary", "part": part, "sums": _numbers(total)})
        return _told(rows)
    return count


class Model:
    """Counts as written tables, one folder for each order, and what all chunks need to know of each."""

    def __init__(self, spark, trained: int, parts: int, hot_context: int):
        self.folder, self.spark = scratch_path(spark, "katz"), spark
        self.trained, self.parts, self.hot_context = trained, parts, hot_context
        self.orders: list[Order] = []

    def counted(self, asked: DataFrame, count) -> None:
        """Count what was asked for, write the order's table and answers, and read the few numbers all need."""
        path = f"{self.folder}/order={len(self.orders) + 1}"
        asked.groupBy("part").applyInArrow(count, TOLD_SCHEMA).write.partitionBy("kind").parquet(path)
        told = self.spark.read.schema(TOLD_SCHEMA).parquet(path)
        width = DISCOUNTED + 3
        first = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
        row = told.where("kind = 'summary'").agg(*first, F.max(F.col("sums")[DISCOUNTED + 1]).alias("most")).first()
        numbers = [int(row[k] or 0) for k in range(width)]
        # At most all tokens divided by hot_context of these.
        hot = told.where("kind = 'hot'").groupBy("context").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(DISCOUNTED + 2)])
        discounts = Discounts.good_turing(numbers[:DISCOUNTED + 1])
        known = {r["context"]: tuple(r)[1:] for r in hot.collect()} if self.orders else {-1: _whole(numbers, discounts)}
        self.orders.append(Order(discounts, numbers[-1], numbers[-2], int(row["most"] or 0) * self.parts, known))

    def answers(self, upto: int) -> DataFrame:
        """Answers of the orders so far, by chunk."""
        out = None
        for k in range(1, upto + 1):
            one = (self.spark.read.schema(TOLD_SCHEMA).parquet(f"{self.folder}/order={k}").where("kind = 'answer'")
                   .select("chunk", F.lit(k).alias("n"), "part", "data"))
            out = one if out is None else out.unionByName(one)
        return out

    def table(self, order: int) -> DataFrame:
        """The written counts of an order: one row for each part, arrays packed."""
        return self.spark.read.schema(TOLD_SCHEMA).parquet(f"{self.folder}/order={order}").where("kind = 'table'").select("part", "data")


def _whole(numbers: list[int], discounts: Discounts) -> tuple[float, float]:
    """Discounted tokens and denominator of the words without context."""
    counts = np.arange(1, DISCOUNTED + 1)
    low = np.array(numbers[:DISCOUNTED], float)
    rest = numbers[-1] - float(low @ counts)
    kept = float(low @ (counts * np.array(discounts.factors))) + rest
    return kept, float(numbers[-1] if low.any() else numbers[-1] + 1)


def _heard(chunk: Chunk, told: pa.Table, model: dict) -> None:
    """Bring a chunk up to the orders that were answered."""
    by_order: dict[int, list] = {}
    for n, part, data in zip(told.column("n").to_pylist(), told.column("part").to_pylist(), told.column("data").to_pylist()):
        by_order.setdefault(n, []).append((part, data))
    for n, order in enumerate(model["orders"], 1):
        answers = [d for _, d in sorted(by_order.get(n, []), key=lambda x: x[0])]
        if n == 1:
            chunk.hear_words(answers, order, model["trained"])
        else:
            chunk.entries(model["hot_context"])
            chunk.hear(answers, order, model["parts"])


def _asking(model: dict):
    def ask(key, chunks, told):
        rows = []
        for row in chunks.to_pylist():
            chunk = Chunk(row)
            _heard(chunk, told, model)
            chunk.entries(model["hot_context"])
            rows += [{"part": part, "chunk": chunk.id, "data": data} for part, data in chunk.ask(model["parts"], len(model["orders"]) + 1)]
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())]))
    return ask


def _scoring(model: dict):
    def score(key, chunks, told):
        out = []
        for row in chunks.to_pylist():
            chunk = Chunk(row)
            _heard(chunk, told, model)
            out.append(chunk.scores(model["orders"][0]))
        return pa.concat_tables(out)
    return score


def _ask_words(parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                yield pa.RecordBatch.from_pylist([{"part": p, "chunk": chunk.id, "data": d} for p, d in chunk.ask_words(parts)],
                                                 pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())]))
    return ask


def _in_buckets(chunks: DataFrame, buckets: int) -> DataFrame:
    """Written in buckets by chunk, so that answers meet the corpus without moving it."""
    spark, name = chunks.sparkSession, f"katz_chunks_{uuid.uuid4().hex}"
    chunks.write.bucketBy(buckets, "chunk").option("path", scratch_path(spark, "katz-chunks")).saveAsTable(name)
    return spark.table(name)


def score_texts(docs: DataFrame, train: Column, order: int = 2, chunk_tokens: int = CHUNK_TOKENS,
                part_keys: int = PART_KEYS, hot_context: int = LEAST_HOT) -> tuple[DataFrame, Model]:
    """(scores, model): documents where ``train`` holds are learnt from, all are scored.

    Scores have doc_id, held_out (not learnt from), n_tokens, n_known, train_tokens, base_score (words without context,
    half added to each count) and score (log10 of the model's probability of the text with its end)."""
    spark = docs.sparkSession
    rows = at_least_partitions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                           F.coalesce(train, F.lit(False)).alias("train")))
    encoded = rows.mapInArrow(lambda batches: _encoded(batches, chunk_tokens), CHUNK_SCHEMA)
    chunks = _in_buckets(encoded, min(MOST_BUCKETS, max(8, 2 * rows.rdd.getNumPartitions())))
    size = chunks.agg(F.sum("n_tokens"), F.sum("n_docs_train"), F.sum("n_words")).first()
    tokens, trained, words = (int(x or 0) for x in size)
    cores = spark.sparkContext.defaultParallelism
    model = Model(spark, trained, 1, max(hot_context, tokens // 4096))
    bucketed = chunks.groupBy("chunk")
    for n in range(1, order + 1):
        model.parts = max(1, min(cores, (words if n == 1 else tokens) // 10_000), -(-(words if n == 1 else tokens) // part_keys))
        if n == 1:
            model.counted(chunks.mapInArrow(_ask_words(model.parts), ASK_SCHEMA), count_words(model.parts))
        else:
            asked = bucketed.cogroup(model.answers(n - 1).groupBy("chunk")).applyInArrow(_asking(_known(model)), ASK_SCHEMA)
            model.counted(asked, count_pairs(model.parts, n == order, model.orders[0]))
    return bucketed.cogroup(model.answers(order).groupBy("chunk")).applyInArrow(_scoring(_known(model)), SCORE_SCHEMA), model


def _known(model: Model) -> dict:
    return {"orders": list(model.orders), "trained": model.trained, "parts": model.parts, "hot_context": model.hot_context}


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 5 is not 1."""
    return score_texts(docs, crc_fold(F.col("doc_id"), 5) != 1, order)[0]
