"""Token ids as raw files, found by document key through a minimal perfect hash (operator 3).

A shard is two files. ``*.ids`` holds nothing but ids, document after document, as little-endian
unsigned integers. ``*.idx`` holds the keys, the record ends and a minimal perfect hash over the
shard's distinct keys: levels of bit arrays, where a key owns the bit at its hash on the first level
on which no other key shares it; the number of set bits before that bit is its slot. A slot stores a
32-bit fingerprint, the first record of its key and how many records the key has, so a lookup costs
the same few reads however many documents there are.

Null doc_ids come first, are kept as records and have no key in the index. A doc_id that occurs
again keeps all of its records, next to one another; they may lie in two neighbouring shards. A null
text is an empty one. An empty table gives an empty manifest and no file."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesim.llm.text import slices
from pagesim.llm.tokens import crc_of_ids, encoder
from pagesim.session import materialize, qualified, scratch_path

NO_KEY = np.iinfo(np.int64).min
LEVEL_GAMMA, MAX_LEVELS = 2.0, 40
READ_IDS = 1 << 21
MANIFEST = ("part long, file string, n_docs long, n_tokens long, first_key long, last_key long, "
            "id_bytes int")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizing hash of the keys under a seed."""
    x = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []  # set bits before each byte, per level
        total = 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.size = total

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        levels, left = [], np.unique(keys)
        while len(left):
            if len(levels) > MAX_LEVELS:
                raise RuntimeError("keys do not separate")
            size = max(64, int(LEVEL_GAMMA * len(left)) + 7 & ~7)
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            own = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(own, bitorder="little"))
            left = left[~own[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that hit no level (then surely not a member)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[hit]] = (self.before[level][at >> 3] + below)[hit]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, by its scheme; a path without one is a file."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Writer:
    """One shard under a name of its own attempt, so a repeated task never meets another's file."""

    def __init__(self, folder: str, part: int, id_bytes: int):
        self.file, self.id_bytes, self.part = f"shard-{part:06d}-{uuid.uuid4().hex}", id_bytes, part
        self.fs, root = _file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{self.file}"
        self.out = self.fs.open_output_stream(self.path + ".ids")
        self.keys, self.counts = [], []

    def add(self, keys: list, ids: list[np.ndarray]) -> None:
        self.out.write(b"".join([x.tobytes() for x in ids]))
        self.keys.append(np.array([NO_KEY if k is None else k for k in keys], np.int64))
        self.counts.append(np.array([len(x) for x in ids], np.int64))

    def close(self) -> dict:
        self.out.close()
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        own, first, number = np.unique(keys, return_index=True, return_counts=True)
        real = own != NO_KEY
        own, first, number = own[real], first[real], number[real]
        table = PerfectHash.of(own)
        slot = table.slots(own)
        prints, start, length = np.zeros(len(own), "<u4"), np.zeros(len(own), "<i8"), np.zeros(len(own), "<i8")
        prints[slot], start[slot], length[slot] = fingerprints(own), first, number
        parts = [keys.astype("<i8"), np.cumsum(counts).astype("<i8"), prints, start, length, *table.levels]
        head = json.dumps({"id_bytes": self.id_bytes, "records": len(keys), "keys": len(own),
                           "levels": [len(x) for x in table.levels]}).encode()
        with self.fs.open_output_stream(self.path + ".idx") as out:
            out.write(len(head).to_bytes(4, "little") + head)
            for x in parts:
                out.write(x.tobytes())
        return {"part": self.part, "file": self.file, "n_docs": len(keys), "n_tokens": int(counts.sum()),
                "first_key": int(own[0]) if len(own) else None, "last_key": int(own[-1]) if len(own) else None,
                "id_bytes": self.id_bytes}


class Shard:
    """An opened shard: its index is in memory, its ids are read by offset."""

    def __init__(self, folder: str, file: str):
        self.fs, root = _file_system(folder)
        self.path = f"{root}/{file}"
        with self.fs.open_input_stream(self.path + ".idx") as f:
            raw = f.read()
        n = int.from_bytes(raw[:4], "little")
        head, at = json.loads(raw[4:4 + n]), 4 + n

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(raw, dtype, count, at)
            at += out.nbytes
            return out

        self.dtype = np.dtype(f"<u{head['id_bytes']}")
        self.keys, self.ends = take("<i8", head["records"]), take("<i8", head["records"])
        self.prints, self.first, self.number = (take(d, head["keys"]) for d in ("<u4", "<i8", "<i8"))
        self.hash = PerfectHash([take("u1", n) for n in head["levels"]])
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; number 0 where the fingerprint differs."""
        keys = np.asarray(keys, np.int64)
        if not self.hash.size:
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slot = self.hash.slots(keys)
        here = (slot >= 0) & (self.prints[slot] == fingerprints(keys))
        return np.where(here, self.first[slot], -1), np.where(here, self.number[slot], 0)

    def records(self, numbers: np.ndarray):
        """Ids of the records, in blocks of neighbours of bounded size."""
        at = 0
        with self.fs.open_input_file(self.path + ".ids") as f:
            while at < len(numbers):
                first, to = numbers[at], at + 1
                while (to < len(numbers) and numbers[to] == numbers[to - 1] + 1
                       and self.ends[numbers[to]] - self.starts[first] <= READ_IDS):
                    to += 1
                low, high = self.starts[first], self.ends[numbers[to - 1]]
                ids = np.frombuffer(f.read_at(int(high - low) * self.dtype.itemsize, int(low) * self.dtype.itemsize), self.dtype)
                for r in numbers[at:to]:
                    yield ids[self.starts[r] - low:self.ends[r] - low]
                at = to


class TokenStore:
    """Keyed access over all shards of a manifest: two binary searches, then one perfect-hash probe."""

    def __init__(self, folder: str, manifest: list):
        self.folder = folder
        self.rows = sorted((r for r in manifest if r["first_key"] is not None), key=lambda r: r["part"])
        self.first = np.array([r["first_key"] for r in self.rows], np.int64)
        self.last = np.array([r["last_key"] for r in self.rows], np.int64)
        self.open: dict[str, Shard] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every record of the key; an empty list for a key that is not there."""
        out = []
        for k in range(int(np.searchsorted(self.last, key)), int(np.searchsorted(self.first, key, "right"))):
            file = self.rows[k]["file"]
            if file not in self.open:
                self.open[file] = Shard(self.folder, file)
            shard = self.open[file]
            first, number = shard.locate(np.array([key]))
            for ids in shard.records(np.arange(first[0], first[0] + number[0])):
                if shard.keys[first[0]] == key:
                    out.append(ids.copy())
        return out


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode ``docs`` and write shards in ascending doc_id order; returns the manifest, already written.

    Texts move once, dealt by ranges of (doc_id, text hash), so no id of any number of rows fills a
    task; ids are written where they arise. ``folder`` must be one that all executors reach."""
    sort = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    moved = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .repartitionByRange(*sort).sortWithinPartitions(*sort))

    def write(batches):
        encode, writer = encoder(tokenizer), None
        for batch in slices(batches):
            ids = encode.encode(batch.column("text").to_pylist(), end_id)
            writer = writer or _Writer(folder, TaskContext.get().partitionId(), encode.dtype.itemsize)
            writer.add(batch.column("doc_id").to_pylist(), ids)
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close()], schema=pa.schema(
                [("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                 ("first_key", pa.int64()), ("last_key", pa.int64()), ("id_bytes", pa.int32())]))

    return materialize(moved.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, read back from the files through the index: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards = manifest.count()

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["file"])
                keys = shard.keys
                known = keys != NO_KEY
                # every key through the index: where its records begin, and how many there are
                own, at = np.unique(keys[known], return_index=True)
                first, number = shard.locate(own[np.argsort(at)])
                inside = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
                record = np.concatenate([np.flatnonzero(~known), np.repeat(first, number) + inside]).astype(np.int64)
                if len(record) != len(keys) or not np.array_equal(np.sort(record), np.arange(len(keys))):
                    raise ValueError(f"the index of {row['file']} does not find each of its records once")
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for r, ids in zip(record, shard.records(record)):
                    out["doc_id"].append(None if keys[r] == NO_KEY else int(keys[r]))
                    out["start"].append(row["base"] + int(shard.starts[r]))
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(crc_of_ids(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return (placed.repartition(max(1, shards), "part")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0,
                folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token shards and return what the files hold, one row per document."""
    folder = qualified(spark, folder or scratch_path(spark, "token-shards"))
    return read_token_shards(write_token_shards(docs, folder, tokenizer, end_id), folder)
