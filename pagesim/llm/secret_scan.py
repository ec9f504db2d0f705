"""Secrets in texts: fixed patterns, and character Markov models for random strings (operator 10).

Two first-order Markov models over the characters of keys and names are trained from the whole corpus,
each distinct run counting once: values that the fixed patterns mark are random strings, other long runs
of these characters are ordinary identifiers, unless the models themselves call them random. As secrets
are among the unmarked runs, each of these is judged by the others, without its own counts, and
what is more likely random leaves the ordinary model, until none changes. A run outside the marked
spans is a secret when it is more likely under the model of random strings.

A null or empty text has no span. Overlapping spans of different kinds are all kept, as the kinds are
searched apart; ``markov`` spans never overlap others. Positions are code points, ends exclusive."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesim.llm.text import narrow, slices
from pagesim.session import at_least_partitions, materialize

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # equal to AKIA[A-Z0-9]+ of 16 or more characters
HEX = re.compile(r"[0-9a-f]{32,}")  # equal to [0-9a-f]+ of 32 or more characters
KINDS = ("assign", "access", "hex", "markov")

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Weight of the uniform prior in each cell of both models, and the mean log-likelihood ratio of a secret.
RANDOM_PRIOR, ORDINARY_PRIOR, THRESHOLD = 2.0, 0.5, 0.0
#: Most times that the runs are judged; mostly three are enough.
ROUNDS = 12
_INDEX = np.zeros(128, np.int64)
_INDEX[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    return out + [(*m.span(), 2) for m in HEX.finditer(text)]


def free_runs(text: str, taken: list) -> list[tuple[int, int]]:
    """Long runs of key characters that touch no taken span."""
    return [m.span() for m in RUN.finditer(text)
            if not any(a < m.end() and m.start() < b for a, b, _ in taken)]


def transitions(run: str) -> np.ndarray:
    """The transitions of a run, as numbers of cells of the transition matrix."""
    at = _INDEX[np.frombuffer(run.encode("ascii"), np.uint8)]
    return at[:-1] * len(LETTERS) + at[1:]


def log_table(counts: np.ndarray, prior: float) -> np.ndarray:
    """Log-likelihoods of all transitions; unseen ones follow a uniform prior with this weight in each cell."""
    m = counts.reshape(len(LETTERS), -1) + prior
    return np.log(m / m.sum(1, keepdims=True)).ravel()


def is_ordinary(run: np.ndarray, random: np.ndarray, rounds: list[np.ndarray]) -> bool:
    """Whether an unmarked run counts as ordinary after these rounds, each given by the transition counts of
    the ordinary runs at its start. A run that is among them is judged without its own counts."""
    (_, cell, cells), (_, row, rows) = (np.unique(x, return_inverse=True, return_counts=True) for x in (run, run // len(LETTERS)))
    ordinary = True
    for counts in rounds:
        seen = counts[run] - ordinary * cells[cell] + ORDINARY_PRIOR
        every = counts.reshape(len(LETTERS), -1).sum(1)[run // len(LETTERS)] - ordinary * rows[row] + ORDINARY_PRIOR * len(LETTERS)
        ordinary = bool((random[run] - np.log(seen / every)).mean() <= THRESHOLD)
    return ordinary


def train(docs: DataFrame) -> tuple[np.ndarray, float]:
    """The table of log-likelihood ratios and the threshold. Only counts of bounded number reach the driver."""
    cells = len(LETTERS) ** 2

    def find(batches):
        for batch in slices(batches):
            found = set()
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    found.update((0, run) for a, b, _ in base for run in RUN.findall(text[a:b]))
                    found.update((1, text[a:b]) for a, b in free_runs(text, base))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())],
                                             names=["kind", "run"])

    runs = at_least_partitions(materialize(narrow(docs).mapInArrow(find, "kind int, run string").distinct(), "secret-runs"))

    def total(kind: int, keep) -> np.ndarray:
        def count(batches):
            found = np.zeros(cells, np.int64)
            for batch in batches:
                for run in map(transitions, batch.column("run").to_pylist()):
                    if keep(run):
                        np.add.at(found, run, 1)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["cell", "n"])

        out = np.zeros(cells, np.int64)
        counted = runs.where(F.col("kind") == kind).select("run").mapInArrow(count, "cell long, n long")
        for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r.cell] = r.n
        return out

    random = log_table(total(0, lambda run: True), RANDOM_PRIOR)
    rounds = [total(1, lambda run: True)]
    while len(rounds) < ROUNDS:
        known = list(rounds)
        rounds.append(total(1, lambda run: is_ordinary(run, random, known)))
        if (rounds[-1] == rounds[-2]).all():
            break
    return random - log_table(rounds[-1], ORDINARY_PRIOR), THRESHOLD


def all_spans(text: str, table: np.ndarray, threshold: float) -> tuple[list, list]:
    """Base spans and base plus model spans, each by start, then kind, then end."""
    base = base_spans(text)
    more = [(a, b, 3) for a, b in free_runs(text, base) if table[transitions(text[a:b])].mean() > threshold]
    by_start = lambda s: (s[0], s[2], s[1])
    return sorted(base, key=by_start), sorted(base + more, key=by_start)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """One row per document: counts per kind, the digest of the base spans, and all spans."""
    table, threshold = model or train(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                        ("base_sha256", pa.string()), ("spans", pa.string()), ("n_markov", pa.int64())])

    def scan(batches):
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, spans = all_spans(text or "", table, threshold)
                n = [sum(k == kind for *_, k in spans) for kind in range(4)]
                rows.append((doc, *n[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), n[3]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return narrow(docs).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, "
                                         "base_sha256 string, spans string, n_markov long")
