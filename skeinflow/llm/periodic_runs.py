"""Periodic runs of words (text that a generator repeats in a loop) by harmonic grid probing.

A run is a stretch of words with smallest period q, of at least ``max(least_words, 4 * q)`` words, that no
neighbour extends. Every stretch of at least four periods covers three grid points 0, p, 2p, ... in a row whose
words equal those one period on, so testing word jp against word (j+1)p finds a point of it: n/p tests for
period p, n ln n in all. Periods are tested in octaves, all tests of an octave at once. Where three tests in a
row hold, the stretch is extended both ways by chunked comparison of the arrays. Smaller periods come first, and
grid points inside a found run whose period divides p are skipped: a stretch with such a period is that run (an
octave never holds two periods of which one divides the other).

Cases: a null text has no words; null ids are rows like others, and no loop is planted into them; texts of any
length are read whole, with memory of some multiple of their words (a document is one task's affair); ties go to
the smallest start, then period; repeated rows stay rows of their own; an empty table gives an empty result;
columns that the result doesn't name are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Grid tests that are done at once.
TESTS = 1 << 20
#: Words that an extension compares first; each further comparison takes twice as many.
CHUNK = 16


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: white space of bytes is just that."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _forward(ids: np.ndarray, at: int, p: int) -> int:
    """The first position from ``at`` on whose word differs from the one p later, or the last without one."""
    end, size = len(ids) - p, CHUNK
    while at < end:
        stop = min(at + size, end)
        differs = np.flatnonzero(ids[at:stop] != ids[at + p : stop + p])
        if len(differs):
            return at + int(differs[0])
        at, size = stop, size * 2
    return end


def _backward(ids: np.ndarray, at: int, p: int) -> int:
    """The first position of the equal stretch that ends behind ``at``."""
    size = CHUNK
    while at > 0:
        start = max(at - size, 0)
        differs = np.flatnonzero(ids[start:at] != ids[start + p : at + p])
        if len(differs):
            return start + int(differs[-1]) + 1
        at, size = start, size * 2
    return 0


def _octave_slices(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of periods, none across an octave, with at most TESTS tests each (one period at least)."""
    top, low = n // LEAST_PERIODS, 1
    while low <= top:
        octave, a = min(2 * low, top + 1), low
        while a < octave:
            b = min(octave, a + max(1, TESTS * a // n))
            yield a, b
            a = b
        low *= 2


def _surviving(ids: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(periods, positions) of the grid points of periods a to b - 1 that start three equal steps, by period."""
    n = len(ids)
    periods = np.arange(a, b)
    counts = (n - 1) // periods  # tests per period
    p = np.repeat(periods, counts)
    at = (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * p
    equal = ids[at] == ids[at + p]
    hit = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:] & (p[2:] == p[:-2]))
    p, at = p[hit], at[hit]
    half = at + p // 2  # one more word of the stretch
    whole = ids[half] == ids[half + p]
    return p[whole], at[whole]


def _uncovered(p: np.ndarray, at: np.ndarray, found: dict[int, list[tuple[int, int]]]) -> np.ndarray:
    """Whether no found run of a divisor of the period holds the word and the one a period on."""
    free = np.ones(len(p), bool)
    for q, runs in found.items():
        own = np.flatnonzero(free & (p % q == 0))
        if len(own):
            starts, ends = np.array(runs).T  # runs of one period start and end in the same order
            last = np.searchsorted(starts, at[own], "right") - 1
            free[own[(last >= 0) & (ends[last] > at[own] + p[own])]] = False
    return free


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b in _octave_slices(len(ids)):
        p, at = _surviving(ids, a, b)
        if len(p):
            free = _uncovered(p, at, found)
            last, end = 0, 0
            for q, i in zip(p[free].tolist(), at[free].tolist(), strict=True):
                if q == last and i + q < end:
                    continue  # inside the stretch before
                start, stop = _backward(ids, i, q), _forward(ids, i, q)
                last, end = q, stop + q
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.setdefault(q, []).append((start, end))
    return sorted((start, end - start, q) for q, spans in found.items() for start, end in spans)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those behind the first period of a run."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, q in found:
        gone[start + q] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, in a tenth of the documents with a loop from some word on: a test of the search on any corpus."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RESULT = "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _described(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(words), len(found), *longest, digest(listed.encode()), digest(b" ".join(collapsed(words, found)))


def run_digests(docs: DataFrame, plant: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of words and runs, the longest run, and digests of all runs and of the text without
    their repetitions. ``plant`` puts loops into a tenth of the documents first."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = planted(words_of(t), id_) if plant else words_of(t)
                rows.append(_described(words, runs(numbered(words))))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *[c.split()[0] for c in RESULT.split(", ")]])

    return docs.select(doc_id, text).mapInArrow(search, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {RESULT}")


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, period of every run, and ``repeated``, the words of its first period."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, t in enumerate(batch.column(1).to_pylist()):
                words = words_of(t)
                rows += [(row, *r, b" ".join(words[r[0] : r[0] + r[2]]).decode("utf-8", "surrogatepass")) for r in runs(numbered(words))]
            row, *made = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in made[:3]], pa.array(made[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "period", "repeated"])

    return docs.select(doc_id, text).mapInArrow(search, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, start bigint, length bigint, period bigint, repeated string")


def without_repetitions(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, of texts that hold runs only the first period of each left, words joined by one space; texts without
    runs, and null, stay as they are."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(text).to_pylist():
                words = words_of(t)
                found = runs(numbered(words))
                out.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass") if found else t)
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

    return docs.mapInArrow(collapse, docs.schema)
