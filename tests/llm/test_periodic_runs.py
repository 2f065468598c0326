"""Runs of words against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from skeinflow.llm import periodic_runs, queries

SMALL = "/root/testdata/sf0.001"
rnd = random.Random(11)


def plain_runs(words):
    """Every period's maximal stretches; of equal stretches the one of the smallest period."""
    n, seen = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            start = i
            while i < n - p and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= 2 * p:
                seen.setdefault((start, i + p), p)
            i += i == start
    return sorted((s, e - s, p) for (s, e), p in seen.items() if e - s >= max(6, 4 * p))


def looped(n, kinds, loops):
    words = [rnd.randrange(kinds) for _ in range(n)]
    for _ in range(loops if n else 0):
        a, p = rnd.randrange(n), rnd.randint(1, 20)
        for i in range(a + p, min(n, a + rnd.randint(1, 120))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("kinds", [1, 2, 3, 5, 40])
def test_runs_equal_a_plain_search(kinds):
    total = 0
    for _ in range(250):
        words = looped(rnd.randint(0, 150), kinds, rnd.randint(0, 4))
        expected = plain_runs(words)
        total += len(expected)
        assert periodic_runs.runs(np.array(words, np.int32)) == expected, words
    assert total > 20


def test_runs_do_not_depend_on_the_size_of_slices(monkeypatch):
    cases = [np.array(looped(400, 3, 6), np.int32) for _ in range(30)]
    whole = [periodic_runs.runs(c) for c in cases]
    monkeypatch.setattr(periodic_runs, "TESTS", 7)
    monkeypatch.setattr(periodic_runs, "CHUNK", 1)
    assert [periodic_runs.runs(c) for c in cases] == whole


def test_long_loops():
    assert periodic_runs.runs(np.zeros(100_000, np.int32)) == [(0, 100_000, 1)]
    assert periodic_runs.runs(np.tile(np.arange(7), 5_000).astype(np.int32)) == [(0, 35_000, 7)]
    nested = np.tile(np.repeat(np.arange(3), 6), 4).astype(np.int32)  # runs of one word inside a run of 18
    found = periodic_runs.runs(nested)
    assert (0, 72, 18) in found and len(found) == 13 == len(plain_runs(nested.tolist()))


def plain_digests(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return n, len(found), *longest, digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_query_equals_a_plain_search(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    short = {d: t for d, t in texts.items() if len(t or "") < 30_000}
    found = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert found.keys() == texts.keys()
    for d, t in short.items():
        assert tuple(found[d])[1:] == plain_digests(d, t, True), d
    assert sum(r["n_runs"] for r in found.values()) > 5


TEXTS = [None, "", " \t\n", "one", "ha " * 50, "ha " * 50, "a b a b\x0ba b a b\ta b a b", "🙂 é " * 9 + "end", "a b c d " * 4 + "x " * 6, "p q r " * 300]


def test_cases(spark):
    rows = [(None if i == 4 else i, t, "x", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string, n_runs int")
    found = sorted((tuple(r) for r in periodic_runs.run_digests(docs).drop("doc_id").collect()), key=str)
    assert found == sorted((plain_digests(None, t, False) for t in TEXTS), key=str)
    listed = {(r["doc_id"], r["start"], r["length"], r["period"], r["repeated"]) for r in periodic_runs.find_runs(docs).collect()}
    assert (7, 0, 18, 2, "🙂 é") in listed and (None, 0, 50, 1, "ha") in listed and (6, 0, 6, 1, "a b") in listed
    kept = {r["n_runs"]: r["text"] for r in periodic_runs.without_repetitions(docs).collect()}
    assert kept[0] is None and kept[2] == TEXTS[2] and kept[4] == "ha" and kept[7] == "🙂 é end" and kept[8] == "a b c d x" and kept[9] == "p q r"
    assert periodic_runs.run_digests(docs.limit(0)).count() == periodic_runs.find_runs(docs.limit(0)).count() == 0
