"""Collocations against plain counts of phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from skeinflow.llm import collocations

rnd = random.Random(5)
SCHEMA = "doc_id long, text string, lang string, phrase string, rank int"


def plain(rows, least, covered=50, top=2000):
    f, n = Counter(), Counter()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(fold)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *w), a in candidates.items():
        if any(100 * b >= covered * a for q, b in candidates.items() if len(q) > len(w) + 1 and q[0] == lang and any(list(q[1 + i : 1 + i + len(w)]) == w for i in range(len(q) - len(w)))):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place = Counter()
    ranked = []
    for r in out:
        place[r[0]] += 1
        if place[r[0]] <= top:
            ranked.append((r[0], place[r[0]], *r[1:]))
    return ranked


def texts(n):
    words = ["a", "A", "b", "to", "the", "Zé", "你好", "\x1f", "x\xa0y", "\x85", "q-r"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?", " ; "]
    out = ["".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [*out, None, "", " . ", "the the the the the", "to be or " * 300]


@pytest.mark.parametrize("shard_words,part_counts,least", [(1 << 20, 1 << 21, 3), (50, 40, 3), (7, 1, 12), (300, 100, 10_000)])
def test_equals_plain_counts(spark, shard_words, part_counts, least):
    rows = [(i, t, rnd.choice(["en", "de", None]), "p", 0) for i, t in enumerate(texts(60))]
    rows += [(None, rows[0][1], "en", None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = collocations.collocations(docs, least=least, shard_words=shard_words, part_counts=part_counts)
    expected = plain([r[1:3] for r in rows], least)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected) and (expected or least > 1000)


def test_top_and_ties(spark):
    rows = [(i, "u v. w x. y z", "en", "", 0) for i in range(4)]
    found = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=2, top=2).collect()
    assert [(r["rank"], r["phrase"], r["score"]) for r in sorted(found)] == [(1, "u v", 1_000_000), (2, "w x", 1_000_000)]


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 4_123_456_789_012, 5_000_000_000_123, 4_200_000_000_777  # noqa: E741
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (l * r)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packed_columns_come_back():
    for n in (0, 1, 1000):
        columns = [np.sort(np.array([rnd.randrange(-(1 << 40), 1 << 62) for _ in range(n)], np.int64)), np.arange(n)[::-1].copy()]
        assert (collocations.unpacked(collocations.packed(*columns), 2) == np.array(columns)).all()


def test_bitmaps_cross_blocks():
    words = np.array([0, 1] * 100 + [-1] + [1, 0] * 64)
    found = {}
    for keys, counts in collocations.pairs_of(collocations.Bitmaps(words, 2), 2):
        found |= dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert found == {0 * 2 + 1: 100 + 63, 1 * 2 + 0: 99 + 64}
