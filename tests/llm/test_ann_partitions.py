"""Nearest neighbours over learned partitions against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import ann_partitions as ann
from skeinflow.llm import queries

SCHEMA = "vec_id long, embedding array<float>, score string, part int"
rng = np.random.default_rng(3)


def plain(rows, k=5, every=50):
    """By id: the k best (vec_id, score) of each query."""
    of = [(i, np.array(v, np.float64)) for i, v in rows]
    out = {}
    for i, q in of:
        if i % every == 0:
            near = {}
            for j, v in of:
                if i != j:
                    s = float((q * v).sum() / (math.sqrt((q * q).sum()) * math.sqrt((v * v).sum())))
                    near[j] = max(near.get(j, -2), s)
            out[i] = sorted(near.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", 1) for i, v in rows], SCHEMA)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def same(a, b):
    return a.keys() == b.keys() and all([x[0] for x in a[q]] == [x[0] for x in b[q]] and np.allclose([x[1] for x in a[q]], [x[1] for x in b[q]], atol=1e-12) for q in a)


def recall(a, b):
    return sum(len({x[0] for x in a[q]} & {x[0] for x in b[q]}) for q in b) / sum(map(len, b.values()))


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert same(found(queries.op11_ann_partitions(spark, "/root/testdata/sf0.001")), plain(rows))


def test_recall_of_several_parts(spark):
    """The given vectors (which have no clusters) and clustered ones; the latter need few probes."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    result, truth = found(ann.search(given, F.col("vec_id") % 50 == 0, config=ann.AnnConfig(part_rows=100))), plain([(r["vec_id"], r["embedding"]) for r in given.collect()])
    assert result.keys() == truth.keys() and recall(result, truth) >= 0.9
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.2 * rng.standard_normal(16)).astype(np.float32)) for i in range(3000)]
    unit = ann.units(np.array([v for _, v in rows], np.float64))
    router = ann.train(unit, 3000, 5, ann.AnnConfig(part_rows=150))
    assert router.parts() == 16 and router.probes <= 6
    result, truth = found(ann.search(table(spark, rows), F.col("vec_id") % 50 == 0, config=ann.AnnConfig(part_rows=150))), plain(rows)
    assert recall(result, truth) >= 0.9


def test_parts_are_balanced_and_cut_few_edges():
    unit = ann.units(np.repeat(rng.standard_normal((8, 12)), 64, axis=0) + 0.05 * rng.standard_normal((512, 12)))
    near = ann.nearest_in_sample(unit, 10)
    part = ann.balanced_parts(near, 3)
    assert set(np.bincount(part)) == {64}
    assert (part[near] == part[:, None]).mean() > 0.8


@pytest.mark.parametrize("config", [ann.AnnConfig(), ann.AnnConfig(block_rows=7, chunk_queries=2)])
def test_ties_copies_and_odd_vectors(spark, config):
    good = [(i, rng.integers(-2, 3, 4) + np.array([0, 0, 0, 5])) for i in range(0, 120)]
    good += [(i, [1, 2, 3, 4]) for i in range(200, 300)] + [(i, [2, 4, 6, 8]) for i in range(300, 320)]  # copies, and the same direction
    good += [(-50, [0, 0, 0, 1]), (150, [1, 2, 3, 4])]
    odd = [(1, None), (50, None), (1000, [0, 0, 0, 0]), (1050, [1, None, 2, 3]), (1100, [1, float("nan"), 0, 0]), (1150, [float("inf"), 1, 1, 1]), (1200, []), (1250, [1, 2]), (None, [1, 2, 3, 4])]
    result = found(ann.search(table(spark, good + odd + good[:30]), F.col("vec_id") % 50 == 0, config=config))
    truth = plain(good)
    assert result.keys() == truth.keys()
    for q in truth:  # equal directions may differ in the last digit
        assert np.allclose([x[1] for x in result[q]], [x[1] for x in truth[q]], atol=1e-12), q
    assert [x[0] for x in result[250]][:5] == [150, 200, 201, 202, 203]


def test_few_and_no_vectors(spark):
    assert found(ann.search(table(spark, [(0, [1, 0]), (7, [1, 1])]), F.col("vec_id") % 50 == 0)) == {0: [(7, 1 / math.sqrt(2))]}
    assert ann.search(table(spark, [(0, [1, 0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_very_large_and_small_components():
    v = np.array([[1e300, 1e300], [1e-300, 0]])
    assert np.allclose(ann.units(ann.scaled(v)), [[2**-0.5, 2**-0.5], [1, 0]])
