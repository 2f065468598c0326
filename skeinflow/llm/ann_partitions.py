"""Approximate nearest neighbours by cosine over learned partitions.

A bounded sample of the vectors (``sample`` of them, of the smallest hashes) gets a graph of its nearest
neighbours, which is cut into equal parts by recursive spectral bisection and exchanges between the halves. A
small network learns from the sample to which parts a vector's neighbours belong. It puts every vector of the
table into its most probable part and routes a query to its ``probes`` most probable ones, the fewest that hold
``recall`` of the neighbours of held-out sample vectors. There every vector is compared in double precision.

Equal vectors are searched as one, which carries as many of their smallest ids as a result can show, so a vector
that a third of the table shares costs as much as any. Parts of many vectors are dealt to blocks, parts of many
queries to chunks; a task holds one block and one chunk. Only the network, the sample and counts per part pass
through the driver. Few vectors have one part, and the search is exact.

Cases: null, empty and zero vectors, those with null or non-finite components, null ids and vectors of another
length than most (of equally common lengths, the longer) take no part; repeated rows count once; of an id with
several vectors each is searched and found, the best score of a pair counts; ties go to the smaller id; an empty
table gives no rows; other columns aren't read. What a result reads stays in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.common import Scratch


@dataclass(frozen=True)
class AnnConfig:
    sample: int = 8192  #: vectors that the graph and the network are made of, at most
    sample_values: int = 1 << 23  #: and their components, at most
    neighbours: int = 10  #: of a vector in the graph
    part_rows: int = 512  #: vectors of a part, as long as the sample has part_sample vectors for each
    part_sample: int = 32
    recall: float = 0.95  #: of held-out sample vectors
    hidden: int = 64
    epochs: int = 30
    block_rows: int = 4096  #: vectors that a task compares with
    chunk_queries: int = 2048  #: queries that a task has at once


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer over unit vectors: the probability of each part."""

    weights: tuple[np.ndarray, ...]
    probes: int

    def parts(self) -> int:
        return self.weights[3].shape[0]

    def ranked(self, unit: np.ndarray, k: int) -> np.ndarray:
        """The k most probable parts of each vector, of equal ones the smaller first."""
        return np.argsort(-_forward(self.weights, unit)[1], axis=1, kind="stable")[:, :k].astype(np.int32)


def _forward(weights: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ weights[0] + weights[1], 0)
    return hidden, hidden @ weights[2] + weights[3]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that squares neither overflow nor vanish and no digit changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0))[1])


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of scaled doubles."""
    values = pa.chunked_array(column) if isinstance(column, pa.Array) else column
    flat = values.combine_chunks().flatten() if len(values) else pa.array([], pa.float64())
    return scaled(np.asarray(flat, np.float64).reshape(len(values), -1 if len(values) else 1))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / norms(vectors)[:, None]


# --- the sample: graph, parts, network


def nearest_in_sample(unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other vectors of each, in blocks."""
    out = np.zeros((len(unit), k), np.int64)
    for a in range(0, len(unit), 1024):
        near = unit[a : a + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(neighbours: np.ndarray, levels: int, seed: int = 1) -> np.ndarray:
    """A part of 2 ** levels for each node, their sizes as equal as halving allows, with few edges between
    parts: each level halves every part at the median of its slowest diffusion, then exchanges nodes between
    the halves while both sides' edges gain."""
    n, k = neighbours.shape
    source, target = np.repeat(np.arange(n), k), neighbours.ravel()
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    part, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    for _ in range(levels):
        inside = part[source] == part[target]
        a, b = source[inside], target[inside]
        degree, sizes = np.bincount(a, minlength=n) + 1, np.bincount(part)
        x = rng.standard_normal(n)
        for _ in range(40):
            x = (x + (np.bincount(a, x[b], n) + x) / degree) / 2
            x -= (np.bincount(part, x) / sizes)[part]
            x /= np.sqrt(np.bincount(part, x * x) / sizes + 1e-300)[part]
        half = _upper_half(part, x)
        for _ in range(6):
            across = half[a] != half[b]
            gain = np.bincount(a, np.where(across, 1.0, -1.0), n)
            half = _exchanged(part, half, gain + rng.random(n) * 1e-3, rng)
        part = 2 * part + half
    return part


def _ranks(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each node within its group by x."""
    order = np.lexsort((x, group))
    sizes = np.bincount(group)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return place


def _upper_half(part: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (2 * _ranks(part, x) >= np.bincount(part)[part]).astype(np.int64)


def _exchanged(part: np.ndarray, half: np.ndarray, gain: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """half after every second pair, by gain, of nodes of both halves has changed places if both gain together."""
    own = 2 * part + half
    place = _ranks(own, -gain)
    low, high = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
    key = lambda i: part[i] * len(part) + place[i]
    low, high = low[np.argsort(key(low))], high[np.argsort(key(high))]
    _, i, j = np.intersect1d(key(low), key(high), assume_unique=True, return_indices=True)
    low, high = low[i], high[j]
    swap = (gain[low] + gain[high] > 0) & (rng.random(len(low)) < 0.5)
    half = half.copy()
    half[low[swap]], half[high[swap]] = 1, 0
    return half


def fitted(unit: np.ndarray, target: np.ndarray, config: AnnConfig, seed: int = 2) -> tuple[np.ndarray, ...]:
    """Weights of the network after Adam on the cross entropy with the target distributions."""
    rng, (n, d), parts = np.random.default_rng(seed), unit.shape, target.shape[1]
    weights = [rng.standard_normal((d, config.hidden)) * np.sqrt(2 / d) * np.sqrt(d), np.zeros(config.hidden), rng.standard_normal((config.hidden, parts)) * np.sqrt(1 / config.hidden), np.zeros(parts)]
    first, second, step, rate = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0, 3e-3
    for _ in range(config.epochs):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            x, y = unit[order[a : a + 256]], target[order[a : a + 256]]
            hidden, out = _forward(tuple(weights), x)
            p = np.exp(out - out.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - y) / len(x)
            back = (error @ weights[2].T) * (hidden > 0)
            step += 1
            for i, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] -= rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(weights)


def train(unit: np.ndarray, rows: int, k: int, config: AnnConfig = AnnConfig()) -> Router:
    """A router for ``rows`` vectors, of which the unit vectors are a sample."""
    n = len(unit)
    levels = int(np.log2(max(1, min(rows / config.part_rows, n / config.part_sample))))
    if levels == 0:
        d = unit.shape[1] if n else 1
        return Router((np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1)
    neighbours = nearest_in_sample(unit, config.neighbours)
    part, parts = balanced_parts(neighbours, levels), 1 << levels
    target = np.zeros((n, parts))
    for column in (np.arange(n), *neighbours.T):
        np.add.at(target, (np.arange(n), part[column]), 1 / (1 + config.neighbours))
    held = np.arange(n) % 8 == 0  # the sample is in the order of a hash
    weights = fitted(unit[~held], target[~held], config)
    router = Router(weights, parts)
    home = router.ranked(unit, 1)[:, 0]
    ranked = router.ranked(unit[held], parts)
    place = np.argsort(ranked, axis=1)  # of each part in a query's order
    true = np.sort(-(unit[held] @ unit.T) + np.where(np.flatnonzero(held)[:, None] == np.arange(n), np.inf, 0), axis=1)[:, : k].max(axis=1)
    near = (-(unit[held] @ unit.T) <= true[:, None]) & (np.flatnonzero(held)[:, None] != np.arange(n))
    query, found = np.nonzero(near)
    needed = np.sort(place[query, home[found]])
    probes = int(needed[min(len(needed) - 1, int(np.ceil(config.recall * len(needed))) - 1)]) + 1
    return Router(weights, probes)


# --- the table


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vec of the rows that take part."""
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vec")).where("vec_id is not null and vec is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    own = own.where(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))
    lengths = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return own.where(F.size("vec") == (lengths["n"] if lengths else 0))


def classes(own: DataFrame, k: int) -> DataFrame:
    """vec, ids: each distinct vector with its k + 1 smallest ids. Tasks keep no more of a vector before the
    shuffle (repeated rows apart, which share a rank)."""
    w = Window.partitionBy("vec").orderBy("vec_id")
    few = own.withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def _routed(df: DataFrame, router: Router, k: int, out: str) -> DataFrame:
    """df with ``out``: the k most probable parts of its ``vec``."""
    schema = T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            ranked = router.ranked(units(matrix(batch.column("vec"))), k) if batch.num_rows else np.zeros((0, k), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ranked) + 1) * k, pa.int32()), pa.array(ranked.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def _spread(counts: dict[int, int], size: int) -> Column:
    """Into how many blocks of about ``size`` rows each part goes."""
    blocks = [-(-counts.get(p, 0) // size) or 1 for p in range(max(counts, default=0) + 1)]
    return F.coalesce(F.get(F.from_json(F.lit(str(blocks)), "array<int>"), F.col("part")), F.lit(1))


def _compared(k: int, id_type: str):
    """(query_id, score, ids): the k + 1 nearest vectors of a block to each query of a chunk."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, query = rows.column("ids").combine_chunks(), queries.column("query_id").combine_chunks()
        if not len(ids) or not len(query):
            picked, score = (np.zeros(0, np.int64),) * 2, np.zeros(0)
        else:
            r, q = matrix(rows.column("vec")), matrix(queries.column("vec"))
            rn, qn = norms(r), norms(q)
            near = (q / qn[:, None]) @ (r / rn[:, None]).T
            most = min(k + 1, len(r))
            least = np.partition(near, len(r) - most, axis=1)[:, len(r) - most]
            i, j = np.nonzero(near >= least[:, None] - 1e-9)  # what rounding may have moved is compared exactly
            score = np.concatenate([(q[i[a : a + 8192]] * r[j[a : a + 8192]]).sum(axis=1) for a in range(0, len(i), 8192)]) / (qn[i] * rn[j])
            smallest = np.asarray([x[0] for x in ids.to_pylist()])
            order = np.lexsort((smallest[j], -score, i))
            sizes = np.bincount(i, minlength=len(q))
            place = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = order[place < most]
            picked, score = (i[order], j[order]), score[order]
        return pa.table({"query_id": query.take(pa.array(picked[0])), "score": pa.array(score, pa.float64()), "ids": ids.take(pa.array(picked[1]))})

    return run, f"query_id {id_type}, score double, ids array<{id_type}>"


def search(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", config: AnnConfig = AnnConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others found of each row that ``queries`` (over the column
    vec_id) picks."""
    own = usable(vectors, vec_id, embedding)
    scratch = Scratch(own.sparkSession)
    rows = scratch.write(classes(own, k))
    n, length = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    taken = rows.orderBy(F.xxhash64("vec"), "vec").limit(min(config.sample, config.sample_values // (length or 1))).select("vec").toArrow()
    router = train(units(matrix(taken.column("vec"))), n, k, config)

    asked = _routed(own.where(queries).select(F.col("vec_id").alias("query_id"), "vec"), router, router.probes, "parts").select("query_id", "vec", F.explode("parts").alias("part"))
    homes = scratch.write(_routed(rows, router, 1, "parts").select("vec", "ids", F.get("parts", F.lit(0)).alias("part")))
    count = lambda df: {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}
    blocks, chunks = _spread(count(homes), config.block_rows), _spread(count(asked), config.chunk_queries)
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    left = homes.withColumn("block", F.pmod(F.xxhash64("vec"), blocks).cast("int")).withColumn("chunk", every(chunks))
    right = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id", "vec"), chunks).cast("int")).withColumn("block", every(blocks))
    key = ["part", "block", "chunk"]
    run, schema = _compared(k, own.schema["vec_id"].dataType.simpleString())
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)

    best = lambda df, order, m: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), order))).where(F.col("rank") <= m)
    pairs = hits.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(pairs, "vec_id", k).select("query_id", "rank", "vec_id", "score")
