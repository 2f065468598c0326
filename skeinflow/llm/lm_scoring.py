"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from
its neighbours on both sides; the conditional log-probabilities of a document's tokens add up to its score.

A token is a word, A-Z lower-cased. The ``vocabulary`` commonest words of the corpus are symbols of their
own; the others share ``others`` symbols by hash, and the counts of ``buckets`` finer ones (a few for each
distinct word, up to a bound) give such a word its part of the symbol's probability. The network embeds the ``side`` words before and after the masked one, weights them by place,
adds them up, and predicts the symbol in two steps: its class (symbols by frequency, classes of about equal
sums of square roots of counts), then the symbol within its class.

Training is data-parallel and reads every position of every document. One pass counts all words, which
sets vocabulary and output biases. Then documents are dealt to shards by a hash of their content; in each
round every shard starts from the shared weights and learns from all its positions, and the shards' weights
are averaged, by positions learned, in a tree. The number of shards follows the size of the corpus, and
weights are summed as integers, so the model depends on the documents alone, not on how they were stored.
The driver holds one set of weights, whose size the configuration bounds.

Cases: a null, empty or wordless text has no tokens, log_prob 0 and mean_log_prob null; one word is
predicted from padding alone; very long texts are read in slices of positions; repeated rows and ids are
scored each, with equal scores for equal texts; words of equal count are ordered by their hash; an empty
table gives an empty result (the network stays as it was initialised). The result has only its own columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.common import Scratch
from skeinflow.llm.jaccard_join import text_slices, word_hashes

SLICE = 1 << 14  #: positions that are scored at once
LARGEST = 4.0  #: output weights are kept within it: with up to 20 hidden units exponentials can't overflow
COUNTED = 1 << 19  #: distinct words that a task counts at once
FIXED = 1 << 22  #: weights are averaged in steps of 1 / FIXED


@dataclass(frozen=True)
class LmConfig:
    side: int = 2  #: words on each side
    size: int = 16  #: of embeddings and hidden layer
    vocabulary: int = 4096  #: words that are symbols of their own
    others: int = 64  #: symbols of all other words
    buckets: int = 1 << 20  #: that these words are counted in, at most: a multiple of ``others``
    classes: int = 40
    rounds: int = 1
    batch: int = 8192  #: positions of a step at most
    steps: int = 256  #: of a shard at least: smaller corpora have smaller steps
    rate: float = 0.3
    shard_bytes: int = 16 << 20  #: text of a shard, about
    max_shards: int = 100_000  #: beyond that shards grow
    seed: int = 11


@dataclass
class LmModel:
    """words: hashes of the vocabulary, ascending; numbers: their symbols; starts: where classes begin and
    the last one ends; rare: log of a word's part of its shared symbol, by bucket; weights: of the network,
    the padding last in ``embed``."""

    words: np.ndarray
    numbers: np.ndarray
    starts: np.ndarray
    rare: np.ndarray
    weights: dict[str, np.ndarray]
    config: LmConfig

    @property
    def pad(self) -> int:
        return int(self.starts[-1])

    def symbols(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the words of all texts, the log of each word's part of its symbol, and the bounds of each
        text."""
        words, cut = word_hashes(texts)
        bucket = words.view(np.int64) % len(self.rare)
        other, part = self.pad - self.config.others + bucket % self.config.others, self.rare[bucket]
        if not len(self.words):
            return other, part, cut
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        return np.where(known, self.numbers[at], other), np.where(known, 0, part), cut


def initial(words: np.ndarray, counts: np.ndarray, rest: np.ndarray, distinct: np.ndarray, config: LmConfig = LmConfig()) -> LmModel:
    """The network before it has learned: it predicts words by frequency. words and counts: the vocabulary;
    rest and distinct: counts and number of all other words by bucket. Half an occurrence is added to each."""
    others = rest.reshape(-1, config.others).sum(axis=0)
    share = (rest + 0.5).reshape(-1, config.others)
    rare = (np.log(share / share.sum(axis=0)).ravel() - np.log(np.maximum(distinct, 1))).astype(np.float32)
    order = np.lexsort((words, -counts))
    total = np.concatenate([counts[order], others]).astype(np.float64) + 0.5  # the shared symbols are the last
    share = np.cumsum(np.sqrt(total))
    cls = np.minimum((share - np.sqrt(total) / 2) / share[-1] * config.classes, config.classes - 1).astype(np.int64)
    starts = np.append(np.searchsorted(cls, np.unique(cls)), len(total))
    mass = np.add.reduceat(total, starts[:-1])
    r = np.random.default_rng(config.seed)
    small = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
    weights = {
        "embed": small(len(total) + 1, config.size), "place": np.full((2 * config.side, config.size), 1 / config.side, np.float32), "bias": np.zeros(config.size, np.float32),
        "high": small(len(mass), config.size), "high_bias": np.log(mass / mass.sum()).astype(np.float32),
        "low": small(len(total), config.size), "low_bias": np.log(total / np.repeat(mass, np.diff(starts))).astype(np.float32),
    }
    sorted_ = np.argsort(words[order])
    return LmModel(words[order][sorted_], sorted_, starts, rare, weights, config)


def padded(ids: np.ndarray, cut: np.ndarray, side: int, pad: int) -> np.ndarray:
    """The symbols of all texts in one row, with ``side`` paddings before, between and after texts."""
    out = np.full(len(ids) + side * len(cut), pad, np.int64)
    out[np.arange(len(ids)) + side * np.repeat(np.arange(1, len(cut)), np.diff(cut))] = ids
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _picked(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at one column."""
    own = z[np.arange(len(z)), column]
    np.exp(z, out=z)
    return (own - np.log(z.sum(axis=1))).astype(np.float64)


def _hidden(w: dict[str, np.ndarray], x: np.ndarray, side: int) -> np.ndarray:
    """Hidden layer of all positions of embedded symbols x but the first and last ``side``."""
    n = len(x) - 2 * side
    s = np.broadcast_to(w["bias"], (n, x.shape[1])).copy()
    for k, shift in enumerate([*range(side), *range(side + 1, 2 * side + 1)]):
        s += x[shift : shift + n] * w["place"][k]
    return np.tanh(s)


def _by_class(model: LmModel, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Class of each target, the order of targets by class, and (class, from, to) in that order."""
    cls = np.searchsorted(model.starts, target, "right") - 1
    order = np.argsort(cls, kind="stable")
    ends = np.cumsum(np.bincount(cls, minlength=len(model.starts) - 1))
    return cls, order, [(c, int(ends[c - 1]) if c else 0, int(e)) for c, e in enumerate(ends.tolist()) if e > (ends[c - 1] if c else 0)]


def log_probs(model: LmModel, row: np.ndarray) -> np.ndarray:
    """log P(symbol | its neighbours) of each position of a padded row that is no padding."""
    w, side, out = model.weights, model.config.side, []
    for a in range(side, len(row) - side, SLICE):
        part = row[a - side : min(a + SLICE, len(row) - side) + side]
        target = part[side : len(part) - side]
        at = np.flatnonzero(target != model.pad)
        target = target[at]
        if not len(at):
            continue
        h = _hidden(w, w["embed"][part], side)[at]
        cls, order, groups = _by_class(model, target)
        found = _picked(h @ w["high"].T + w["high_bias"], cls)
        h, target, low = h[order], target[order], np.empty(len(at))
        for c, i, j in groups:
            s, e = model.starts[c : c + 2]
            low[i:j] = _picked(h[i:j] @ w["low"][s:e].T + w["low_bias"][s:e], target[i:j] - s)
        found[order] += low
        out.append(found)
    return np.concatenate(out) if out else np.empty(0)


class Learner:
    """Adagrad on runs of positions, from given weights."""

    def __init__(self, model: LmModel, batch: int):
        self.model, self.batch, self.n = model, batch, 0
        self.w = {k: v.copy() for k, v in model.weights.items()}
        self.seen = {k: np.full_like(v, 1e-3) for k, v in model.weights.items()}

    def learn(self, row: np.ndarray) -> None:
        """All positions of a padded row."""
        side = self.model.config.side
        for a in range(side, len(row) - side, self.batch):
            self.step(row[a - side : min(a + self.batch, len(row) - side) + side])

    def step(self, part: np.ndarray) -> None:
        w, side, model = self.w, self.model.config.side, self.model
        target = part[side : len(part) - side]
        at = np.flatnonzero(target != model.pad)
        target, n = target[at], len(at)
        if not n:
            return
        x = w["embed"][part]
        hidden = _hidden(w, x, side)
        h = hidden[at]
        cls, order, groups = _by_class(model, target)
        p = _softmax(h @ w["high"].T + w["high_bias"])
        p[np.arange(n), cls] -= 1
        back = p @ w["high"]
        self._move("high", slice(None), p.T @ h / n)
        self._move("high_bias", slice(None), p.sum(axis=0) / n)
        h, target, low = h[order], target[order], np.empty_like(h)
        for c, i, j in groups:
            s, e = model.starts[c : c + 2]
            q = _softmax(h[i:j] @ w["low"][s:e].T + w["low_bias"][s:e])
            q[np.arange(j - i), target[i:j] - s] -= 1
            low[i:j] = q @ w["low"][s:e]
            self._move("low", slice(s, e), q.T @ h[i:j] / n)
            self._move("low_bias", slice(s, e), q.sum(axis=0) / n)
        back[order] += low
        slope = np.zeros_like(hidden)
        slope[at] = back
        slope *= (1 - hidden * hidden) / n
        near, m = np.zeros_like(x), len(slope)
        places = np.empty_like(w["place"])
        for k, shift in enumerate([*range(side), *range(side + 1, 2 * side + 1)]):
            near[shift : shift + m] += slope * w["place"][k]
            places[k] = np.einsum("nd,nd->d", x[shift : shift + m], slope)
        self._move("place", slice(None), places)
        self._move("bias", slice(None), slope.sum(axis=0))
        by = np.argsort(part, kind="stable")
        ids = part[by]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        self._move("embed", ids[first], np.add.reduceat(near[by], first))
        self.n += n

    def _move(self, k: str, rows, g: np.ndarray) -> None:
        self.seen[k][rows] += g * g
        self.w[k][rows] -= self.model.config.rate * g / np.sqrt(self.seen[k][rows])
        if k in ("high", "low"):
            np.clip(self.w[k][rows], -LARGEST, LARGEST, out=self.w[k][rows])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (hash), n: the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, n = (np.concatenate(x) for x in zip(*held, strict=True))
            found, back = np.unique(words, return_inverse=True)
            return found, np.bincount(back, n).astype(np.int64)

        rows = lambda words, n: pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])
        for _, texts in text_slices(batches, text):
            held.append(np.unique(word_hashes(texts)[0], return_counts=True))
            if sum(len(x) for x, _ in held) > COUNTED:
                held = [merged()]
                if len(held[0][0]) > COUNTED // 2:
                    yield rows(*held.pop())
        if held:
            yield rows(*merged())

    return docs.select(F.col(text).alias(text)).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.rint(np.concatenate([v.ravel() for v in w.values()]).astype(np.float64) * FIXED).astype(np.int64)


def _unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([v.size for v in like.values()])[:-1]
    return {k: (x / FIXED).reshape(v.shape).astype(np.float32) for (k, v), x in zip(like.items(), np.split(flat, cuts), strict=True)}


def _summed(rows: DataFrame) -> tuple[int, np.ndarray | int]:
    """Sums (n, vector of integers) rows in a tree, so that no task or driver holds more than a few vectors."""
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    read = lambda a, r: add(a, (r["n"], np.frombuffer(r["vector"], "<i8") * r["n"]))
    return rows.rdd.treeAggregate((0, 0), read, add, depth=3)


def train(docs: DataFrame, config: LmConfig = LmConfig(), doc_id: str = "doc_id", text: str = "text") -> LmModel:
    """Learns from all positions of all documents."""
    sc = docs.sparkSession.sparkContext
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.write(word_counts(docs, text))
        top = counts.orderBy(F.desc("n"), "word").limit(config.vocabulary).toPandas()
        known = counts.count()
        buckets = config.others
        while buckets < min(config.buckets, 4 * known):
            buckets *= 2
        found = counts.groupBy(F.pmod("word", F.lit(buckets)).cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("words")).toArrow()  # columns: a row object each would be the driver's memory
    words, n = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    rest, distinct = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    at = found["bucket"].to_numpy()
    rest[at], distinct[at] = found["n"].to_numpy(), found["words"].to_numpy()
    total = int(rest.sum())
    np.subtract.at(rest, words % buckets, n)
    np.subtract.at(distinct, words % buckets, 1)
    model = initial(words.view(np.uint64), n, rest, distinct, config)
    if not len(words):
        return model
    size = docs.agg(F.sum(F.octet_length(text))).first()[0]
    shards = min(config.max_shards, 1 + size // config.shard_bytes)
    batch = int(min(config.batch, max(16, total // shards // config.steps)))
    content = F.xxhash64(F.col(text), F.col(doc_id).cast("string"))
    dealt = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), content.alias("deal")).repartition(shards, "deal").sortWithinPartitions("deal", "text")
    for _ in range(config.rounds):
        shared = sc.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            learner = Learner(model, batch)
            for _, texts in text_slices(batches, "text"):
                ids, _, cut = model.symbols(texts)
                learner.learn(padded(ids, cut, model.config.side, model.pad))
            if learner.n:  # thousands of positions, so that sums stay in 64 bits
                yield pa.RecordBatch.from_arrays([pa.array([1 + (learner.n >> 10)], pa.int64()), pa.array([_packed(learner.w).tobytes()], pa.binary())], ["n", "vector"])

        n, total = _summed(dealt.mapInArrow(learn, "n bigint, vector binary"))
        model = LmModel(model.words, model.numbers, model.starts, model.rare, _unpacked(total / n, model.weights), config)
    return model


def score(docs: DataFrame, model: LmModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over all tokens) and mean_log_prob of every document."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, texts in text_slices(batches, "text"):
            ids, parts, cut = model.symbols(texts)
            logs, n = log_probs(model, padded(ids, cut, model.config.side, model.pad)) + parts, np.diff(cut)
            sums = [float(logs[a:b].sum()) for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
            mean = [s / k if k else None for s, k in zip(sums, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.array(mean, pa.float64())], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
