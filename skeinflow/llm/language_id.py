"""Language identification: the nearest of several centroids per language, by cosine of TF-IDF vectors
of character n-grams, with rejection by distance.

Training reads a bounded sample of labelled documents (``docs_per_lang`` per language at most, picked
by hash of the text, whole texts); their hashed n-gram counts are made on the executors. Per language a
spherical k-means splits the vectors into ``centroids`` groups. Prediction is a pass over Arrow batches.

Cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; a text whose best
cosine is below the language's limit is still named, but rejected; very long texts are read whole, in
slices; a language with fewer documents than centroids gets fewer; more labels than ``langs`` are an error; no labelled document at all: every
text is ``und``; equal cosines go to the first language in sorted order; repeated rows are independent;
an empty table gives an empty result. Input columns whose names clash with the results give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1 << 18  #: characters whose n-grams are hashed at once


@dataclass(frozen=True)
class LanguageConfig:
    bins: int = 4096  #: hashed n-gram features
    grams: tuple[int, ...] = (1, 2, 3)
    centroids: int = 3  #: per language
    docs_per_lang: int = 400  #: bound of the training sample
    langs: int = 256  #: more labels than this end the training with an error
    reject: float = 0.4  #: texts below this share of the low training cosines are rejected


@dataclass
class LanguageModel:
    langs: list[str]  #: of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    limit: dict[str, float]  #: lowest cosine that is not rejected
    config: LanguageConfig


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point, or a blank where it is no letter."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def gram_counts(text: str, config: LanguageConfig) -> np.ndarray | None:
    """Hashed n-gram counts of the letters of a text, with blanks between words; None without a letter."""
    out, carry = np.zeros(config.bins), np.array([32], np.uint64)
    low, found = text.lower(), False
    for a in range(0, len(low), SLICE):
        points = _letters()[np.frombuffer(low[a : a + SLICE].encode("utf-32-le"), "<u4")]
        points = np.concatenate([carry, points.astype(np.uint64), *([np.array([32], np.uint64)] if a + SLICE >= len(low) else [])])
        blank = points == 32
        found = found or not blank.all()
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # one blank between words
        keep[0] = True
        points = points[keep]
        h = np.zeros(len(points), np.uint64)
        for n in range(1, max(config.grams) + 1):
            h = (h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]) if n > 1 else points.copy()
            if n in config.grams:
                mixed = (h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                out += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % config.bins, minlength=config.bins)
        carry = points[-(max(config.grams) - 1) :] if max(config.grams) > 1 else points[:0]
    return out if found else None


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / (np.linalg.norm(v) or 1.0)


def split_centroids(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; the seeds are the first vector and then, again and again, the farthest one."""
    seeds = [0]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int((vectors @ vectors[seeds].T).max(axis=1).argmin()))
    centers = vectors[seeds]
    for _ in range(rounds):
        near = (vectors @ centers.T).argmax(axis=1)
        sums = np.stack([vectors[near == i].sum(axis=0) if (near == i).any() else centers[i] for i in range(len(centers))])
        centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centers


def train(labelled: DataFrame, config: LanguageConfig = LanguageConfig(), text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fits on labelled rows (null labels and texts are left out). The sample that reaches the driver is
    bounded: langs * docs_per_lang sparse vectors at most."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(config.langs + 1).collect()}
    if len(sizes) > config.langs:
        raise ValueError(f"more than {config.langs} labels of languages")
    if not sizes:
        return LanguageModel([], np.zeros((0, config.bins)), np.ones(config.bins), {}, config)
    scale = 1 << 30
    share: Column = F.lit(0)
    for name, n in sorted(sizes.items()):  # 0.9: the drawn number stays below the bound
        share = F.when(F.col("lang") == name, F.lit(min(scale, int(0.9 * config.docs_per_lang * scale / n)) if n > config.docs_per_lang else scale)).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(scale)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = batch.column("lang").to_pylist(), [gram_counts(t, config) for t in batch.column("text").to_pylist()]
            kept = [(n, c.astype(np.float32).tobytes()) for n, c in zip(names, found, strict=True) if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.binary())], ["lang", "counts"])

    counted = drawn.mapInArrow(count, "lang string, counts binary").orderBy("lang", "counts").limit(config.langs * config.docs_per_lang).collect()
    if not counted:
        return LanguageModel([], np.zeros((0, config.bins)), np.ones(config.bins), {}, config)
    names = np.array([r["lang"] for r in counted])
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in counted])
    del counted  # the driver holds the counts once, and the vectors of one language at a time
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    langs, centers, limit = [], [], {}
    for name in sorted(set(names.tolist())):
        own = np.stack([vector(c.astype(np.float64), idf) for c in counts[names == name]])
        c = split_centroids(own, config.centroids)
        langs += [name] * len(c)
        centers.append(c)
        limit[name] = config.reject * float(np.quantile((own @ c.T).max(axis=1), 0.01))
    return LanguageModel(langs, np.concatenate(centers), idf, limit, config)


def predict(model: LanguageModel, text: str | None) -> tuple[str, float, bool]:
    """(language, score, rejected)"""
    counts = gram_counts(text, model.config) if text and model.langs else None
    if counts is None:
        return "und", 0.0, True
    cosines = model.centroids @ vector(counts, model.idf)
    best = int(cosines.argmax())
    score = float(min(1.0, max(0.0, cosines[best])))
    return model.langs[best], score, score < model.limit[model.langs[best]]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``score`` and ``lang_rejected``. Only the text is looked at."""
    made = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("lang_rejected", pa.bool_())])
    names = [c for c in docs.columns if c not in made.names]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids * bins floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            found = [predict(fitted, t) for t in batch.column(text).to_pylist()]
            out = pa.Table.from_batches([batch]).select(names)
            for i, field in enumerate(made):
                out = out.append_column(field, pa.array([x[i] for x in found], field.type))
            yield from out.combine_chunks().to_batches()

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])]).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
