"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents and stored: each task turns the documents it reads into segments, and a
segment holds the postings (positions by term, a term being a 64-bit hash of a word) of all terms of up to
SEGMENT_WORDS words of whole documents, as one row of a table in the shared folder. A test item becomes
windows of consecutive words; a window is looked up in every segment by its rarest term there, and the
offset-adjusted postings of its other terms, rarer ones first, are intersected with the places that are
left. Nothing is shuffled, no term or document can become a hot key, and a segment is bounded.

The test windows are the stated query set: blocks of bounded size, each broadcast (to the executors' disks,
where memory is short); a task opens one at a time. Windows and places are expanded in slices, so the
memory of a search depends on neither the test set nor the frequency of a term.

Cases: a null or wordless text has no words and no hits; an item without words has no window, one with
fewer words than a window is a window of its own; an item without an id takes no part (nothing could name
its hits); items that repeat an id count once for a document; one text may be a segment
alone when it is very long; repeated rows and ids give a row each; empty tables give no hits or an
empty result. Input columns whose names clash with the results give way. Two of N distinct words have the
same hash with a chance of about N^2 / 2^65; a false hit would need this of a word whose neighbours match.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.common import materialize
from skeinflow.llm.jaccard_join import text_slices, word_hashes

WINDOW = 10
SEGMENT_WORDS = 200_000
BLOCK_BYTES = 2 << 20  #: test text that one block of windows is made of, about
PLACES = 1 << 19  #: windows or places that are looked at at once

#: Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased: all else becomes a blank.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


class Windows:
    """The windows of a block of test items: ``terms`` ascending; ``ids``, the terms of all items one after
    another, as their places in ``terms``; ``groups``, per length the first place and the item of each window."""

    def __init__(self, items: Iterable[tuple[str, str | None]], width: int = WINDOW):
        rows = list(items)
        words, cut = word_hashes([t for _, t in rows], _FOLD)
        self.items = [i for i, _ in rows]
        self.terms, ids = np.unique(words, return_inverse=True)
        self.ids = ids.astype(np.int32)
        sizes = np.diff(cut)
        self.groups: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k in sorted({min(width, n) for n in sizes.tolist() if n}):
            own = np.flatnonzero((sizes == k) if k < width else (sizes >= width))
            count = sizes[own] - k + 1
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            self.groups.append((k, (np.repeat(cut[own], count) + inside).astype(np.int32), np.repeat(own, count).astype(np.int32)))


class Segment:
    """Postings of some documents: for each term (ascending) its positions, ascending. Documents follow one
    another with a free position between them, so no exact match spans two."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray):
        self.starts, self.terms, self.offsets, self.positions = starts, terms, offsets, positions

    @staticmethod
    def build(words: np.ndarray, cut: np.ndarray) -> Segment:
        """words: hashes of all words; cut: where each document's begin and the last one's end."""
        at = np.arange(len(words)) + np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        order = np.argsort(words, kind="stable")
        sorted_ = words[order]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(words)])
        return Segment(cut + np.arange(len(cut)), sorted_[first], np.append(first, len(words)), at[order])

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def search(self, windows: Windows, slop: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
        """(start, length, item number, exact, document) of all places where a window occurs, in slices: each
        term at its offset, or with slop at most so many words from it, in the document of the rarest term.
        A start may then lie up to slop words before the document."""
        if not len(self.terms) or not len(windows.terms):
            return
        found = np.minimum(np.searchsorted(self.terms, windows.terms), len(self.terms) - 1)
        here = self.terms[found] == windows.terms
        span = int(self.starts[-1]) + 1
        keys = np.repeat(np.arange(len(self.terms)), np.diff(self.offsets)) * span + self.positions
        count = np.diff(self.offsets)
        missing = np.append(0, np.cumsum(~here[windows.ids]))
        for k, first, items in windows.groups:
            whole = np.flatnonzero(missing[first + k] == missing[first])
            for a in range(0, len(whole), PLACES // k):
                some = whole[a : a + PLACES // k]
                rows = found[windows.ids[first[some][:, None] + np.arange(k)]]
                rarest = np.append(0, np.cumsum(count[rows].min(axis=1)))
                b = 0
                while b < len(some):  # so many windows that their rarest terms have PLACES places; one at least
                    c = max(b + 1, int(np.searchsorted(rarest, rarest[b] + PLACES, "right")) - 1)
                    yield self._places(rows[b:c], items[some[b:c]], keys, count, span, slop)
                    b = c

    def _places(self, rows: np.ndarray, items: np.ndarray, keys: np.ndarray, count: np.ndarray, span: int, slop: int) -> tuple[np.ndarray, ...]:
        order = np.argsort(count[rows], axis=1, kind="stable")  # rarest terms first
        term = np.take_along_axis(rows, order, axis=1)
        n = count[term[:, 0]]
        w = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[self.offsets[term[w, 0]] + inside] - order[w, 0]
        anchor, exact = start + order[w, 0], np.ones(len(w), bool)
        for k in range(1, rows.shape[1]):
            want = term[w, k] * span + start + order[w, k]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            if slop:  # the nearer of the two postings around the place, in the anchor's document
                before = np.maximum(at - 1, 0)
                at = np.where(np.abs(keys[before] - want) < np.abs(keys[at] - want), before, at)
            gap = np.abs(keys[at] - want)
            near = (gap <= slop) & (start + order[w, k] >= 0) & (start + order[w, k] < span)
            if slop:
                near &= self.document(self.positions[at]) == self.document(anchor)
            exact = (exact & (gap == 0))[near]
            w, start, anchor = w[near], start[near], anchor[near]
        return start, np.full(len(start), rows.shape[1]), items[w], exact, self.document(anchor)


class Hits:
    """What a segment's documents share with the test items, over all blocks of windows."""

    def __init__(self, segment: Segment):
        self.segment = segment
        self.edges = np.zeros(int(segment.starts[-1]) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(len(segment.starts) - 1)]

    def add(self, windows: Windows) -> None:
        for start, length, item, _, doc in self.segment.search(windows):
            self.edges += np.bincount(start, minlength=len(self.edges)) - np.bincount(start + length, minlength=len(self.edges))
            for d, i in np.unique(np.stack([doc, item], axis=1), axis=0).tolist():
                self.items[d].add(windows.items[i])

    def words_hit(self) -> list[int]:
        hit = np.append(0, np.cumsum(np.cumsum(self.edges[:-1]) > 0))
        return np.diff(hit[self.segment.starts]).tolist()


def test_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """Broadcast blocks of windows, each made of about ``block_bytes`` of test text; the driver holds one at
    a time."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    if blocks == 1:
        return [sc.broadcast(Windows(rows.collect(), width))]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    return [sc.broadcast(Windows(dealt.where(F.col("block") == b).select("item", "text").collect(), width)) for b in range(blocks)]


def opened(blocks: list[Broadcast]) -> Iterator[Windows]:
    """The blocks one after another; of several, a worker keeps none."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            vars(block).pop("_value", None)


def _segments(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Segment]]:
    """Slices of the batches with their segments."""
    for rows, texts in text_slices(batches, text):
        words, cut = word_hashes(texts, _FOLD)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + SEGMENT_WORDS, "right")) - 1)
            yield rows.slice(a, b - a), Segment.build(words[cut[a] : cut[b]], cut[a : b + 1] - cut[a])
            a = b


def _index_schema(doc_id: T.DataType) -> T.StructType:
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    return T.StructType([T.StructField(c, t) for c, t in (("doc_ids", T.ArrayType(doc_id)), ("starts", ints), ("terms", longs), ("offsets", ints), ("positions", ints))])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all terms of all documents, written to the shared folder: a row per segment with
    doc_ids, starts, terms, offsets and positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(kind)))
        for rows, s in _segments(batches, "text"):
            ids = rows.column("doc_id")
            yield pa.RecordBatch.from_arrays([
                pa.array([ids.to_pylist()], pa.list_(ids.type)), whole(s.starts, np.int32), whole(s.terms.view(np.int64), np.int64), whole(s.offsets, np.int32), whole(s.positions, np.int32),
            ], ["doc_ids", "starts", "terms", "offsets", "positions"])

    return materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _index_schema(docs.schema[doc_id].dataType)))


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[list, Segment]]:
    for row in range(batch.num_rows):
        starts, offsets, positions = (batch.column(c)[row].values.to_numpy().astype(np.int64) for c in ("starts", "offsets", "positions"))
        yield batch.column("doc_ids")[row].as_py(), Segment(starts, batch.column("terms")[row].values.to_numpy().view(np.uint64), offsets, positions)


def _doc_id(index: DataFrame) -> T.StructField:
    return T.StructField("doc_id", index.schema["doc_ids"].dataType.elementType)


def search_index(index: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """doc_id, n_words, n_hit and item_ids (sorted as strings) of every indexed document."""
    schema = T.StructType([_doc_id(index), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, segment in _stored(batch):
                hits = Hits(segment)
                for windows in opened(blocks):
                    hits.add(windows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, batch.schema.field("doc_ids").type.value_type), pa.array(np.diff(segment.starts) - 1, pa.int64()),
                    pa.array(hits.words_hit(), pa.int64()), pa.array([sorted(x) for x in hits.items], pa.list_(pa.string())),
                ], schema.names)

    return index.mapInArrow(run, schema)


def phrase_matches(index: DataFrame, blocks: list[Broadcast], slop: int = 0) -> DataFrame:
    """doc_id, item_id, start (word of the document) and exact of every place of a window; with slop,
    also where each word is at most so many words from its place."""
    schema = T.StructType([_doc_id(index), T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("exact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, segment in _stored(batch):
                for windows in opened(blocks):
                    for start, _, item, exact, doc in segment.search(windows, slop):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([ids[d] for d in doc.tolist()], batch.schema.field("doc_ids").type.value_type), pa.array([windows.items[i] for i in item.tolist()], pa.string()),
                            pa.array(start - segment.starts[doc], pa.int64()), pa.array(exact, pa.bool_()),
                        ], schema.names)

    return index.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, item_ids of every document, from a stored index of all of them."""
    return search_index(build_index(docs, doc_id, text), test_windows(benchmark))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, that share no window with a test item. Here a segment of the index lives
    as long as the task that reads its documents, so no text is moved and no row is joined back."""
    blocks = test_windows(benchmark)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, segment in _segments(batches, text):
            hits = Hits(segment)
            for windows in opened(blocks):
                hits.add(windows)
            yield rows.select(columns).filter(pa.array([not n for n in hits.words_hit()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
