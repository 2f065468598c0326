"""Collocations: phrases that occur more often than their parts suggest, counted on position bitmaps.

Texts become shards of about SHARD_WORDS positions, in which an end of a piece takes a position of its own that
no word has. A shard has a compressed bitmap of positions per word (its non-empty 64-bit blocks); shifting a
phrase's bitmap by one and a logical AND with the bitmaps of the words that follow there extends it by each of them,
and the popcount is the number of occurrences, overlaps included. Extension is depth-first: a range
of words goes to its pairs and on to its triples before the next begins. Counts are summed over shards.

Only what can reach ``least`` is counted: pairs of words that do, triples of pairs that do. Each shard is told
which of its own words and pairs those are, by joins on the shard; no list of all of them is sent anywhere. A
shard is stored as one row of numbered words (which makes its bitmaps wherever it is opened); its counts travel
packed, by hash of the phrase, and each task adds up those of one hash range.

Cases: null and empty texts have no words; a null lang is ``und``; one document is in one shard, so memory grows
with the longest text; equal scores go by a, then by the phrase's UTF-8 bytes; repeated rows count each; an empty
table, and a lang without candidates, give no rows; doc_id and other columns aren't read. What a result reads is
written to the shared folder and stays there with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm.common import Scratch

#: Positions of a shard, beyond which the next document opens a new one.
SHARD_WORDS = 1 << 20
#: Counts of phrases that one task adds up at once, about.
PART_COUNTS = 1 << 21
#: Blocks of bitmaps that one step extends.
STEP = 1 << 18

#: Ends of pieces become an upper-case letter, which no lower-cased text has.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"A" * 10)


class _Numbers(dict):
    """Words of one language with their numbers in the shard; a new word gets the next."""

    def __init__(self, listed: list):
        super().__init__({b"A": 0})
        self.listed = listed

    def __missing__(self, word: bytes) -> int:
        self.listed.append((self, word))
        self[word] = len(self.listed)
        return len(self.listed)


def pieces_and_words(text: str | None) -> list[bytes]:
    """The words in lower case (A-Z only), ``A`` at the end of each piece."""
    return (text or "").encode().lower().translate(_ENDS).replace(b"A", b" A ").split()


# --- packed columns of numbers


def packed(*columns: np.ndarray) -> bytes:
    """Equally long columns of whole numbers, the first one ascending, as compressed bytes."""
    table = np.array(columns, "<i8").reshape(len(columns), -1)
    table[0, 1:] = np.diff(table[0])
    planes = table.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) + planes.shape[2].to_bytes(8, "little")


def unpacked(blob: bytes, n: int) -> np.ndarray:
    """The n columns as rows of an array."""
    size = int.from_bytes(blob[-8:], "little")
    planes = np.frombuffer(pa.decompress(blob[:-8], decompressed_size=8 * n * size, codec="zstd", asbytes=True), np.uint8)
    table = np.ascontiguousarray(planes.reshape(n, 8, size).transpose(0, 2, 1)).view("<i8").reshape(n, size).astype(np.int64)
    table[0] = np.cumsum(table[0])
    return table


def packed_tokens(tokens: np.ndarray) -> bytes:
    """Small whole numbers, most of them in few bytes, as compressed bytes."""
    return pa.compress(np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) + len(tokens).to_bytes(8, "little")


def unpacked_tokens(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[-8:], "little")
    planes = np.frombuffer(pa.decompress(blob[:-8], decompressed_size=4 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, size).T).view("<u4").ravel()


# --- shards

_SHARD = "shard bigint, n_words bigint, tokens binary, vocabulary array<struct<lang:string,word:string,n:bigint>>"


def _shard_row(number: int, listed: list, langs: dict, tokens: list[np.ndarray]) -> pa.RecordBatch:
    all_ = np.concatenate(tokens)
    counts = np.bincount(all_, minlength=len(listed) + 1)[1:]
    name = {id(d): lang for lang, d in langs.items()}
    words = pa.StructArray.from_arrays([pa.array([name[id(d)] for d, _ in listed], pa.string()), pa.array([w.decode() for _, w in listed], pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"])
    columns = [pa.array([number], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([packed_tokens(all_)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "n_words", "tokens", "vocabulary"])


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: its number, words, positions (0: end of a piece) and vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, listed, langs, tokens, size = TaskContext.get().partitionId() << 32, [], {}, [], 0
        for batch in batches:
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):  # noqa: E741
                words = pieces_and_words(t)
                if not words:
                    continue
                words.append(b"A")
                known = langs.setdefault(l, _Numbers(listed))
                tokens.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                size += len(words)
                if size >= shard_words:
                    yield _shard_row(number, listed, langs, tokens)
                    number, listed, langs, tokens, size = number + 1, [], {}, [], 0
        if size:
            yield _shard_row(number, listed, langs, tokens)

    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(run, _SHARD)


# --- bitmaps


class Bitmaps:
    """Compressed position bitmaps of a shard's kept words: entries (word, block, mask), by block and by word."""

    def __init__(self, words: np.ndarray, n_kept: int):
        """words: at each position the number of a kept word, or -1."""
        at = np.flatnonzero(words >= 0)
        block, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
        keys, of = np.unique(block * max(n_kept, 1) + words[at], return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.mask = np.bitwise_or.reduceat(bit[order], np.searchsorted(of[order], np.arange(len(keys)))) if len(keys) else np.zeros(0, np.uint64)
        self.block, self.word = keys // max(n_kept, 1), keys % max(n_kept, 1)
        self.entry = np.full(((len(words) >> 6) + 2) << 6, -1, np.int64)  # at each position, of its word in its block
        self.entry[at] = of
        self.any = np.zeros(len(self.entry) >> 6, np.uint64)  # positions of a block with a kept word
        np.bitwise_or.at(self.any, self.block, self.mask)
        self.by_word = np.argsort(self.word, kind="stable")
        self.word_starts = np.searchsorted(self.word[self.by_word], np.arange(n_kept + 1))

    def ranges(self) -> Iterator[np.ndarray]:
        """Entries of ranges of words, one word at least, each of about as many entries as a step takes."""
        n, low = len(self.word_starts) - 1, 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(self.word_starts, self.word_starts[low] + STEP, "right")) - 1)
            yield self.by_word[self.word_starts[low] : self.word_starts[high]]
            low = high

    def extended(self, prefix: np.ndarray, block: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(prefix, word, block, mask) of every phrase that goes on with a word. The bitmaps are shifted by one;
        the word at the first position left is ANDed, what it hits is one longer phrase and leaves, and so on
        until no position is left: no AND comes out empty."""
        carried = np.flatnonzero(mask >> np.uint64(63))
        prefix = np.concatenate([prefix, prefix[carried]])
        block = np.concatenate([block, block[carried] + 1])
        mask = np.concatenate([mask << np.uint64(1), np.ones(len(carried), np.uint64)]) & self.any[block]
        yield prefix[:0], prefix[:0], block[:0], mask[:0]
        while True:
            left = np.flatnonzero(mask)
            if not len(left):
                return
            prefix, block, mask = prefix[left], block[left], mask[left]
            first = np.bitwise_count(~mask & (mask - np.uint64(1))).astype(np.int64)
            entry = self.entry[(block << 6) + first]
            hit = mask & self.mask[entry]
            yield prefix, self.word[entry], block, hit
            mask = mask ^ hit


def _grouped(parts: Iterator[tuple[np.ndarray, ...]], n_words: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(keys prefix * n_words + word ascending, popcounts, (index of the key, block, mask) of the entries)."""
    prefix, word, block, mask = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys = prefix * n_words + word
    order = np.argsort(keys)
    keys, block, mask = keys[order], block[order], mask[order]
    opens = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    counts = np.add.reduceat(np.bitwise_count(mask).astype(np.int64), np.flatnonzero(opens)) if len(keys) else np.zeros(0, np.int64)
    return keys[opens], counts, (np.cumsum(opens) - 1, block, mask)


def pairs_of(maps: Bitmaps, n_kept: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first * n_kept + second, occurrences) of the pairs of each range of words."""
    for own in maps.ranges():
        if len(own):
            keys, counts, _ = _grouped(maps.extended(maps.word[own], maps.block[own], maps.mask[own]), n_kept)
            yield keys, counts


def triples_of(maps: Bitmaps, n_kept: int, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, second, third, occurrences) of the triples both of whose pairs are in ``pairs`` (ascending)."""
    if not len(pairs):
        return
    listed = lambda k: pairs[np.minimum(np.searchsorted(pairs, k), len(pairs) - 1)] == k
    for own in maps.ranges():
        if not len(own):
            continue
        keys, _, (of, block, mask) = _grouped(maps.extended(maps.word[own], maps.block[own], maps.mask[own]), n_kept)
        deep = np.flatnonzero(listed(keys)[of])
        if len(deep):
            found, counts, _ = _grouped(maps.extended(of[deep], block[deep], mask[deep]), n_kept)
            pair, third = keys[found // n_kept], found % n_kept
            whole = listed(pair % n_kept * n_kept + third)
            yield pair[whole] // n_kept, pair[whole] % n_kept, third[whole], counts[whole]


# --- counts over shards


def _part(columns: list[np.ndarray], parts: int) -> np.ndarray:
    """The part of each phrase, by a multiplicative hash of its words' ids."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(parts)).astype(np.int64)


def _dealt(shard: int, columns: list[np.ndarray], counts: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, shard, packed phrases and counts)."""
    part = _part(columns, parts)
    order = np.lexsort((*columns[::-1], part))
    part, rows = part[order], [c[order] for c in [*columns, counts]]
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(part[a]), shard, packed(*[c[a:b] for c in rows])


def _opened(tokens: bytes, kept: pa.StructArray) -> tuple[Bitmaps, np.ndarray]:
    """A shard's bitmaps of its kept words, and the ids of these, ascending."""
    index, ids = (kept.field(f).to_numpy().astype(np.int64) for f in ("index", "id"))
    order = np.argsort(ids)
    tokens = unpacked_tokens(tokens)
    number = np.full(int(max(tokens.max(initial=0), index.max(initial=0))) + 1, -1, np.int64)
    number[index[order]] = np.arange(len(ids))
    return Bitmaps(number[tokens], len(ids)), ids[order]


def _counted(opened: DataFrame, words: int, parts: int) -> DataFrame:
    """part, shard, counts: occurrences in each shard of the phrases of 2 or 3 words that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column("shard")[i].as_py()
                maps, ids = _opened(batch.column("tokens")[i].as_py(), batch.column("kept")[i].values)
                n = len(ids)
                if words == 2:
                    found = [(k // n, k % n, c) for k, c in pairs_of(maps, n)]
                else:
                    known = [np.searchsorted(ids, unpacked(b, 2)) for b in batch.column("pairs")[i].as_py()]
                    found = list(triples_of(maps, n, np.sort(np.concatenate([a * n + b for a, b in known]))))
                if found:
                    *phrase, counts = (np.concatenate(x) for x in zip(*found, strict=True))
                    if len(counts):
                        rows = list(zip(*_dealt(shard, [ids[w] for w in phrase], counts, parts), strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["part", "shard", "counts"])

    return opened.mapInArrow(run, "part bigint, shard bigint, counts binary")


def _frequent(counted: DataFrame, words: int, least: int) -> DataFrame:
    """shard, found: packed phrases with their counts over all shards of those that reach ``least`` (shard null),
    and for each shard its own of these."""

    def run(group: pa.Table) -> pa.Table:
        blobs = [unpacked(b, words + 1) for b in group.column("counts").to_pylist()]
        table = np.concatenate(blobs, axis=1)
        source = np.repeat(np.arange(len(blobs)), [b.shape[1] for b in blobs])
        order = np.lexsort(table[:words][::-1])
        table, source = table[:, order], source[order]
        opens = np.append(True, (table[:words, 1:] != table[:words, :-1]).any(axis=0))
        sums = np.add.reduceat(table[words], np.flatnonzero(opens))
        rows = []
        if (sums >= least).any():
            rows.append((None, packed(*table[:words, opens][:, sums >= least], sums[sums >= least])))
            kept = np.flatnonzero((sums >= least)[np.cumsum(opens) - 1])
            kept = kept[np.argsort(source[kept], kind="stable")]  # by shard, phrases ascending
            cuts = np.searchsorted(source[kept], np.arange(len(blobs) + 1))
            for shard, a, b in zip(group.column("shard").to_pylist(), cuts, cuts[1:], strict=False) if words == 2 else ():
                if a < b:
                    rows.append((shard, packed(*table[:words, kept[a:b]])))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "found": pa.array([r[1] for r in rows], pa.binary())})

    return counted.groupBy("part").applyInArrow(run, "shard bigint, found binary")


def _listed(frequent: DataFrame, words: int) -> DataFrame:
    """The frequent phrases as rows of word ids w1, w2, ... and their count f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*[f"w{i + 1}" for i in range(words)], "f"]
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in unpacked(blob, words + 1)], names)

    return frequent.where("shard is null").select("found").mapInArrow(run, ", ".join([*[f"w{i + 1} bigint" for i in range(words)], "f bigint"]))


# --- scores


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in whole decimals."""
    exact = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact(a) * exact(a)), exact(l) * exact(r))


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS, part_counts: int = PART_COUNTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 or 3 words by score.

    Candidates occur ``least`` times or more (a). A cut into two parts with l and r occurrences has the score
    floor(1000000 * a * a / (l * r)); the lowest-scoring cut counts, of equal ones the first. Phrases inside a
    longer candidate with ``covered`` percent of their occurrences or more go. n: the language's words."""
    scratch = Scratch(docs.sparkSession)
    stored = scratch.write(shards(docs, text, lang, shard_words))
    parts = max(1, (stored.agg(F.sum("n_words")).first()[0] or 0) // part_counts)
    vocabulary = stored.select("shard", F.posexplode("vocabulary").alias("index", "v")).select("shard", (F.col("index") + 1).alias("index"), "v.*")
    sums = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    total = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    words = scratch.write(sums.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()))
    kept = vocabulary.join(words.hint("shuffle_hash"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("index", "id")).alias("kept"))
    opened = stored.select("shard", "tokens").join(kept, "shard")
    two = scratch.write(_frequent(_counted(opened, 2, parts), 2, least))
    own = two.where("shard is not null").groupBy("shard").agg(F.collect_list("found").alias("pairs"))
    pairs = _listed(two, 2)
    triples = scratch.write(_listed(_frequent(_counted(opened.join(own, "shard"), 3, parts), 3, least), 3))

    word = lambda i: words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("f").alias(f"f{i}"), "lang")
    longer = triples.select(F.explode(F.array(F.struct("w1", "w2", "f"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))).alias("p")).select("p.*")
    longer = longer.groupBy("w1", "w2").agg(F.max("f").alias("longer"))
    ends = pairs.join(word(1), "w1").join(word(2).drop("lang"), "w2")
    short = ends.join(longer, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True)))
    short = short.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"))
    head = pairs.withColumnRenamed("f", "f12")
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23"))
    long = triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(word(1), "w1").join(word(2).drop("lang"), "w2").join(word(3).drop("lang"), "w3")
    first = _score(F.col("f"), F.col("f1"), F.col("f23")) <= _score(F.col("f"), F.col("f12"), F.col("f3"))
    cut = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    long = long.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("f").alias("a"), cut("f1", "f12").alias("l"), cut("f23", "f3").alias("r"))
    scored = short.unionByName(long).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    ranked = _first(scored, top).join(total, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; each task keeps no more than that before the shuffle."""
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
