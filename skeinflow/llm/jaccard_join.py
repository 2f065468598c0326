"""Near-duplicate classes by an exact Jaccard join on word shingles: parity sketches, pigeonhole, verify.

A document's set: the hashes of its distinct shingles. Documents link if 100 * |A & B| >= 75 * |A | B|,
so for linked sets |A ^ B| <= (|A| + |B|) / 7, and a partner of A has 3/4 to 4/3 of its size.

* Classes. Equal sets are one class (``cls``, a 64-bit hash of the set); only classes are compared.
* Signatures. Per size band the hash range splits into blocks; the parity (XOR) of the hashes in a
  block is its signature. Each element of A ^ B changes one block, so of A's ``occupied`` blocks at
  least occupied - d keep their signature in B, where d = min(n/3, (n + top of the band)/7) bounds
  |A ^ B|. Small sets use every element as a block of its own. A set whose occupied blocks are not
  more than d (rare) adds such single-element blocks as well.
* Pigeonhole. With a global order of signatures by how many classes share them, one of A's d + 1 first
  ones is shared with any partner, and it is among the partner's d + 1 first ones too. So signatures of
  one class alone are dropped after they are counted as ranks, and each class keeps what is left of its
  d + 1 first: common passages and boilerplate end beyond them, and classes without a partner keep
  nothing or little. No signature is ever capped.
* Candidates. The first round links each class of a signature group to one pivot (the class with the
  greatest share of shared blocks: the source of edited copies), which is linear in the group. Verified
  links are contracted; then only classes of different components within a group are compared. A pair
  must pass the parity-sketch bound first: the Hamming distance of two bit sketches (XOR of one bit per
  shingle) never exceeds |A ^ B|.
* Verification compares the sets themselves, made again from the texts of the classes involved.
* Components: minimum labels over the links, with pointer jumping, each round written out.

Signatures of copies are written once per task, and sets travel only for classes with a candidate. The
driver sees counts, one bitmap of fixed size (BITMAP_BITS) and HOT_KEYS signatures at most, never links,
components or fingerprints of all documents.

Hot keys. Signatures that very many classes share are found in a sample of the classes and dealt to all
tasks by key and class. Pivots of groups and least neighbours of a hub are aggregated on the map side,
written, and joined, so that the adaptive join can split a large group. The comparison within a group of
different components stands behind the sketch bound; its pairs are made in the tasks, block by block.

Cases: a null text or one without words has an empty set, links with nothing and is its own component;
fewer words than a shingle form one shingle, the whole sequence; repeated ids give a row each, and a
component's id is the smallest doc_id in it; a null id never is that unless all are null; very long
texts are read whole; an empty table gives an empty result. The result of near_duplicate_classes has only
its own columns, without_near_duplicates takes and gives back columns of any name.
64-bit hashes stand for shingles and sets: N distinct ones meet by chance with about N^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.common import Scratch, beside, materialize

SHINGLE = 5
SMALL = 64  #: sets below this size use single elements as blocks
BLOCKS_PER_ELEMENT = 0.36  #: blocks of a band, per element of its largest set
BITMAP_BITS = 1 << 26  #: of the filter that picks the texts to verify
TASK_CLASSES = 200_000  #: classes that a task remembers to have written
ROWS_PER_TASK = 2_000_000  #: signatures that one shuffle task sorts, about
SAMPLED = 64  #: one class of so many, by hash, shows which signatures are hot
HOT_CLASSES = ROWS_PER_TASK // 8  #: a signature of so many classes, as the sample has it, is hot
HOT_KEYS = 100_000  #: hot signatures that are told to all tasks, the most shared ones first
SATURATED = 1 << 20  #: rows of one signature that a task holds; beyond them it passes rows on as they come
BATCH_BYTES = 1 << 20  #: text whose shingles are made at once, unless one text is longer
HASH_BYTES = 1 << 18  #: bytes whose letters are hashed at once

HOT = 32  #: bit of a key
BANDS = pa.list_(pa.struct([("band", pa.int64()), ("spare", pa.int64()), ("keys", pa.int64())]))
_U = np.uint64
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if 0x09 <= c <= 0x0D else c for c in range(256))
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(texts: list[str | None], fold: bytes = _FOLD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, by default [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and where
    each text's words start and the last one's end. fold says what each byte becomes, a blank between words.
    A word's hash is a sum over its letters, so slices of bytes give parts of it that add up, wherever they
    cut."""
    coded = [t.encode().translate(fold) if t else b"" for t in texts]
    points = np.frombuffer(b" ".join([b"", *coded, b""]), np.uint8)
    ends = np.cumsum([0, *[len(t) + 1 for t in coded]])
    blank = points == 0x20
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, stops = turns[::2], turns[1::2]
    lengths = stops - starts
    sums = np.zeros(len(starts), _U)
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(min(HASH_BYTES, int(lengths.max(initial=0))), _STEP)]), dtype=np.uint64)
    for p in range(0, len(points), HASH_BYTES):
        a, b = np.searchsorted(stops, p, "right"), np.searchsorted(starts, p + HASH_BYTES)
        if a == b:
            continue
        part = np.minimum(stops[a:b], p + HASH_BYTES) - np.maximum(starts[a:b], p)
        letters = points[p : p + HASH_BYTES][~blank[p : p + HASH_BYTES]]
        first = np.cumsum(part) - part
        inside = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), part)
        found = np.add.reduceat(_BYTE[letters] * powers[inside], first)
        if starts[a] < p:  # a word that began in an earlier slice
            found[:1] *= _U(pow(int(_STEP), int(p - starts[a]), 1 << 64))
        sums[a:b] += found
    return mix(sums ^ lengths.astype(_U)), np.searchsorted(starts, ends)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: 5 consecutive words; of a shorter text all words
    together."""
    words, cut = word_hashes(texts)
    rolled = mix(sum((words[k : len(words) - SHINGLE + 1 + k] * _PLACE[k] for k in range(SHINGLE)), _U(0))) if len(words) >= SHINGLE else words[:0]
    out = []
    for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _U(b - a)))
        else:
            out.append(np.empty(0, _U))
    return out


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(mix(np.array([mix(s ^ _STEP).sum(dtype=np.uint64) ^ mix(np.array([len(s)], _U))[0]], _U)).astype(np.int64)[0])


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """XOR of one bit per element, in the power of two that is 2 to 4 bits per element (64 at least)."""
    bits = max(64, 1 << (int(len(s)).bit_length() + 1))
    odd = np.bincount((mix(s + _STEP) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def most_apart(n: int, top: int) -> int:
    """The most elements that a set of n elements and a partner of the band may differ in."""
    return min(n // 3, (n + top) // 7)


def bands_of(n: int) -> list[tuple[int, int, int]]:
    """(band, blocks, most apart) of a set's own band and, if a partner may be in it, the next. Band 0 has
    no blocks: its elements are."""
    own = 0 if n < SMALL else n.bit_length()
    after = SMALL if own == 0 else 1 << own
    out = []
    for band in [own] + [after.bit_length()] * (4 * n >= 3 * after):
        top = SMALL - 1 if band == 0 else (1 << band) - 1
        out.append((band, int(np.ceil(BLOCKS_PER_ELEMENT * (top + 1))) if band else 0, most_apart(n, top)))
    return out


def band_sizes(s: np.ndarray) -> list[dict[str, int]]:
    """band, spare and number of keys, as band_signatures gives them."""
    out = []
    for band, blocks, apart in bands_of(len(s)):
        block = ((s >> _U(32)) * _U(blocks)) >> _U(32)
        keys = int(np.count_nonzero(block[1:] != block[:-1])) + 1 if band else len(s)
        spare = keys - apart - 1
        out.append({"band": band, "spare": max(0, spare), "keys": keys if spare >= 0 else keys + len(s)})
    return out


def band_signatures(s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(band, spare, keys) for the set's own band and, if a partner may be in it, the next. The low 5 bits
    of a key are its band, the next one is free (HOT); a class may leave out its ``spare`` most shared keys
    of a band."""
    out = []
    for band, blocks, apart in bands_of(len(s)):
        if band == 0:
            keys = mix(s ^ _U(1))
            spare = len(s) - apart - 1
        else:
            block = ((s >> _U(32)) * _U(blocks)) >> _U(32)
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            keys = mix(mix(np.bitwise_xor.reduceat(s, first)) + block[first] * _STEP + _U(band))
            spare = len(keys) - apart - 1
            if spare < 0:  # the blocks alone can't prove a partner: single elements as well, all kept
                keys, spare = np.concatenate([keys, mix(s ^ _U(band + 0x1000))]), 0
        out.append((band, spare, (keys & ~_U(63)) | _U(band)))
    return out


def text_slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with their texts: about BATCH_BYTES of text, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        a, held = 0, 0
        for i, n in enumerate([*sizes, BATCH_BYTES + 1]):
            if i > a and held + n > BATCH_BYTES:
                rows = batch.slice(a, i - a)
                yield rows, rows.column(text).to_pylist()
                a, held = i, 0
            held += n


def _text_batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, texts in text_slices(batches, text):
        yield rows, shingle_sets(texts)


def profiles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, cls and bands of every document (the last two null for empty sets), and the
    signatures (``sample``) of one class of SAMPLED, once a task."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T._parse_datatype_string("n_shingles bigint, cls bigint, bands array<struct<band:bigint,spare:bigint,keys:bigint>>, sample array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def sample(c: int | None, s: np.ndarray) -> np.ndarray | None:
            if c is None or c % SAMPLED or c in seen:
                return None
            if len(seen) >= TASK_CLASSES:
                seen.clear()
            seen.add(c)
            return np.concatenate([keys for _, _, keys in band_signatures(s)]).view(np.int64)

        for rows, sets in _text_batches(batches, text):
            classes = [class_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.array([band_sizes(s) if len(s) else None for s in sets], BANDS),
                pa.array([sample(c, s) for c, s in zip(classes, sets, strict=True)], pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "cls", "bands", "sample"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, schema)


def hot_signatures(profile: DataFrame, hot: int = HOT_CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of about ``hot`` classes or more, ascending, and their number of classes: HOT_KEYS at most.
    Which ones they are decides how rows are dealt to tasks and the order of signatures, never the links."""
    sampled = profile.where("sample is not null").select("cls", "sample").dropDuplicates(["cls"])
    counts = sampled.select(F.explode("sample").alias("key")).groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("n")).where(F.col("n") >= hot)
    found = counts.orderBy(F.desc("n"), "key").limit(HOT_KEYS).toPandas().sort_values("key")
    return found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def signatures(docs: DataFrame, text: str = "text", hot: Broadcast | None = None) -> DataFrame:
    """key, cls: the signatures of every class; those of hot signatures have the HOT bit. A task writes a
    class once; copies in other tasks repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known = hot.value[0] if hot is not None else np.empty(0, np.int64)
        for _, sets in _text_batches(batches, text):
            keys, owners = [], []
            for s in sets:
                c = class_of(s) if len(s) else None
                if c is None or c in seen:
                    continue
                if len(seen) >= TASK_CLASSES:
                    seen.clear()
                seen.add(c)
                for _, _, found in band_signatures(s):
                    keys.append(found)
                    owners.append(np.full(len(found), c, np.int64))
            if keys:
                flat = np.concatenate(keys).view(np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    flat = flat | np.where(known[at] == flat, HOT, 0)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.concatenate(owners))], ["key", "cls"])

    return docs.select(F.col(text).alias(text)).mapInArrow(run, "key bigint, cls bigint")


def shared_signatures(keyed: DataFrame, tasks: int, hot: Broadcast | None = None) -> DataFrame:
    """key, cls and sharing for the keys of two classes or more: sorted within the tasks, then read as a
    stream that holds one key's classes at a time.

    sharing is a function of the key alone, which is all that the order of signatures needs: the number of
    classes; from SATURATED rows on that number, and such rows are passed on in pieces; for hot keys, whose
    rows are dealt by key and class to all tasks, what the sample says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = hot.value if hot is not None else (np.empty(0, np.int64),) * 2

        def groups(k: np.ndarray, c: np.ndarray, saturated: bool = False) -> pa.RecordBatch:
            spread = (k & HOT) != 0
            many = spread | saturated
            same = k[1:] == k[:-1]
            many[1:] |= same
            many[:-1] |= same
            k, c = k[many], c[many]  # few are left to order by class
            order = np.lexsort((c, k))
            k, c = k[order], c[order]
            new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))[: len(k)]
            k, c = k[new], c[new]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
            size = np.diff(np.append(first, len(k)))
            sharing = np.repeat(size, size)
            if saturated:
                sharing[:] = SATURATED
            spread = (k & HOT) != 0
            if spread.any():
                sharing[spread] = sizes[np.searchsorted(known, k[spread] & ~HOT)]
            keep = sharing > 1
            return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(c[keep]), pa.array(sharing[keep])], ["key", "cls", "sharing"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key, which may go on in the next batch
        rows, passed = 0, False

        def last() -> pa.RecordBatch:
            k, c = (np.concatenate(x) for x in zip(*held, strict=True))
            return groups(k, c, passed or len(k) >= SATURATED)

        for batch in batches:
            k, c = batch.column("key").to_numpy(), batch.column("cls").to_numpy()
            if not len(k):
                continue
            if held:
                on = int(np.searchsorted(k, held[0][0][0], "right"))
                held.append((k[:on], c[:on]))
                rows += on
                k, c = k[on:], c[on:]
                if len(k) or rows >= SATURATED:
                    yield last()
                    passed = not len(k)
                    held, rows = [(held[0][0][:1], held[0][1][:1])] if passed else [], 0
            if len(k):
                cut = int(np.searchsorted(k, k[-1]))
                yield groups(k[:cut], c[:cut])
                held, rows, passed = [(k[cut:], c[cut:])], len(k) - cut, False
        if held:
            yield last()

    deal = F.when(F.col("key").bitwiseAND(F.lit(HOT)) != 0, F.xxhash64("key", "cls")).otherwise(F.col("key"))
    dealt = keyed.repartition(tasks, deal).sortWithinPartitions("key")  # by one number: a radix sort
    return dealt.mapInArrow(run, "key bigint, cls bigint, sharing bigint")


def kept_signatures(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """key, cls, weight: of each class's shared keys those that its ``spare`` doesn't cover; weight is the
    share of the class's keys in the band that are shared."""
    band = F.col("key").bitwiseAND(F.lit(31))
    of = F.filter("bands", lambda b: b["band"] == band)[0]
    rows = shared.join(classes.select("cls", "bands"), "cls").withColumns({"band": band, "spare": of["spare"], "keys": of["keys"]}).drop("bands")
    own = Window.partitionBy("cls", "band")
    rank = F.row_number().over(own.orderBy(F.desc("sharing"), F.desc("key")))
    rows = rows.withColumns({"rank": rank, "weight": F.count(F.lit(1)).over(own) / F.col("keys")})
    return rows.where(F.col("rank") > F.col("spare")).select("key", "cls", "weight")


def _folded(x: Column) -> Column:
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def may_link(n_a: Column, sketch_a: Column, n_b: Column, sketch_b: Column) -> Column:
    """Sizes within 3/4 and sketches not farther apart than linked sets can be."""
    near = F.size(sketch_a) - F.size(sketch_b)
    a = F.when(near > 0, _folded(sketch_a)).otherwise(sketch_a)
    b = F.when(near < 0, _folded(sketch_b)).otherwise(sketch_b)
    hamming = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (4 * F.least(n_a, n_b) >= 3 * F.greatest(n_a, n_b)) & (7 * hamming <= n_a + n_b)


def class_sets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """cls, n, sketch, elements of the classes in wanted.cls, made from the texts again. A bitmap of the wanted
    classes keeps the others' sets in their tasks; what it lets through by chance joins with nothing."""
    flagged = wanted.select("cls", (F.pmod(F.col("cls"), F.lit(BITMAP_BITS))).alias("bit"))
    found = flagged.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 64) as int))")).alias("bits")).toPandas()
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _text_batches(batches, text):
            ids, elements = [], []
            for s in sets:
                c = class_of(s) if len(s) else None
                if c is None or c in seen or not int(shared.value[(c % BITMAP_BITS) >> 6]) >> (c % 64) & 1:
                    continue
                if len(seen) >= TASK_CLASSES:
                    seen.clear()
                seen.add(c)
                ids.append(c)
                elements.append(s.view(np.int64))
            if ids:
                offsets = np.cumsum([0, *map(len, elements)]).astype(np.int32)
                sketches = [parity_sketch(s.view(np.uint64)) for s in elements]
                lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values)))
                folded = lists(np.cumsum([0, *map(len, sketches)]).astype(np.int32), sketches)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(offsets), pa.int64()), folded, lists(offsets, elements)], ["cls", "n", "sketch", "elements"])

    made = docs.select(text).mapInArrow(run, "cls bigint, n bigint, sketch array<bigint>, elements array<bigint>").join(wanted.select("cls"), "cls", "left_semi")
    return made.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "elements")])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link."""
    left = sets.select(F.col("cls").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= 75 * (F.size("x") + F.size("y") - both)).select("a", "b")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """cls, label (smallest class of its component) for every class in links (a, b): large and small
    stars in turn, each step written out, until nothing changes.

    A step's least neighbours are summed up on the map side and written before they are joined with the
    edges, so that the adaptive join can split the edges of a hub. Nothing is grouped right behind a join by
    the same key: that would keep its partitions whole.
    """
    edges = scratch.write(links.select(F.col("a").alias("u"), F.col("b").alias("v")))  # repeated ones do no harm
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v")
        oriented = scratch.write(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        least = scratch.write(oriented.groupBy("u").agg(F.min("v").alias("m")))
        starred = oriented.join(least, "u")
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = scratch.write(small)
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("label"))
        mark = new


def class_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT_CLASSES) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, cls of every document, and component_id, stays of every class: stays for the
    smallest class of those that have the component's smallest doc_id. Both are written tables."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with Scratch(spark) as scratch:
        profiled = scratch.write(profiles(docs))
        profile = materialize(profiled.select("doc_id", "n_shingles", "cls"))
        filled = profiled.where(F.col("cls").isNotNull())
        classes = scratch.write(filled.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
        elements = classes.agg(F.sum("n")).first()[0] or 0
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(elements * 0.7 // ROWS_PER_TASK) + 1)
        known = hot_signatures(profiled, hot)
        told = spark.sparkContext.broadcast(known) if len(known[0]) else None
        kept = scratch.write(kept_signatures(shared_signatures(signatures(docs, hot=told), tasks, told), classes))

        pivots = scratch.write(kept.groupBy("key").agg(F.max(F.struct("weight", "cls"))["cls"].alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"))
        starred = kept.join(pivots, "key").where("cls != pivot")
        tried = scratch.write(starred.select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct())
        sets = scratch.write(class_sets(docs, kept.select("cls").distinct()))  # of all that may be compared, in either round
        sized = sets.select("cls", "n", "sketch")
        named = lambda c: sized.select(*[F.col(x).alias(f"{x}_{c}" if x != "cls" else c) for x in sized.columns])
        first = tried.join(named("a"), "a").join(named("b"), "b").where(may_link(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b")))
        labels = components(verified(scratch.write(first.select("a", "b")), sets), scratch)

        placed = scratch.write(kept.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")))
        groups = placed.groupBy("key").agg(F.max(F.struct("weight", "cls", "label")).alias("pivot"), F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
        groups = scratch.write(groups.where("low != high and size > 2").select("key", F.col("pivot.cls").alias("pivot"), F.col("pivot.label").alias("main")))
        open_ = scratch.write(placed.join(groups, "key").where("cls != pivot").select("key", "cls", "label", "main").join(sized, "cls"))
        side = lambda df, c: df.select("key", *[F.col(x).alias(f"{x}_{c}") for x in ("cls", "label", "main", "n", "sketch")])
        apart = side(open_.where("label != main"), "a").join(side(open_, "b"), "key").where((F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("main_b")) | (F.col("cls_a") < F.col("cls_b"))))
        second = apart.where(may_link(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b")))
        second = scratch.write(second.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        if not second.isEmpty():
            labels = components(labels.select(F.col("cls").alias("a"), F.col("label").alias("b")).union(verified(second, sets)), scratch)

        placed = scratch.write(classes.select("cls", "rep").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")))
        # the smallest id of a component; a null one only if there is no other
        heads = scratch.write(placed.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "cls")).alias("head")).select("label", F.col("head.rep").alias("component_id"), F.col("head.cls").alias("head")))
        return profile, materialize(placed.join(heads, "label").select("cls", "component_id", (F.col("cls") == F.col("head")).alias("stays")))


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT_CLASSES) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    profile, found = class_components(docs, doc_id, text, hot)
    out = profile.join(found, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, of which one per component stays: that with the component's smallest id
    (of several such rows, one of the smallest class). Documents without words stay. Ids that occur once
    are decided by id; the rows of other ids, null ones among them, by their own classes."""
    profile, found = class_components(docs, doc_id, text)
    stays = F.col("cls").isNull() | (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    fates = materialize(profile.join(found, "cls", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(stays).alias("stays")).where("rows > 1 or not stays or doc_id is null"))
    rows = beside(docs, doc_id=doc_id, text=text)
    kept = rows.where("doc_id is not null").join(fates, "doc_id", "left_anti").select("row.*")
    odd = fates.where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("odd_id"))
    if odd.isEmpty():
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _text_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], ["row", "doc_id", "cls"])

    again = rows.join(odd, F.col("doc_id").eqNullSafe(F.col("odd_id")), "left_semi")
    classed = again.mapInArrow(run, T.StructType([again.schema["row"], again.schema["doc_id"], T.StructField("cls", T.LongType())]))
    placed = classed.join(found, "cls", "left").where(stays)
    one = placed.where("cls is not null").groupBy("cls").agg(F.first("row").alias("row"))
    return kept.unionByName(placed.where("cls is null").select("row.*")).unionByName(one.select("row.*"))
