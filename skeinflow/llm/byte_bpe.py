"""Byte-level BPE by a rank file: the tokenizers library over Arrow batches, with a byte-to-character
table, offsets, and a decoder that reverses the table.

The rank file gives each token's bytes and rank. The vocabulary of the library needs printable tokens,
so each byte maps to one character; the merges are recovered from the ranks (a token's last merge is
what merging its bytes by lower ranks leaves as two parts). The text splits by the given pattern, and
each match is encoded separately, without special tokens.

Cases: a null text counts as empty (no tokens, digests of nothing); very long texts are encoded whole
(batches are bounded by characters, so one text is at most a batch of its own); ids may cut a character
in two, so decoding joins the bytes of all ids before it reads UTF-8, and shows what stays incomplete
as U+FFFD; ties, repeated rows and empty tables need no care, rows are independent. Input columns whose
names clash with the results give way to them.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

#: Characters of text that one call of the encoder sees at most, unless one text is longer.
BATCH_CHARS = 1_000_000
#: Matches of the pattern whose ids a worker keeps; beyond that it starts anew.
KNOWN_MATCHES = 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes the token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class RankEncoder:
    """The tokenizers library set up from a rank file; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks, shown = read_ranks(path), byte_characters()
        show = lambda token: "".join([shown[b] for b in token])
        order = sorted((r, t) for t, r in ranks.items() if len(t) > 1)
        merges = [tuple(map(show, last_merge(t, ranks))) for _, t in order]
        vocab = {show(t): r for t, r in ranks.items()}
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.matches = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))  # of one match of the pattern
        self.matches.pre_tokenizer = as_bytes
        self.whole = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))  # of a text, with offsets
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), as_bytes])
        self.pattern = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.table[r] = t

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Each match is encoded once while it is known; a text's ids are those of its matches."""
        found = [self.pattern.findall(t) for t in texts]
        if len(self.known) > KNOWN_MATCHES:
            self.known.clear()
        new = list(set(chain.from_iterable(found)).difference(self.known))
        self.known.update(zip(new, [e.ids for e in self.matches.encode_batch_fast(new, add_special_tokens=False)], strict=True))
        return [list(chain.from_iterable(map(self.known.__getitem__, f))) for f in found]

    def ids_and_starts(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        found = self.whole.encode_batch(texts, add_special_tokens=False)
        return [e.ids for e in found], [[o[0] for o in e.offsets] for e in found]


@lru_cache(maxsize=4)
def load_encoder(path: str, pattern: str) -> RankEncoder:
    return RankEncoder(path, pattern)


def decode_ids(ids, table: list[bytes]) -> bytes:
    """The bytes that the ids stand for, joined; characters split between ids come together again."""
    return b"".join([table[i] for i in ids])


def _in_batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > BATCH_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def _kept(batch: pa.RecordBatch, names: list[str]) -> pa.Table:
    return pa.Table.from_batches([batch]).select(names)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """docs with ``n_tokens``, ``ids`` and, if asked for, ``token_starts``: the character of the text at
    which each token starts (for a token inside a character, that character)."""
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("token_starts", T.ArrayType(T.IntegerType()))] * offsets
    names = [c for c in docs.columns if c not in ("n_tokens", "ids", "token_starts")]
    schema = T.StructType([*[docs.schema[c] for c in names], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            rows = _kept(batch, names)
            for a, b in _in_batches(texts):
                ids, starts = encoder.ids_and_starts(texts[a:b]) if offsets else (encoder.ids(texts[a:b]), None)
                out = rows.slice(a, b - a)
                out = out.append_column("n_tokens", pa.array([len(x) for x in ids], pa.int64()))
                out = out.append_column("ids", pa.array(ids, pa.list_(pa.int32())))
                if offsets:
                    out = out.append_column("token_starts", pa.array(starts, pa.list_(pa.int32())))
                yield from out.combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """encoded with ``decoded_bytes`` and ``decoded`` (UTF-8, incomplete characters as U+FFFD). Null ids
    decode to nothing; an id outside the table fails."""
    names = [c for c in encoded.columns if c not in ("decoded_bytes", "decoded")]
    schema = T.StructType([*[encoded.schema[c] for c in names], T.StructField("decoded_bytes", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_encoder(ranks_path, pattern).table
        for batch in batches:
            raw = [decode_ids(x or [], table) for x in batch.column(ids).to_pylist()]
            out = _kept(batch, names).append_column("decoded_bytes", pa.array(raw, pa.binary()))
            out = out.append_column("decoded", pa.array([x.decode("utf-8", "replace") for x in raw], pa.string()))
            yield from out.combine_chunks().to_batches()

    return encoded.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text: encoded, then decoded from
    the ids in the same task, so that neither ids nor decoded bytes travel."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            n, coded, decoded = [], [], []
            for a, b in _in_batches(texts):
                for ids in encoder.ids(texts[a:b]):
                    n.append(len(ids))
                    coded.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(decode_ids(ids, encoder.table)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(doc_id, text).mapInArrow(run, schema)
