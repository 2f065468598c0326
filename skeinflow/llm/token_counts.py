"""Token counts by compiled finite-state transducers, for byte-level BPE tokenizer files.

Two deterministic transducers, both compiled from the tokenizer file:

* the splitter reads character classes (with the look-ahead that the split pattern needs folded into
  the class) and marks on its transitions where a piece starts. It has 8 states, so a chunk of text is
  summarised by a state map: the end state for every start state. The chunks of a batch advance in
  lock-step, their maps compose by a parallel prefix scan, and the composed maps give each chunk its
  true start state.
* the counter reads the bytes of a piece; its transitions carry the change in the number of tokens of
  what was read. A state holds, for every suffix that may still grow into a token, the last token
  before that suffix and its distance in tokens. States are compiled when first reached.

Why the counter is right: with merges in rank order, a sequence of tokens is the encoding of its bytes
exactly if each neighbouring pair is the encoding of its own bytes, and dropping the last token of an
encoding leaves the encoding of the rest. So of all tokens that end at a byte just one fits the last
token before it.

Cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside texts count as the one
token that the library makes of them; very long texts and very long pieces take time in proportion to
their length; rows are independent, so repeated rows, repeated ids and ties need no care; an empty
table gives an empty result. The result has only its own columns.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skeinflow.llm.byte_bpe import byte_characters

BATCH_CHARS = 1_000_000  #: characters that the splitter reads at once, unless one text is longer
CHUNK = 256  #: characters of a chunk
KNOWN_PIECES = 300_000  #: pieces whose count a worker keeps
MAX_STATES = 200_000  #: compiled counter states that a worker keeps

NEVER = (-1, -1, -1)  #: how a single byte came about

# symbols of the splitter: what a character is, with what follows it
LETTER, NUMBER, OTHER, CLIP1, CLIP2, BLANK_LAST, SPACE_LAST, SPACE, SYMBOLS = range(9)
# its states: what is open after a character
CLOSED, LETTERS, NUMBERS, OTHERS, BLANK, SPACES, ONE_MORE, TWO_MORE = range(8)


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, piece starts here) by state and symbol; symbol + SYMBOLS is the first of a text."""
    run = {LETTER: (LETTERS, {LETTERS, BLANK}), NUMBER: (NUMBERS, {NUMBERS, BLANK}), OTHER: (OTHERS, {OTHERS, BLANK})}
    nxt, starts = np.zeros((8, 2 * SYMBOLS), np.uint8), np.zeros((8, 2 * SYMBOLS), np.uint8)
    for state in range(8):
        for symbol in range(SYMBOLS):
            if symbol in run:
                to, joins = run[symbol]
                step = (to, state not in joins)
            elif symbol in (CLIP1, CLIP2):  # an apostrophe before 's, 't, 'm, 'd or before 're, 've, 'll
                step = (OTHERS, False) if state in (OTHERS, BLANK) else (ONE_MORE if symbol == CLIP1 else TWO_MORE, True)
            elif symbol == BLANK_LAST:  # goes to the piece after it
                step = (BLANK, True)
            elif symbol == SPACE_LAST:
                step = (CLOSED, True)
            else:
                step = (SPACES, state != SPACES)
            if state == TWO_MORE and symbol == LETTER:
                step = (ONE_MORE, False)
            elif state == ONE_MORE and symbol == LETTER:
                step = (CLOSED, False)
            nxt[state, symbol], starts[state, symbol] = step
    nxt[:, SYMBOLS:], starts[:, SYMBOLS:] = nxt[CLOSED, :SYMBOLS], 1
    return nxt, starts


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of code points; first: where texts start. Looks ahead at most two characters."""
    kind = character_classes()[points]
    same = np.ones(len(points), bool)  # the next character belongs to the same text
    same[first[first > 0] - 1] = False
    same[-1:] = False
    out = kind.copy()
    space = kind == SPACE
    last = space[:-1] & ~space[1:] & same[:-1]
    at = np.flatnonzero(last)
    out[at] = np.where(points[at] == 0x20, BLANK_LAST, SPACE_LAST)
    for i in np.flatnonzero(points == 0x27).tolist():
        if same[i]:
            a = chr(points[i + 1])
            b = chr(points[i + 2]) if same[i + 1] else ""
            if a in "stmd":
                out[i] = CLIP1
            elif a + b in ("re", "ve", "ll"):
                out[i] = CLIP2
    out[first] += SYMBOLS
    return out


def piece_starts(symbols: np.ndarray, tables: tuple[np.ndarray, np.ndarray], chunk: int = CHUNK) -> np.ndarray:
    """Positions at which the splitter starts a piece."""
    nxt, starts = tables
    n, width = len(symbols), nxt.shape[1]
    if not n:
        return np.empty(0, np.int64)
    rows = -(-n // chunk)
    padded = np.zeros(rows * chunk, np.int64)
    padded[:n] = symbols
    by_step = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    step = (nxt.astype(np.int64) * width).ravel()  # states as row offsets
    maps = np.tile(np.arange(8, dtype=np.int64) * width, (rows, 1))
    for s in by_step:  # all chunks and all start states at once
        maps = step[maps + s[:, None]]
    reach, gap = maps // width, 1
    while gap < rows:  # prefix scan: reach[i] maps the start of the first chunk to the end of chunk i
        reach[gap:] = np.take_along_axis(reach[gap:], reach[:-gap].copy(), axis=1)
        gap *= 2
    state = np.concatenate([[CLOSED], reach[:-1, CLOSED]]) * width
    marks, flat = np.empty((chunk, rows), np.uint8), starts.ravel()
    for k, s in enumerate(by_step):
        marks[k] = flat[state + s]
        state = step[state + s]
    return np.flatnonzero(marks.T.ravel()[:n])


class Counter(dict):
    """Number of tokens of a piece, by the compiled transducer; remembers pieces as a dict."""

    def __init__(self, model: dict):
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda token: bytes([byte_of[c] for c in token])
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.ids[raw(a)], self.ids[raw(b)]): k for k, (a, b) in enumerate(pairs)}
        self.child: list[dict[int, int]] = [{}]  # the trie of all tokens
        self.token = [-1]
        for t, i in self.ids.items():
            node = 0
            for b in t:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = i
        self.born = {self.ids[raw(a) + raw(b)]: (k, self.ids[raw(a)], self.ids[raw(b)]) for k, (a, b) in enumerate(pairs)}
        self.reset()

    def reset(self) -> None:
        self.states = [((0, -1, 0),)]  # of each: (trie node of a suffix, last token before it, tokens since)
        self.number = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}  # state * 256 + byte: next state, change in tokens

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their bytes together: going back in time, undo the
        later merge of the two tokens at the seam; no pair that met there may merge before one of them
        was taken up. Of equal merges the left one comes first."""
        until = 1 << 40
        while self.rank.get((a, b), 1 << 40) >= until:
            born_a, born_b = self.born.get(a, NEVER), self.born.get(b, NEVER)
            if born_a[0] > born_b[0]:
                until, a = born_a[0], born_a[2]
            elif born_b[0] >= 0:
                until, b = born_b[0] + 1, born_b[1]
            else:
                return True
        return False

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        grown = [(self.child[node][byte], last, since) for node, last, since in self.states[state] if byte in self.child[node]]
        # the token that ends at this byte; longer ones first, they fit most often
        node, last, since = next(x for x in grown if self.token[x[0]] >= 0 and (x[1] < 0 or self.fits(x[1], self.token[x[0]])))
        change = 1 - since
        key = (*((n, u, d + change) for n, u, d in grown if self.child[n]), (0, self.token[node], 0))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], change

    def __missing__(self, piece: str) -> int:
        state, total = 0, 0
        for b in piece.encode():
            at = state << 8 | b
            found = self.step.get(at)
            if found is None:
                found = self.step[at] = self.compile(state, b)
            state = found[0]
            total += found[1]
        if len(self) > KNOWN_PIECES:
            self.clear()
        self[piece] = total
        if len(self.states) > MAX_STATES:
            self.reset()
        return total


class TokenCounter:
    """Counts tokens of texts as the tokenizers library does for a byte-level BPE file; one per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space can be compiled")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.tables = compile_splitter()
        self.counter = Counter(spec["model"])

    def __call__(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        parts, owner = [], []  # texts cut at special strings
        for i, t in enumerate(texts):
            cut = self.special.split(t) if self.special and self.special.search(t) else [t]
            counts[i] = len(cut) - 1
            parts += [x for x in cut if x]
            owner += [i] * sum(map(bool, cut))
        if not parts:
            return counts
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        first = np.cumsum([0, *map(len, parts[:-1])])
        starts = piece_starts(symbols_of(points, first), self.tables)
        cuts = starts.tolist()
        pieces = [whole[a:b] for a, b in zip(cuts, [*cuts[1:], len(whole)], strict=True)]
        n = np.fromiter(map(self.counter.__getitem__, pieces), np.int64, len(pieces))
        np.add.at(counts, owner, np.add.reduceat(n, np.searchsorted(starts, first)))
        return counts


@lru_cache(maxsize=2)
def load_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            n, held, chars = [], [], 0
            for t in texts:
                if held and chars + len(t) > BATCH_CHARS:
                    n.append(count(held))
                    held, chars = [], 0
                held.append(t)
                chars += len(t)
            n = np.concatenate([*n, count(held)]) if held else np.empty(0, np.int64)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(doc_id, text).mapInArrow(run, schema)
