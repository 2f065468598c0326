"""What a person's aliases and notes say beyond the structured fields: small functions over the few texts of
one person, as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

GATHERED = StructType().add("values", ArrayType(StringType())).add("quotes", ArrayType(StringType()))

# Where notes are cut, and what their parts lose at the ends.
NOTE_CUTS = re.compile(r"[\r\n]+|[，,。；;：:！？?!]+")
NOTE_EDGES = " \t\r\n　，,。；;：:！？?!、"


def _gap(c: str) -> bool:
    return c.isspace() or unicodedata.category(c).startswith("P")


def contact_key(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if not _gap(c))


def words(text: str) -> list[str]:
    return "".join(" " if _gap(c) else c for c in unicodedata.normalize("NFKC", text).lower()).split(" ")


def chained(text: str, parts: set[str]) -> bool:
    """Whether a text is a chain of the parts and nothing else."""
    reached = [True] + [False] * len(text)
    for i in range(len(text)):
        if reached[i]:
            for p in parts:
                if text.startswith(p, i):
                    reached[i + len(p)] = True
    return bool(text and parts) and reached[-1]


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[same:] == b[same + 1 :])


def derived(alias: str, names: list[str], values: list[str]) -> bool:
    """Whether an alias says nothing new of someone with these names (the first is the canonical one), known by
    these companies and titles: a known name; a chain of the values' words; a known name with such a chain, a
    part of a value, or a value but for one character before or behind it. An alias of 2 characters that
    doesn't hold the canonical name is a name of its own."""
    key, known = contact_key(alias), [k for k in map(contact_key, names) if k]
    if not key or key in known:
        return True
    if len(key) == 2 and contact_key(names[0]) not in key:
        return False
    fields = {k for k in map(contact_key, values) if k}
    parts = {w for v in values for w in words(v) if w}
    rests = [key[len(n) :] if key.startswith(n) else key[: -len(n)] for n in known if key.startswith(n) or key.endswith(n)]
    near = lambda rest, v: rest in v or (len(rest) >= 3 and one_edit(rest, v)) or (v in rest and len(rest) - len(v) == 1)
    return chained(key, parts) or any(r and (chained(r, parts) or any(near(r, v) for v in fields)) for r in rests)


def free_parts(note: str, values: list[str]) -> list[str]:
    """The parts of a note that say more than structured values: all of a note that holds no value; nothing of
    one that is a value. Else it is cut at sentence marks, and of a part that holds one value, once, what
    follows it stays, of a part without one all, of others nothing."""
    note = note.strip()
    known = list(dict.fromkeys(v.strip().lower() for v in values if v.strip()))
    if not note or note.lower() in known:
        return []
    if not any(v in note.lower() for v in known):
        return [note]
    out = []
    for part in filter(None, (p.strip() for p in NOTE_CUTS.split(note))):
        low = part.lower()
        held = [v for v in known if v in low]
        if not held:
            out.append(part.strip(NOTE_EDGES))
        elif len(held) == 1 and low.find(held[0]) == low.rfind(held[0]):
            tail = part[low.find(held[0]) + len(held[0]) :].strip(NOTE_EDGES)
            if not any(v in tail.lower() for v in known):
                out.append(tail)
    return [p for p in out if p]


def collected(entries: list[tuple[str | None, list[str]]]) -> tuple[list[str], list[str]]:
    """Of (quote, values) entries each value once, and the quotes of entries that bring a new one."""
    values: list[str] = []
    quotes: list[str] = []
    for quote, found in entries:
        new = [v for v in dict.fromkeys(found) if v not in values]
        values += new
        if new and quote is not None:
            quotes.append(quote)
    return values, quotes


@F.pandas_udf(ArrayType(StringType()))
def derived_aliases(aliases: pd.Series, names: pd.Series, values: pd.Series) -> pd.Series:
    """Those of an array of aliases that are derived."""
    return pd.Series([[a for a in x if derived(a, list(n), [v for v in f if v])] for x, n, f in zip(aliases, names, values, strict=True)], dtype=object)


@F.pandas_udf(GATHERED)
def _notes(note: pd.Series, quote: pd.Series, told: pd.Series, told_quotes: pd.Series, values: pd.Series, value_quotes: pd.Series) -> pd.DataFrame:
    rows = []
    for n, q, t, tq, v, vq in zip(note, quote, told, told_quotes, values, value_quotes, strict=True):
        plain = lambda s: (s or "").strip().lower()
        every = {plain(x) for x in v}
        same = lambda source: [x for x, y in zip(v, vq, strict=True) if plain(y) == plain(source)]  # noqa: E731, B023
        said = [(q, n or ""), *zip(tq, t, strict=True)]
        rows.append(collected([(source, [] if plain(x) in every else free_parts(x or "", same(source))) for source, x in said]))  # noqa: B023
    return pd.DataFrame(rows, columns=["values", "quotes"])


@F.pandas_udf(GATHERED)
def _aliases(own: pd.Series, told: pd.Series, told_quotes: pd.Series) -> pd.DataFrame:
    trim = lambda xs: [x.strip() for x in xs if x and x.strip()]
    return pd.DataFrame([collected([(None, trim(o)), *((q, trim([x])) for x, q in zip(t, tq, strict=True))]) for o, t, tq in zip(own, told, told_quotes, strict=True)], columns=["values", "quotes"])


def gathered_notes(note: Column, quote: Column, facts: Column, anchors: Column) -> Column:
    """values and quotes of a person's note and of facts (value, source_quote), without what structured values
    of the same quote (anchors: quote, value) say."""
    return _notes(note, quote, facts["value"], facts["source_quote"], anchors["value"], anchors["quote"])


def gathered_aliases(own: Column, facts: Column) -> Column:
    """values and quotes of a person's aliases and those that facts name."""
    return _aliases(own, facts["value"], facts["source_quote"])
