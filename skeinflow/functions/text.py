"""Text functions as Column expressions; one Arrow UDF, for NFKC, which Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

EDGES = "(?U)^[\\s\\x{FEFF}]+|[\\s\\x{FEFF}]+$"
#: Scripts that count as CJK.
CJK = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end; Spark's own trim only knows the blank."""
    return F.regexp_replace(c, EDGES, "")


def norm_compare(c: Column) -> Column:
    """Key of exact name matches: trimmed, lower case."""
    return F.lower(trimmed(c))


def norm_lookup(c: Column) -> Column:
    """Key of lookups: trimmed, runs of white space as one blank, lower case."""
    return F.lower(collapsed(c))


def collapsed(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), "(?U)\\s+", " ")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(values: pd.Series) -> pd.Series:
    return values.map(lambda a: None if a is None else [None if v is None else unicodedata.normalize("NFKC", v) for v in a])


#: What NFKC may change: all but ASCII, controls, letters of Latin-1, ideographs and some punctuation.
COMPOSED = "[^\\x{0}-\\x{9F}\\x{C0}-\\x{FF}\\x{2013}-\\x{2014}\\x{2018}-\\x{2019}\\x{201C}-\\x{201D}\\x{3001}-\\x{3002}\\x{3008}-\\x{3011}\\x{4E00}-\\x{9FFF}]"


def nfkc(c: Column) -> Column:
    """NFKC; only texts that it may change go to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(COMPOSED), c)), c)


def nfkc_each(items: Column) -> Column:
    return F.coalesce(_nfkc_each(F.when(F.exists(items, lambda x: x.rlike(COMPOSED)), items)), items)


GAPS = "(?U)[\\p{P}\\s]+"


def norm_contact(c: Column) -> Column:
    """Key of near matches: NFKC, lower case, without punctuation and white space."""
    return F.regexp_replace(F.lower(nfkc(c)), GAPS, "")


def norm_contacts(items: Column) -> Column:
    """norm_contact of each string of an array (a lambda can't call the UDF itself)."""
    return F.transform(nfkc_each(items), lambda x: F.regexp_replace(F.lower(x), GAPS, ""))


def tokens(c: Column) -> Column:
    """Pieces between punctuation and white space after NFKC and lower case."""
    return F.filter(F.split(F.lower(nfkc(c)), GAPS), lambda x: x != "")


def tokens_of(items: Column) -> Column:
    """tokens of all strings of an array, each once."""
    return F.array_distinct(F.filter(F.flatten(F.transform(nfkc_each(items), lambda x: F.split(F.lower(x), GAPS))), lambda x: x != ""))


def escaped(c: Column) -> Column:
    """A text as the part of a pattern that stands for itself, whatever it holds."""
    return F.regexp_replace(c, "([\\\\^$.|?*+()\\[\\]{}])", "\\\\$1")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, by code points; 0 if either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def edits_within(a: Column, b: Column, similarity: float) -> Column:
    """Edits between two texts of these lengths that are so similar, at most."""
    return F.floor((1 - similarity) * F.greatest(a, b) + 1e-9).cast("int")


def at_least_similar(a: Column, b: Column, similarity: float) -> Column:
    """edit_similarity(a, b) >= similarity, by a distance that gives up beyond the limit (and one edit more, so
    that rounding decides nothing); texts whose lengths rule it out aren't compared."""
    longer, apart = F.greatest(F.length(a), F.length(b)), F.abs(F.length(a) - F.length(b))
    most = edits_within(F.length(a), F.length(b), similarity) + 1
    near = F.call_function("levenshtein", a, b, most)
    return F.when((F.length(a) == 0) | (F.length(b) == 0) | (apart > most), F.lit(False)).otherwise((near >= 0) & (1 - near / longer >= similarity))


def optional(c: Column) -> Column:
    """Trimmed, blank as null."""
    return F.nullif(trimmed(c), F.lit(""))


def truncated(c: Column, n: int) -> Column:
    """First n code points."""
    return F.substring(c, 1, n)


def cjk_ratio(c: Column) -> Column:
    """CJK letters among all letters; 0 without a letter."""
    letters = F.regexp_count(c, F.lit("\\p{L}"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.regexp_count(c, F.lit(f"{CJK}")) / letters)


def distinct_strings(items: Column) -> Column:
    """Trimmed, without blanks, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(items, trimmed), lambda x: x != ""))


def joined_quotes(items: Column) -> Column:
    return F.array_join(distinct_strings(items), "\n\n")


def alias_list(c: Column) -> Column:
    """Aliases written in one field, separated by commas of either width, enumeration commas or newlines."""
    return distinct_strings(F.split(c, "[,、，\n]"))


def without_fence(c: Column) -> Column:
    """Model output without a Markdown fence around it."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), "^```[A-Za-z]*\\s*", ""), "\\s*```$", ""))


#: 'label: content' on one line: a label of up to 20 characters without digits.
LABELLED = "^([^:：\\n\\d]{1,20})[:：]\\s*([^\\n\\r\\u2028\\u2029]*)\\z"


def label_of(c: Column) -> Column:
    """Label of 'label: content', as written; '' without one."""
    return F.regexp_extract(c, LABELLED, 1)


def content_of(c: Column) -> Column:
    """What follows the label; all of it without one."""
    return F.when(label_of(c) != "", F.regexp_extract(c, LABELLED, 2)).otherwise(c)


def label_key(c: Column) -> Column:
    """norm_contact of the label; null without one."""
    return norm_contact(F.nullif(label_of(c), F.lit("")))


def content_key(c: Column) -> Column:
    """norm_contact of what follows the label."""
    return norm_contact(content_of(c))


def shortest_sentence(quote: Column, value: Column) -> Column:
    """Shortest sentence of a quote that holds the value (the first of equals), else the whole quote."""
    parts = F.filter(F.transform(F.split(quote, "[。！？!?.\n]"), trimmed), lambda x: F.contains(x, value) & (x != ""))
    sized = F.array_sort(F.transform(parts, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))
    return F.coalesce(F.get(sized, F.lit(0))["x"], quote)


def mentions(text: Column, names: Column) -> Column:
    """Whether '@', blanks and one of the names stand in the text."""
    return F.exists(names, lambda n: (n != "") & (F.regexp_count(text, F.concat(F.lit("(?U)@\\s*"), escaped(n))) > 0))


def composed_of(text: Column, words: Column) -> Column:
    """Whether the text is a chain of the words and nothing else."""
    quoted = F.transform(F.filter(words, lambda w: w != ""), escaped)
    return (F.size(quoted) > 0) & F.rlike(text, F.concat(F.lit("^(?:"), F.array_join(quoted, "|"), F.lit(")+$")))


def without_speaker(text: Column, names: Column) -> Column:
    """Text after the last place where one of the names is followed by punctuation or a blank; '' if the text
    is a label that ends in a name behind such a separator; all of it if no name stands so."""
    separator = "(?U)^[\\p{P}\\s]"
    known = F.filter(names, lambda n: n != "")
    before = lambda n: F.call_function("instr", F.reverse(text), F.reverse(n))  # noqa: E731  from the end: 1 if it ends in the name
    end = lambda n: F.length(text) - before(n) + 1  # noqa: E731  characters up to the end of the last occurrence
    follows = lambda n: F.substring(text, end(n) + 1, F.lit(1)).rlike(separator)
    bare = F.exists(known, lambda n: (before(n) == 1) & (F.length(text) > F.length(n)) & F.substring(text, F.length(text) - F.length(n), F.lit(1)).rlike(separator))
    cut = F.array_max(F.concat(F.array(F.lit(0)), F.transform(known, lambda n: F.when((before(n) > 0) & follows(n), end(n)).otherwise(0))))
    return F.when(bare, F.lit("")).otherwise(F.when(cut == 0, text).otherwise(F.substring(text, cut + 2, F.length(text))))


def key_values(detail: Column) -> Column:
    """Map of the 'key=value' lines of a text."""
    pairs = F.filter(F.split(detail, "\n"), lambda x: F.contains(x, F.lit("=")))
    entries = F.transform(pairs, lambda x: F.struct(trimmed(F.substring_index(x, "=", 1)).alias("key"), trimmed(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    # the last line of a key counts
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])))


def stack_frames(stack: Column, most: int = 8) -> Column:
    """First frames ('at ...') of a stack trace."""
    return F.slice(F.filter(F.transform(F.split(stack, "\n"), trimmed), lambda x: x.rlike("^at \\S")), 1, most)


def masked(secret: Column) -> Column:
    """All but the last four characters hidden."""
    return F.concat(F.lit("****"), F.right(trimmed(secret), F.lit(4)))


def data_uri(text: Column) -> Column:
    """Synthetic address of a pasted text: percent-encoded, blanks as %20."""
    return F.concat(F.lit("data:text/plain,"), F.replace(F.url_encode(trimmed(text)), F.lit("+"), F.lit("%20")))


def annotated_line(text: Column, side: Column, anchor: Column) -> Column:
    """'[side=... time_anchor=...] text' with the marks that are known."""
    marks = F.concat_ws(" ", F.concat(F.lit("side="), side), F.concat(F.lit("time_anchor="), anchor))
    return F.when(marks == "", text).otherwise(F.concat(F.lit("["), marks, F.lit("] "), text))


def ascii_nocase(c: Column) -> Column:
    """Folds A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
