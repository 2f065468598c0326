"""Quality rules by distribution divergence, in DataFrame functions only.

Base counts of every text (words, symbols, repeated lines, words in repeated 5-word windows) give a
first verdict. A text that passes is compared with references of all labelled languages: its histogram of
character classes and that of common words, by Jensen-Shannon distance; it is kept if one and the same
language is near enough in both. A language's common words are those that most of its labelled documents
hold, and its reference sums up the histograms of all its labelled documents that pass the base rule.

The text is read twice: for the languages' common words, and for the counts and histograms, which are
written to the shared folder (without the text, unless the caller wants it back), summed up by language,
and judged.

Cases: a null text counts as empty (no words, so it fails the base rule); documents below
``min_words`` skip the divergence test, their histograms are too noisy; rows are independent, so ties,
repeated rows and repeated ids each get their own verdict; an empty table gives an empty result; a
corpus without labelled languages has no references, and only the base rules decide; more labels than
``max_langs`` end the job with an error, as a language without a reference would lose its documents.
Columns of the input that clash with ours are replaced in the result of ``quality_rules``;
``kept_documents`` gives back whatever columns it gets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm.common import let, materialize

WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Character classes of the histogram, beside white space and the rest (mostly lower-case letters).
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "symbol": r"#*$%&|<>",
    "stop": r".,;:?'()\x22-",
}


#: Columns of ``quality_features``.
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_hist", "word_hist"]


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 60  #: below this the divergence test is skipped
    common: int = 8  #: common words of each language
    max_class_distance: float = 0.28  #: Jensen-Shannon distance of the character classes
    max_word_distance: float = 0.25  #: and of the common words
    slack: float = 0.3  #: added to both limits as slack / sqrt(number of words): sampling noise
    max_langs: int = 2000  #: languages whose references the driver is meant to hold


def _split(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def _windows(words: Column) -> Column:
    """64-bit hashes of the 5-word windows, in order. Two different windows of a text of n words meet
    with a chance of about n^2 / 2^65."""

    def hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashes))


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur twice or more: sorted, equal neighbours give the places,
    and each place adds the words up to the next one, 5 at most."""

    def total(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(sorted_: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(sorted_, j)["g"] == x["g"], F.lit(False))
        twice = F.filter(sorted_, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), total)

    pairs = F.transform(windows, lambda x, i: F.struct(x.alias("g"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), repeated))


def common_words(docs: DataFrame, config: QualityConfig = QualityConfig(), text: str = "text", lang: str = "lang") -> list[str]:
    """The ``common`` words of each language that most of its labelled documents hold (of equals the first
    in order), all together, sorted: at most max_langs times common reach the driver."""
    found = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), _split(F.col(text)).alias("words")).where(F.size("words") >= config.min_words)
    counts = found.select("lang", F.explode(F.array_distinct("words")).alias("word")).groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= config.common).select("lang", "word").limit(config.max_langs * config.common + 1).collect()
    if len(rows) > config.max_langs * config.common:
        raise ValueError(f"more than {config.max_langs} labels of languages")
    return sorted({r["word"] for r in rows})


def quality_features(docs: DataFrame, words: list[str], config: QualityConfig = QualityConfig(), text: str = "text") -> DataFrame:
    """docs with the base counts, ``base_failed`` and the two histograms (arrays of counts; the last place of
    word_hist holds all other words). Columns named like ours, or _ and a name, give way.

    What is left of a text without its lower-case letters and blanks is short, so only one expression
    runs over every character; common words are counted by what removing them takes away.
    """
    given = docs.columns
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumns({
        "_words": _split(F.col("_t")),
        "_rest": F.regexp_replace("_t", r"[\p{Ll}\x20]+", ""),
        "_blanks": F.octet_length("_t") - F.octet_length(F.replace(F.col("_t"), F.lit(" "), F.lit(""))),
        "_length": F.length("_t"),
    })
    of = lambda keep: F.length(F.regexp_replace("_rest", f"[^{keep}]+", ""))
    out = out.withColumns({
        **{f"_{k}": of(c) for k, c in CLASSES.items()},
        "_space": F.col("_blanks") + of(r"\x09-\x0D"),
        "_common": F.concat(F.lit(" "), F.array_join(F.filter("_words", lambda w: w.isin(words)), "  "), F.lit(" ")),
        "n_words": F.size("_words").cast("long"),
    })
    seen = lambda w: (F.octet_length("_common") - F.octet_length(F.replace(F.col("_common"), F.lit(f" {w} "), F.lit("")))) / F.lit(len(w.encode()) + 2)
    classes = [F.col(f"_{k}") for k in CLASSES] + [F.col("_space")]
    out = out.withColumns({
        "word_chars": (F.col("_length") - F.col("_space")).cast("long"),
        "n_symbols": F.col("_symbol").cast("long"),
        "class_hist": F.array(*classes, F.col("_length") - sum(classes[1:], classes[0])).cast("array<bigint>"),
        "_counts": F.array(*map(seen, words)).cast("array<bigint>"),
        "_lines": F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0),
        "_windows": _windows(F.col("_words")),
    })
    others = F.col("n_words") - F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns({
        "word_hist": F.concat("_counts", F.array(others)),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _covered(F.col("_windows")),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.select(*[F.col(f"`{c}`") for c in given if c not in MADE], *MADE)


def language_references(features: DataFrame, config: QualityConfig = QualityConfig(), lang: str = "lang") -> dict[str, tuple[list[int], list[int]]]:
    """Histogram totals by language, of all labelled documents with ``min_words`` words that pass the base
    rule. One row per language reaches the driver. Integer sums: the order of rows never matters."""
    clean = features.where(F.col(lang).isNotNull() & ~F.col("base_failed") & (F.col("n_words") >= config.min_words))
    places = clean.select(F.col(lang).alias("lang"), F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("class_hist").alias("hist")), F.struct(F.lit(1).alias("of"), F.col("word_hist").alias("hist")))).alias("h"))
    sums = places.select("lang", "h.of", F.posexplode("h.hist").alias("place", "n")).groupBy("lang", "of", "place").agg(F.sum("n").alias("n"))
    found: dict[str, tuple[list[int], list[int]]] = {}
    for r in sums.orderBy("lang", "of", "place").collect():
        found.setdefault(r["lang"], ([], []))[r["of"]].append(r["n"])
    return found


def js_distance(hist: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram column to fixed reference counts."""
    whole = sum(reference) or 1
    ref = F.array(*[F.lit(x / whole) for x in reference])

    def term(p: Column, q: Column) -> Column:
        of = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
        return of(p) + of(q)

    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = let(total.cast("double"), lambda n: F.transform(hist, lambda x: x / n))
    sum_ = F.aggregate(F.zip_with(shares, ref, term), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), sum_ / 2))).otherwise(F.lit(1.0))


def quality_verdict(features: DataFrame, references: dict[str, tuple[list[int], list[int]]], config: QualityConfig = QualityConfig()) -> DataFrame:
    """Adds class_distance and word_distance, both to the language that is nearest by their sum, and ``kept``."""
    if not references:
        return features.withColumns({"class_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double"), "kept": ~F.col("base_failed")})
    noise = F.lit(config.slack) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    each = F.array(*[F.struct(js_distance(F.col("class_hist"), c).alias("c"), js_distance(F.col("word_hist"), w).alias("w")) for _, (c, w) in sorted(references.items())])
    near = F.exists("_each", lambda d: (d["c"] <= config.max_class_distance + noise) & (d["w"] <= config.max_word_distance + noise))
    best = F.array_min(F.transform("_each", lambda d: F.struct((d["c"] + d["w"]).alias("s"), d["c"].alias("c"), d["w"].alias("w"))))
    out = features.withColumn("_each", each)
    return out.withColumns({"class_distance": best["c"], "word_distance": best["w"], "kept": ~F.col("base_failed") & ((F.col("n_words") < config.min_words) | near)}).drop("_each")


def quality_rules(docs: DataFrame, config: QualityConfig = QualityConfig(), text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those in ``carry``) with counts, histograms, distances and ``kept``."""
    names = docs.columns if carry is None else carry
    words = common_words(docs, config, text, lang)
    own = [f"`{c}`" for c in names if c not in [*MADE, "class_distance", "word_distance", "kept"]]
    found = _judged(docs, docs.select(*map(F.col, own)), words, config, text, lang)
    return found.select("row.*", *MADE, "class_distance", "word_distance", "kept")


def _judged(docs: DataFrame, carried: DataFrame, words: list[str], config: QualityConfig, text: str, lang: str) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried.columns]).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    features = materialize(quality_features(rows, words, config).drop("text"))
    return quality_verdict(features, language_references(features, config), config)


def kept_documents(docs: DataFrame, config: QualityConfig = QualityConfig(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, all columns, that the rules keep."""
    found = _judged(docs, docs, common_words(docs, config, text, lang), config, text, lang)
    return found.where("kept").select("row.*")
