"""Matching operators. Similarity conditions stand behind equality keys, never in a nested loop."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions import rules
from skeinflow.functions.text import ascii_nocase, at_least_similar, edits_within, norm_compare, norm_lookup, once
from skeinflow.scratch import materialize

GRAM = 3  #: characters of the pieces that similar texts share
GRAM_BUCKETS = 1 << 14  #: of pieces, whose counts are told to all tasks
EARLIEST = (32, 256, 2048)  #: first quotes of a batch that the others are held against, in rounds
PART = 4096  #: quotes of a batch that meet others in one task
HEADS = 256  #: quotes of a key that each text is held against before pieces of texts are made


def exact_matches(people: DataFrame, contacts: DataFrame, person: str, name: str, contact_id: str, contact_name: str, aliases: str) -> DataFrame:
    """(person, contact) of all contacts whose name or alias equals the name, trimmed and in lower case."""
    keys = contacts.select(F.col(contact_id), F.explode(F.concat(F.array(contact_name), F.coalesce(aliases, F.array()))).alias("_name"))
    keys = keys.select(contact_id, norm_compare(F.col("_name")).alias("_key")).where("_key != ''").distinct()
    return people.select(person, norm_compare(F.col(name)).alias("_key")).join(keys.hint("merge"), "_key").select(person, contact_id).distinct()


def first_match(people: DataFrame, contacts: DataFrame, person: str, name: str, contact_id: str, contact_name: str, aliases: str) -> DataFrame:
    """The first contact, by name without regard to ASCII case and then id, whose name or one of whose aliases
    is the name, trimmed, collapsed and in lower case."""
    named = contacts.select(contact_id, F.col(contact_name).alias("_order"), F.explode(F.concat(F.array(contact_name), F.coalesce(aliases, F.array()))).alias("_name"))
    keys = named.select(contact_id, ascii_nocase(F.col("_order")).alias("_order"), norm_lookup(F.col("_name")).alias("_key")).where("_key != ''")
    firsts = keys.groupBy("_key").agg(F.min(F.struct("_order", F.col(contact_id).alias("id"))).alias("_f"))  # one a name, before people meet it
    found = people.select(person, norm_lookup(F.col(name)).alias("_key")).join(firsts, "_key")
    return found.groupBy(person).agg(F.min("_f").alias("_f")).select(person, F.col("_f.id").alias(contact_id))


def deletions(c: Column) -> Column:
    """The text and all texts with one character less: texts one edit apart share one of them."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, cut).otherwise(F.array())))


def near_matches(left: DataFrame, right: DataFrame, left_id: str, left_key: str, right_id: str, right_key: str) -> DataFrame:
    """(left, right) at edit distance exactly 1, for keys of 2 characters or more; a key of 2 only
    matches one of 2. An equality join on hashed deletion keys finds the candidates. Texts one edit apart share
    one deletion key, no more, so rows that are distinct before the join give distinct pairs. The sides are
    merged: a plan takes rows with their keys for as few as the table's, and would broadcast them all."""
    keyed = lambda df, id_, key: df.where(F.length(key) >= 2).select(F.col(id_).alias("_id"), F.col(key).alias("_text")).distinct().select("_id", "_text", F.explode(deletions(F.col("_text"))).alias("_key")).withColumn("_key", F.xxhash64("_key"))
    a = keyed(left, left_id, left_key).select("_key", F.col("_id").alias("_l"), F.col("_text").alias("_a"))
    b = keyed(right, right_id, right_key).select("_key", F.col("_id").alias("_r"), F.col("_text").alias("_b"))
    one = F.call_function("levenshtein", F.col("_a"), F.col("_b"), F.lit(1)) == 1
    pairs = a.join(b.hint("merge"), "_key").where(one & ((F.length("_a") > 2) | (F.length("_b") == 2)))
    return pairs.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id))


def _hashes(c: Column) -> Column:
    """Hashes of the pieces of GRAM characters at each position; a shorter text is its own."""
    long = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - GRAM), lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(GRAM)]))
    return F.when(F.length(c) < GRAM, F.array(F.xxhash64(c))).otherwise(once(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), long))


def _spoiled(length: Column, similarity: float) -> Column:
    """Edits between a text of this length and the longest that may be so similar."""
    return F.floor((1 - similarity) / similarity * length + 1e-9).cast("int")


def _gram_texts(df: DataFrame, id_: str, text: str, on: tuple[str, ...]) -> DataFrame:
    """on, _id, _n (the length) and _g, the hashes of a text that isn't empty."""
    own = df.select(*on, F.col(id_).alias("_id"), F.col(text).alias("_text")).where(F.col("_text") != "")
    return own.select(*on, "_id", F.length("_text").alias("_n"), _hashes(F.col("_text")).alias("_g"))


def _gram_counts(*texts: DataFrame) -> Column:
    """How often pieces occur, by GRAM_BUCKETS buckets of hashes, in an eighth of the texts: this only says which
    pieces go first."""
    eighth = [df.where(F.pmod(F.xxhash64("_id"), F.lit(8)) == 0) for df in texts]
    grams = reduce(DataFrame.unionByName, [df.select(F.explode("_g").alias("_h")) for df in eighth])
    found = {r["b"]: r["count"] for r in grams.groupBy(F.pmod("_h", F.lit(GRAM_BUCKETS)).cast("int").alias("b")).count().collect()}
    return F.from_json(F.lit(str([found.get(k, 0) for k in range(GRAM_BUCKETS)])), "array<bigint>")


def _ranked(counts: Column) -> Column:
    """Of ``_g`` each piece once, rare ones first: n, h, i (where it stands) and whether it repeats."""
    entry = lambda h, i: F.struct(F.get(counts, F.pmod(h, F.lit(GRAM_BUCKETS)).cast("int")).alias("n"), h.alias("h"), i.alias("i"))

    def distinct(s: Column) -> Column:
        first = F.transform(s, lambda x, k: F.struct(x["n"].alias("n"), x["h"].alias("h"), x["i"].alias("i"), F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)).alias("again"), F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)).alias("late")))
        return F.filter(first, lambda x: ~x["late"])

    return once(F.sort_array(F.transform("_g", entry)), distinct)


SIMILAR, EVERY, RAREST = 0, 1, 2


def _postings(texts: DataFrame, counts: Column, similarity: float, on: tuple[str, ...], kinds: dict[int, tuple[int, Column]]) -> DataFrame:
    """on, _why, _key, _id, _n, _pos: pieces of texts under the kinds of join that they are for, each of which
    takes all pieces, the rarest or those behind which similar texts meet, of texts where its condition holds.

    An edit spoils GRAM pieces at most, so all but GRAM * edits of a text's distinct pieces also stand in a
    similar one, shifted by no more than the edits. With all pieces in one order (rare ones first; any order
    loses no pair), one of the first GRAM * edits + 1 of either text is the first that both have in such places.
    _pos is null where the piece repeats, and then says nothing."""
    take = {SIMILAR: lambda r: F.slice(r, F.lit(1), GRAM * _spoiled(F.col("_n"), similarity) + 1), EVERY: lambda r: r, RAREST: lambda r: F.slice(r, 1, 1)}
    entry = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x["h"].alias("h"), F.when(~x["again"], x["i"]).alias("i"))
    parts = [F.when(where, F.transform(take[what](F.col("_r")), entry(kind))).otherwise(F.array().cast("array<struct<kind:int,h:bigint,i:int>>")) for kind, (what, where) in kinds.items()]
    rows = texts.withColumn("_r", _ranked(counts)).select(*on, "_id", "_n", F.explode(F.concat(*parts)).alias("_p"))
    return rows.select(*on, F.col("_p.kind").alias("_why"), F.col("_p.h").alias("_key"), "_id", "_n", F.col("_p.i").alias("_pos"))


def _similar_postings(texts: DataFrame, counts: Column, similarity: float, on: tuple[str, ...]) -> DataFrame:
    return _postings(texts, counts, similarity, on, {0: (SIMILAR, F.lit(True))}).drop("_why")


def _sided(df: DataFrame, side: str, on: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") if c not in (*on, "_key") else F.col(c) for c in df.columns])


def _may_be_similar(similarity: float) -> Column:
    """Lengths and places of _l and _r allow the similarity."""
    lengths = F.least("_n_l", "_n_r") >= similarity * F.greatest("_n_l", "_n_r") - 1e-9
    return lengths & F.coalesce(F.abs(F.col("_pos_l") - F.col("_pos_r")) <= edits_within(F.col("_n_l"), F.col("_n_r"), similarity), F.lit(True))


def _with_texts(pairs: DataFrame, left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str) -> DataFrame:
    """pairs (_l, _r) with both texts, _a and _b."""
    with_a = pairs.join(left.select(F.col(left_id).alias("_l"), F.col(left_text).alias("_a")), "_l")
    return with_a.join(right.select(F.col(right_id).alias("_r"), F.col(right_text).alias("_b")), "_r")


def similar_pairs(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_id: str, right_text: str, similarity: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(left, right) of texts (with unique ids) at least so similar, for limits above 0.8, with equal values in
    the columns ``on``. Only ids, lengths and places of pieces (``_similar_postings``) meet in the join that
    finds candidates; each pair's texts are compared once."""
    a, b = _gram_texts(left, left_id, left_text, on), _gram_texts(right, right_id, right_text, on)
    counts = _gram_counts(a, b)
    pairs = _sided(_similar_postings(a, counts, similarity, on), "l", on).join(_sided(_similar_postings(b, counts, similarity, on), "r", on), [*on, "_key"])
    pairs = pairs.where(_may_be_similar(similarity)).select(F.col("_id_l").alias("_l"), F.col("_id_r").alias("_r")).distinct()
    found = _with_texts(pairs, left, left_id, left_text, right, right_id, right_text).where(at_least_similar(F.col("_a"), F.col("_b"), similarity))
    return found.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id))


def unique_target(pairs: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target) where a key has one target only: ambiguous matches stay empty."""
    return pairs.groupBy(key).agg(F.count_distinct(target).alias("_targets"), F.min(target).alias(target)).where("_targets = 1").drop("_targets")


def _ends(df: DataFrame, by: list[str], target: str) -> DataFrame:
    """by and the least and greatest target of each group: all that tells whether a key of groups has one target
    only, without a row per pair."""
    return df.groupBy(*by).agg(F.min(target).alias("_least"), F.max(target).alias("_most"))


def one_target(groups: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target) where all ``_ends`` that a key meets name one target."""
    return _ends_of(groups, key).where("_least = _most").select(key, F.col("_least").alias(target))


def _ends_of(groups: DataFrame, key: str) -> DataFrame:
    return groups.groupBy(key).agg(F.min("_least").alias("_least"), F.max("_most").alias("_most"))


def similar_ends(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_id: str, right_text: str, similarity: float, on: tuple[str, ...] = ()) -> DataFrame:
    """left_id and the ``_ends`` of the right ids whose text is so similar, as ``similar_pairs`` would find them: each
    text of each ``on`` is compared once, however many ids have it. Right texts that no left one of their ``on`` is
    like in length go before any pieces are made."""
    by = lambda text: [*on, F.col(text).alias("_text")]
    texts = materialize(left.select(*by(left_text)).distinct().select("*", F.struct(*on, "_text").alias("_t_l")))
    band = F.floor(F.log(F.length("_text")) / -math.log(similarity - 1e-6))  # lengths of similar texts lie in one band or in neighbours
    reach = texts.where("_text <> ''").select(*on, F.explode(F.array(band - 1, band, band + 1)).alias("_band")).distinct()
    near = right.select(*by(right_text), F.col(right_id).alias("_id")).where("_text <> ''").withColumn("_band", band).join(reach, [*on, "_band"], "left_semi")
    held = materialize(_ends(near, [*on, "_text"], "_id").withColumn("_t_r", F.struct(*on, "_text")))
    pairs = similar_pairs(texts, held, "_t_l", "_text", "_t_r", "_text", similarity, on)
    ends = _ends_of(pairs.join(held.select("_t_r", "_least", "_most"), "_t_r"), "_t_l")
    return left.withColumn("_t_l", F.struct(*by(left_text))).join(ends, "_t_l").select(left_id, "_least", "_most")


def duplicate_meetings(new: DataFrame, known: DataFrame, new_id: str, known_id: str, kind: str, title: str, day: str, least_length: int = 8, least_similarity: float = 0.9) -> DataFrame:
    """(new, known, tier): same kind and title, if just one; several block; else the same kind and day,
    long titles and similarity, if just one. A new meeting without a kind is a meeting; empty titles match
    nothing."""
    n = new.select(F.col(new_id).alias("_n"), F.coalesce(kind, F.lit("meeting")).alias("_kind"), F.col(title).alias("_t"), F.col(day).alias("_day")).where("_t <> ''")
    k = known.select(F.col(known_id).alias("_k"), F.col(kind).alias("_kind"), F.col(title).alias("_u"), F.col(day).alias("_day2"))
    exact = materialize(n.join(_ends(k.withColumnRenamed("_u", "_t"), ["_kind", "_t"], "_k"), ["_kind", "_t"]))
    tier1 = one_target(exact, "_n", "_k").select("_n", "_k", F.lit("exact").alias("tier"))
    rest = n.join(exact.select("_n").distinct(), "_n", "left_anti").where((F.length("_t") >= least_length) & F.col("_day").isNotNull())
    longer = k.where(F.length("_u") >= least_length).withColumnRenamed("_day2", "_day")
    near = similar_ends(rest, longer, "_n", "_t", "_k", "_u", least_similarity, ("_kind", "_day"))
    tier2 = one_target(near, "_n", "_k").select("_n", "_k", F.lit("similar").alias("tier"))
    return tier1.unionByName(tier2).select(F.col("_n").alias(new_id), F.col("_k").alias(known_id), "tier")


def overlap_matches(notices: DataFrame, meetings: DataFrame, notice: str, meeting: str, day: str, names: str) -> DataFrame:
    """(notice, meeting) of the one meeting of the notice's day with a common participant."""
    held = _ends(meetings.select(meeting, day, F.explode(names).alias("_p")), [day, "_p"], meeting)
    return one_target(notices.select(notice, day, F.explode(names).alias("_p")).join(held, [day, "_p"]), notice, meeting)


def progress_targets(matches: DataFrame, fragment: str, target: str, confidence: str) -> DataFrame:
    """(fragment, target) where all matches are high and name one target."""
    agreed = matches.groupBy(fragment).agg(F.bool_and(F.coalesce(F.col(confidence) == "high", F.lit(False))).alias("_high"), F.count_distinct(target).alias("_n"), F.min(target).alias(target))
    return agreed.where("_high and _n = 1").select(fragment, target)


def uncovered(evidence: DataFrame, covering: DataFrame, id_: str, key: str, text: str, quote: str, least: int = 8, similarity: float = 0.85, heads: int = HEADS) -> DataFrame:
    """Evidence (with unique ``id_``) that no quote of its key covers, as ``rules.holds`` says.

    Texts meet ``heads`` quotes of their key, at most, by the key alone: this is all of a key with so few quotes,
    and costs no more than that many comparisons a text. Only texts of larger keys that none of these covers meet
    the other quotes by pieces (``_covered_by_pieces``), equal texts of a key as one."""
    texts = evidence.select(F.col(id_).alias("_id"), F.col(key).alias("_on"), rules.norm_contact(F.col(text)).alias("_text"))
    texts = materialize(texts.where("_text <> ''"))
    quotes = covering.select(F.col(key).alias("_on"), F.col(quote).alias("_raw")).distinct().select("_on", F.get(rules.coverage(F.array("_raw")), F.lit(0)).alias("_q"))
    quotes = quotes.where("_q.key <> '' and (_q.segments is null or size(_q.segments) > 0)").distinct().select("_on", "_q", F.xxhash64("_q").alias("_id"))
    quotes = materialize(quotes)
    place = F.row_number().over(Window.partitionBy("_on").orderBy("_id"))
    first = quotes.withColumn("_place", place).where(F.col("_place") <= heads + 1)
    held = texts.join(first.where(F.col("_place") <= heads).select("_on", "_q"), "_on")
    near = materialize(held.where(rules.holds(F.col("_text"), F.col("_q"), least, similarity)).select("_id").distinct())
    large = materialize(first.where(F.col("_place") > heads).select("_on"))
    covered = near
    if not large.isEmpty():
        rest = texts.join(large, "_on", "left_semi").join(near, "_id", "left_anti").withColumn("_t", F.struct("_on", F.xxhash64("_text").alias("_h")))
        rest = materialize(rest)
        each = materialize(rest.groupBy("_t").agg(F.first("_on").alias("_on"), F.first("_text").alias("_text")).withColumnRenamed("_t", "_id"))
        found = _covered_by_pieces(each, quotes.join(large, "_on", "left_semi"), least, similarity)
        covered = near.unionByName(rest.join(found, rest["_t"] == found["_e"], "left_semi").select("_id"))
    return evidence.join(covered.select(F.col("_id").alias("_e")), F.col(id_) == F.col("_e"), "left_anti")


def _covered_by_pieces(texts: DataFrame, quotes: DataFrame, least: int, similarity: float) -> DataFrame:
    """_e, the ids of texts (_id, _on, _text) that a quote (_on, _q, _id) of their key covers.

    Texts and quotes meet by id, key and a hashed piece, each for one reason: both have it among the pieces of
    similar texts (``_postings``); it is the rarest piece of a quote, or of its first long segment, and
    stands in the text; it is the rarest of the text and stands in the quote. One join finds the candidates, and
    each pair's texts are compared once."""
    elided = F.col("_q.segments").isNotNull()
    looked = quotes.select("_on", F.struct("_on", "_id").alias("_id"), elided.alias("_cut"), F.when(elided, F.get(F.col("_q.segments"), F.lit(0))).otherwise(F.col("_q.key")).alias("_text"))
    a = _gram_texts(texts, "_id", "_text", ("_on",))
    b = _gram_texts(looked.withColumn("_k", F.struct("_on", "_cut")), "_id", "_text", ("_k",)).select("_k._on", "_k._cut", "_id", "_n", "_g")
    counts = _gram_counts(a, b)
    long, whole = F.col("_n") >= least, F.expr("not _cut")
    left = _postings(a, counts, similarity, ("_on",), {0: (SIMILAR, F.lit(True)), 1: (EVERY, F.lit(True)), 2: (RAREST, long)})
    right = _postings(b, counts, similarity, ("_on",), {0: (SIMILAR, whole), 1: (RAREST, long | ~whole), 2: (EVERY, whole & long)})
    on = ("_on", "_why")
    pairs = _sided(left, "l", on).join(_sided(right, "r", on), [*on, "_key"])
    shorter = F.when(F.col("_why") == 2, F.col("_n_l") <= F.col("_n_r")).when(F.col("_why") == 1, F.col("_n_r") <= F.col("_n_l"))
    pairs = pairs.where(F.coalesce(shorter, _may_be_similar(similarity))).select(F.col("_id_l").alias("_l"), F.col("_id_r").alias("_r")).distinct()
    held = _with_texts(pairs, texts, "_id", "_text", quotes.withColumn("_id", F.struct("_on", "_id")), "_id", "_q")
    return held.where(rules.holds(F.col("_a"), F.col("_b"), least, similarity)).select(F.col("_l").alias("_e")).distinct()


def batch_duplicates(items: DataFrame, key: str, order: str, quote: str, similarity: float = 0.85, earliest: tuple[int, ...] = EARLIEST) -> DataFrame:
    """(order, first): for each item the first earlier one with the same key and a similar quote.

    Equal quotes are compared once, by their first item. Quotes meet the ``earliest`` of their batch in rounds, a
    few first: what is found among these is the first of all, and only quotes that found nothing go on. What is
    left of larger batches meets all others (``_first_of_rest``). Pairs are compared where they meet, and only the
    first similar quote of each leaves the task."""
    once_each = items.where(F.col(quote) != "").groupBy(F.col(key).alias("_on"), F.col(quote).alias("_text")).agg(F.min(order).alias("_first"))
    once_each = materialize(once_each)
    sized = once_each.join(once_each.groupBy("_on").agg(F.count("*").alias("_size")), "_on").withColumn("_n", F.length("_text"))
    most = edits_within(F.col("_n"), F.col("_n"), similarity)
    similar = lambda edits: 1 - edits / F.col("_n") >= similarity  # noqa: E731  as edit_similarity rounds
    each = materialize(sized.withColumn("_edits", F.when(similar(most + 1), most + 1).when(similar(most), most).otherwise(most - 1)))
    place = F.row_number().over(Window.partitionBy("_on").orderBy("_first"))
    early = materialize(each.withColumn("_place", place).where(F.col("_place") <= earliest[-1]))
    todo, found, done = each, [], 0
    for most in earliest:
        found.append(materialize(_first_similar(todo, early.where((F.col("_place") > done) & (F.col("_place") <= most)), similarity)))
        todo, done = materialize(todo.where(F.col("_size") > most).join(found[-1], "_first", "left_anti")), most
    if not todo.isEmpty():
        found.append(_first_of_rest(todo, each, similarity))
    firsts = once_each.join(reduce(DataFrame.unionByName, found), "_first", "left").select("_on", "_text", F.least("_first", "_r").alias("first"))
    pairs = items.join(firsts, (items[key] == firsts["_on"]) & (items[quote] == firsts["_text"])).where(F.col("first") < F.col(order))
    return pairs.select(order, "first")


def _first_similar(left: DataFrame, right: DataFrame, similarity: float, deal_right: bool = False) -> DataFrame:
    """_first and _r, the first earlier quote of the right that is similar: within ``_edits`` of the longer one. The quotes of one side are dealt to
    tasks, PART of a batch to each; the others meet all of these."""
    parts = F.ceil(F.col("_size") / PART)
    dealt, spread = F.pmod(F.xxhash64("_first"), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.select("_on", "_text", "_first", "_n", "_edits", (spread if deal_right else dealt).alias("_part")).repartition(tasks, "_on", "_part")
    b = right.select("_on", F.col("_text").alias("_other"), F.col("_first").alias("_r"), F.col("_n").alias("_m"), F.col("_edits").alias("_most"), (dealt if deal_right else spread).alias("_part")).repartition(tasks, "_on", "_part")
    may = (F.col("_r") < F.col("_first")) & (F.abs(F.col("_n") - F.col("_m")) <= F.greatest("_edits", "_most"))
    pairs = a.join(b, ["_on", "_part"]).where(may & F.expr("levenshtein(_text, _other, greatest(_edits, _most)) >= 0"))
    return pairs.groupBy("_first").agg(F.min("_r").alias("_r"))


def _first_of_rest(todo: DataFrame, each: DataFrame, similarity: float) -> DataFrame:
    """``_first_similar`` of todo among all quotes of its batches: by pieces (``_similar_postings``), or, where lists
    of pieces hold more pairs than the batches, as with short quotes of one form, by the batch alone.

    In each list of quotes that share a piece all are first held against the list's first one: where that is
    similar, the list has nothing earlier. Only what may come before the best found so far is compared further, so
    a crowd of similar quotes costs one comparison each, not one a pair."""
    held = each.join(todo.select("_on").distinct(), "_on", "left_semi")
    a = _gram_texts(held.drop("_n"), "_first", "_text", ("_on",))
    postings = materialize(_similar_postings(a, _gram_counts(a), similarity, ("_on",)))
    mine = materialize(postings.join(todo.select(F.col("_first").alias("_id")), "_id", "left_semi"))
    at = ["_on", "_key"]
    lists = mine.groupBy(*at).agg(F.count("*").cast("double").alias("_m")).join(postings.groupBy(*at).agg(F.count("*").alias("_n")), at)
    if todo.agg(F.sum(F.col("_size").cast("double"))).first()[0] <= lists.agg(F.sum(F.col("_m") * F.col("_n"))).first()[0]:
        return _first_similar(todo, held, similarity, deal_right=True)
    heads = postings.groupBy(*at).agg(F.min_by(F.struct("_id", "_n", "_pos"), "_id").alias("_h")).select(*at, F.col("_h._id").alias("_id_r"), F.col("_h._n").alias("_n_r"), F.col("_h._pos").alias("_pos_r"))
    left = _sided(mine, "l", ("_on",))

    def verified(pairs: DataFrame) -> DataFrame:
        """_l and the first _r that is similar."""
        pairs = pairs.where(_may_be_similar(similarity)).select(F.col("_id_l").alias("_l"), F.col("_id_r").alias("_r")).distinct()
        found = _with_texts(pairs, todo, "_first", "_text", held, "_first", "_text").where(at_least_similar(F.col("_a"), F.col("_b"), similarity))
        return found.groupBy("_l").agg(F.min("_r").alias("_r"))

    by_head = materialize(verified(left.join(heads, at).where("_id_r < _id_l")))
    best = by_head.select(F.col("_l").alias("_id_l"), F.col("_r").alias("_best"))
    rest = left.join(best, "_id_l", "left").join(heads.select(*at, F.col("_id_r").alias("_head")), at)
    others = rest.where("_head < _id_l and (_best is null or _head < _best)").join(_sided(postings, "r", ("_on",)), at)
    by_rest = verified(others.where("_id_r > _head and _id_r < _id_l and (_best is null or _id_r < _best)"))
    return by_head.unionByName(by_rest).groupBy(F.col("_l").alias("_first")).agg(F.min("_r").alias("_r"))


def related(people: DataFrame, seeds: DataFrame, group: str, names: str, seed: str) -> DataFrame:
    """Per group the union of names of the people who share a name with a seed."""
    spread = people.withColumn("_p", F.monotonically_increasing_id()).select(group, "_p", names, F.explode(names).alias("_name"))
    hit = spread.join(seeds.select(F.col(seed).alias("_name")).distinct(), "_name", "left_semi").dropDuplicates(["_p"])
    each = hit.select(group, F.explode(names).alias("_name")).distinct()  # a group's names once, before they come together
    return each.groupBy(group).agg(F.array_sort(F.collect_list("_name")).alias("related"))


def grounded(insights: DataFrame, observations: DataFrame, id_: str, owner: str, based_on: str, observation: str) -> DataFrame:
    """Insights with the references that are observations of their owner, in order, without repeats;
    those without any are dropped."""
    refs = insights.select(id_, owner, F.posexplode(based_on).alias("_pos", observation))
    kept = refs.join(observations.select(owner, observation).distinct(), [owner, observation], "left_semi")
    first = kept.groupBy(id_, observation).agg(F.min("_pos").alias("_pos"))
    return first.groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", observation))), lambda x: x[observation]).alias(based_on))


def one_by_status(rows: DataFrame, key: str, status: str, order: list[str], target: str) -> DataFrame:
    """Target of the best status present; none if the best status has several."""
    rank = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        rank = F.when(F.col(status) == v, F.lit(i)).otherwise(rank)
    best = rows.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy(key))).where("_rank = _best")
    return unique_target(best, key, target)
