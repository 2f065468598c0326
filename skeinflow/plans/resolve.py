"""Entity resolution and meeting progress. What a model decided comes in as columns; all else is joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import rules
from skeinflow.functions.text import norm_compare, norm_contact, trimmed
from skeinflow.operators import dedup, match

LATEST_MEETINGS = 20  #: upcoming meetings that progress may refer to


def resolve_participants(people: DataFrame, contacts: DataFrame, model: DataFrame | None = None, key: str = "screenshot_id") -> DataFrame:
    """key, pos, status (same_as, new, unsure), contact_id, candidate_ids and source of every participant
    but oneself.

    people: key, pos, name, is_self. contacts: id, canonical_name, aliases. model: key, pos, decision,
    contact_id, candidate_ids, for those whom no name decides. One exact match is the contact, several are
    unsure; in an empty library all are new; else the model decides, but a near name turns its ``new``
    into unsure and joins the candidates of its ``unsure``. Without a decision a person stays unsure."""
    others = people.where(~F.coalesce("is_self", F.lit(False))).withColumn("_p", F.struct(key, "pos"))
    exact = match.exact_matches(others, contacts, "_p", "name", "id", "canonical_name", "aliases")
    exact = exact.groupBy("_p").agg(F.array_sort(F.collect_set("id")).alias("_exact"))
    names = contacts.select("id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array()))).alias("_name")).select("id", norm_contact(F.col("_name")).alias("_c")).distinct()
    near = match.near_matches(others.select("_p", norm_contact(F.col("name")).alias("_k")), names, "_p", "_k", "id", "_c")
    near = near.groupBy("_p").agg(F.array_sort(F.collect_set("id")).alias("_near"))
    rows = others.join(exact, "_p", "left").join(near, "_p", "left")
    if model is None:
        rows = rows.withColumns({"decision": F.lit(None).cast("string"), "_id": F.lit(None).cast("long"), "_ids": F.lit(None).cast("array<bigint>")})
    else:
        rows = rows.join(model.select(key, "pos", "decision", F.col("contact_id").alias("_id"), F.col("candidate_ids").alias("_ids")), [key, "pos"], "left")
    empty_library = contacts.isEmpty()
    n, empty = F.size(F.coalesce("_exact", F.array())), F.array().cast("array<bigint>")
    found = F.coalesce("_near", empty)
    nobody = F.lit(None).cast("long")
    of = lambda status, contact, ids, source: F.struct(F.lit(status).alias("status"), contact.alias("contact_id"), ids.alias("candidate_ids"), F.lit(source).alias("source"))
    by_model = (
        F.when(F.col("decision") == "same_as", of("same_as", F.col("_id"), empty, "llm"))
        .when((F.col("decision") == "new") & (F.size(found) > 0), of("unsure", nobody, found, "near_match"))
        .when(F.col("decision") == "new", of("new", nobody, empty, "llm"))
        .otherwise(of("unsure", nobody, F.array_distinct(F.concat(F.coalesce("_ids", empty), found)), "llm"))
    )
    decided = (
        F.when(n == 1, of("same_as", F.get("_exact", F.lit(0)), empty, "exact"))
        .when(n > 1, of("unsure", nobody, F.col("_exact"), "exact_multiple"))
        .when(F.lit(empty_library), of("new", nobody, empty, "empty_db"))
        .otherwise(by_model)
    )
    return rows.select(key, "pos", "name", norm_compare(F.col("name")).alias("normalized_name"), decided.alias("_d")).select(key, "pos", "name", "normalized_name", "_d.*")


def progress_fragments(people: DataFrame, facts: DataFrame, events: DataFrame, quotes: DataFrame, key: str = "screenshot_id") -> DataFrame:
    """key, place, content, source_quote of what reports progress: people's summaries and notes, notes and
    other facts, events' agendas or titles, quotes; low confidence doesn't count; the first of a quote
    stays. Documents about oneself alone give none."""
    part = lambda df, rank, content, where="true": df.where(where).select(key, F.struct(F.lit(rank).alias("r"), F.col("pos").cast("int").alias("p"), F.lit(0).alias("s")).alias("place"), content.alias("content"), "source_quote")
    sure = "confidence <> 'low'"
    rows = people.where(sure).select(key, "source_quote", F.posexplode(F.array("interaction_summary", "notes")).alias("s", "content"), "pos")
    rows = rows.select(key, F.struct(F.lit(0).alias("r"), F.col("pos").cast("int").alias("p"), F.col("s").alias("s")).alias("place"), "content", "source_quote")
    rows = rows.unionByName(part(facts, 1, F.col("value"), f"{sure} and field in ('notes', 'other')"))
    rows = rows.unionByName(part(events, 2, F.coalesce("agenda", "title"), sure)).unionByName(part(quotes, 3, F.col("text")))
    rows = rows.where((trimmed(F.col("content")) != "") & (trimmed(F.col("source_quote")) != "") & (rules.direct_progress(F.col("content")) | rules.direct_progress(F.col("source_quote"))))
    met = people.where(~F.coalesce("is_self", F.lit(False))).select(key).distinct()
    first = dedup.keep_first(rows.join(met, key, "left_semi").withColumn("_q", trimmed(F.col("source_quote"))), [key, "_q"], ["place"])
    return first.drop("_q")


def progress_candidates(meetings: DataFrame) -> DataFrame:
    """The newest upcoming meetings, each id once, in its newest version."""
    row = F.max_by(F.struct(*meetings.columns), F.struct("created_at", F.to_json(F.struct(*meetings.columns))))
    rows = meetings.where("status = 'upcoming'").groupBy("id").agg(row.alias("_m")).select("_m.*")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(LATEST_MEETINGS)


def progress_resolutions(fragments: DataFrame, matches: DataFrame, fragment: str = "fragment_id", key: str = "screenshot_id") -> DataFrame:
    """key, meeting_id and fragments of each document, of those that only high matches to one meeting claim."""
    target = match.progress_targets(matches, fragment, "meeting_id", "confidence")
    rows = fragments.join(target, fragment)
    return rows.groupBy(key, "meeting_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(fragment, "content", "source_quote"))), lambda x: F.struct(x["content"].alias("content"), x["source_quote"].alias("source_quote"))).alias("fragments"))
