"""Proposals: from evidence and resolutions to cards. Each builder gives rows of one schema:
screenshot_id, type, place, payload (map of text), confidence, source_quote, candidate_ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions import contacts, rules
from skeinflow.functions.chinese_time import calendar_day, event_time, text_day
from skeinflow.functions.text import cjk_ratio, content_key, distinct_strings, joined_quotes, label_key, mentions, norm_compare, norm_contact, norm_contacts, trimmed, without_speaker
from skeinflow.operators import match
from skeinflow.operators.review import meeting_changes
from skeinflow.operators.snapshots import appended, merged_participants
from skeinflow.scratch import materialize

FIELDS = ["company", "title", "phone", "wechat_id", "notes"]
TYPES = ["create_contact", "update_contact", "create_meeting", "record_interaction"]
KEY = "screenshot_id"


def _card(kind: str, payload: dict[str, Column], confidence: Column, quote: Column, candidates: Column | None = None) -> list[Column]:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in payload.items()])
    kept = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))
    none = F.array().cast("array<bigint>")
    return [F.col(KEY), F.lit(kind).alias("type"), F.col("pos").cast("int").alias("place"), kept.alias("payload"), confidence.alias("confidence"), quote.alias("source_quote"), F.coalesce(candidates, none).alias("candidate_ids") if candidates is not None else none.alias("candidate_ids")]


def drafts(related: DataFrame) -> DataFrame:
    """What a contact would hold: a person's own fields, else the first fact of the field; aliases, with those
    from facts, that say something new; of the notes and other facts what repeats no field of the same quote;
    and the quotes of all that."""
    own = lambda f: F.nullif(trimmed(F.col(f)), F.lit(""))
    fields = [f for f in FIELDS if f != "notes"]
    facts_of = lambda *names: F.filter("facts", lambda x: x["field"].isin(*names))
    rows = related.withColumns({f"_f_{f}": F.when(own(f).isNull(), F.get(facts_of(f), F.lit(0))) for f in fields})
    rows = rows.withColumns({f"d_{f}": F.coalesce(own(f), F.col(f"_f_{f}.value")) for f in fields})
    anchors = F.array(*[F.struct(F.coalesce(f"_f_{f}.source_quote", "source_quote").alias("quote"), F.col(f"d_{f}").alias("value")) for f in fields])
    rows = rows.withColumns({"_anchors": F.filter(anchors, lambda a: a["value"].isNotNull()), "_told": facts_of("notes", "other"), "_called": facts_of("alias")})
    rows = rows.withColumns({
        "_notes": contacts.gathered_notes(F.col("notes"), F.col("source_quote"), F.col("_told"), F.col("_anchors")),
        "_names": contacts.gathered_aliases(F.coalesce("aliases", F.array().cast("array<string>")), F.col("_called")),
    })
    known = F.array("d_company", "d_title")
    quotes = F.concat(F.array("source_quote"), F.col("_names.quotes"), F.array(*[F.col(f"_f_{f}.source_quote") for f in fields]), F.col("_notes.quotes"))
    rows = rows.withColumns({"_derived": contacts.derived_aliases(F.col("_names.values"), F.array("name"), known), "_quotes": F.filter(quotes, lambda q: q.isNotNull())})
    return rows.withColumns({
        "d_notes": F.nullif(F.array_join("_notes.values", "；"), F.lit("")),
        "d_aliases": F.array_except("_names.values", "_derived"),
        "d_quote": joined_quotes(F.col("_quotes")),
    }).drop("_anchors", "_told", "_called", "_notes", "_names", "_derived", "_quotes", *[f"_f_{f}" for f in fields])


def contact_cards(drafted: DataFrame, resolved: DataFrame, people: DataFrame) -> DataFrame:
    """A create card for every person not in the library (unless a mere mention), an update card for
    every one in it with fields that say more than the library."""
    rows = drafted.join(resolved.select(KEY, "pos", "status", "contact_id", "candidate_ids"), [KEY, "pos"])
    known = F.exists(F.array(*[F.nullif(trimmed(F.col(f)), F.lit("")) for f in FIELDS if f != "notes"]), lambda v: v.isNotNull()) | (F.size(distinct_strings(F.coalesce("aliases", F.array()))) > 0)
    mention = rules.suppressed_mention(F.col("role"), F.col("name"), known, F.size("facts") > 0)
    new = rows.where((F.col("status") != "same_as") & ~mention)
    values = {"name": trimmed(F.col("name")), "aliases": F.array_join("d_aliases", "、"), **{f: F.col(f"d_{f}") for f in FIELDS}}
    created = new.select(*_card("create_contact", values, F.col("confidence"), F.col("d_quote"), F.col("candidate_ids")))
    lib = people.select(F.col("id").alias("contact_id"), "canonical_name", F.coalesce("aliases", F.array()).alias("c_aliases"), *[F.col(f).alias(f"c_{f}") for f in FIELDS])
    old = rows.where("status = 'same_as'").join(lib, "contact_id")

    def change(f: str) -> Column:
        differs = ~F.col(f"d_{f}").eqNullSafe(F.col(f"c_{f}"))
        if f in ("company", "title"):
            differs = differs & ~rules.redundant_value(F.col(f"c_{f}"), F.col(f"d_{f}"))
        return F.when(F.col(f"d_{f}").isNotNull() & differs, F.col(f"d_{f}"))

    said = distinct_strings(F.concat(F.array("name"), F.coalesce("aliases", F.array())))
    old = old.withColumn("_said", said).withColumn("_derived", contacts.derived_aliases(F.col("_said"), F.concat(F.array("canonical_name"), F.col("c_aliases")), F.array("c_company", "c_title", "d_company", "d_title")))
    more = F.array_except("_said", "_derived")
    changed = old.withColumns({**{f"n_{f}": change(f) for f in FIELDS}, "n_aliases": F.nullif(F.array_join(more, "，"), F.lit("")), "c_aliases": F.array_join("c_aliases", "，")})
    changed = changed.where(F.exists(F.array(*[F.col(f"n_{f}") for f in ["aliases", *FIELDS]]), lambda v: v.isNotNull()))
    fields = {"contact_id": F.col("contact_id"), "contact_name": F.col("canonical_name"), **{f: F.col(f"n_{f}") for f in ["aliases", *FIELDS]}, **{f"old_{f}": F.when(F.col(f"n_{f}").isNotNull(), F.col(f"c_{f}")) for f in ["aliases", *FIELDS]}}
    return created.unionByName(changed.select(*_card("update_contact", fields, F.col("confidence"), F.col("d_quote"))))


def routed_events(events: DataFrame) -> DataFrame:
    """events with ``route``: keep, timeless_dropped, no_change (a notice that changes nothing) or notice."""
    notice = rules.meeting_notice(F.col("kind"), F.col("title"), F.col("source_quote"))
    changes = rules.meeting_change(F.col("title"), F.col("source_quote"))
    timeless = rules.timeless_communication(F.col("kind"), F.col("has_time_signal"), F.col("location"), F.col("title"))
    return events.withColumn("route", F.when(notice & ~changes, "no_change").when(notice, "notice").when(timeless, "timeless_dropped").otherwise("keep"))


def _named(events: DataFrame, names: Column, now: Column | None) -> DataFrame:
    """Title keys, days and names of events or meetings, as notices are compared with them. now: a timestamp
    whose year a month and day without a year has; without it only times count."""
    day = calendar_day(F.col("time_iso"))
    said = day if now is None else F.coalesce(day, text_day(F.col("time_text"), now))
    return events.withColumns({"_t": norm_contact(F.col("title")), "_day": day, "day": said, "names": F.array_distinct(F.filter(F.transform(names, norm_compare), lambda n: n != ""))})


def named_meetings(meetings: DataFrame, now: Column | None = None) -> DataFrame:
    """Known meetings with what events are compared with (``_named``), unless they have it."""
    return meetings if "_t" in meetings.columns else _named(meetings, F.transform("participants", lambda p: p["name"]), now)


def notice_targets(routed: DataFrame, meetings: DataFrame, now: Column | None = None) -> DataFrame:
    """screenshot_id, pos, meeting_id of notices: the one meeting of a like title, else, if no title is alike,
    the one of the day with a common participant."""
    n = _named(routed.where("route = 'notice'"), F.col("participant_names"), now).select(F.struct(KEY, "pos").alias("_n"), "_t", "day", "names")
    m = named_meetings(meetings, now).where("kind = 'meeting'").select(F.col("id").alias("_m"), F.col("_t").alias("_u"), "day", "names")
    alike = materialize(match.similar_ends(n, m, "_n", "_t", "_m", "_u", 0.9))
    first = match.one_target(alike, "_n", "_m")
    rest = n.join(alike.select("_n").distinct(), "_n", "left_anti").where("day is not null")
    second = match.overlap_matches(rest, m.where("day is not null"), "_n", "_m", "day", "names")
    return first.unionByName(second).select(f"_n.{KEY}", "_n.pos", F.col("_m").alias("meeting_id"))


def batch_targets(routed: DataFrame, stored: DataFrame, now: Column | None = None) -> DataFrame:
    """screenshot_id, pos, target (pos of a meeting of the same screenshot) of notices without a stored
    meeting: the one of a like title, else the one with a common participant and, if the notice has a day, of
    that day."""
    rows = _named(routed, F.col("participant_names"), now)
    n = rows.where("route = 'notice'").join(stored.select(KEY, "pos"), [KEY, "pos"], "left_anti").select(KEY, F.struct(KEY, "pos").alias("_n"), "_t", "day", "names")
    m = rows.where("kind = 'meeting'").select(KEY, F.col("pos").alias("_m"), F.col("_t").alias("_u"), F.col("day").alias("_day"), F.col("names").alias("_names"))
    alike = materialize(match.similar_ends(n, m, "_n", "_t", "_m", "_u", 0.9, (KEY,)))
    first = match.one_target(alike, "_n", "_m")
    rest = n.join(alike.select("_n").distinct(), "_n", "left_anti").select(KEY, "_n", "day", F.explode("names").alias("_p"))
    met = rest.join(m.select(KEY, "_m", "_day", F.explode("_names").alias("_p")), [KEY, "_p"]).where(F.col("day").isNull() | (F.col("day") == F.col("_day")))
    second = match.unique_target(met.select("_n", "_m").distinct(), "_n", "_m")
    return first.unionByName(second).select(f"_n.{KEY}", "_n.pos", F.col("_m").alias("target"))


def without_discarded(fragments: DataFrame, routed: DataFrame) -> DataFrame:
    """Fragments (screenshot_id, source_quote, ...) without those whose quote a notice or a timeless event
    that was taken out already holds."""
    gone = routed.where("route <> 'keep'").withColumn("source_quote", trimmed(F.col("source_quote")))
    gone = gone.select(KEY, F.struct(norm_contact(F.col("source_quote")).alias("key"), label_key(F.col("source_quote")).alias("label"), content_key(F.col("source_quote")).alias("content")).alias("_g"))
    gone = gone.groupBy(KEY).agg(F.collect_set("_g").alias("_gone"))
    rows = fragments.join(gone, KEY, "left").withColumns({"_k": norm_contact(F.col("source_quote")), "_l": label_key(F.col("source_quote")), "_c": content_key(F.col("source_quote"))})
    hit = F.coalesce(rules.discarded(F.col("_k"), F.col("_l"), F.col("_c"), F.col("_gone")), F.lit(False))
    return rows.where(~hit).select(*fragments.columns)


def changed_targets(routed: DataFrame, targets: DataFrame) -> DataFrame:
    """Events that are kept, the targets of notices with the notices' quotes in agenda and quote."""
    quotes = targets.join(routed.select(KEY, "pos", "source_quote"), [KEY, "pos"])
    added = quotes.groupBy(KEY, F.col("target").alias("pos")).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("p"), "source_quote")))["source_quote"].alias("_q"))
    rows = routed.where("route = 'keep'").join(added, [KEY, "pos"], "left")
    some = F.col("_q").isNotNull()
    return rows.withColumns({
        "agenda": F.when(some, appended(F.col("agenda"), F.array_join("_q", "；"))).otherwise(F.col("agenda")),
        "source_quote": F.when(some, joined_quotes(F.concat(F.array("source_quote"), F.col("_q")))).otherwise(F.col("source_quote")),
    }).drop("_q")


def repeated_meetings(events: DataFrame, meetings: DataFrame) -> DataFrame:
    """_id (screenshot_id, pos) and _m (known meeting) of events that repeat a known meeting."""
    rows = events.select(F.struct(KEY, "pos").alias("_id"), "kind", norm_contact(F.col("title")).alias("_title"), calendar_day(F.col("time_iso")).alias("_day"))
    known = named_meetings(meetings).select(F.col("id").alias("_m"), "kind", F.col("_t").alias("_title"), "_day")
    return match.duplicate_meetings(rows, known, "_id", "_m", "kind", "_title", "_day").drop("tier")


PEOPLE = "array<struct<contact_id:bigint,name:string>>"


def with_people(events: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """events with ``people``: participants in order, with the ids of those whom their document resolves; oneself
    once."""
    names = events.select(KEY, "pos", F.posexplode("participant_names").alias("_p", "_name")).withColumn("_n", norm_compare(F.col("_name")))
    own = F.col("_n") == rules.SELF_NAME
    if resolved is None:
        found = names.withColumn("_id", F.lit(None).cast("long"))
    else:
        ids = resolved.where("status = 'same_as'").groupBy(KEY, F.col("normalized_name").alias("_n")).agg(F.min("contact_id").alias("_id"))
        found = names.join(ids, [KEY, "_n"], "left")
    found = found.groupBy(KEY, "pos", F.when(own, F.lit(-1)).otherwise(F.col("_p")).alias("_as")).agg(F.min(F.struct("_p", F.when(~own, F.col("_id")).alias("contact_id"), F.when(own, rules.SELF_NAME).otherwise(F.col("_name")).alias("name"))).alias("_x"))
    people = F.transform(F.sort_array(F.collect_list("_x")), lambda x: F.struct(x["contact_id"].alias("contact_id"), x["name"].alias("name")))
    return events.join(found.groupBy(KEY, "pos").agg(people.alias("people")), [KEY, "pos"], "left").withColumn("people", F.coalesce("people", F.array().cast(PEOPLE)))


def meeting_cards(kept: DataFrame, meetings: DataFrame, resolved: DataFrame | None = None, repeated: DataFrame | None = None) -> DataFrame:
    """A meeting card per kept event; one that repeats a known meeting (``repeated_meetings``, if they are at hand)
    names it, keeps what it doesn't say itself and lists what it changes."""
    repeated = repeated_meetings(kept, meetings) if repeated is None else repeated
    rows = with_people(kept, resolved).withColumn("_id", F.struct(KEY, "pos")).join(repeated, "_id", "left")
    known = F.struct("title", "time_iso", "time_text", "location", F.coalesce("participants", F.array().cast(PEOPLE)).cast(PEOPLE).alias("participants"), "agenda")
    rows = rows.join(meetings.select(F.col("id").alias("_m"), known.alias("_old")), "_m", "left")
    said = lambda c: F.nullif(trimmed(c), F.lit(""))
    kept_or = lambda c, f: F.coalesce(c, said(F.col(f"_old.{f}")))
    whole = said(F.regexp_replace("source_quote", "(?U)\\s*\\n\\s*", ""))
    agenda = F.coalesce(F.nullif(F.col("agenda"), F.lit("")), F.when(F.col("kind") == "other", whole))
    people = F.when(F.col("_m").isNotNull(), merged_participants(F.col("_old.participants"), F.col("people"))).otherwise(F.col("people"))
    rows = rows.withColumns({"agenda": kept_or(agenda, "agenda"), "time_text": F.coalesce(kept_or(said(F.col("time_text")), "time_text"), F.lit("")), "time_iso": kept_or(said(F.col("time_iso")), "time_iso"), "location": kept_or(F.nullif(F.col("location"), F.lit("")), "location"), "_people": people})
    new = F.struct("title", "time_iso", "time_text", "location", F.col("_people").alias("participants"), "agenda")
    ids = F.array_join(F.transform("_people", lambda p: F.coalesce(p["contact_id"].cast("string"), F.lit(""))), ",")
    fields = {
        "kind": F.col("kind"), "title": F.col("title"), "time_text": F.col("time_text"), "time_iso": F.col("time_iso"), "location": F.col("location"), "agenda": F.col("agenda"), "participants": F.array_join(F.transform("_people", lambda p: p["name"]), "、"),
        "participant_ids": F.when(F.exists("_people", lambda p: p["contact_id"].isNotNull()), ids), "duplicate_of_meeting_id": F.col("_m"), "changes": F.when(F.col("_m").isNotNull(), meeting_changes(F.col("_old"), new)),
    }
    return rows.select(*_card("create_meeting", fields, F.col("confidence"), F.col("source_quote")))


def progress_cards(resolutions: DataFrame, meetings: DataFrame) -> DataFrame:
    """Agenda cards of meetings with progress, where fragments add something: one per document and meeting.
    resolutions: screenshot_id, meeting_id, fragments."""
    rows = resolutions.join(meetings.select(F.col("id").alias("meeting_id"), "kind", "title", F.col("agenda").alias("_old")), "meeting_id")
    rows = rows.withColumn("_new", appended(F.col("_old"), F.array_join(F.transform("fragments", lambda f: f["content"]), "；"))).where("_new <> coalesce(_old, '')")
    fields = {"kind": F.col("kind"), "title": F.col("title"), "agenda_append": F.array_join(F.transform("fragments", lambda f: f["content"]), "；"), "agenda": F.col("_new"), "duplicate_of_meeting_id": F.col("meeting_id")}
    quote = joined_quotes(F.transform("fragments", lambda f: f["source_quote"]))
    return rows.withColumn("pos", F.lit(1000)).select(*_card("create_meeting", fields, F.lit("high"), quote))


def interaction_cards(drafted: DataFrame, resolved: DataFrame, events: DataFrame, created: DataFrame) -> DataFrame:
    """One card per person who took part and said something of their own: no mere mention or reply, no
    acknowledgement, nothing an event already holds, not just meeting logistics beside a meeting. People
    of one contact, or of one unresolved name, share a card; new people need their create card."""
    rows = drafted.join(resolved.select(KEY, "pos", "status", "contact_id", "normalized_name"), [KEY, "pos"])
    rows = rows.where(~F.coalesce(F.col("role") == "mentioned", F.lit(False)) & ~F.coalesce(F.col("speech_act") == "respond", F.lit(False)))
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array()))
    own = F.when(mentions(F.col("source_quote"), names), F.array().cast("array<string>")).otherwise(F.array("source_quote"))
    rows = rows.withColumns({
        "_key": F.when(F.col("status") == "same_as", F.concat(F.lit("contact:"), F.col("contact_id").cast("string"))).otherwise(F.concat(F.lit("pending:"), F.col("normalized_name"))),
        "_own": own, "_quotes": F.transform("quotes", lambda q: F.struct(q["text"].alias("text"), q["source_quote"].alias("source_quote"))), "_facts": F.transform("facts", lambda f: f["source_quote"]), "_rank": F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0),
    })
    grouped = rows.groupBy(KEY, "_key").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "_own", "_quotes", "_facts", "interaction_summary"))).alias("_g"), F.max("_rank").alias("_rank"), F.min_by("status", "pos").alias("status"), F.min_by("contact_id", "pos").alias("contact_id"), F.min("pos").alias("pos"))
    grouped = grouped.withColumns({"name": F.get("_g", F.lit(0))["name"], "_own": F.flatten(F.col("_g._own")), "_quotes": F.flatten(F.col("_g._quotes")), "_said": F.transform(F.flatten(F.col("_g._quotes")), lambda q: q["text"]), "_facts": F.flatten(F.col("_g._facts")), "summary": F.array_join(distinct_strings(F.filter("_g.interaction_summary", lambda s: s.isNotNull())), "；")})
    made = created.where("type = 'create_contact'").select(F.col(KEY).alias("_shot"), norm_compare(F.col("payload")["name"]).alias("_made"), F.lit(True).alias("_has")).distinct()
    grouped = grouped.join(made, (F.col(KEY) == F.col("_shot")) & (norm_compare(F.col("name")) == F.col("_made")), "left").drop("_shot", "_made")
    grouped = grouped.where((F.col("status") == "same_as") | F.col("_has"))
    evidence = F.array_distinct(F.filter(F.transform(F.when(F.size("_said") > 0, F.col("_said")).otherwise(F.col("_own")), lambda e: trimmed(without_speaker(e, F.array("name")))), lambda e: e != ""))
    held = events.groupBy(KEY).agg(F.collect_set("source_quote").alias("_held"), F.bool_or(F.col("kind").isin("meeting", "appointment")).alias("_meets"))
    held = held.withColumn("_held", rules.coverage(F.col("_held")))  # once a document, not once a person
    # dealt to as many tasks as there are, and written before what it filters: short rows, but much to do for each
    rows = grouped.join(held, KEY, "left").repartition(int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions")), KEY, "_key")
    rows = rows.withColumns({"_evidence": evidence, "_held": F.coalesce("_held", F.array().cast("array<struct<key:string,segments:array<string>>>"))})
    rows = materialize(rows.withColumn("_keyed", F.arrays_zip("_evidence", norm_contacts(F.col("_evidence")).alias("key"))))
    alive = F.filter("_keyed", lambda e: ~rules.pure_acknowledgement(e["_evidence"]) & ~rules.covered_by(e["key"], F.col("_held")))
    rows = rows.withColumn("_alive", F.transform(alive, lambda e: e["_evidence"])).where((F.size("_alive") > 0) & ~(F.coalesce("_meets", F.lit(False)) & F.forall("_alive", rules.meeting_logistics)))
    own = distinct_strings(F.filter("_own", lambda e: ~rules.pure_acknowledgement(e)))
    said = F.filter("_quotes", lambda q: ~rules.pure_acknowledgement(q["text"]))
    rows = rows.withColumns({"_own": own, "_quotes": said})
    text = F.array_join(distinct_strings(F.concat(F.array(F.array_join("_own", "；")), F.transform("_quotes", lambda q: q["text"]))), "；")
    rows = rows.withColumn("_text", text)
    fields = {"contact_id": F.col("contact_id"), "contact_name": F.col("name"), "summary": rules.interaction_text(F.col("summary"), F.col("_text"), cjk_ratio)}
    confidence = F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("_rank"))
    return rows.select(*_card("record_interaction", fields, confidence, joined_quotes(F.concat("_own", "_facts", F.transform("_quotes", lambda q: q["source_quote"])))))


def propose(parts: dict[str, DataFrame], related: DataFrame, resolved: DataFrame, people: DataFrame, meetings: DataFrame, progress: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """All cards of the documents, with card_no in the order contacts, meetings, interactions."""
    drafted, resolved = materialize(drafts(related)), materialize(resolved)  # written: plans that use them again stay small
    contact = materialize(contact_cards(drafted, resolved, people))
    events = parts["events"] if now is None else parts["events"].withColumn("time_iso", event_time(F.col("time_text"), F.col("time_iso"), now))
    routed = materialize(routed_events(events))
    meetings = materialize(named_meetings(meetings, now))
    stored = materialize(notice_targets(routed, meetings, now))
    targets = materialize(batch_targets(routed, stored, now))
    # a target that repeats a known meeting passes its notices on to it
    repeated = materialize(repeated_meetings(routed.where("route = 'keep'"), meetings))
    twins = repeated.select(F.col(f"_id.{KEY}").alias(KEY), F.col("_id.pos").alias("target"), F.col("_m").alias("meeting_id"))
    passed = targets.join(twins, [KEY, "target"]).select(KEY, "pos", "meeting_id")
    kept = materialize(changed_targets(routed, targets.join(twins, [KEY, "target"], "left_anti")))
    cards = [contact, meeting_cards(kept, meetings, resolved, repeated), interaction_cards(drafted, resolved, events, contact)]
    told = stored.unionByName(passed).join(routed.select(KEY, "pos", F.col("source_quote").alias("content"), "source_quote"), [KEY, "pos"])
    found = told.select(KEY, "pos", "meeting_id", "content", "source_quote", F.lit(1).alias("of"))
    if progress is not None:
        reported = progress.select(KEY, F.posexplode("fragments").alias("pos", "_f"), "meeting_id").select(KEY, F.col("pos").cast("int"), "meeting_id", "_f.content", "_f.source_quote")
        found = found.unionByName(without_discarded(reported, routed).withColumn("of", F.lit(0)))
    fragments = F.transform(F.sort_array(F.collect_list(F.struct("of", "pos", "content", "source_quote"))), lambda x: F.struct(x["content"].alias("content"), x["source_quote"].alias("source_quote")))
    cards.append(progress_cards(materialize(found).groupBy(KEY, "meeting_id").agg(fragments.alias("fragments")), meetings))
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    order = Window.partitionBy(KEY).orderBy(rank, "place", "source_quote")
    return reduce(DataFrame.unionByName, cards).withColumn("card_no", F.row_number().over(order))
