"""Confirmed cards folded into a new snapshot of the library, set by set: contacts, updates, meetings,
interactions, and the observations that follow from them. Nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.rules import SELF_NAME, observation_kind
from skeinflow.functions.text import alias_list, collapsed, distinct_strings, norm_compare, norm_lookup, shortest_sentence, trimmed
from skeinflow.operators import match
from skeinflow.operators.batch import confirmed_in_order
from skeinflow.operators.snapshots import rebased, replaced
from skeinflow.scratch import materialize

FIELDS = ["company", "title", "phone", "wechat_id", "notes"]
#: How fields are called in observations.
LABELS = {"company": "公司", "title": "职位", "phone": "电话", "wechat_id": "微信号", "notes": "备注"}
ALLOWED = {
    "create_contact": ["name", "aliases", *FIELDS, "merge_contact_id"],
    "update_contact": ["contact_id", "contact_name", "aliases", "old_aliases", *FIELDS, *[f"old_{f}" for f in FIELDS]],
    "create_meeting": ["kind", "title", "time_text", "time_iso", "location", "agenda", "agenda_append", "participants", "participant_ids", "duplicate_of_meeting_id", "changes"],
    "record_interaction": ["contact_id", "contact_name", "summary"],
}
OBSERVATION = ["contact_id", "screenshot_id", "kind", "content", "source_quote", "observed_at"]
INSIGHTS_PER_CONTACT = 3
LARGEST_ID = (1 << 53) - 1  #: beyond it numbers of JSON aren't exact


def value(name: str) -> Column:
    return F.col("payload")[name]


def card_errors(cards: DataFrame) -> DataFrame:
    """cards with ``errors``: what keeps a card from being applied."""
    blank = lambda name: trimmed(F.coalesce(value(name), F.lit(""))) == ""
    is_ = lambda kind: F.col("type") == kind
    bad_id = lambda name: value(name).isNotNull() & ~F.coalesce(value(name).try_cast("long").between(1, LARGEST_ID), F.lit(False))
    checks = [
        (F.col("status") != "pending", "not_pending"),
        (~F.col("type").isin("create_contact", "update_contact", "create_meeting", "record_interaction"), "type"),
        (is_("create_contact") & blank("name"), "name"), (is_("create_contact") & (trimmed(value("name")) == SELF_NAME), "self_name"),
        (is_("update_contact") & (blank("contact_id") | bad_id("contact_id")), "contact_id"),
        (is_("create_meeting") & blank("title"), "title"), (is_("create_meeting") & bad_id("duplicate_of_meeting_id"), "meeting_id"),
        (is_("record_interaction") & blank("summary"), "summary"), (is_("record_interaction") & bad_id("contact_id"), "contact_id"),
        ((is_("record_interaction") | is_("update_contact")) & (trimmed(F.coalesce(value("contact_name"), F.lit(""))) == SELF_NAME), "self_name"),
        (is_("create_contact") & F.array_contains(alias_list(F.coalesce(value("aliases"), F.lit(""))), SELF_NAME), "self_name"),
        (is_("create_meeting") & value("kind").isNotNull() & ~value("kind").isin("meeting", "appointment", "other"), "kind"),
        (is_("create_contact") & value("merge_contact_id").isNotNull() & bad_id("merge_contact_id"), "contact_id"),
        *[(is_(kind) & (F.size(F.array_except(F.map_keys("payload"), F.array(*[F.lit(f) for f in fields]))) > 0), "field") for kind, fields in ALLOWED.items()],
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in checks])
    return cards.withColumn("errors", F.array_distinct(F.filter(found, lambda e: e.isNotNull())))


def next_ids(df: DataFrame, table: DataFrame, order: str, buckets: int = 256) -> DataFrame:
    """df with ``new_id``, gapless above the ids of a table, the same for the same rows: numbers within
    buckets of the order column (a long) by hash, after the counts of the buckets before."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sizes = {r["_b"]: r["count"] for r in dealt.groupBy("_b").count().collect()}
    before = [top + sum(sizes.get(k, 0) for k in range(b)) for b in range(buckets)]
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return dealt.withColumn("new_id", F.get(F.from_json(F.lit(str(before)), "array<bigint>"), F.col("_b").cast("int")) + inside).drop("_b")


def created_contacts(cards: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contacts with the new ones, card_id and contact_id of what was created). A card that names an
    existing contact to merge into adds its name and aliases there instead."""
    rows = cards.where("type = 'create_contact'")
    rows = rows.withColumn("merge", value("merge_contact_id").try_cast("long"))
    fresh = next_ids(rows.where("merge is null"), contacts, "card_id")
    new = fresh.select(F.col("new_id").cast("long").alias("id"), trimmed(value("name")).alias("canonical_name"), alias_list(F.coalesce(value("aliases"), F.lit(""))).alias("aliases"), *[value(f).alias(f) for f in FIELDS], F.col("resolved_at").alias("created_at"), F.col("resolved_at").alias("updated_at"))
    merged = rows.where("merge is not null").groupBy(F.col("merge").alias("id")).agg(F.flatten(F.collect_list(F.concat(F.array(trimmed(value("name"))), alias_list(F.coalesce(value("aliases"), F.lit("")))))).alias("_more"))
    kept = contacts.join(merged, "id", "left")
    names = F.filter(F.array_distinct(F.concat("aliases", F.coalesce("_more", F.array()))), lambda a: norm_compare(a) != norm_compare(F.col("canonical_name")))
    kept = kept.withColumn("aliases", F.when(F.col("_more").isNull(), F.col("aliases")).otherwise(names)).drop("_more").select(*new.columns)
    ids = fresh.select("card_id", "screenshot_id", trimmed(value("name")).alias("name"), F.col("new_id").cast("long").alias("contact_id")).unionByName(rows.where("merge is not null").select("card_id", "screenshot_id", trimmed(value("name")).alias("name"), F.col("merge").alias("contact_id")))
    return kept.unionByName(new), ids


def updated_contacts(cards: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contacts, status-change observations): the last card of a field counts; a change of a field that
    had a value, as the library has it, is observed."""
    rows = cards.where("type = 'update_contact'").withColumn("id", value("contact_id").try_cast("long"))
    last = [F.max_by(value(f), F.when(value(f).isNotNull(), F.col("card_id"))).alias(f"n_{f}") for f in FIELDS]
    new = rows.groupBy("id").agg(*last, F.max("resolved_at").alias("_at"), F.max(F.struct("card_id", "screenshot_id", "source_quote")).alias("_c"))
    joined = contacts.join(new, "id", "left")
    news = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("old"), F.col(f"n_{f}").alias("new")) for f in FIELDS])
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    moved = joined.where("_at is not null").select("id", "_at", "_c", F.explode(F.filter(news, lambda x: x["new"].isNotNull() & x["old"].isNotNull() & (x["old"] != x["new"]))).alias("x"))
    seen = moved.select(F.col("id").alias("contact_id"), "_c.screenshot_id", F.lit("status_change").alias("kind"), F.concat(F.element_at(labels, F.col("x.field")), F.lit('由 "'), "x.old", F.lit('" 变为 "'), "x.new", F.lit('"')).alias("content"), "_c.source_quote", F.col("_at").alias("observed_at"))
    out = joined.select(*[F.coalesce(f"n_{c}", c).alias(c) if c in FIELDS else F.coalesce("_at", c).alias(c) if c == "updated_at" else F.col(c) for c in contacts.columns])
    return out, seen


def applied_meetings(cards: DataFrame, meetings: DataFrame, created: DataFrame) -> DataFrame:
    """Meetings with the new ones; a card for a known one appends to its agenda as that is now, rebased on
    what the card saw, and fills what is empty. Participants get the id of the one contact created on the
    same screenshot with their name."""
    rows = cards.where("type = 'create_meeting'").withColumn("known", value("duplicate_of_meeting_id").try_cast("long"))
    people = rows.select("card_id", "screenshot_id", F.split(F.coalesce(value("participant_ids"), F.lit("")), ",").alias("_ids"), F.posexplode(F.split(F.coalesce(value("participants"), F.lit("")), "、")).alias("pos", "name")).where("trim(name) <> ''")
    people = people.withColumn("_given", F.get("_ids", F.col("pos")).try_cast("long")).drop("_ids")
    ids = created.groupBy("screenshot_id", norm_compare(F.col("name")).alias("_n")).agg(F.count_distinct("contact_id").alias("_c"), F.min("contact_id").alias("contact_id")).where("_c = 1").drop("_c")
    people = people.withColumn("_n", norm_compare(F.col("name"))).join(ids, ["screenshot_id", "_n"], "left").withColumn("contact_id", F.coalesce("_given", "contact_id"))
    who = people.groupBy("card_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "contact_id", "name"))), lambda p: F.struct(p["contact_id"].alias("contact_id"), p["name"].alias("name"))).alias("participants"))
    rows = rows.join(who, "card_id", "left").withColumn("participants", F.coalesce("participants", F.array()))
    fresh = next_ids(rows.where("known is null"), meetings, "card_id")
    new = fresh.select(F.col("new_id").cast("long").alias("id"), value("kind").alias("kind"), value("title").alias("title"), value("time_iso").alias("time_iso"), F.coalesce(value("time_text"), F.lit("")).alias("time_text"), value("location").alias("location"), "participants", value("agenda").alias("agenda"), F.lit("upcoming").alias("status"), F.col("resolved_at").alias("created_at"))
    more = rows.where("known is not null").groupBy(F.col("known").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("card_id", F.coalesce(value("agenda_append"), value("agenda"), F.lit("")).alias("a")))), lambda x: x["a"]), "；").alias("_a"), F.max_by(value("time_iso"), F.when(value("time_iso").isNotNull(), F.col("card_id"))).alias("_t"), F.max_by(value("location"), F.when(value("location").isNotNull(), F.col("card_id"))).alias("_l"))
    joined = meetings.join(more, "id", "left")
    agenda = F.when(F.col("_a").isNull(), F.col("agenda")).otherwise(F.nullif(rebased(F.lit("\x00"), F.col("agenda"), F.col("_a")), F.lit("")))
    joined = joined.withColumns({"agenda": agenda, "time_iso": F.coalesce("time_iso", "_t"), "location": F.coalesce("location", "_l")}).drop("_a", "_t", "_l")
    return joined.select(*new.columns).unionByName(new)


def interactions(cards: DataFrame, contacts: DataFrame, created: DataFrame) -> DataFrame:
    """Interaction observations: of the card's contact, else of the one contact created on the same
    screenshot with its name. Without a clear contact a card gives nothing."""
    rows = cards.where("type = 'record_interaction'").withColumns({"_given": value("contact_id").try_cast("long"), "_n": norm_compare(value("contact_name"))})
    made = created.groupBy("screenshot_id", norm_compare(F.col("name")).alias("_n")).agg(F.count_distinct("contact_id").alias("_c"), F.min("contact_id").alias("_made")).where("_c = 1").drop("_c")
    rows = rows.join(made, ["screenshot_id", "_n"], "left").withColumn("contact_id", F.coalesce("_given", "_made")).where("contact_id is not null")
    rows = rows.join(contacts.select(F.col("id").alias("contact_id")), "contact_id", "left_semi")
    return rows.select("contact_id", "screenshot_id", F.lit("interaction").alias("kind"), value("summary").alias("content"), "source_quote", F.col("resolved_at").alias("observed_at"))


def contexts(cards: DataFrame, contacts: DataFrame, created: DataFrame) -> DataFrame:
    """screenshot_id, contact_id, name (norm_lookup): under which names a screenshot's evidence speaks of the
    contacts of its confirmed cards; those of the contact, of the card, and of a new contact's card."""
    made = created.select("screenshot_id", "contact_id", F.array("name").alias("said"))
    given = cards.where("type in ('update_contact', 'record_interaction')").select("screenshot_id", value("contact_id").try_cast("long").alias("contact_id"), F.array(value("contact_name")).alias("said"))
    rows = made.unionByName(given.where("contact_id is not null")).join(contacts.select(F.col("id").alias("contact_id"), "canonical_name", "aliases"), "contact_id")
    names = distinct_strings(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array()), F.filter("said", lambda n: n.isNotNull())))
    return rows.select("screenshot_id", "contact_id", F.explode(names).alias("_n")).select("screenshot_id", "contact_id", norm_lookup(F.col("_n")).alias("name")).distinct()


def fact_observations(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Facts (screenshot_id, subject_name, value, source_quote, observed_at, and field if known) about the
    people of ``contexts``: fields as 'label: value', notes and others as preference or fact; aliases are no
    observation."""
    rows = (facts if "field" in facts.columns else facts.withColumn("field", F.lit("other"))).where("field <> 'alias'")
    rows = rows.withColumn("name", norm_lookup(F.col("subject_name"))).join(known, ["screenshot_id", "name"])
    return _observed(rows, F.col("field"), trimmed(F.col("value")), trimmed(F.col("source_quote")))


def people_observations(people: DataFrame, known: DataFrame) -> DataFrame:
    """Fields of participants (screenshot_id, name, aliases, fields, source_quote, observed_at), each with the
    shortest sentence of the quote that holds it."""
    said = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array())), norm_lookup)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), trimmed(F.col(f)).alias("value")) for f in FIELDS])
    rows = people.withColumn("_row", F.monotonically_increasing_id()).withColumns({"_names": said, "_f": F.filter(fields, lambda x: x["value"] != "")})
    rows = rows.select("screenshot_id", "_f", "source_quote", "observed_at", F.explode(F.array_distinct("_names")).alias("name")).join(known, ["screenshot_id", "name"])
    rows = rows.select("screenshot_id", "contact_id", "source_quote", "observed_at", F.explode("_f").alias("_x")).distinct()
    return _observed(rows, F.col("_x.field"), F.col("_x.value"), trimmed(shortest_sentence(F.col("source_quote"), F.col("_x.value"))))


def _observed(rows: DataFrame, field: Column, said: Column, quote: Column) -> DataFrame:
    free = field.isin("notes", "other")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), field)
    rows = rows.withColumns({"kind": F.when(free, observation_kind(said)).otherwise("fact"), "content": F.when(free, said).otherwise(F.concat(label, F.lit(": "), said)), "source_quote": quote})
    return rows.where("content <> '' and source_quote <> ''").select(*OBSERVATION)


def sibling_cards(names: DataFrame, cards: DataFrame) -> DataFrame:
    """screenshot_id, shown, name, status of the create cards of a screenshot that go by a displayed name, in
    any state: why a card that waits for one can't be applied. names: screenshot_id, shown."""
    made = cards.where("type = 'create_contact'").select("screenshot_id", "card_id", trimmed(value("name")).alias("name"), "status", F.explode(F.concat(F.array(value("name")), alias_list(F.coalesce(value("aliases"), F.lit(""))))).alias("_a"))
    made = made.select("screenshot_id", "card_id", "name", "status", norm_lookup(F.col("_a")).alias("_k")).distinct()
    return names.withColumn("_k", norm_lookup(F.col("shown"))).join(made, ["screenshot_id", "_k"]).select("screenshot_id", "shown", "card_id", "name", "status").distinct()


def contact_needs(cards: DataFrame, contacts: DataFrame) -> DataFrame:
    """card_id, needs: the create cards of their screenshots that interactions without a contact go by, under the
    displayed name; a card that names no contact of the library and no create card, or several, needs one that
    isn't there (null)."""
    rows = cards.where("type in ('record_interaction', 'update_contact')").select("card_id", "screenshot_id", value("contact_id").try_cast("long").alias("_given"), norm_compare(value("contact_name")).alias("_n"))
    given = rows.where("_given is not null").join(contacts.select(F.col("id").alias("_given")), "_given", "left_anti").select("card_id", F.lit(None).cast("long").alias("needs"))
    made = cards.where("type = 'create_contact'").select("screenshot_id", norm_compare(value("name")).alias("_n"), F.col("card_id").alias("needs"))
    made = match.unique_target(made.withColumn("_k", F.struct("screenshot_id", "_n")), "_k", "needs").select("_k.screenshot_id", "_k._n", "needs")
    return given.unionByName(rows.where("_given is null").join(made, ["screenshot_id", "_n"], "left").select("card_id", "needs"))


def deduplicated(observations: DataFrame) -> DataFrame:
    """Facts and preferences once per contact and content, with the shortest quote and the first time;
    interactions once per contact and screenshot; others once per screenshot, content and quote; a fact
    whose value a status change of the contact holds is left out."""
    by_content = F.col("kind").isin("fact", "preference")
    said = observations.where(by_content).groupBy("contact_id", "kind", "content").agg(F.min_by("screenshot_id", F.struct("observed_at", "screenshot_id")).alias("screenshot_id"), F.min_by("source_quote", F.struct(F.length("source_quote"), F.col("observed_at"))).alias("source_quote"), F.min("observed_at").alias("observed_at"))
    changed = observations.where("kind = 'status_change'").select("contact_id", F.regexp_extract("content", "^(.+?)由 ", 1).alias("_f"), F.regexp_extract("content", '变为 "(?s:(.*))"$', 1).alias("_v"))
    changed = changed.select("contact_id", F.when(F.col("_f") == LABELS["notes"], F.col("_v")).otherwise(F.concat("_f", F.lit(": "), "_v")).alias("content")).distinct()
    said = said.join(changed, ["contact_id", "content"], "left_anti")
    met = observations.where("kind = 'interaction'").groupBy("contact_id", "screenshot_id", "kind").agg(F.min_by(F.struct("content", "source_quote", "observed_at"), F.struct("observed_at", "content")).alias("_x")).select("contact_id", "screenshot_id", "kind", "_x.*")
    rest = observations.where(~by_content & (F.col("kind") != "interaction")).groupBy("contact_id", "screenshot_id", "kind", "content", "source_quote").agg(F.min("observed_at").alias("observed_at"))
    return said.select(*OBSERVATION).unionByName(met.select(*OBSERVATION)).unionByName(rest.select(*OBSERVATION))


def settled(cards: DataFrame, created: DataFrame) -> DataFrame:
    """The applied cards with status confirmed and the contact that each ended at."""
    made = created.select("card_id", F.col("contact_id").alias("_made"))
    rows = cards.join(made, "card_id", "left").withColumn("resolved_contact_id", F.coalesce("_made", value("contact_id").try_cast("long")))
    return rows.withColumn("status", F.lit("confirmed")).drop("_made", "errors")


def execute(cards: DataFrame, contacts: DataFrame, meetings: DataFrame, observations: DataFrame, facts: DataFrame | None = None, people: DataFrame | None = None) -> dict[str, DataFrame]:
    """The next snapshot: contacts, meetings, observations, the applied cards, and the rejected ones with
    their errors: ``dependency`` where a card waits for a contact that no card of the run creates. facts and
    people: of the evidence, for the observations that follow from it."""
    checked = materialize(card_errors(cards))
    order = confirmed_in_order(checked.select("card_id", (F.size("errors") > 0).alias("failed")), contact_needs(checked, contacts))
    late = order.where("outcome in ('dependency', 'cycle')").select("card_id", F.array("outcome").alias("_late"))
    checked = materialize(checked.join(late, "card_id", "left").withColumn("errors", F.concat("errors", F.coalesce("_late", F.array().cast("array<string>")))).drop("_late"))
    valid = checked.where(F.size("errors") == 0)
    library, created = created_contacts(valid, contacts)
    library, moved = updated_contacts(valid, library)
    told = interactions(valid, library, created).unionByName(moved)
    known = contexts(valid, library, created)
    if facts is not None:
        told = told.unionByName(fact_observations(facts, known))
    if people is not None:
        told = told.unionByName(people_observations(people, known))
    return {
        "contacts": library, "meetings": applied_meetings(valid, meetings, created), "observations": deduplicated(observations.select(*OBSERVATION).unionByName(told)),
        "rejected": checked.where(F.size("errors") > 0), "created": created, "cards": settled(valid, created),
    }


def grounded_insights(old: DataFrame, proposed: DataFrame, observations: DataFrame) -> DataFrame:
    """Insights after a run: proposed ones (contact_id, pos, kind, content, based_on, generated_at) that
    rest on observations of their contact, once each, the first few per contact; they replace the old
    insights of their contacts, others stay. observations: contact_id, id."""
    own = observations.groupBy("contact_id").agg(F.collect_set("id").alias("_own"))
    rows = proposed.join(own, "contact_id").withColumns({"based_on": F.array_distinct(F.array_intersect("based_on", "_own")), "content": collapsed(F.col("content"))})
    rows = rows.where((F.size("based_on") > 0) & (F.col("content") != ""))
    first = rows.groupBy("contact_id", "kind", "content", "based_on").agg(F.min("pos").alias("pos"), F.min("generated_at").alias("generated_at"))
    ranked = first.withColumn("_rn", F.row_number().over(Window.partitionBy("contact_id").orderBy("pos"))).where(F.col("_rn") <= INSIGHTS_PER_CONTACT)
    return replaced(old, ranked.select(*old.columns), "contact_id")
