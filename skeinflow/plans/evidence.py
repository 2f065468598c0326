"""Evidence documents: nested model output, its ingestion and its child tables.

A document lists participants, events, facts and quotes. Position counts: where rules keep the first of
several, it is the one that comes first in the document, so every child row carries ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.rules import SELF_NAME
from skeinflow.functions.strict import ISO, Field, document_errors
from skeinflow.functions.text import norm_compare, norm_lookup, trimmed

PARTICIPANT = "struct<name:string,is_self:boolean,role:string,speech_act:string,aliases:array<string>,company:string,title:string,phone:string,wechat_id:string,notes:string,interaction_summary:string,confidence:string,source_quote:string>"
EVENT = "struct<kind:string,title:string,time_text:string,time_iso:string,has_time_signal:boolean,location:string,participant_names:array<string>,agenda:string,confidence:string,source_quote:string>"
FACT = "struct<subject_name:string,field:string,value:string,confidence:string,source_quote:string>"
QUOTE = "struct<speaker_name:string,text:string,source_quote:string>"
DOCUMENT = f"struct<participants:array<{PARTICIPANT}>,events:array<{EVENT}>,facts:array<{FACT}>,quotes:array<{QUOTE}>>"
PARTS = ("participants", "events", "facts", "quotes")
CONFIDENCE = ["high", "medium", "low"]

_TEXT, _MAYBE, _SURE = Field(), Field(optional=True), Field(values=tuple(CONFIDENCE))
#: What a document may hold. is_self, has_time_signal and the confidence of oneself may be missing: they are filled in.
STRICT = {
    "participants": {
        "name": _TEXT, "is_self": Field("BOOLEAN", optional=True), "role": Field(optional=True, values=("speaker", "mentioned")), "speech_act": Field(optional=True, values=("initiate", "respond")),
        "aliases": Field("ARRAY", optional=True), "company": _MAYBE, "title": _MAYBE, "phone": _MAYBE, "wechat_id": _MAYBE, "notes": _MAYBE, "interaction_summary": Field(optional=True, pattern="(?U)\\S"),
        "confidence": Field(optional=True, values=tuple(CONFIDENCE)), "source_quote": _TEXT,
    },
    "events": {
        "kind": Field(values=("meeting", "appointment", "other")), "title": _TEXT, "time_text": Field(empty=True), "time_iso": Field(nullable=True, pattern=ISO), "has_time_signal": Field("BOOLEAN", optional=True),
        "location": _MAYBE, "participant_names": Field("ARRAY", optional=True), "agenda": _MAYBE, "confidence": _SURE, "source_quote": _TEXT,
    },
    "facts": {"subject_name": _TEXT, "field": Field(values=("alias", "company", "title", "phone", "wechat_id", "notes", "other")), "value": _TEXT, "confidence": _SURE, "source_quote": _TEXT},
    "quotes": {"speaker_name": Field(nullable=True), "text": _TEXT, "source_quote": _TEXT},
}


def parsed(df: DataFrame, raw: str = "raw_extraction") -> DataFrame:
    """df with ``evidence``: the parsed document with what older ones lack filled in. is_self: the name is
    the self name; has_time_signal: there is a time; confidence of oneself: high. Damaged documents, those with
    keys or values that STRICT doesn't allow, and people without confidence, make it null."""
    doc = F.from_json(raw, DOCUMENT)
    people = F.transform(F.coalesce(doc["participants"], F.array()), lambda p: _with_self(p))
    events = F.transform(F.coalesce(doc["events"], F.array()), lambda e: e.withField("has_time_signal", F.coalesce(e["has_time_signal"], trimmed(F.coalesce(e["time_iso"], F.lit(""))) != "")).withField("participant_names", F.coalesce(e["participant_names"], F.array())))
    whole = F.struct(people.alias("participants"), events.alias("events"), F.coalesce(doc["facts"], F.array()).alias("facts"), F.coalesce(doc["quotes"], F.array()).alias("quotes"))
    bad = doc.isNull() | (F.size(document_errors(F.col(raw), STRICT)) > 0)
    unsure = F.exists(people, lambda p: ~F.coalesce(p["confidence"].isin(CONFIDENCE), F.lit(False)))
    return df.withColumn("evidence", F.when(~bad & ~unsure, whole))


def _with_self(p: Column) -> Column:
    own = F.coalesce(p["is_self"], trimmed(p["name"]) == SELF_NAME)
    return p.withField("is_self", own).withField("confidence", F.coalesce(p["confidence"], F.when(own, "high")))


def children(df: DataFrame, part: str, key: str = "screenshot_id") -> DataFrame:
    """A row per element of a part: key, pos and the element's fields."""
    return df.where(F.col("evidence").isNotNull()).select(key, F.posexplode(f"evidence.{part}").alias("pos", "_e")).select(key, "pos", "_e.*")


def with_self_names(df: DataFrame, self_names: list[str], known: DataFrame | None = None, name: str = "known_name") -> DataFrame:
    """Marks people with one of one's own names as self, unless a contact has that name; in the names of
    events, self hits fold into one self name at the end."""
    own = [n.strip() for n in self_names if n.strip()]
    keys = F.transform(F.array(*[F.lit(n) for n in [*own, SELF_NAME]]), norm_lookup)
    taken = F.array().cast("array<string>")
    if known is not None:  # contacts with one's own names: as many rows as there are such names at most
        mine = sorted({" ".join(n.split()).lower() for n in own})
        held = known.select(norm_lookup(F.col(name)).alias("k")).where(F.col("k").isin(mine)).distinct().collect()
        if held:
            taken = F.array(*[F.lit(r["k"]) for r in held])
    hit = lambda n: F.array_contains(keys, norm_lookup(n)) & ~F.array_contains(taken, norm_lookup(n))
    people = F.transform("evidence.participants", lambda p: p.withField("is_self", hit(p["name"])))
    events = F.transform("evidence.events", lambda e: e.withField("participant_names", F.concat(F.filter(e["participant_names"], lambda n: ~hit(n)), F.when(F.exists(e["participant_names"], hit), F.array(F.lit(SELF_NAME))).otherwise(F.array()))))
    return df.withColumn("evidence", F.when(F.col("evidence").isNotNull(), F.col("evidence").withField("participants", people).withField("events", events)))


def related(people: DataFrame, facts: DataFrame, quotes: DataFrame, key: str = "screenshot_id") -> DataFrame:
    """People with their facts and quotes as ordered arrays, matched by name within the document."""
    f = facts.withColumn("_n", norm_compare(F.col("subject_name"))).groupBy(key, "_n").agg(F.sort_array(F.collect_list(F.struct("pos", "field", "value", "source_quote", "confidence"))).alias("facts"))
    q = quotes.where("speaker_name is not null").withColumn("_n", norm_compare(F.col("speaker_name"))).groupBy(key, "_n").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "source_quote"))).alias("quotes"))
    joined = people.withColumn("_n", norm_compare(F.col("name"))).join(f, [key, "_n"], "left").join(q, [key, "_n"], "left").drop("_n")
    return joined.withColumns({"facts": F.coalesce("facts", F.array()), "quotes": F.coalesce("quotes", F.array())})


def first_fact(facts: Column, field: str) -> Column:
    """Value of the first fact of a field."""
    return F.get(F.filter(facts, lambda f: f["field"] == field), F.lit(0))["value"]
