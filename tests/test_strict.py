"""Strict documents: each violation, and what may be missing."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from skeinflow.functions.strict import document_errors
from skeinflow.plans import evidence, execute

WHOLE = {
    "participants": [{"name": "Ada", "is_self": False, "aliases": ["A"], "confidence": "high", "source_quote": "q"}],
    "events": [{"kind": "other", "title": "t", "time_text": "", "time_iso": None, "has_time_signal": False, "participant_names": [], "confidence": "low", "source_quote": "q"}],
    "facts": [{"subject_name": "Ada", "field": "phone", "value": "1", "confidence": "low", "source_quote": "q"}],
    "quotes": [{"speaker_name": None, "text": "x", "source_quote": "x"}],
}


def changed(path, value):
    doc = copy.deepcopy(WHOLE)
    at = doc
    for k in path[:-1]:
        at = at[k]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(doc)


P, E, Q = ("participants", 0), ("events", 0), ("quotes", 0)
CASES = [
    (json.dumps(WHOLE), []), ("{}", []), ('{"facts": []}', []), ("{damaged", ["json"]), ("[1]", ["type"]), ("null", ["type"]), (None, ["json"]),
    (changed((*P, "nickname"), "x"), ["participants: nickname: unknown"]), (changed(("people",), []), ["people: unknown"]), (changed(("facts",), None), ["facts: type"]), (changed(("facts",), {}), ["facts: type"]),
    (changed((*P, "is_self"), "no"), ["participants: is_self: type"]), (changed((*P, "is_self"), KeyError), []), (changed((*P, "aliases"), ["A", 1]), ["participants: aliases: type"]), (changed((*P, "aliases"), [""]), ["participants: aliases: empty"]),
    (changed((*P, "company"), None), ["participants: company: null"]), (changed((*P, "company"), ""), ["participants: company: empty"]), (changed((*P, "role"), "host"), ["participants: role: value"]), (changed((*P, "name"), 7), ["participants: name: type"]),
    (changed((*E, "time_iso"), "2026-09-02T15:00:00+08:00"), []), (changed((*E, "time_iso"), "2026-09-02"), ["events: time_iso: value"]), (changed((*E, "time_iso"), KeyError), ["events: time_iso: missing"]), (changed((*E, "kind"), "party"), ["events: kind: value"]),
    (changed((*Q, "speaker_name"), KeyError), ["quotes: speaker_name: missing"]), (changed((*Q, "text"), ""), ["quotes: text: empty"]), (changed(("quotes", 0), "x"), ["quotes: type"]), (changed((*P, "interaction_summary"), " 　"), ["participants: interaction_summary: value"]),
]


def test_violations(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string")
    found = {r["i"]: r["e"] for r in df.select("i", document_errors(F.col("raw"), evidence.STRICT).alias("e")).collect()}
    assert [sorted(found[i]) for i in range(len(CASES))] == [sorted(e) for _, e in CASES]


def test_only_whole_documents_are_evidence(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw_extraction string")
    kept = {r["i"] for r in evidence.parsed(df).where("evidence is not null").collect()}
    assert kept == {i for i, (_, e) in enumerate(CASES) if not e}


@pytest.mark.parametrize("value,bad", [("1", False), (str((1 << 53) - 1), False), (str(1 << 53), True), ("0", True), ("-3", True), ("1.5", True), ("x", True)])
def test_ids_are_exact_numbers(spark, value, bad):
    card = spark.createDataFrame([("update_contact", "pending", {"contact_id": value, "contact_name": "a"})], "type string, status string, payload map<string,string>")
    assert ("contact_id" in execute.card_errors(card).first()["errors"]) == bad
