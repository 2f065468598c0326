"""Meeting cards of known meetings; cards that wait for others: order, errors that spread, cycles; a missing contact in a run of cards."""

import json
import random

from skeinflow.operators.batch import confirmed_in_order
from skeinflow.plans import execute, fixtures_queries, propose


def outcomes(spark, cards, needs):
    found = confirmed_in_order(spark.createDataFrame(cards, "card_id long, failed boolean"), spark.createDataFrame(needs, "card_id long, needs long"))
    return {r["card_id"]: (r["outcome"], r["round"]) for r in found.collect()}


def test_chains_confirm_in_order_and_errors_spread(spark):
    found = outcomes(spark, [(1, False), (2, False), (3, False), (4, True), (5, False), (6, False), (7, False), (8, False), (9, False)], [(2, 1), (3, 2), (5, 4), (6, 5), (7, 99), (8, 9), (9, 8)])
    assert found == {1: ("confirmed", 0), 2: ("confirmed", 1), 3: ("confirmed", 2), 4: ("failed", 0), 5: ("dependency", 1), 6: ("dependency", 2), 7: ("dependency", 0), 8: ("cycle", 3), 9: ("cycle", 3)}
    assert outcomes(spark, [], []) == {}


def test_random_graphs_equal_a_plain_fixpoint(spark):
    r = random.Random(6)
    cards = [(i, r.random() < 0.15) for i in range(40)]
    needs = [(i, r.randrange(0, i + 2)) for i in range(1, 40) if r.random() < 0.7 for _ in range(r.randint(1, 2))]
    plain, failed, there = {}, dict(cards), {i for i, _ in cards}
    while True:
        new = {}
        for i in there - plain.keys():
            of = [n for c, n in needs if c == i]
            if failed[i]:
                new[i] = "failed"
            elif any(n not in there or plain.get(n, "confirmed") != "confirmed" for n in of):
                new[i] = "dependency"
            elif all(plain.get(n) == "confirmed" for n in of):
                new[i] = "confirmed"
        if not new:
            break
        plain |= new
    assert {i: o for i, (o, _) in outcomes(spark, cards, needs).items()} == {i: plain.get(i, "cycle") for i in there}


def test_a_missing_contact_is_a_dependency_error(spark):
    schema = "card_id long, screenshot_id long, type string, payload map<string,string>, status string, source_quote string, resolved_at string"
    card = lambda no, kind, **payload: (no, 1, kind, payload, "pending", "q", "t")
    cards = spark.createDataFrame([
        card(1, "create_contact", name="Ada"), card(2, "record_interaction", contact_name=" ada ", summary="met"), card(3, "record_interaction", contact_name="Bo", summary="met"),
        card(4, "create_contact", name="我"), card(5, "update_contact", contact_id="77", contact_name="x", company="c"), card(6, "create_contact", name="Cy", nickname="C"), card(7, "record_interaction", contact_name="Cy", summary="met"),
    ], schema)
    none = lambda schema: spark.createDataFrame([], schema)
    done = execute.execute(cards, none(fixtures_queries.CONTACTS), none(fixtures_queries.MEETINGS), none("contact_id long, screenshot_id long, kind string, content string, source_quote string, observed_at string"))
    assert {r["card_id"]: r["errors"] for r in done["rejected"].collect()} == {3: ["dependency"], 4: ["self_name"], 5: ["dependency"], 6: ["field"], 7: ["dependency"]}
    assert {r["card_id"] for r in done["cards"].collect()} == {1, 2} and done["observations"].count() == 1


def test_cards_of_known_meetings_list_their_changes(spark):
    schema = "screenshot_id long, pos int, kind string, title string, time_text string, time_iso string, location string, participant_names array<string>, agenda string, confidence string, source_quote string"
    events = spark.createDataFrame([(1, 0, "meeting", "Budget review", "", None, "Room 2", ["Ada", "我", " 我 ", "Bo"], None, "high", "q"), (1, 1, "other", "Buy paper", "", None, None, [], None, "high", "a \n b"), (1, 2, "meeting", "Plan talk", "t", "2026-09-03T10:00:00Z", None, ["Cy"], "x", "low", "q")], schema)
    known = spark.createDataFrame([(7, "meeting", "budget review!", "2026-09-02T15:00:00Z", "9/2", "Room 1", [(5, "Ada"), (None, "Di")], "old", "upcoming", "c"), (8, "meeting", "Plan talk", "2026-09-03T10:00:00Z", "t", None, [(None, "Cy")], "x", "upcoming", "c")], fixtures_queries.MEETINGS)
    resolved = spark.createDataFrame([(1, "ada", "same_as", 5), (1, "bo", "same_as", 6), (1, "cy", "unsure", None)], "screenshot_id long, normalized_name string, status string, contact_id long")
    cards = {r["place"]: r["payload"] for r in propose.meeting_cards(events, known, resolved).collect()}
    first = cards[0]
    assert (first["duplicate_of_meeting_id"], first["time_iso"], first["agenda"], first["location"]) == ("7", "2026-09-02T15:00:00Z", "old", "Room 2")
    assert (first["participants"], first["participant_ids"]) == ("Ada、Di、我、Bo", "5,,,6")
    assert json.loads(first["changes"]) == {"title": {"old": "budget review!", "new": "Budget review"}, "location": {"old": "Room 1", "new": "Room 2"}, "participants": {"old": "Ada（联系人 5）、Di", "new": "Ada（联系人 5）、Di、我、Bo（联系人 6）"}}
    assert cards[1]["agenda"] == "ab" and "changes" not in cards[1]
    assert cards[2]["changes"] == "{}"
