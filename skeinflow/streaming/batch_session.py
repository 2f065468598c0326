"""A batch of screenshots from proposal to confirmation, as a fold over its steps.

Proposed cards of a screenshot are settled against what earlier screenshots of the batch left: people not yet in
the library wait under negative ids behind the create card that named them first (their anchor), which later
cards of the same person merge into; meetings and interactions with such people depend on their anchors; an
``other`` item that an earlier pending or rejected one already says (same time, similar quote) goes, and gives it
its time if that one has none. Confirmed anchors replace negative ids by real ones; a rejected anchor leaves a
tombstone, from which a reopened one comes back under a new id; a card whose anchors aren't all confirmed waits.

``fold_batches`` takes a table: rows reach the fold sorted by batch and step, and a task holds one batch's state,
not its rows. ``batch_session_stream`` takes a stream and keeps that state in a state store (ValueState and
MapState per batch, so a restart goes on where it stopped). Both give the same rows.

Input rows, one per card and action: batch, step, card_id, action (propose, confirm, reject, reopen), type (of a
proposed card), name, aliases, fields, people (names of participants), kind, time_text, time_iso, source_quote,
contact_id (of a confirmed anchor). A step is a screenshot or a review action; a stream has all rows of a step in
one micro-batch, steps in order. Output: one row per input row, with what became of the card.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skeinflow.functions.chinese_time import time_key
from skeinflow.functions.text import norm_compare, norm_contact

SIMILAR = 0.85
OUTCOME = "batch long, step int, card_id long, outcome string, target long, temporary_id long, depends array<long>, contact_ids array<long>, merged string"
TEXTS = ["action", "type", "name", "kind", "time_text", "time_iso", "source_quote"]


def keyed(steps: DataFrame) -> DataFrame:
    """steps with the keys that names, quotes and times are compared by."""
    each = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), norm_compare)
    return steps.select(
        F.col("batch").cast("long").alias("batch"), F.col("step").cast("int").alias("step"), F.col("card_id").cast("long").alias("card_id"), *TEXTS,
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.to_json("fields").alias("fields"), F.col("contact_id").cast("long").alias("contact_id"),
        norm_compare(F.col("name")).alias("name_key"), each(F.col("aliases")).alias("alias_keys"), each(F.col("people")).alias("people_keys"),
        F.coalesce(norm_contact(F.col("source_quote")), F.lit("")).alias("quote_key"), time_key(F.coalesce("time_text", F.lit(""))).alias("time_key"),
    )


def similar(a: str, b: str, least: float = SIMILAR) -> bool:
    """Whether 1 - edit distance / longer length reaches the limit; the distance stops beyond it."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if not a or not b or abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(new[max(0, low - 1) : high + 1]) > most:
            return False
        row = new
    return row[-1] <= most


class Batch:
    """State of one batch: people (by anchor card), other items and dependencies (by card), next negative id."""

    def __init__(self, next_id: int = -1, people: dict | None = None, items: dict | None = None, waits: dict | None = None):
        self.next_id, self.people, self.items, self.waits = next_id, people or {}, items or {}, waits or {}
        self.touched: set[tuple[str, int]] = set()  # what a state store has to write
        self.named: dict[str, list[int]] = {}  # anchors by name
        self.timed: dict[str, list[int]] = {}  # items by time
        for p in self.people.values():
            self._name(p)
        for i in self.items.values():
            self.timed.setdefault(i["time_key"], []).append(i["card"])

    def _name(self, person: dict) -> None:
        for key in person["keys"]:
            cards = self.named.setdefault(key, [])
            if person["card"] not in cards:
                cards.append(person["card"])

    def _put(self, kind: str, card: int, value: dict) -> dict:
        getattr(self, kind)[card] = value
        self.touched.add((kind, card))
        return value

    def _known(self, key: str, step: int) -> dict | None:
        """The first person of that name from an earlier screenshot."""
        found = (self.people[c] for c in self.named.get(key, ()))
        return min((p for p in found if not p["gone"] and p["step"] < step), key=lambda p: (p["step"], p["card"]), default=None)

    def _anchored(self, row: dict) -> dict:
        fields = {f: [v.strip(), row["step"]] for f, v in row["fields"].items() if v and v.strip()}
        keys = list(dict.fromkeys(k for k in [row["name_key"], *row["alias_keys"]] if k))
        person = self._put("people", row["card_id"], {"card": row["card_id"], "step": row["step"], "id": self.next_id, "keys": keys, "fields": fields, "quotes": [row["source_quote"]] if row["source_quote"] else [], "contact": None, "gone": False})
        self._name(person)
        self.next_id -= 1
        return {"outcome": "anchor", "target": row["card_id"], "temporary_id": person["id"]}

    def _merged(self, person: dict, row: dict) -> dict:
        """Later fields win, quotes and aliases add up."""
        for f, v in row["fields"].items():
            if v and v.strip() and person["fields"].get(f, ["", -1])[1] <= row["step"]:
                person["fields"][f] = [v.strip(), row["step"]]
        person["quotes"] += [q for q in [row["source_quote"]] if q and q not in person["quotes"]]
        person["keys"] = list(dict.fromkeys([*person["keys"], *(k for k in row["alias_keys"] if k)]))
        self._name(self._put("people", person["card"], person))
        merged = {**{f: v for f, (v, _) in sorted(person["fields"].items())}, "quotes": len(person["quotes"])}
        return {"outcome": "merged", "target": person["card"], "temporary_id": person["id"], "merged": json.dumps(merged, ensure_ascii=False)}

    def _said(self, row: dict) -> dict | None:
        """The first earlier item that says the same; it takes the time if it has none."""
        for card in self.timed.get(row["time_key"], ()):
            item = self.items[card]
            if item["status"] != "confirmed" and item["step"] < row["step"] and similar(row["quote_key"], item["quote_key"]):
                gives = item["status"] == "pending" and item["time_iso"] is None and row["time_iso"] is not None
                if gives:
                    self._put("items", card, {**item, "time_iso": row["time_iso"]})
                return {"outcome": "duplicate", "target": card, "merged": row["time_iso"] if gives else None}
        return None

    def propose(self, row: dict) -> dict:
        card, step = row["card_id"], row["step"]
        if row["type"] in ("create_contact", "update_contact"):
            person = self._known(row["name_key"], step)
            if person and person["contact"] is not None:
                return {"outcome": "known", "target": person["card"], "contact_ids": [person["contact"]]}
            if person:
                return self._merged(person, row)
            return self._anchored(row) if row["type"] == "create_contact" and row["name_key"] else {"outcome": "kept"}
        if row["type"] == "create_meeting" and row["kind"] == "other":
            if found := self._said(row):
                return found
            self._put("items", card, {"card": card, "step": step, "quote_key": row["quote_key"], "time_key": row["time_key"], "time_iso": row["time_iso"], "status": "pending"})
            self.timed.setdefault(row["time_key"], []).append(card)
        met = [self._known(n, step) for n in (row["people_keys"] if row["type"] == "create_meeting" else [row["name_key"]])]
        waits = list(dict.fromkeys(p["card"] for p in met if p and p["contact"] is None))
        if waits:
            self._put("waits", card, {"anchors": [p["card"] if p else None for p in met]})
        return {"outcome": "kept", "depends": waits, "contact_ids": [p["id"] if p["contact"] is None else p["contact"] for p in met if p]}

    def review(self, row: dict) -> dict:
        card, action = row["card_id"], row["action"]
        person, item = self.people.get(card), self.items.get(card)
        if action == "confirm":
            anchors = [self.people[a] for a in self.waits.get(card, {"anchors": []})["anchors"] if a is not None]
            missing = list(dict.fromkeys(p["card"] for p in anchors if p["contact"] is None))
            if any(p["gone"] for p in anchors):
                return {"outcome": "broken", "depends": missing}
            if missing:
                return {"outcome": "waiting", "depends": missing}
            if person and row["contact_id"] is not None:
                self._put("people", card, {**person, "contact": row["contact_id"]})
            if item:
                self._put("items", card, {**item, "status": "confirmed"})
            return {"outcome": "confirmed", "contact_ids": [row["contact_id"]] if person and row["contact_id"] is not None else [p["contact"] for p in anchors]}
        if action == "reject":
            if person:
                self._put("people", card, {**person, "gone": True})
            if item:
                self._put("items", card, {**item, "status": "rejected"})
            return {"outcome": "rejected"}
        if person and person["gone"]:
            self._put("people", card, {**person, "gone": False, "id": self.next_id, "contact": None})
            self.next_id -= 1
            return {"outcome": "reopened", "temporary_id": self.next_id + 1}
        if item:
            self._put("items", card, {**item, "status": "pending"})
        return {"outcome": "reopened"}

    def apply(self, rows: Iterator[dict]) -> Iterator[dict]:
        """Results of rows in order. A screenshot's rows don't see each other: they share a step."""
        for row in rows:
            row["fields"] = json.loads(row["fields"]) if row["fields"] else {}
            result = self.propose(row) if row["action"] == "propose" else self.review(row)
            yield {"batch": row["batch"], "step": row["step"], "card_id": row["card_id"], "target": None, "temporary_id": None, "depends": [], "contact_ids": [], "merged": None, **result}


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for frame in frames:
        for row in frame.to_dict("records"):
            for c in ("contact_id", *TEXTS, "name_key", "fields"):
                row[c] = None if row[c] is None or row[c] != row[c] else row[c]
            row["contact_id"] = None if row["contact_id"] is None else int(row["contact_id"])
            row["alias_keys"], row["people_keys"] = list(row["alias_keys"]), list(row["people_keys"])
            row["name_key"] = row["name_key"] or ""
            yield row


def _frame(results: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    return pd.DataFrame(results, columns=names, dtype=object)


def fold_batches(steps: DataFrame) -> DataFrame:
    """Outcomes of a table of steps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for _, rows in groupby(_rows(frames), lambda r: r["batch"]):
            for result in Batch().apply(rows):
                out.append(result)
                if len(out) == 1000:
                    yield _frame(out)
                    out = []
        if out:
            yield _frame(out)

    dealt = keyed(steps).where("batch is not null").repartition("batch").sortWithinPartitions("batch", "step", "card_id")
    return dealt.mapInPandas(run, OUTCOME)


class _Processor(StatefulProcessor):
    """Batch, kept as a value (the next negative id) and a map (kind and card to JSON)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next_id = handle.getValueState("next_id", "id long")
        self.parts = handle.getMapState("parts", "kind string, card long", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        kept: dict[str, dict] = {"people": {}, "items": {}, "waits": {}}
        for (kind, card), (value,) in sorted(self.parts.iterator()) if self.parts.exists() else ():
            kept[kind][card] = json.loads(value)
        in_order = lambda d: dict(sorted(d.items(), key=lambda x: x[1]["at"]))
        state = Batch(self.next_id.get()[0] if self.next_id.exists() else -1, *(in_order(kept[k]) for k in ("people", "items", "waits")))
        frame = pd.concat(list(rows)).sort_values(["step", "card_id"], kind="stable")
        out = list(state.apply(_rows(iter([frame]))))
        for kind in ("people", "items", "waits"):
            for at, (card, value) in enumerate(getattr(state, kind).items()):
                if (kind, card) in state.touched:
                    self.parts.updateValue((kind, card), (json.dumps({**value, "at": at}, ensure_ascii=False),))
        self.next_id.update((state.next_id,))
        yield _frame(out)

    def close(self) -> None:
        pass


def batch_session_stream(steps: DataFrame) -> DataFrame:
    """Outcomes of a stream of steps. The session needs the RocksDB state store provider."""
    return keyed(steps).where("batch is not null").groupBy("batch").transformWithStateInPandas(_Processor(), OUTCOME, "Append", "None")
