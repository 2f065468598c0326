"""Review of a batch: the order of cards, the current one, where to go next, duplicates, and small
projections that its screens show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.chinese_time import ABSOLUTE_LINE
from skeinflow.functions.text import trimmed

BATCH = 20  #: assets of one batch


def review_sequence(cards: DataFrame, batch: str, group: str, card: str) -> DataFrame:
    """cards with ``place`` (from 0) in their batch: by group, then card. Cards of one batch are few; a batch
    is what one person reviews."""
    rows = F.array_sort(F.collect_list(F.struct(group, card)))
    return cards.groupBy(batch).agg(rows.alias("_r")).select(batch, F.posexplode("_r").alias("place", "_c")).select(batch, "place", f"_c.{group}", f"_c.{card}")


def current_pending(cards: DataFrame, batch: str, group: str, card: str, status: str) -> DataFrame:
    """(batch, card): the first pending card in review order; batches without one have none."""
    return cards.where(F.col(status) == "pending").groupBy(batch).agg(F.min(F.struct(group, card))[card].alias(card))


def auto_follow(cards: DataFrame, current: DataFrame, batch: str, group: str, card: str, screenshot: str, status: str) -> DataFrame:
    """batch, screenshot to go to: null while the current one (batch, screenshot) has a pending card or none
    is pending in the batch, else that of the first pending card."""
    pending = cards.where(F.col(status) == "pending")
    now = current.select(batch, F.col(screenshot).alias("_now"))
    rows = now.join(pending.select(batch, group, card, screenshot), batch, "left")
    here = F.coalesce(F.bool_or(F.col(screenshot) == F.col("_now")), F.lit(False))
    first = F.min(F.when(F.col(card).isNotNull(), F.struct(group, card, screenshot)))[screenshot]
    return rows.groupBy(batch).agg(F.when(~here, first).alias(screenshot))


def unopened_duplicates(items: DataFrame, batch: str, screenshot: str, original: str, pending: str) -> DataFrame:
    """Items without a screenshot of their own that repeat one with pending cards which no item of the batch
    shows."""
    shown = items.where(F.col(screenshot).isNotNull()).select(batch, F.col(screenshot).alias(original)).distinct()
    return items.where(F.col(screenshot).isNull() & F.col(original).isNotNull() & (F.col(pending) > 0)).join(shown, [batch, original], "left_anti")


def item_for(items: DataFrame, wanted: DataFrame, batch: str, screenshot: str, original: str, order: str) -> DataFrame:
    """(batch, screenshot, item): the first item that shows a wanted screenshot, else the first one without a
    screenshot that repeats it."""
    own = items.where(F.col(screenshot).isNotNull()).select(batch, F.col(screenshot).alias("_s"), F.lit(0).alias("_tier"), order)
    other = items.where(F.col(screenshot).isNull() & F.col(original).isNotNull()).select(batch, F.col(original).alias("_s"), F.lit(1).alias("_tier"), order)
    found = own.unionByName(other).groupBy(batch, F.col("_s").alias(screenshot)).agg(F.min(F.struct("_tier", order))[order].alias("item"))
    return wanted.join(found, [batch, screenshot], "left").select(batch, screenshot, "item")


def capped(assets: DataFrame, batch: str, order: str, most: int = BATCH) -> DataFrame:
    """The first assets of each batch: one upload takes no more. Groups are limited before the shuffle."""
    from skeinflow.operators.dedup import top_k

    return top_k(assets, [batch], [F.col(order)], most, "_rank").drop("_rank")


def timestamp_hints(lines: DataFrame, key: str) -> DataFrame:
    """key, hints: trimmed absolute time lines (relative ones say nothing by themselves) that have a place, from
    top to bottom, left to right."""
    placed = lines.where("placed").where(trimmed(F.col("text")).rlike(ABSOLUTE_LINE))
    return placed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", trimmed(F.col("text")).alias("text")))), lambda x: x["text"]).alias("hints"))


def without_computed(contacts: DataFrame, computed: tuple[str, ...] = ("observation_count", "last_interaction_at")) -> DataFrame:
    """Contacts as they are matched: without what reads add to them."""
    return contacts.drop(*computed)


def references(based_on: Column) -> Column:
    """Ids of a JSON list that may hold numbers or numeric texts; null if one of them is no whole number of
    2^53 - 1 at most."""
    raw = F.from_json(based_on, "array<string>")
    ids = F.transform(raw, lambda x: F.when(trimmed(x).rlike(r"^-?\d{1,16}(\.0*)?$"), F.regexp_replace(trimmed(x), r"\..*$", "").try_cast("long")))
    safe = F.forall(ids, lambda i: i.isNotNull() & (F.abs(i) < 2**53))
    return F.when(raw.isNull(), F.array().cast("array<bigint>")).when(F.coalesce(safe, F.lit(False)), ids)


def participants_text(participants: Column) -> Column:
    """Names as they are shown, an id behind a name that has one; null for nobody."""
    shown = F.transform(participants, lambda p: F.concat(trimmed(p["name"]), F.when(p["contact_id"].isNull(), "").otherwise(F.concat(F.lit("（联系人 "), p["contact_id"].cast("string"), F.lit("）")))))
    return F.nullif(F.array_join(shown, "、"), F.lit(""))


def participants_json(participants: Column) -> Column:
    """Ids and trimmed names as one canonical text, for comparison."""
    each = F.transform(participants, lambda p: F.concat(F.lit("["), F.coalesce(p["contact_id"].cast("string"), F.lit("null")), F.lit(","), json_text(trimmed(p["name"])), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def meeting_changes(old: Column, new: Column) -> Column:
    """JSON of what a card changes of a known meeting (structs of title, time_iso, time_text, location,
    participants, agenda): by field the old and new value as they are shown, null if blank; participants differ if
    their ids or names do. '{}' if nothing changes."""
    shown = lambda m, f: participants_text(m[f]) if f == "participants" else F.nullif(trimmed(m[f]), F.lit(""))
    entries = []
    for f in ("title", "time_iso", "time_text", "location", "participants", "agenda"):
        a, b = (participants_json(old[f]), participants_json(new[f])) if f == "participants" else (shown(old, f), shown(new, f))
        value = F.to_json(F.struct(shown(old, f).alias("old"), shown(new, f).alias("new")), {"ignoreNullFields": "false"})
        entries.append(F.when(~a.eqNullSafe(b), F.concat(F.lit(f'"{f}":'), value)))
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*entries), lambda e: e.isNotNull()), ","), F.lit("}"))


def json_text(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def kilobytes(c: Column) -> Column:
    return F.round(c / 1024).cast("long")
